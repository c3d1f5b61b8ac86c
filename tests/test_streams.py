"""Streams over several triggers."""

import datetime
from pathlib import Path

import pytest

from campaign.sources import tail
from campaign.streaming import events as st


class Log:
    """A followed folder, looked at as often as asked, with one checkpoint."""

    def __init__(self, spark, place: Path, **options):
        self.spark, self.place, self.options, self.looks = spark, place, options, 0
        (place / "logs").mkdir(parents=True)

    def file(self, name: str) -> Path:
        return self.place / "logs" / name

    def look(self) -> list[str]:
        self.looks += 1
        out = str(self.place / f"rows{self.looks}")
        stream = tail.follow(self.spark, (self.place / "logs").as_uri(), "*.log", **self.options)

        def keep(rows, k):
            rows.write.mode("append").parquet(out)

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(self.place / "state")).trigger(availableNow=True).start().awaitTermination()
        if not Path(out).exists():
            return []
        return [r["line"] for r in self.spark.read.parquet(out).orderBy("path", "at").collect()]


def test_lines_are_followed_once_over_triggers_and_restarts(spark, tmp_path):
    log = Log(spark, tmp_path / "a")
    log.file("x.log").write_text("one\ntwo\nthr")
    log.file("y.log").write_text("")
    log.file("other.txt").write_text("not this\n")
    assert log.look() == ["one", "two"]
    with log.file("x.log").open("a") as f:
        f.write("ee\nfour\n\nfünf\r\n")
    log.file("y.log").write_text("y1\n")
    assert log.look() == ["three", "four", "", "fünf", "y1"]
    assert log.look() == []
    log.file("x.log").write_text("new\n")  # truncated
    log.file("z.log").write_text("z1\nz2\n")
    assert log.look() == ["new", "z1", "z2"]
    log.file("z.log").write_text("other start\nlonger than before\n")  # replaced by a longer one
    log.file("y.log").unlink()
    assert log.look() == ["other start", "longer than before"]


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_long_files_are_read_in_pieces(spark, tmp_path, piece):
    lines = ["", "a", "é" * 30, "b\tc", "x" * 200] * 6
    log = Log(spark, tmp_path / f"p{piece}", piece_bytes=piece)
    text = "".join(f"{x}\n" for x in lines).encode()
    reader = tail._Reader((tmp_path / f"p{piece}/logs").as_uri(), "*.log", piece)
    log.file("x.log").write_bytes(text[:400])
    first = reader.latestOffset()
    log.file("x.log").write_bytes(text + b"unfinished")
    second = reader.latestOffset()
    got = [r for a, b in ((reader.initialOffset(), first), (first, second)) for part in reader.partitions(a, b) for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["line"] for r in got] == lines
    assert [r["at"] for r in got] == [sum(len(x.encode()) + 1 for x in lines[:k]) for k in range(len(lines))]
    assert reader.partitions(second, second) == []


def test_the_last_line_end_is_found_in_files_of_many_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 10)
    import pyarrow.fs as pafs

    for text, end in ((b"", 0), (b"no end at all, not even here", 0), (b"a\n" + b"x" * 55, 2), (b"ab" * 20 + b"\n", 41), (b"\n", 1)):
        (tmp_path / "f").write_bytes(text)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
            assert tail._ends(f, len(text)) == [end, text[: min(end, tail.HEAD_BYTES)].hex()]


T0 = datetime.datetime(2024, 1, 1)


class Stream:
    """A stateful stream over files that arrive one after the other; each look reads what is new, from the checkpoint of the one before."""

    def __init__(self, spark, place: Path, schema: str, operator):
        self.spark, self.place, self.schema, self.operator, self.looks = spark, place, schema, operator, 0
        (place / "in").mkdir(parents=True)

    def look(self, rows: list[tuple]) -> tuple[list[tuple], int]:
        """(what is told, rows of state): `rows` have seconds after T0 in the place of ts."""
        self.looks += 1
        at = [c.split()[0] for c in self.schema.split(", ")].index("ts")
        timed = [(*r[:at], T0 + datetime.timedelta(seconds=r[at]), *r[at + 1 :]) for r in rows]
        self.spark.createDataFrame(timed, self.schema).coalesce(1).write.mode("append").parquet(str(self.place / "in"))
        out, told = str(self.place / f"out{self.looks}"), []
        stream = self.operator(self.spark.readStream.schema(self.schema).parquet(str(self.place / "in")))
        key = "spark.sql.streaming.stateStore.providerClass"
        self.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            query = stream.writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(out)).option("checkpointLocation", str(self.place / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.unset(key)
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        for r in self.spark.read.schema(stream.schema).parquet(out).collect():
            told.append(tuple(int((v - T0).total_seconds()) if isinstance(v, datetime.datetime) else v for v in r))
        return sorted(told), state


def test_coalesced_events_ignore_late_ones_and_their_state_ends(spark, tmp_path):
    c, m, end, gone = st.CREATED, st.MODIFIED, st.CLOSED, st.DELETED
    s = Stream(spark, tmp_path / "c", "path string, seq long, ts timestamp, bit int", lambda df: st.coalesce_events(df, "10 seconds", idle_seconds=50))
    assert s.look([("a", 1, 0, c), ("b", 2, 5, m), ("a", 3, 8, m)])[0] == []
    assert s.look([("a", 4, 12, end), ("b", 5, 13, end), ("a", 6, 14, m), ("a", 7, 15, end)])[0] == [("a", 12, "created"), ("a", 15, "modified"), ("b", 13, "modified")]
    # older than what the paths know, though not than the watermark: nothing; in order again after it
    assert s.look([("a", 3, 14, c), ("a", 8, 13, end), ("b", 9, 16, gone)])[0] == [("b", 16, "deleted")]
    told, state = s.look([("open", 10, 100, c)])
    assert told == [] and state > 0
    # older than the watermark: dropped, also where the path's state is gone
    assert s.look([("a", 11, 20, c), ("a", 12, 21, end)])[0] == []
    # the open path was idle too long; a close tells nothing of its creation
    assert s.look([("x", 13, 400, gone)])[0] == [("x", 400, "deleted")]
    assert s.look([("open", 14, 420, end)])[0] == []
    told, state = s.look([("y", 15, 1000, gone)])
    told, state = s.look([("y", 16, 2000, gone)])
    assert state <= 2  # the last path and its timer


def test_terminated_tasks_leave_the_state_and_late_events_change_no_count(spark, tmp_path):
    s = Stream(spark, tmp_path / "d", "task_id long, seq long, ts timestamp, state string, returncode int", lambda df: st.state_deltas(df, "10 seconds", keep_seconds=20))
    counts = {}

    def look(*rows):
        told, state = s.look(list(rows))
        for name, delta in told:
            counts[name] = counts.get(name, 0) + delta
        return {k: v for k, v in counts.items() if v}, state

    assert look((1, 1, 0, "NEW", None), (2, 2, 1, "RUNNING", None))[0] == {"NEW": 1, "RUNNING": 1}
    assert look((1, 3, 5, "RUNNING", None), (1, 4, 4, "SUBMITTED", None))[0] == {"RUNNING": 2}
    assert look((1, 5, 3, "NEW", None))[0] == {"RUNNING": 2}  # late, within the watermark
    assert look((1, 6, 8, "TERMINATED", 0), (2, 7, 9, "TERMINATED", 7))[0] == {"TERMINATED": 2, "ok": 1, "failed": 1}
    assert look((2, 8, 10, "TERMINATED", 0))[0] == {"TERMINATED": 2, "ok": 2}  # another return code while it is kept
    assert look((3, 9, 100, "RUNNING", None))[0] == {"TERMINATED": 2, "ok": 2, "RUNNING": 1}
    assert look((1, 10, 50, "RUNNING", None))[0] == {"TERMINATED": 2, "ok": 2, "RUNNING": 1}  # older than the watermark
    now, state = look((3, 11, 120, "TERMINATED", 1))
    assert now == {"TERMINATED": 3, "ok": 2, "failed": 1}
    now, state = look((4, 12, 1000, "TERMINATED", 0))
    now, state = look((5, 13, 3000, "TERMINATED", 0))
    assert now == {"TERMINATED": 5, "ok": 4, "failed": 1} and state <= 2


def test_checked_tasks_leave_the_state(spark, tmp_path):
    s = Stream(spark, tmp_path / "e", "task_id long, ts timestamp, state string", lambda df: st.lost_tasks_stream(df, 30, "10 seconds", forget_seconds=100))
    assert s.look([(1, 0, "RUNNING"), (2, 0, None), (3, 0, None), (3, 5, "RUNNING")])[0] == []
    assert s.look([(1, 60, "RUNNING")])[0] == [(2, 0, True)]
    assert s.look([(2, 20, "RUNNING"), (1, 70, "RUNNING")])[0] == []  # a late good check takes nothing back
    assert s.look([(2, 80, "RUNNING")])[0] == [(2, 0, False)]
    assert s.look([(4, 90, None), (1, 150, "RUNNING")])[0] == [(4, 90, True)]
    told, state = s.look([(1, 500, "RUNNING")])
    assert told == []
    assert s.look([(4, 520, "RUNNING")])[0] == []  # forgotten
    told, state = s.look([(5, 2000, "RUNNING")])
    assert told == [] and state <= 2
