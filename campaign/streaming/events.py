"""Structured Streaming operators, each with the batch operator that gives the same result on the whole input.

Events are ordered by time: those older than what a key's state holds are ignored. With a watermark Spark drops those that are older than it, so what a
key's state is needed for ends there, and a timer clears it then; without one nothing is dropped and states stay. Watermarks and delays are parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.tail import follow

#: Bits of the raw events.
CREATED, MODIFIED, CLOSED, DELETED = 1, 2, 4, 8
_LISTING = "path string, mtime long"


def inbox_created(spark: SparkSession, folder: str, pattern: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, mtime): one row for each new file, of the given name pattern."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.col("modificationTime").alias("mtime"))


def follow_log(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """A stream of (path, at, line): the lines that are added to log files, each once, also to files that were read before."""
    return follow(spark, folder, pattern)


def coalesce_events_batch(raw: DataFrame) -> DataFrame:
    """(path, ts, event) from raw (path, seq, ts, bit): at a close `created` if a create was seen since the last
    close or delete, else `modified` if a modify was; `deleted` at once."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ts", "seq")
    ends = F.col("bit").isin(CLOSED, DELETED)
    part = raw.withColumn("part_", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = F.bit_or("bit").over(Window.partitionBy("path", "part_"))
    event = F.when(F.col("bit") == DELETED, "deleted").when(seen.bitwiseAND(F.lit(CREATED)) > 0, "created").when(seen.bitwiseAND(F.lit(MODIFIED)) > 0, "modified")
    return part.withColumn("event", event).where(ends & F.col("event").isNotNull()).select("path", "ts", "event")


def _ms(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class _Timed(StatefulProcessor):
    """A state with one timer a key."""

    def set_timer(self, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class _Coalescer(_Timed):
    def __init__(self, timed: bool, idle_ms: int | None):
        self.timed, self.idle_ms = timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "bits int, ts timestamp, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, last, last_seq = self.seen.get() if self.seen.exists() else (0, None, None)
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], ignore_index=True)
        if last is not None:  # late ones change nothing
            frame = frame[(frame["ts"] > pd.Timestamp(last)) | (frame["ts"] == pd.Timestamp(last)) & (frame["seq"] > last_seq)].reset_index(drop=True)
        if not len(frame):
            return
        bit = frame["bit"].to_numpy(np.int64)
        ends = np.isin(bit, (CLOSED, DELETED))
        # all bits since the last close or delete, by part; the first part goes on from the state
        starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        seen = np.bitwise_or.reduceat(bit, starts)
        seen[0] |= before
        seen = seen[np.searchsorted(starts, np.arange(len(bit)), "right") - 1]
        event = np.select([bit == DELETED, seen & CREATED > 0, seen & MODIFIED > 0], ["deleted", "created", "modified"], "")
        told = ends & (event != "")
        bits = 0 if ends[-1] else int(seen[-1])
        last = frame["ts"].iloc[-1]
        if bits or self.timed:
            self.seen.update((bits, last.to_pydatetime(), int(frame["seq"].iloc[-1])))
        else:
            self.seen.clear()
        if self.timed:  # a closed path is remembered as long as late events of it may come, an open one until it was idle for as long as asked
            self.set_timer(_ms(last) if not bits else None if self.idle_ms is None else _ms(last) + self.idle_ms)
        yield pd.DataFrame({"path": key[0], "ts": frame["ts"][told], "event": event[told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())


def coalesce_events(raw: DataFrame, watermark: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """The same on a stream. Events older than a path's last one, or than the watermark, change nothing.

    With a watermark the state of a path goes when it passes the last close or delete; one that was never closed stays, or goes once the
    watermark is idle_seconds past its last event, after which a close tells nothing of what was before. Without, it goes at the close or delete.
    """
    made = _Coalescer(watermark is not None, None if idle_seconds is None else idle_seconds * 1000)
    known = raw if watermark is None else raw.withWatermark("ts", watermark)
    return known.groupBy("path").transformWithStateInPandas(made, "path string, ts timestamp, event string", "Append", "None" if watermark is None else "EventTime")


def live_state_counts_batch(events: DataFrame) -> DataFrame:
    """(state, n): tasks by their last state; terminated ones count again as `ok` or `failed` by their return code, if they have one."""
    code = F.col("returncode") if "returncode" in events.columns else F.lit(None).cast("int")
    last = events.select("task_id", "ts", "seq", F.struct(F.col("state").alias("state"), code.alias("code")).alias("s")).groupBy("task_id").agg(F.max_by("s", F.struct("ts", "seq")).alias("s"))
    end = F.when((F.col("s.state") == "TERMINATED") & F.col("s.code").isNotNull(), F.when(F.col("s.code") == 0, "ok").otherwise("failed"))
    names = F.when(end.isNull(), F.array("s.state")).otherwise(F.array(F.col("s.state"), end))
    return last.select(F.explode(names).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def _names(state: str | None, code: int | None) -> list[str]:
    """What a task counts as."""
    if state is None:
        return []
    return [state] if state != "TERMINATED" or code is None else [state, "ok" if code == 0 else "failed"]


class _LastState(_Timed):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, code int, ts timestamp, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Only the newest of the rows counts, and only if it is newer than what is known: changes between cancel out."""
        state, code, ts, seq = self.last.get() if self.last.exists() else (None, None, None, None)
        newest = None
        for frame in rows:
            own = frame.sort_values(["ts", "seq"]).iloc[-1]
            if newest is None or (own["ts"], own["seq"]) > (newest["ts"], newest["seq"]):
                newest = own
        if ts is not None and (newest["ts"], newest["seq"]) <= (pd.Timestamp(ts), seq):
            return
        own = None if pd.isna(newest["returncode"]) else int(newest["returncode"])
        delta = Counter(_names(newest["state"], own))
        delta.subtract(_names(state, code))
        self.last.update((newest["state"], own, newest["ts"].to_pydatetime(), int(newest["seq"])))
        if self.keep_ms is not None:
            self.set_timer(_ms(newest["ts"]) + self.keep_ms if newest["state"] == "TERMINATED" else None)
        yield pd.DataFrame([(k, n) for k, n in delta.items() if n], columns=["state", "delta"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def state_deltas(events: DataFrame, watermark: str | None = None, keep_seconds: int = 0) -> DataFrame:
    """(state, delta) on a stream of (task_id, seq, ts, state, returncode): -1 for what the task no longer counts as, +1 for what it does now.

    Late events, older than the task's last one or than the watermark, change nothing. With a watermark a terminated task is kept until it is keep_seconds
    past the end; then its state goes and it counts as terminated for good: what comes under its id later is another task. Without, all tasks are kept.
    """
    code = F.col("returncode").cast("int") if "returncode" in events.columns else F.lit(None).cast("int")
    known = events.select("task_id", "seq", "ts", "state", code.alias("returncode"))
    made, mode = (_LastState(None), "None") if watermark is None else (_LastState(keep_seconds * 1000), "EventTime")
    known = known if watermark is None else known.withWatermark("ts", watermark)
    return known.groupBy("task_id").transformWithStateInPandas(made, "state string, delta long", "Append", mode)


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, event): changes between two listings (path, mtime)."""
    from ..operators.tables import snapshot_diff

    return snapshot_diff(old, new)


def follow_listings(listings: DataFrame, folder: str) -> None:
    """Compares each listing that arrives on a stream with the one before, until all that is there has been read.

    What arrives in one trigger is one listing. Listing k is kept in folder/listings/k and its changes in
    folder/changes/listing=k, both overwritten if the batch is run again; the first listing is all created.
    """

    def compare(listing: DataFrame, k: int) -> None:
        spark = listing.sparkSession
        listing.select("path", "mtime").write.mode("overwrite").parquet(f"{folder}/listings/{k}")
        new = spark.read.schema(_LISTING).parquet(f"{folder}/listings/{k}")
        old = spark.read.schema(_LISTING).parquet(f"{folder}/listings/{k - 1}") if k else spark.createDataFrame([], _LISTING)
        listing_changes(old, new).write.mode("overwrite").parquet(f"{folder}/changes/listing={k}")

    listings.writeStream.foreachBatch(compare).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def changes_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(path, event, listing): the changes that follow_listings has found."""
    return spark.read.schema("path string, event string, listing int").parquet(f"{folder}/changes")


class _LostTask(_Timed):
    """Keeps since when a task's checks fail. Its timer tells that it is lost at the end of the delay; else it ends the state."""

    def __init__(self, delay_ms: int, forget_ms: int | None):
        self.delay_ms, self.forget_ms = delay_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bad = handle.getValueState("bad", "since timestamp, last timestamp, told boolean")

    def wait(self, since, last, told: bool) -> None:
        if since is None:  # only late checks would need it
            self.set_timer(_ms(last))
        elif not told:
            self.set_timer(_ms(since) + self.delay_ms)
        else:
            self.set_timer(None if self.forget_ms is None else _ms(last) + self.delay_ms + self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, last, told = self.bad.get() if self.bad.exists() else (None, None, False)
        frame = pd.concat(list(rows)).sort_values("ts", ignore_index=True)
        frame = frame[frame["ts"] > pd.Timestamp(last)] if last is not None else frame  # late ones change nothing
        if not len(frame):
            return
        good = np.flatnonzero(frame["good"].to_numpy(bool))
        out = []
        if len(good):
            if told:
                out.append((key[0], pd.Timestamp(since), False))
            since, told = None, False
        after = frame[int(good[-1]) + 1 :] if len(good) else frame
        after = after[after["ts"] > frame["ts"].iloc[good[-1]]] if len(good) else after
        if since is None and len(after):
            since = after["ts"].iloc[0]
        last = frame["ts"].iloc[-1]
        self.bad.update((pd.Timestamp(since).to_pydatetime() if since is not None else None, last.to_pydatetime(), told))
        self.wait(since, last, told)
        yield pd.DataFrame(out, columns=["task_id", "since", "lost"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, last, told = self.bad.get() if self.bad.exists() else (None, None, False)
        if since is None or told:
            self.bad.clear()
            return
        self.bad.update((since, last, True))
        self.wait(since, last, True)
        yield pd.DataFrame([(key[0], pd.Timestamp(since), True)], columns=["task_id", "since", "lost"])


def lost_tasks_stream(checks: DataFrame, delay_seconds: int, watermark: str = "0 seconds", forget_seconds: int | None = None) -> DataFrame:
    """(task_id, since, lost) on a stream of checks (task_id, ts, state or null): a task is lost when its checks have
    failed for the delay, by the watermark and whether or not it is checked again; a later good check takes that back (lost is false).

    The state of a task whose last check was good goes with the watermark; that of a lost one when nothing was heard of it for
    forget_seconds after the delay, if given, after which nothing is taken back.
    """
    known = checks.withWatermark("ts", watermark).select("task_id", "ts", F.col("state").isNotNull().alias("good"))
    kind = checks.schema["task_id"].dataType.simpleString()
    made = _LostTask(delay_seconds * 1000, None if forget_seconds is None else forget_seconds * 1000)
    return known.groupBy("task_id").transformWithStateInPandas(made, f"task_id {kind}, since timestamp, lost boolean", "Append", "EventTime")
