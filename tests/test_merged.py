"""Merged documents, external programs and columns of logs."""

import csv
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from campaign.operators import commands, tables
from campaign.sources import merged


def parts(path: Path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("n", [None, 7])
def test_xml_parts_are_one_document(spark, tmp_path, n):
    rows = spark.range(500).select(F.col("id").alias("task_id"), F.concat(F.lit("<&> é\n"), F.col("id").cast("string")).alias("text"))
    merged.write_parts(rows.repartition(5), str(tmp_path / "x"), ["task_id"], parts=n)
    found = ET.fromstring(parts(tmp_path / "x"))
    assert found.tag == "ROWSET" and [(int(r.find("task_id").text), r.find("text").text.split("\n")[0]) for r in found] == [(k, "<&> é") for k in range(500)]
    merged.join_parts(spark, str(tmp_path / "x"), str(tmp_path / "one.xml"))
    assert (tmp_path / "one.xml").read_text() == parts(tmp_path / "x") and not list(tmp_path.glob("one.xml.*"))
    back = spark.read.format("xml").option("rowTag", "row").schema("task_id long, text string").load(str(tmp_path / "one.xml"))
    assert back.count() == 500
    with pytest.raises(FileExistsError):
        merged.write_parts(rows, str(tmp_path / "x"), ["task_id"])
    with pytest.raises(FileExistsError):
        merged.join_parts(spark, str(tmp_path / "x"), str(tmp_path / "one.xml"))


def test_csv_parts_have_one_header(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 'x,"y"').alias("b"))
    merged.write_parts(rows.repartition(4), str(tmp_path / "c"), ["a"], kind="csv", parts=6)
    got = list(csv.reader(parts(tmp_path / "c").splitlines()))
    assert got[0] == ["a", "b"] and [int(r[0]) for r in got[1:]] == list(range(300))
    merged.join_parts(spark, str(tmp_path / "c"), str(tmp_path / "one.csv"))
    back = spark.read.csv(str(tmp_path / "one.csv"), header=True, schema="a long, b string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_documents_without_rows(spark, tmp_path):
    none = spark.range(0).select(F.col("id").alias("a"))
    merged.write_parts(none, str(tmp_path / "x"), ["a"])
    merged.write_parts(none, str(tmp_path / "c"), ["a"], kind="csv")
    assert list(ET.fromstring(parts(tmp_path / "x"))) == [] and parts(tmp_path / "c") == "a\n"


def sh(program: str) -> list[str]:
    return ["/bin/sh", "-c", program]


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_programs_that_fail_hang_and_flood_keep_their_rows(spark):
    program = 'read x; case "$x" in ok*) cat; echo "$x";; bad) echo no >&2; exit 5;; kill) kill -9 $$;; hang) echo begun; sleep 60 & sleep 60;; big) head -c 300000 /dev/zero | tr "\\0" a;; esac'
    texts = ["ok 1\nmore", "bad", "kill", "hang", "big", None, "ok " + "z" * 200_000]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id int, input string, stdout string").repartition(3)
    got = by_id(commands.run_command(df, sh(program), "input", timeout=3))
    assert len(got) == 7
    assert (got[0]["stdout"], got[0]["exitcode"], got[0]["timed_out"]) == ("moreok 1\n", 0, False)
    assert (got[1]["exitcode"], got[1]["stderr"], got[1]["signal"]) == (5, "no\n", None)
    assert (got[2]["exitcode"], got[2]["signal"]) == (None, 9)
    assert (got[3]["exitcode"], got[3]["timed_out"], got[3]["stdout"]) == (None, True, "begun\n") and 2.9 < got[3]["seconds"] < 10
    assert len(got[4]["stdout"]) == 300_000 and got[4]["exitcode"] == 0
    assert got[5]["exitcode"] == 0 and got[6]["stdout"] == f"ok {'z' * 200_000}\n"
    assert by_id(commands.run_command(df.limit(1), ["/no/such/program"], "input")).popitem()[1]["exitcode"] == 127
    assert commands.run_command(df.limit(0), sh("cat"), "input").collect() == []


def test_a_kept_program_is_started_again_after_each_end(spark):
    program = 'n=0; while read x; do n=$((n + 1)); case "$x" in bad) echo no >&2; exit 4;; hang) sleep 60;; *) echo "$n $x";; esac; done'
    texts = ["a", "b", "bad", "c", "hang", "d", "two\nlines", "e"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, input string").coalesce(1)
    got = by_id(commands.run_command(df, sh(program), "input", timeout=2, keep=True))
    assert [got[k]["stdout"] for k in range(8)] == ["1 a", "2 b", "", "1 c", "", "1 d", "", "2 e"]
    assert [got[k]["exitcode"] for k in range(8)] == [0, 0, 4, 0, None, 0, None, 0]
    assert got[2]["stderr"] == "no\n" and got[4]["timed_out"] and "several lines" in got[6]["stderr"]


def test_log_columns_for_many_keys_and_what_is_missing(spark):
    log = spark.createDataFrame(
        [(1, 2, "b_rate", k, 10.0 + k) for k in range(2)] + [(1, 1, "a_rate", k, 1.0 + k) for k in range(3)] + [(2, 1, "rate_x", 0, 5.0), (3, 1, "a_rate", 0, 7.0)],
        "task_id long, column_no int, name string, row_idx int, value double",
    )
    tasks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, None)], "task_id long, returncode int")
    found, missing = tables.collect_log_columns(log, tasks, ["rate", "a_", "b_", "a_"])
    # the first column counts as a whole, also where another has more rows
    assert sorted(map(tuple, found.collect())) == [("a_", 1, 0, 1.0), ("a_", 1, 1, 2.0), ("a_", 1, 2, 3.0), ("b_", 1, 0, 10.0), ("b_", 1, 1, 11.0), ("rate", 1, 0, 1.0), ("rate", 1, 1, 2.0), ("rate", 1, 2, 3.0), ("rate", 2, 0, 5.0)]
    assert sorted(map(tuple, missing.collect())) == [(2, "a_"), (2, "b_"), (4, "a_"), (4, "b_"), (4, "rate")]
    wide = tables.log_tables(found.where("key = 'rate'"))
    assert wide.columns == ["key", "row_idx", "1", "2"] and sorted(map(tuple, wide.collect())) == [("rate", 0, 1.0, 5.0), ("rate", 1, 2.0, None), ("rate", 2, 3.0, None)]
    assert tables.log_tables(found, most=1).columns == found.columns
    none, all_ = tables.collect_log_columns(log, tasks, [])
    assert none.collect() == [] and all_.collect() == []
