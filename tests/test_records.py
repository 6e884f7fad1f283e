"""Decoded, settled and observed records."""

import json
import time

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.operators import records
from corpusloom.sources import sinks

SCHEMA = StructType([StructField("a", StringType()), StructField("n", LongType())])


def test_nothing_of_a_record_is_lost(spark):
    rows = [(1, '{"a": "x", "n": 2}'), (2, '{"a": "x", "n": "two", "more": {"b": [1]}, "none": null}'), (3, "[1"), (4, None), (5, "{}"), (6, '"text"'), (7, "")]
    got = {r["id"]: r for r in records.decoded(spark.createDataFrame(rows, "id long, j string").withColumn("rescued", F.lit("old")), "j", SCHEMA).collect()}
    assert tuple(got[1]["record"]) == ("x", 2) and got[1]["rescued"] == {}
    assert tuple(got[2]["record"]) == ("x", None) and {k: v.replace(" ", "") for k, v in got[2]["rescued"].items()} == {"n": "two", "more": '{"b":[1]}'}
    assert [got[k]["malformed"] for k in range(1, 8)] == [False, False, True, False, False, True, True]
    assert got[3]["record"] is None and got[3]["rescued"] is None and got[5]["rescued"] == {}


def response(code, **fields):
    return json.dumps({"code": code, "data": {"data": fields}})


def test_contents_and_refusals(spark):
    items = spark.createDataFrame([(k, f"list {k}") for k in range(1, 8)] + [(None, "no key")], "id long, holding string")
    answers = [(1, response(0, gist="one", court="C")), (2, response("0", gist="two")), (3, response(500, gist="three")), (4, response(0, other="x")), (5, '{"code": 0, "data": null}'), (6, "broken"), (1, response(0, gist="zzz")), (None, response(0, gist="nobody's"))]
    out = records.with_content(items, spark.createDataFrame(answers, "id long, response string"), "id", {"holding": "gist", "court": "court"}).collect()
    got = {r["id"]: (r["holding"], r["court"], r["content_full"]) for r in out}
    assert len(out) == 8 and got[1] == ("one", "C", True) and got[2] == ("two", None, True)
    assert all(got[k] == (f"list {k}", None, False) for k in range(3, 8)) and got[None] == ("no key", None, False)


def test_full_rows_stay(spark):
    kind = "id long, v string, content_full boolean"
    old = spark.createDataFrame([(1, "full", True), (2, "part", False), (3, "old", True), (4, "only", None)], kind)
    new = spark.createDataFrame([(1, "part", False), (2, "full", True), (3, "new", True), (5, "b", False), (5, "a", False), (None, "x", False)], kind)
    got = {r["id"]: r["v"] for r in records.settled(old, new, "id").collect()}
    assert got == {1: "full", 2: "full", 3: "new", 4: "only", 5: "a", None: "x"}
    assert records.settled(old.limit(0), new.limit(0), "id").count() == 0


def test_counts_come_from_the_write(spark, tmp_path):
    seen = sinks.written(spark.range(100), str(tmp_path / "a"), even=F.count_if(F.col("id") % 2 == 0), top=F.max("id"))
    assert seen == {"rows": 100, "even": 50, "top": 99} and spark.read.parquet(str(tmp_path / "a")).count() == 100
    assert sinks.written(spark.range(0), str(tmp_path / "b"))["rows"] == 0


def test_one_failure_doesnt_stop_the_rest(spark, tmp_path):
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    heard = []
    got = sinks.written_each({"a": spark.range(3), "bad": bad, "b": spark.range(4)}, str(tmp_path), lambda n, c: heard.append((n, c)))
    assert got == {"a": 3, "bad": -1, "b": 4} and heard == [("a", 3), ("bad", -1), ("b", 4)]


def test_progress_while_a_stream_runs(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "in"))
    heard = []
    listener = sinks.Progress("told", lambda rows, batches: heard.append((rows, batches)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination(120)
        end = time.time() + 20
        while (not heard or heard[-1][0] < 100) and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [b for _, b in heard] == [1, 2, 3, 4] and heard[-1][0] == 100
