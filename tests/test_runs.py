"""Paused runs: the batch form against plain Python, and the streams against the batch form, also when they are stopped midway."""

import random

import pytest

from corpusloom.streaming import runs

KINDS = runs.Kinds(asks=("ask",), resumes=("resume",), cancels=("cancel",))
SCHEMA = "key long, at long, id long, kind string"
END = 10**15


def brute(rows):
    out = []
    for key in sorted({r[0] for r in rows}):
        seq, waits, held = 0, False, []
        for _, _, i, kind in sorted(r for r in rows if r[0] == key):
            send = []
            if waits and kind in KINDS.resumes:
                send, held, waits = [(i, kind), *held], [], False
            elif waits and kind in KINDS.cancels:
                send = [(i, kind)]
            elif waits and kind not in KINDS.asks:
                held.append((i, kind))
            elif not waits and kind not in ("resume", "cancel"):
                send, waits = [(i, kind)], kind in KINDS.asks
            for x in send:
                seq += 1
                out.append((key, seq, *x))
            if send and kind == "cancel":
                break
    return out


def log(n=400, seed=1):
    draw = random.Random(seed)
    return [(k if (k := draw.randrange(9)) < 6 else 0, 10**9 * draw.randrange(1, n), i, draw.choice(["step"] * 6 + ["ask", "resume", "cancel"][: 3 if i % 5 == 0 else 2])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch(spark, seed):
    rows = log(seed=seed)
    got = runs.replayed(spark.createDataFrame(rows, SCHEMA).repartition(3), KINDS)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, 1, "step"), (1, None, 2, "step"), (1, 5, 3, None), (1, 5, 3, None), (1, 6, 4, "ask")]
    got = runs.replayed(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as seq", "2 as due"), KINDS)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3, ""), (1, 2, 3, ""), (1, 3, 4, "ask")]
    assert runs.replayed(spark.createDataFrame([], SCHEMA), KINDS).count() == 0


def streams(spark, tmp_path, rows):
    """Events and answers in files of their own, out of order, one file a micro-batch; a last row of no run lets the watermark pass all others."""
    draw = random.Random(7)
    answers = [r for r in rows if r[3] in ("resume", "cancel")]
    for name, part in (("events", [r for r in rows if r not in answers]), ("answers", answers)):
        part = sorted(part, key=lambda r: r[1] + draw.randrange(40 * 10**9))
        step = -(-len(part) // 4)
        for k in range(4):
            spark.createDataFrame(part[k * step : (k + 1) * step] or [(99, 1, 0, "step")][:0], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([(99, END, 0, "step")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/{name}")
    return runs.streamed(read("events"), read("answers"), KINDS, "30 days")


def test_stream_stopped_and_started_again(spark, tmp_path):
    """Stopped after two micro-batches and started on its checkpoint, the stream gives what the batch gives; a third start adds nothing."""
    rows = log(200)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        with runs.durable(spark):
            stream = streams(spark, tmp_path, rows)
            runs.settle(stream, f"{tmp_path}/out", f"{tmp_path}/check", max_batches=2)
            for _ in range(2):
                runs.settle(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").filter("key != 99").select("key", "seq", "id", "kind").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)
