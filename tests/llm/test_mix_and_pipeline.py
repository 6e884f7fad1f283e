import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import curriculum_mix, queries
from tests.llm.helpers import SF, documents, empty, odd
from tests.oracle import connect, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """size, target and taken of each row, with targets by repeated resharing and takes document by document."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    total = defaultdict(int)
    for (_, _, s), n in zip(docs, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    taken = [0] * len(docs)
    for s in order:
        mine = sorted((k for k in range(len(docs)) if docs[k][2] == s), key=lambda k: (hashlib.md5(str((docs[k][1] or "") if docs[k][0] is None else docs[k][0]).encode()).hexdigest(), docs[k][0] is not None, docs[k][0] or 0, size[k]))
        rest = int(target[s] + 1e-9)
        for _ in range(2):
            for k in mine:
                n = min(size[k], rest)
                taken[k] += n
                rest -= n
    return [(d[0], size[k], total[d[2]], round(target[d[2]], 6), taken[k]) for k, d in enumerate(docs)]


@pytest.mark.parametrize("make", [odd, documents])
@pytest.mark.parametrize("digits", [1, 4])
def test_mix(spark, make, digits, monkeypatch):
    monkeypatch.setattr(curriculum_mix, "SLOT_DIGITS", digits)
    docs = make(spark).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in curriculum_mix.mix_table(docs).collect()]
    assert sorted(got, key=str) == sorted(brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]), key=str)


def test_mix_of_nothing(spark):
    assert curriculum_mix.mix_table(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in curriculum_mix.mix_table(blank).collect()] == [0, 0]


def test_curriculum(spark):
    docs = documents(spark)
    out = curriculum_mix.curriculum(docs.withColumn("mix_pass", F.lit("old")))
    assert out.columns == [*docs.columns, "mix_pass", "mix_position"]
    got = out.collect()
    assert [r["mix_position"] for r in got] == sorted(r["mix_position"] for r in got)
    assert all(0 <= r["mix_position"] <= 1 for r in got)
    assert sum(len(WORD.findall(r["text"])) for r in got) == curriculum_mix.mix_table(docs).agg(F.sum("taken")).first()[0]
    heavy = [r["mix_position"] for r in got if r["source"] == "src0"]
    light = [r["mix_position"] for r in got if r["source"] == "src10"]
    assert sum(heavy) / len(heavy) < sum(light) / len(light)  # heavy sources lead, light ones are annealed in


def test_schedule_inversion(spark):
    knots = ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0))
    area = lambda t: (0.5 * t + t * t * 0.5 / 1.2) if t <= 0.6 else 0.45 + (t - 0.6) * 1.0 + (t - 0.6) ** 2 * 1.0 / 0.8
    for t in (0.0, 0.1, 0.6, 0.75, 1.0):
        share = area(t) / area(1.0)
        assert spark.range(1).select(curriculum_mix._time_of(F.lit(share), knots)).first()[0] == pytest.approx(t, abs=1e-9)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_all_rows(spark, name):
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1 if name == "op4_chat_prefix" else documents(spark).count()
    assert queries.QUERIES[name](spark, SF).count() == n


def test_pipeline(spark):
    """Every stage's decisions, against the operators on the stage's own input and brute force."""
    docs = documents(spark)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if "near" in name:
            from tests.llm.test_neardup_hamming import brute as groups

            want = sorted({c for _, _, c in groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])})
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == want
        if "mixing" in name:
            want = sum(t for *_, t in brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]))
            assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == want
        docs = out
    assert len(seen) == 5
    assert sorted(map(tuple, docs.select("doc_id", "n_pieces").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces").collect()))


def test_pipeline_of_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {"doc_id", "ids"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)
    corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_tables_go_with_their_scope(spark, tmp_path):
    """Intermediate tables are deleted when what they were for is written; rows without an id come through all stages."""
    from pathlib import Path

    from corpusloom.llm import _store

    here = lambda: {p.name for p in Path(_store.shared_dir(spark).removeprefix("file://")).glob("*") if p.is_dir()}
    docs = documents(spark)
    docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 != 3, F.col("doc_id"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    before = here()
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert not [n for n in here() - before if n.startswith(("stage0", "stage1", "stage2", "features", "edges", "slots"))]
    assert ran.filter("doc_id is null").count() > 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
