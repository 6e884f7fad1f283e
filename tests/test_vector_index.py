"""The vector index against the exact search: recall, repeated ids, zero vectors, hot lists, blocks of queries."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, vector_index
from corpusloom.sources.readers import table

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def share(found, true):
    n, hits = vector_index.recall(found, true).agg(F.sum("n"), F.sum("hits")).first()
    return hits / n


def asked(e, by=50):
    return e.filter(f"vec_id % {by} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_recall_on_all_queries(spark):
    """Vectors without structure: recall at 5 of at least 0.9, and every score is the exact one."""
    e = table(spark, SF, "embeddings")
    index = vector_index.build(e)
    assert index.codes.count() == e.count() and index.lists.count() <= 22
    found, true = vector_index.search(index, asked(e), e), retrieval.search(asked(e), e)
    assert share(found, true) >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in retrieval.search(asked(e), e, k=500).collect()}
    rows = found.collect()
    assert all(scores[r.query_id, r.vec_id] == r.score for r in rows) and len(rows) == 5 * len({r.query_id for r in rows})


def clustered(n=3000, groups=20, dim=16):
    draw = random.Random(5)
    centers = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    # the first group holds a third of all rows
    return [(k, [x + draw.gauss(0, 0.2) for x in centers[0 if k % 3 == 0 else k % groups]]) for k in range(n)]


def test_clustered_vectors_need_few_lists(spark):
    """With structure, tuning finds that few lists are enough: fewer than a fifth of all codes are read."""
    e = spark.createDataFrame(clustered(), SCHEMA)
    index = vector_index.build(e)
    assert index.probes <= index.lists.count() / 5
    assert share(vector_index.search(index, asked(e), e), retrieval.search(asked(e), e)) >= 0.9


def test_all_lists_are_exact(spark):
    """Looking into all lists and scoring all codes is the exact search."""
    e = spark.createDataFrame(clustered(400), SCHEMA)
    index = vector_index.build(e, n_lists=7, probes=7)
    got = vector_index.search(index, asked(e, 20), e, fetch=400).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.search(asked(e, 20), e).collect()))


def test_blocks_of_queries(spark, monkeypatch):
    e = spark.createDataFrame(clustered(300), SCHEMA)
    index = vector_index.build(e, n_lists=5, probes=2)
    whole = sorted(map(tuple, vector_index.search(index, asked(e, 5), e).collect()))
    monkeypatch.setattr(vector_index, "MOST_PROBES", 20)
    assert sorted(map(tuple, vector_index.search(index, asked(e, 5), e).collect())) == whole


@pytest.mark.parametrize("n_lists", [None, 3])
def test_odd_rows(spark, n_lists):
    """Nulls aren't indexed; zero vectors score 0; extra columns of the same names as the index's don't matter."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [2.0, 0.1]), (5, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as list", "'x' as code", "2.0 as score")
    found = vector_index.search(vector_index.build(e, n_lists, probes=3), asked(e, 1), e, k=2)
    assert [(r.vec_id, r.score) for r in found.filter("query_id = 1").orderBy("rank").collect()] == [(1, 1.0), (4, 0.998752)]
    assert [r.score for r in found.filter("query_id = 2").collect()] == [0.0, 0.0]
    nothing = spark.createDataFrame([], SCHEMA)
    assert vector_index.search(vector_index.build(nothing), asked(e, 1), nothing).count() == 0


def test_no_code_is_shuffled_before_its_best(spark):
    """Codes meet queries by broadcast on the list's number, with no product of all pairs."""
    e = spark.createDataFrame(clustered(100), SCHEMA)
    index = vector_index.build(e, 4, 2)
    plan = vector_index.search(index, asked(e), e)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (list" in plan and plan.count("Join Cross") <= 1
