"""The search by matrix products gives the rows, scores and ranks of the search by expressions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import catalog
from corpusloom.sources.readers import table
from tests.test_vector_index import SCHEMA, SF, asked


def same(queries, corpus, k):
    want = retrieval.search(queries, corpus, k)
    assert sorted(map(tuple, retrieval.nearest(queries, corpus, k).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [1, 5, 600])
def test_given_vectors(spark, k):
    e = table(spark, SF, "embeddings")
    same(asked(e), e, k)


def test_ties_and_equal_vectors(spark, monkeypatch):
    """Many equal rows, multiples of them, near ties, zero rows, more queries than a block: ties go by id."""
    draw = random.Random(3)
    rows = [(k, draw.choice([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [1.0, 0.0005, 0.0], [0.0, 0.0, 0.0], [0.0, 1.0, draw.random()]])) for k in draw.sample(range(5000), 700)]
    e = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 6)
    same(asked(e), e, 4)


def test_odd_rows_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [1.0]), (4, [1.0, None]), (5, [-1.0, 0.5])]
    e = spark.createDataFrame(rows, SCHEMA)
    assert [(r.query_id, r.vec_id) for r in retrieval.nearest(asked(e, 1), e, 3).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 5), (5, 5), (5, 1)]
    assert retrieval.nearest(asked(e, 1), e.limit(0), 3).count() == retrieval.nearest(asked(e.limit(0)), e, 3).count() == 0


def test_recall_makes_no_rows_of_all_pairs(spark):
    """Pairs of all queries with all rows are made in no join; the one cross join is of queries and lists."""
    plan = catalog.QUERIES["knn_index_recall"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") <= 1 and plan.count("MapInArrow") == 3
