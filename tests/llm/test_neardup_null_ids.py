"""Rows without an id link others as any row does."""

from tests.llm.test_neardup_hamming import check


def test_links_through_rows_without_id(spark):
    words = [f"w{k}" for k in range(100)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # texts 1 and 2 are linked only through the one without an id, which is there twice; the last two are a group without ids
    lone = [f"v{k}" for k in range(60)]
    rows = [(1, changed(20, 60)), (None, changed()), (None, changed()), (2, changed(0, 40, 80)), (None, " ".join(lone)), (None, " ".join([*lone, "y"]))]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
