"""Exact dedup against brute force: odd rows, hot groups, and buckets that don't fit at first."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import grace_dedup, queries
from tests.llm.helpers import ODD, SF, documents, empty, odd
from tests.oracle import connect, rows


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute(table):
    """Of (doc_id, text) rows the (doc_id, keep_id, group_size, text_sha256) and the number of rows that stay by group."""
    by = {}
    for doc_id, text in table:
        by.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((d, min(by[norm(t)])[3], len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in table), key=repr), len(by)


def check(got, table):
    want, n = brute(table)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    stay = [r for r in got if r.kept]
    assert len(stay) == n == len({r.text_sha256 for r in stay}) and all(r.doc_id == r.keep_id for r in stay)


def test_query(spark):
    got = queries.op13_grace_dedup(spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(queries.ORACLES["op13_grace_dedup"]).df())


def test_odd_rows(spark):
    check(grace_dedup.groups(odd(spark)).collect(), [(r[0], r[1]) for r in ODD])
    assert grace_dedup.groups(empty(spark)).collect() == [] == grace_dedup.deduplicated(empty(spark)).collect()


@pytest.mark.parametrize("room", [1, 3000])
def test_recursion(spark, monkeypatch, room):
    """A table that holds one content, or a few: rounds go on until all are settled; one text has a third of all rows."""
    monkeypatch.setattr(grace_dedup, "ROOM", room)
    draw = random.Random(3)
    table = [(k, "hot  text" if k % 3 == 0 else " ".join(draw.choice(["a", "bb", "ccc"]) for _ in range(draw.randrange(6)))) for k in range(240)]
    table += [(900, "x" * 5000), (901, "x " * 5000), (902, "x" * 5000)]
    out = grace_dedup.groups(spark.createDataFrame(table, "doc_id long, text string").repartition(5))
    check(out.collect(), table)


def test_rounds_grow(spark):
    """Contents of one first digit don't fit one bucket: they are spilled and partitioned by their next bits."""
    found = grace_dedup.combined(spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string"))
    from corpusloom.llm._store import kept
    from pyspark.sql import functions as F

    both = kept(found, "records").filter("content is not null")
    contents = both.select("local", "sha", "content", F.expr("h & 1152921504606846975").alias("h"), *grace_dedup._BEST, F.octet_length("content").alias("size"))
    whole = grace_dedup.ROOM
    grace_dedup.ROOM = 500
    try:
        done = [t.count() for t in grace_dedup.rounds(contents)]
    finally:
        grace_dedup.ROOM = whole
    assert len(done) > 1 and sum(done) == 300


def test_table_compares_contents():
    """Equal hashes, different contents: both get an entry; the table grows."""
    table = grace_dedup.Table(4)
    entries = [table.add(-1 - table.find(h, c), h, c) for h, c in ((7, b"a"), (7, b"b"), (-1, b""), (3, b"c"), (11, b"d"))]
    assert entries == [0, 1, 2, 3, 4] and table.find(7, b"b") == 1 and table.find(7, b"c") < 0 and len(table.slots) >= 10
    assert table.bytes == 4 and np.count_nonzero(table.slots >= 0) == 5


def test_deduplicated_keeps_columns(spark):
    """Columns with names that the operator uses itself are kept; rows that differ only in another column are equal."""
    table = spark.createDataFrame([(2, "a b", 1, "p"), (1, "ab", 2, "q"), (3, "a\tb", 3, None), (4, None, 4, "r"), (None, "  ", 5, "s")], "doc_id int, text string, row int, sha string")
    got = sorted(tuple(r) for r in grace_dedup.deduplicated(table).collect() if r.doc_id is not None)
    assert grace_dedup.deduplicated(table).columns == table.columns
    assert got == [(2, "a b", 1, "p")]  # of the empty texts, the longer one without an id stays
    assert grace_dedup.groups(table).filter("doc_id is null").first().kept


def test_string_ids(spark):
    table = [("b", "x y"), ("a", "xy "), (None, "x\ny"), ("c", "z")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in grace_dedup.groups(spark.createDataFrame(table, "doc_id string, text string")).collect()}
    assert got == {"b": ("a", 3, False), "a": ("a", 3, True), None: ("a", 3, False), "c": ("c", 1, True)}


def test_extra_columns_and_long_text(spark):
    wide = documents(spark).selectExpr("*", "1 as content", "2 as local", "3 as bucket")
    assert grace_dedup.groups(wide).count() == wide.count()
    long = "y z" * 3_000_000
    check(grace_dedup.groups(spark.createDataFrame([(1, long), (2, long + " "), (3, long + "y")], "doc_id long, text string")).collect(), [(1, long), (2, long + " "), (3, long + "y")])
