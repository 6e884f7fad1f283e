import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neardup_hamming as nd
from tests.llm.helpers import documents, empty, odd


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """Component and set size of each row, by comparing all pairs."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    find = lambda k: k if group[k] == k else find(group[k])
    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(sets[k]), low.get(find(k), i)) for k, (i, _) in enumerate(rows)]


def check(spark, df):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]), key=str)


def test_odd_rows(spark):
    check(spark, odd(spark).filter("doc_id is not null"))
    assert nd.near_duplicates(odd(spark)).count() == odd(spark).count()


def test_empty_table(spark):
    assert nd.near_duplicates(empty(spark)).count() == 0
    assert nd.deduplicated(empty(spark)).columns == empty(spark).columns


def test_whole_table(spark):
    check(spark, documents(spark))


def test_wide_family(spark):
    """Copies of one text that differ more and more: linked only through those in between."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"p{j}" for j in range(60)) + " " + " ".join(f"u{k}_{j}" for j in range(70))) for k in range(60)]  # a shared passage
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "CELL", 6)
    test_wide_family(spark)


def test_deduplicated(spark):
    rows = nd.deduplicated(odd(spark).withColumn("root", F.lit(1)).withColumn("node", F.lit("clash")))
    assert rows.columns == [*odd(spark).columns, "root", "node"]
    # a text that is near no other stays, though another text has its doc_id; a repeated row is there once
    assert sorted(r["doc_id"] for r in rows.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 9]


def test_deduplicated_by_row(spark):
    """Clashing columns, ids with several texts, copies without an id: one row of each group stays, the same one in each run."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words, "end"])
    rows = [(5, " ".join(words), "a"), (5, "another text that is like no other here", "b"), (5, "another text that is like no other here", "a"), (7, near, "a"), (None, near, "a"), (None, "lone words without any id at all", "a"), (None, "lone words without any id at all", "b"), (8, None, "a"), (8, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, goes string").withColumn("__id", F.lit(1)).withColumn("__maybe", F.lit("m")).withColumn("row", F.lit(2)).withColumn("key", F.lit(3)).withColumn("th", F.lit(4)).withColumn("a.b", F.lit(5))
    want = [(None, "lone words without any id at all", "a"), (5, " ".join(words), "a"), (5, "another text that is like no other here", "a"), (8, None, "a"), (8, None, "b")]
    got = nd.deduplicated(docs.orderBy(F.desc("goes")))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r, 1, "m", 2, 3, 4, 5) for r in want), key=str)


def test_deduplicated_without_filter(spark, monkeypatch):
    monkeypatch.setattr(nd, "MOST_FILTER_BITS", 4)
    groups = brute([(r["doc_id"], r["text"]) for r in documents(spark).collect()])
    assert sorted(r["doc_id"] for r in nd.deduplicated(documents(spark)).collect()) == sorted({c for _, _, c in groups})


def test_sets_with_one_name(spark, monkeypatch):
    """Different sets whose first 64-bit names are equal aren't merged."""
    source = nd.__file__
    text = open(source).read().replace("return tuple(mix(both).astype(np.int64).tolist())", "return len(names) % 3, int(mix(both).astype(np.int64)[1])")
    assert text != open(source).read()
    module = type(nd)("renamed")
    exec(compile(text, source, "exec"), module.__dict__)
    docs = documents(spark)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in module.near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_hubs(spark, monkeypatch):
    """A star of 5000 leaves, and a path through it, with hubs that are joined apart."""
    monkeypatch.setattr(nd, "HUB", 64)
    links = [(7, k) for k in range(8, 5008)] + [(5007, 6000), (6000, 3)] + [(9000, 9001)]
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 3 for k in [3, 6000, *range(7, 5008)]}, 9000: 9000, 9001: 9000}


def test_spread(spark, monkeypatch):
    monkeypatch.setattr(nd, "HUB", 3)
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (3, 1), (None, 2), (None, 3), (4, 4)], "key long, x long")
    table = spark.createDataFrame([(1, 50, "one"), (2, 1, "two"), (3, 1, None), (9, 1, "nine")], "key long, n long, said string")
    for how in ("inner", "left"):
        got = nd.spread(rows, table, "key", ["said"], 55, how)
        assert got.columns == ["key", "x", "said"]
        want = [(1, k, "one") for k in range(50)] + [(2, 0, "two"), (3, 1, None)] + ([(None, 2, None), (None, 3, None), (4, 4, None)] if how == "left" else [])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_large_family_ends(spark):
    """20 000 first groups tied by a shared passage, few of which are linked: nothing is compared with everything."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{j}" for j in range(70))
    rows = [(k, f"{passage} " + " ".join(f"u{k}_{j}" for j in range(45))) for k in range(20_000)]
    rows += [(100_000 + k, rows[k][1] + f" changed{k}") for k in rng.choice(20_000, 50, replace=False).tolist()]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: i - 100_000 if i >= 100_000 else i for i, _ in rows}


def test_long_text_in_slices(spark, monkeypatch):
    from corpusloom.llm import _text

    monkeypatch.setattr(_text, "PIECE_BYTES", 100)
    text = " ".join(f"word{k}" for k in range(300))
    cut = list(nd._sets(pa.array([text, text + "!" * 400 + " x", "", None, "y" * 1000])))
    monkeypatch.undo()
    assert [x.tolist() for x in cut] == [x.tolist() for x in nd._sets(pa.array([text, text + "!" * 400 + " x", "", None, "y" * 1000]))]


def test_pigeonhole():
    """Signatures within REACH differences share a key, whichever symbols differ."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, nd.INDEXED)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(nd.INDEXED, nd.REACH, replace=False)] += 1
    shared = nd.keys_of(a) == nd.keys_of(b)
    assert shared.any(axis=1).all()
    assert (nd.first_slot(a, b) == shared.argmax(axis=1)).all()


def test_forest():
    a, b = nd.forest(np.array([5, 9, 2, 7]), np.array([9, 2, 5, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 2, 9: 2, 8: 7}


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4)], [(k, k + 1) for k in range(50)], [(0, k) for k in range(1, 30)]])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for x in {x for e in links for x in e}:
        group, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for e in links:
                if y in e:
                    for z in e:
                        if z not in group:
                            group.add(z)
                            todo.append(z)
        want[x] = min(group)
    assert got == want
