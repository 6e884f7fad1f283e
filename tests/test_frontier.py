"""Crawl closures, gapless keys, exact rounding and discovery against plain Python."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import frontier, retrieval, store
from corpusloom.sources import html


def closure(seeds, links):
    depth = {s: 0 for s in seeds if s is not None}
    edge = list(depth)
    while edge:
        edge = sorted({t for n, t in links if n in set(edge) and t is not None} - set(depth))
        depth |= {t: max(depth.values()) + 1 for t in edge}
    return depth


def test_reached_equals_a_walk(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)] + [("n0", None), (None, "n1"), ("n0", "n0")]
    links += [("n0", f"hub{k}") for k in range(40)] + links[:5] + [("n7", "m0"), *((f"m{k}", f"m{k + 1}") for k in range(6))]
    seeds = ["n0", "n7", None, "n0", "alone"]
    got = frontier.reached(spark.createDataFrame([(s,) for s in seeds], "node string"), spark.createDataFrame(links, "node string, to string")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["depth"] for r in got} == closure(seeds, links)
    assert max(r["depth"] for r in got) > 5


def test_reached_with_few_steps_and_empty_tables(spark):
    chain = spark.createDataFrame([(f"{k}", f"{k + 1}") for k in range(9)], "node string, to string")
    seeds = spark.createDataFrame([("0",)], "node string")
    assert sorted(r["node"] for r in frontier.reached(seeds, chain, 2).collect()) == ["0", "1", "2"]
    assert frontier.reached(seeds.limit(0), chain).count() == 0
    assert [tuple(r) for r in frontier.reached(seeds, chain.limit(0)).collect()] == [("0", 0)]


def test_links_and_titles(spark):
    rows = [
        (1, "https://a.org/list?x=1#top", '<A class="k" HREF=\'d/1.html\'><b>First</b>\n title</A> <a href="/d/2.html">abc</a><a href="#up">to the top</a><a href="/list?x=1">list itself</a>'),
        (2, "http://a.org/list2", '<a href="http://a.org/d/1.html">Second title</a><a href="//b.org/z">Other site</a><a href="/d/2.html">Two, named</a>'),
        (3, None, '<a href="/d/9.html">without a URL</a>'),
        (4, "http://a.org/none", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["node"], r["to"]) for r in frontier.page_links(pages).collect()}
    assert ("http://a.org/list?x=1", "http://a.org/d/1.html") in got and ("http://a.org/list2", "http://b.org/z") in got
    assert not any(n == t for n, t in got)
    only = frontier.page_links(pages, where=F.col("to").contains("b.org")).collect()
    assert [tuple(r) for r in only] == [("http://a.org/list2", "http://b.org/z")]
    listed = {r["url"]: (r["title"], r["list_url"]) for r in frontier.listed(pages, "page_id", where=F.col("to").contains("/d/")).collect()}
    assert listed == {"http://a.org/d/1.html": ("First title", rows[0][1]), "http://a.org/d/2.html": ("Two, named", rows[1][1])}
    assert [tuple(a) for a in pages.select(html.anchors(F.col("html")).alias("a")).first()["a"]][0] == ("d/1.html", "First title")


def test_probes(spark):
    one = spark.range(1)
    assert one.select(frontier.probes(F.lit("h?s=1"), ("page", "p"), 2).alias("u")).first()["u"] == ["h?s=1", "h?s=1&page=1", "h?s=1&p=1", "h?s=1&page=2", "h?s=1&p=2"]
    assert one.select(frontier.probes(F.lit("h"), ("page",), 0).alias("u")).first()["u"] == ["h"]


def test_numbers_are_gapless_and_in_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(50)]), rng.choice(["a", "b", None])) for _ in range(3000)] + [(7, "hot")] * 3000
    got = store.numbered(spark.createDataFrame(rows, "k long, v string").repartition(5), ["k"], first=11).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(11, 11 + len(rows)))
    keys = [-1 if r["k"] is None else r["k"] for r in got]
    assert keys == sorted(keys)
    assert sorted(map(repr, ((r["k"], r["v"]) for r in got))) == sorted(map(repr, rows))


def test_insert_returning(spark):
    old = spark.createDataFrame([(4, "x"), (9, "y")], "id long, name string")
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    whole, added = store.insert_returning(old, new, "id", ["name"])
    assert sorted(map(tuple, added.collect())) == [(10, "a"), (11, "b")] and whole.count() == 4
    assert sorted(map(tuple, store.insert_returning(old.limit(0), new, "id", ["name"])[1].collect())) == [(1, "a"), (2, "b")]
    assert store.insert_returning(old, new.limit(0), "id", ["name"])[0].count() == 2


@pytest.mark.parametrize("places", [0, 1, 2, 4, 6])
def test_rounding_is_by_the_binary_value(spark, places):
    rng = random.Random(places)
    values = [0.125, 2.675, 0.5, 1.5, 2.5, -0.5, 1e-9, -1e-9, 0.0, 1e300, 123456789.5, 5e-324, 1 / 2_000_000]
    values += [rng.randrange(10**6) / 2 ** rng.randrange(12) for _ in range(2000)] + [rng.randrange(10**7) / 10**7 for _ in range(2000)]
    values += [(rng.randrange(10**5) + 0.5) / 10**places for _ in range(2000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.round_exact(F.col("v"), places).alias("r")).collect()
    assert all(struct.pack("d", r["r"]) == struct.pack("d", float(round(r["v"], places))) for r in got)


def test_rounding_of_what_is_no_number(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [repr(r["r"]) for r in rows.select(text.round_exact(F.col("v"), 2).alias("r")).collect()] == ["None", "nan", "inf", "-inf"]


def test_discovery(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    right, up = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "a long question", "rewritten", right, up), (2, "short", "rewritten", right, up), (3, "a long question", " ", right, up), (4, "a long question", "rewritten", right, None), (5, None, None, None, None)]
    asked = spark.createDataFrame(rows, "query_id long, text string, rewrite string, query array<double>, rewrite_query array<double>")
    got = {r["query_id"]: (r["searched"], r["vec_id"]) for r in retrieval.discovered(asked, corpus, k=1).collect()}
    assert got == {1: ("rewritten", 2), 2: ("short", 1), 3: ("a long question", 1), 4: ("a long question", 1), 5: ("", None)}
