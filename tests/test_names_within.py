"""Names within names against plain Python, and very long ones."""

import random

from corpusloom.operators import joins


def test_names_within(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("甲乙丙😀a") for _ in range(draw.randrange(0, 9))) for _ in range(60)]
    left, right = words[:30] + ["中华人民共和国民法典", ""], words[30:] + ["民法典", "法", "中华人民共和国民法典实施细则"]
    got = joins.names_within(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "other string"))
    want = sorted({(a, b) for a in left for b in right if a and b and (a in b or b in a)})
    assert sorted((r["name"], r["other"]) for r in got.collect()) == want


def test_long_names(spark):
    """A cited name of 10 000 characters: no row is larger than a few pieces for each of its characters."""
    long = "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(10_000))
    cited = spark.createDataFrame([(1, long, "第一条"), (2, long[4000:4600], "第一条"), (3, long + "x", "第二条")], "id int, law string, article string")
    store = spark.createDataFrame([("c1", long[3000:7000], "第一条", "t1"), ("c2", "民法典", "第一条", "t2")], "chunk_id string, law string, article string, article_text string")
    got = {r["id"]: (r["how"], r["chunk_id"]) for r in joins.verify_citations(cited, store).collect()}
    assert got == {1: ("fuzzy", "c1"), 2: ("fuzzy", "c1"), 3: ("none", None)}
