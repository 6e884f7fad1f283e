"""Queries do the whole job: small tables whose rows a cut would lose, against results worked out here in Python."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.operators import retrieval
from corpusloom.plans import catalog


def run(spark, folder, query, **tables):
    """The query's rows over tables that are lists of dicts."""
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{name}.parquet")
    return [r.asDict() for r in catalog.QUERIES[query](spark, str(folder)).collect()]


def documents(texts):
    return [{"doc_id": i, "text": t, "lang": "de", "source": f"src{i % 3}", "n_chars": len(t or "")} for i, t in texts]


def test_citations_of_all_orders(spark, tmp_path):
    keys = [(o, n) for o in (1, 500, 501, 70_000, 3_000_000_000) for n in (1, 2)]
    got = run(spark, tmp_path, "citation_extract", lineitem=[{"l_orderkey": o, "l_linenumber": n, "l_partkey": o % 97} for o, n in keys])
    want = [(o, n, "合同法", f"第{n}条") for o, n in keys] + [(o, n, f"P{o % 97}", None) for o, n in keys]
    assert sorted(tuple(r.values()) for r in got) == sorted(want, key=lambda r: r[:3])


def test_merge_has_all_documents(spark, tmp_path):
    got = run(spark, tmp_path, "dataset_merge", documents=documents([(i, "t") for i in range(12)]))
    assert sorted((r["doc_id"], r["origin"]) for r in got) == [(i, "existing" if i % 4 == 2 else "generated") for i in range(12)]


def test_byte_cut_of_any_text(spark, tmp_path):
    texts = ["é" * 30, "a" + "é" * 30, "中" * 20, "x" * 39 + "😀", "x" * 38 + "😀y", "x" * 40, "x" * 41, "�" * 20, "x" * 37 + "�" + "é", "x" * 36 + "�\nzz", "", None]
    got = run(spark, tmp_path, "byte_truncate", documents=documents(enumerate(texts)))

    def head(t):
        raw = (t or "").encode()
        return t or "" if len(raw) <= 40 else raw[:40].decode(errors="ignore") + "..."

    assert {r["doc_id"]: (r["n_bytes"], r["head"]) for r in got} == {i: (None if t is None else len(t.encode()), head(t)) for i, t in enumerate(texts)}


def test_whole_deltas_are_folded(spark, tmp_path):
    said = [("user", "a long first turn"), ("assistant", "and its long answer"), ("system", "a call's whole result"), ("user", None), ("user", "more than five")]
    got = run(spark, tmp_path, "timeline_fold", conversations=[{"conv_id": 1, "turn": k, "role": r, "text": t} for k, (r, t) in enumerate(said)])
    assert sorted((r["block"], r["kind"], r["t"], r["n"]) for r in got) == [(1, "think", said[0][1] + said[1][1], 2), (2, "tool", said[2][1], 1), (3, "think", said[4][1], 2)]


def test_whole_documents_are_hydrated(spark, tmp_path):
    texts = {1: "short", 2: "x" * 501, 3: "y" * 120_000, 4: "z" * 120_001}
    angle = {0: 0.0, 50: 1.0, 100: 2.0, 150: 3.0, 200: 4.0, 1: 0.01, 2: 1.01, 3: 2.01, 4: 3.01, 5: 4.01}
    vectors = [{"vec_id": i, "label": 0, "embedding": [math.cos(a), math.sin(a)]} for i, a in angle.items()]
    got = run(spark, tmp_path, "locate_and_hydrate", documents=documents(texts.items()), embeddings=vectors)
    assert {r["vec_id"]: (r["body"], r["truncated"]) for r in got} == {1: (texts[1], False), 2: (texts[2], False), 3: (texts[3], False), 4: (texts[4][:120_000], True), 5: (None, None)}


@pytest.mark.parametrize("query", ["knn_topk", "knn_filtered", "knn_threshold", "knn_rerank", "locate_and_hydrate"])
def test_more_queries_than_a_block(spark, tmp_path, monkeypatch, query):
    vectors = [{"vec_id": i, "label": i // 50 % 4, "embedding": [math.cos(i), math.sin(i)]} for k in range(9) for i in (50 * k, 50 * k + 1)]
    tables = {"embeddings": vectors, "documents": documents((50 * k + 1, f"text {k}") for k in range(9))}
    whole = sorted(run(spark, tmp_path, query, **tables), key=str)
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    assert whole and sorted(run(spark, tmp_path, query, **tables), key=str) == whole


def test_blocks_have_each_query_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    ids = [*range(50), *[7] * 6, None]
    parts = [[r["query_id"] for r in b.collect()] for b in retrieval.blocks(spark.createDataFrame([(i,) for i in ids], "query_id long"))]
    assert sorted((i for p in parts for i in p), key=str) == sorted(ids, key=str)
    assert all(len(p) <= 4 or len(p) <= 7 and 7 in p for p in parts)


def test_cascade_reads_the_whole_text(spark, tmp_path):
    far = " " * 300
    got = run(spark, tmp_path, "classify_cascade", documents=documents(enumerate([f"x.{far}tion", f"x.{far}der ", f"x.{far}| tion", f"x{far}.tion", "x.", "tion"])))
    assert {r["doc_id"]: (r["keep"], r["priority"]) for r in got} == {0: (True, "P0_CONTRACT"), 1: (True, "P1_CIVIL"), 2: (False, "DROP"), 3: (True, "P0_CONTRACT"), 4: (False, "DROP"), 5: (False, "DROP_NONINSTRUMENT")}


def test_tags_are_proven_by_title_and_body(spark, tmp_path):
    far = " " * 300
    got = run(spark, tmp_path, "pruned_tags", documents=documents([(0, f"{far}tion"), (2, "x"), (1, f"{far}tion"), (3, "x")]))
    assert {r["doc_id"]: r["kept"] for r in got} == {0: "service,other", 2: "other", 1: "service", 3: ""}


def test_blocks_have_fields_without_blanks(spark, tmp_path):
    """A field's name that has a blank in the text is found, and written without it."""
    items = [{"l_orderkey": 7, "l_linenumber": n, "l_partkey": 1, "l_suppkey": 1, "l_quantity": float(n), "l_extendedprice": 1.0} for n in (1, 2, 3, 4, 5)]
    got = run(spark, tmp_path, "contract_blocks", lineitem=items)
    assert [(r["type"], r["text"]) for r in sorted(got, key=lambda r: r["nth"])] == [("paragraph", "第1条 数量1"), ("paragraph", "第1条 价款"), ("paragraph", "杂项2"), ("heading", "质量标准：" + "优" * 12 + "3"), ("paragraph", "第4条 数量4"), ("paragraph", "第4条 价款"), ("paragraph", "杂项5")]
