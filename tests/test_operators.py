"""Operators on small tables: edge cases and examples with exact results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, joins, packing, retrieval, segments, store, windows
from corpusloom.sources import html, readers, sinks
from corpusloom.streaming import events


def test_evaluation_example(spark):
    df = spark.createDataFrame([("high", "safe", True), ("high", "high", True), ("safe", "medium", True), ("medium", "medium", True)], "gold string, predicted string, success boolean")
    r = evaluation.rates(df).first()
    assert (r["high_miss_rate"], r["high_to_safe_rate"], r["safe_false_positive_rate"]) == (0.5, 0.5, 1.0)
    assert r["risk_recall"] == pytest.approx(2 / 3, abs=1e-6)


def test_evaluation_of_nothing(spark):
    df = spark.createDataFrame([], "gold string, predicted string, success boolean")
    r = evaluation.rates(df).first()
    assert r["accuracy"] == 0.0 and r["high_recall"] == 0.0
    assert evaluation.confusion(df).count() == 3


def test_failed_rows_count_as_misses(spark):
    samples = spark.createDataFrame([(1, "safe"), (2, "high")], "id int, gold string")
    none = spark.createDataFrame([(1, None), (2, None)], "id int, predicted string")
    rows = {r["id"]: r for r in evaluation.paired(samples, none, none, "id").collect()}
    assert rows[1]["false_alarm"] and rows[2]["missed"]


def test_verify_citations(spark):
    store_ = spark.createDataFrame([("c1", "合同法", "第五十二条", "t1"), ("c2", "公司法", "第三条", "t2"), ("c3", "民法典合同编", "第九条", "t3"), ("c4", "民法典总则编", "第九条", "t4")], "chunk_id string, law string, article string, article_text string")
    cited = spark.createDataFrame([(1, "中华人民共和国合同法", "52"), (2, "公司", "3"), (3, "民法典", "9"), (4, "劳动法", "52"), (5, "", "")], "id int, law string, article string")
    got = {r["id"]: (r["verified"], r["how"], r["chunk_id"]) for r in joins.verify_citations(cited, store_).collect()}
    assert got == {1: (True, "exact", "c1"), 2: (True, "fuzzy", "c2"), 3: (False, "none", None), 4: (False, "none", None)}


def test_upsert_and_ignore(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, at int")
    assert sorted(map(tuple, store.upsert(t, changes, ["id"], "at").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, store.insert_ignore(t, changes, ["id"], [F.col("at")]).collect())) == [(1, "a"), (2, "b"), (3, "z")]


def test_keep_rules(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "k", ""), (4, "k", "d")], "pos int, key string, body string")
    assert [r["pos"] for r in windows.keep_with_body(d, "key", "body", F.col("pos")).orderBy("pos").collect()] == [1, 2, 4]


def test_merge_keeps_first_weight(spark):
    d = spark.createDataFrame([(1, 1, "long enough text here", 0.9), (1, 2, "short one!!", 0.1), (1, 3, "tiny", 0.5)], "doc int, pos int, text string, weight double")
    rows = windows.merge_short(d, "doc", "pos", "text", F.lit(False), "weight").collect()
    assert [(r["text"], r["weight"], r["merged_from"]) for r in rows] == [("long enough text here\nshort one!!", 0.9, 2)]


def test_heading_path(spark):
    d = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "b"), (1, 3, None, "x"), (1, 4, 1, "C"), (1, 5, None, "y")], "doc int, pos int, level int, heading string")
    got = [r["path"] for r in windows.carry_path(d, "doc", "pos", "level", "heading", 2).orderBy("pos").collect()]
    assert got == ["A", "A > b", "A > b", "C", "C"]


def test_packing():
    assert packing.pack_units([("p", "aaa"), ("p", "bbb"), ("q", "c"), ("q", "d" * 20)], 8) == [("p", "aaa\nbbb", 2, False), ("q", "c", 1, False), ("q", "d" * 20, 1, True)]
    chunks = packing.pack_overlapping([("L", "aaaa"), ("L", "bbbb"), ("L", "cccc"), ("M", "d")], 9, 4)
    assert chunks == [("L", "aaaabbbb"), ("L", "bbbbcccc"), ("M", "d")]
    assert packing.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert "".join(packing.split_text("One two. Three four. Five.", 12)).replace(" ", "") == "Onetwo.Threefour.Five."
    assert packing.split_table(["h", "-", "r1", "r2", "r3"], 2, 9) == ["h\n-\nr1\nr2", "h\n-\nr3"]
    assert packing.select_diverse([(5, 0, frozenset("a")), (4, 1, frozenset("a")), (3, 2, frozenset("b"))], 2) == [0, 2]


def test_fold_streams_documents(spark):
    d = spark.createDataFrame([(k, n, "", f"line {n}") for k in range(20) for n in range(30)], "doc long, pos int, path string, line string")
    rows = packing.packed(d, "doc", "pos", "path", "line", 40).collect()
    whole = {k: "\n".join(r["text"] for r in sorted((r for r in rows if r["doc"] == k), key=lambda r: r["chunk"])) for k in range(20)}
    assert all(whole[k] == "\n".join(f"line {n}" for n in range(30)) for k in range(20))


def test_clauses(spark):
    d = spark.createDataFrame([(1, "title\n一、甲\n第一条 乙\n1. 丙\n第二条 丁"), (2, None)], "doc int, text string")
    got = [(r["segment"], r["body"]) for r in segments.clauses(d, "doc", "text").orderBy("segment").collect()]
    assert got == [(0, "title"), (1, "一、甲"), (2, "第一条 乙\n1. 丙"), (3, "第二条 丁")]


def test_retrieval_limits(spark):
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)] + [(99, [0.0, 0.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r["vec_id"] for r in retrieval.search(q, e, k=2).orderBy("rank").collect()] == [9, 8]
    assert retrieval.exact_fetch(e, law="", article=None).count() == 0


def test_html():
    page = "<body><nav>menu</nav><div><p>" + "text " * 60 + "</p></div><div>short</div><script>x()</script></body>"
    assert html.main_text(page) == ("text " * 60).strip()
    assert html.main_text("<div>a</div><p>b") == "a\nb"
    assert html.main_text(None) == ""
    assert html.table_markdown([["a", "b"], ["", ""], ["c", "d|e"]]) == "| a | b |\n| --- | --- |\n| c | d\\|e |"


def test_links(spark):
    d = spark.createDataFrame([("http://h.x/a/b.html",)], "url string")
    got = d.select(F.array(*(html.absolute(F.col("url"), F.lit(x)) for x in ("c.html", "/r", "//o.y/z", "https://q/"))).alias("r")).first()["r"]
    assert got == ["http://h.x/a/c.html", "http://h.x/r", "http://o.y/z", "https://q/"]


def test_docx(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    rows = html.docx_rows(readers.binary_files(spark, str(tmp_path), "*.docx")).orderBy("pos").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("paragraph", "one\ttwo"), ("table", "| c1 | c2 |")]


def test_json_lines(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType().add("id", "integer").add("v", "string")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": oops}\n')
    assert readers.json_lines(spark, str(tmp_path / "missing.jsonl"), schema).count() == 0
    assert [r["id"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema, strict=False).collect() if r["id"]] == [1]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a"], None)], "id int, tags array<string>, note string")
    assert sinks.csv_ready(d).first().asDict() == {"id": "1", "tags": '["a"]', "note": ""}
    assert sinks.ordered(d, ["note"], ["id"]).columns == ["note", "tags", "id"]
    for _ in range(2):
        sinks.append_new(d.select("id", "note"), str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_markdown_folder(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.md").write_text(f"# {n}")
    assert [r["file_name"] for r in readers.markdown_folder(spark, str(tmp_path)).collect()] == ["a.md", "b.md"]
    with pytest.raises(FileNotFoundError):
        readers.markdown_folder(spark, str(tmp_path), names=["zz.md"])


def test_terminal_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "view"), (1, 2, "done"), (1, 3, "late"), (2, 1, "view")], "job int, at int, kind string")
    log.write.parquet(str(tmp_path / "log"))
    batch = events.until_terminal(log, "job", ["at"], F.col("kind") == "done")
    assert sorted((r["job"], r["at"]) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would go on asking for empty batches
    stream = events.until_terminal_stream(events.replay(spark, str(tmp_path / "log"), log.schema), "job", "at", "kind", ["done"])
    run = stream.writeStream.format("memory").queryName("until_terminal").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted((r["job"], r["at"], r["seq"]) for r in spark.table("until_terminal").collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_order_over_batches(spark, tmp_path):
    """A late event of a later batch comes after; what follows a terminal event of an earlier batch goes."""
    schema = "job int, at int, kind string"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for batch in ([(1, 5, "x"), (2, 1, "done")], [(1, 3, "x"), (1, 4, "x"), (2, 0, "x")]):
        frame = spark.createDataFrame(batch, schema).coalesce(1)
        frame.write.mode("append").parquet(log)
        stream = events.until_terminal_stream(events.replay(spark, log, frame.schema), "job", "at", "kind", ["done"])
        stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r["job"], r["at"], r["seq"]) for r in spark.read.parquet(out).collect()) == [(1, 3, 2), (1, 4, 3), (1, 5, 1), (2, 1, 1)]
