"""Text functions, numerals, rules: examples with exact results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numerals, rules, text


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, key",
    [("第533条", "533"), ("533", "533"), ("五百三十三", "533"), ("第五百三十三条之一", "533之1"), ("第十条", "10"), ("第一千零一条", "1001"), ("十二万", "120000"), ("附则", "附则"), ("", ""), (None, "")],
)
def test_article_key(spark, raw, key):
    assert one(spark, numerals.article_key(F.col("s")), s=raw) == key


@pytest.mark.parametrize("n, cn", [(0, "零"), (10, "十"), (13, "十三"), (20, "二十"), (101, "一百零一"), (110, "一百一十"), (1001, "一千零一"), (1010, "一千零一十"), (9999, "九千九百九十九"), (10000, None)])
def test_from_int(spark, n, cn):
    assert one(spark, numerals.from_int(F.lit(n))) == cn


def test_numerals_round_trip(spark):
    bad = spark.range(1, 10000).withColumn("back", numerals.to_int(numerals.from_int(F.col("id")))).filter("back is null or back != id")
    assert bad.count() == 0


def test_clean(spark):
    assert one(spark, text.clean_line(F.col("s")), s="　a  b\t\nc ") == "a b c"
    assert one(spark, text.clean_line(F.col("s")), s=None) == ""
    assert one(spark, text.compact(F.col("s")), s=" a　b ") == "ab"
    assert one(spark, text.clean_text(F.col("s")), s="a　 b\n\n\n\nc\n") == "a b\n\nc"


def test_drop_lines(spark):
    s = "keep\nNOISE\npre x\nhas mid y\n2024-01-01\nend mark\nafter"
    got = one(spark, text.drop_lines(F.col("s"), exact=("NOISE",), prefixes=("pre",), containing=("mid",), patterns=(r"\d{4}-\d\d-\d\d",), stop_at=("end mark",)), s=s)
    assert got == "keep"


def test_statutes(spark):
    assert one(spark, text.statute_lines(F.col("s")), s="《合同法》第1条\n第二条\n一审：x\n《民法》") == "《合同法》第1条\n第二条"


def test_citations(spark):
    got = one(spark, text.citations(F.col("s")), s="依《中华人民共和国合同法》第一条、第五十二条第一款及《公司法》，再引《合同法》第一条")
    assert [(r["law"], r["article"]) for r in got] == [("合同法", "第一条"), ("合同法", "第五十二条第一款"), ("公司法", None)]
    assert one(spark, text.citations(F.col("s")), s=None) == []


def test_truncate_bytes(spark):
    assert one(spark, text.truncate_bytes(F.col("s"), 4), s="中文字") == "中"
    assert one(spark, text.truncate_bytes(F.col("s"), 6, "…"), s="中文") == "中文"
    assert one(spark, text.truncate_bytes(F.col("s"), 5, "…"), s="abcdef") == "abcde…"


def test_titles(spark):
    assert one(spark, text.best_title([F.lit("已于 2020"), F.lit("long title"), F.lit("short"), F.lit(None).cast("string")])) == "short"
    assert one(spark, text.best_title([F.lit("")])) == "未命名"
    assert one(spark, text.normalize_title(F.col("s")), s="《示范 文本》（试行）2020年ABC") == "示范文本abc"
    assert one(spark, text.recover_title(F.lit("x"), F.col("s"), "关于.{1,20}的(?:规定|批复)", ("规定",)), s="前言 关于合同的规定。") == "关于合同的规定"


def test_lists(spark):
    assert one(spark, text.json_list(F.col("s")), s='["a","b"]') == ["a", "b"]
    assert one(spark, text.json_list(F.col("s")), s="[bad") == []
    assert one(spark, text.json_list(F.col("s"), raw_on_error=True), s="plain") == ["plain"]
    assert one(spark, text.sentences(F.col("s")), s="一。二！三") == ["一。", "二！", "三"]
    assert one(spark, text.inline_articles(F.col("s")), s="前 第一条 甲 第二条 乙") == ["前 第一条 甲 ", "第二条 乙"]
    assert one(spark, text.box_union(F.array(F.array(F.lit(3.0), F.lit(1.0), F.lit(4.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(0.0))))) == [1.0, 1.0, 4.0, 9.0]


def test_garbage(spark):
    assert one(spark, text.drop_garbage(F.col("s"), allowed="A-Za-z0-9 "), s="good line\n@@@###a\n---") == "good line"


def test_files(spark):
    assert one(spark, F.struct(*text.file_parts(F.col("s"))), s="民法典_20200528.docx") == ("民法典", "20200528", "2020-05-28")
    assert one(spark, F.struct(*text.file_parts(F.col("s"))), s="notes.md") == ("notes", "", "")
    with pytest.raises(Exception, match="unsupported"):
        one(spark, text.parser_for(F.col("s")), s="a.exe")


def test_placeholders(spark):
    assert one(spark, rules.placeholder_share(F.col("s")), s="") == 1.0
    assert one(spark, rules.placeholder_share(F.col("s")), s="ab__") == 1.0  # matched and counted again
    assert one(spark, rules.placeholder_share(F.col("s")), s="abcdefgh__") == pytest.approx(0.4)


def test_coercion(spark):
    assert one(spark, rules.coerce(F.col("s"), {"甲方乙方": "双方"}, "未知"), s="x") == "未知"
    with pytest.raises(Exception, match="unknown value"):
        one(spark, rules.strict(F.col("s"), {"low": "safe"}), s="x")


def test_relevance(spark):
    args = ("关于.+?(解释|批复)", ("规定",), ("刑事",), ("担保",), ("诉讼时效",))
    decide = lambda s: one(spark, rules.instrument_relevance(F.col("s"), F.lit(""), *args), s=s)
    assert decide("新闻")["priority"] == "DROP_NONINSTRUMENT"
    assert decide("关于合同刑事的解释")["priority"] == "DROP"
    assert tuple(decide("关于担保合同的解释")["matched"]) == ("合同/协议", "担保")
    assert decide("关于诉讼时效的规定")["priority"] == "P1_CIVIL"
    assert decide("关于破产的规定")["keep"] is False


def test_cases(spark):
    decide = lambda **c: one(spark, rules.case_relevance(F.col("t"), F.col("k"), F.col("c"), F.col("s"), F.col("w"), ("刑事",), ("离婚",), ("居间",), "合同法", ("违约",)), **c)["priority"]
    assert decide(t="", k="", c="", s="", w="") == "DROP_NONCASE"
    assert decide(t="a", k="刑事", c="", s="", w="") == "DROP"
    assert decide(t="买卖合同", k="", c="", s="", w="") == "P0_CONTRACT"
    assert decide(t="a", k="", c="", s="第463条", w="") == "P1_STATUTE"
    assert decide(t="a", k="", c="", s="第46条", w="违约") == "P2_KEYWORD"
