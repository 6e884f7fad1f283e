"""Small document tables with the cases that every operator must define a result for."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{k % 977} und{k % 13}" for k in range(60_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", None, 10),
    (3, None, None, "b", None),
    (4, "", "en", None, 0),
    (5, " \n\t ", None, "b", 3),
    (6, "1234 5678 !!", "de", "a", 12),
    (7, "Übung äöü 中文 😀 naïve", "de", "", 20),
    (8, LONG, "de", "a", len(LONG)),
    (9, "one two", "en", "c", 7),
    (9, "one two", "en", "c", 7),
    (9, "another text of the same id", "en", "c", 20),
    (None, "no id at all here", "en", "c", 17),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
