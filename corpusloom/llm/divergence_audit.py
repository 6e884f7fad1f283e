"""How far the sources of a language differ in their words: an inverted index of corrections to a baseline.

Terms are runs of letters (A-Z, lower-cased, a-z, and whatever lies beyond ASCII). A language keeps the V terms that occur in at least
``LEAST_DOCS`` of its documents; only they count from then on. A source of a language gives a kept term with count c the share
``p = 1 + floor(SCALE * (c + 2) / (N + 2 V))``, N being the source's count of kept terms; the language as a whole gives q alike. Two
shares differ by ``f(p, q) = floor((p - q)^2 / (p + q))``. All of that is integers.

The difference of two sources is the sum of f over all V terms, but no term that both lack is ever looked at:

* *Baseline.* Each pair starts at V times f of the two shares of a zero count.
* *One-sided corrections.* A term of a source, against the zero of the other one, changes that by f(p, zero) - f(zero, zero), which depends
  on its count only: a source's postings are first summed up to (count, terms with that count).
* *Two-sided corrections.* Where the postings of a term hold both sources, what the two one-sided corrections make of it is put right.
  Corrections of zero are not emitted.

The best terms of a source are ranked by window among its own postings.

Null text, lang and source count as ''. A source whose documents have no kept term has all shares of zero; if a language keeps no term,
its pairs have the value 0 and it has no term rows. Repeated rows are documents of their own; other columns are ignored. An empty table
gives no row. What is put out is one row for each ordered pair of sources of a language, so it grows with the square of their number.
Memory: a task counts terms up to ``ROOM`` entries before it gives them to the shuffle, and reads a long text in slices; the distinct
terms of one text are held at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import give_back, kept, modest_batches, scratch

#: A kept term occurs in so many documents of its language at least.
LEAST_DOCS = 10
#: The sum of all shares, but for rounding and the 1 that each has.
SCALE = 1_000_000_000
#: A source's terms are given to this rank.
TOP_TERMS = 10
#: Entries (source, term) that a task counts before it gives them out.
ROOM = 400_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20

#: Letters by byte: A-Z lower-cased, a-z and bytes beyond ASCII as they are, all others a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time; no term is cut."""
    raw = text.encode().translate(LETTERS)
    at = 0
    while len(raw) - at > SLICE:
        end = raw.rfind(b" ", at, at + SLICE)
        end = end if end > at else raw.find(b" ", at + SLICE)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; a row without a term for each group."""
    texts = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    modest_batches(documents.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (n, docs) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.nulls(1, pa.string()), pa.array([0]), pa.array([0])], names=names)
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    part = terms[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])], names=names
                    )
            found.clear()

        for batch in batches:
            langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
            for k, key in enumerate(zip(langs, sources)):
                n, docs = found.setdefault(key, (Counter(), Counter()))
                before = len(n)
                parts = words(texts[k].as_py())
                seen = set()
                for part in parts:
                    n.update(part)
                    seen.update(part)
                docs.update(seen)
                size += len(n) - before
                if size > ROOM:
                    yield from out()
                    size = 0
        yield from out()
        give_back()

    raw = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """A count's share of a source with ``total`` occurrences of the language's ``terms`` kept terms."""
    exact = lambda c: c.cast("decimal(25,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * exact(count + 2), exact(total + 2 * terms)) + 1


def apart(p: Column, q: Column) -> Column:
    """How far two shares differ."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _paired(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Rows of two sources of one language (and of one term, where asked), each pair once: the lesser name is a's."""
    mine = a.select(*on, *(F.col(c).alias(f"{c}_a") for c in a.columns if c not in on))
    other = b.select(*on, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in on))
    return mine.join(other, list(on)).filter(F.col("source_a") < F.col("source_b"))


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language by difference, and each source's most telling terms."""
    spark = documents.sparkSession
    with scratch(spark):
        counts = kept(counted(documents), "terms")
        vocabulary = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= LEAST_DOCS).drop("docs")
        postings = kept(counts.filter(F.col("term").isNotNull()).drop("docs").join(vocabulary, ["lang", "term"]), "postings")
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        by_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
        groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
        groups = kept(groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))), "groups")
        known = postings.join(groups, ["lang", "source"])
        shared = kept(known.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("all_n"), F.col("lang_total"), F.col("terms"))).select("lang", "source", "term", "p", "q", "zero"), "shares")
        return kept(_pairs(groups, shared).unionByName(_terms(shared)), "audit", outlives=True)


def _pairs(groups: DataFrame, shared: DataFrame) -> DataFrame:
    zero = apart(F.col("zero_a"), F.col("zero_b"))
    pairs = _paired(groups.select("lang", "source", "zero", "terms"), groups.select("lang", "source", "zero"), "lang")
    base = pairs.select("lang", "source_a", "source_b", F.coalesce(F.col("terms_a") * zero, F.lit(0)).alias("value"))
    alike = shared.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    zeros = groups.select("lang", "source", "zero")
    first = _paired(alike, zeros, "lang").withColumn("value", F.col("terms_a") * (apart(F.col("p_a"), F.col("zero_b")) - zero))
    second = _paired(zeros, alike, "lang").withColumn("value", F.col("terms_b") * (apart(F.col("zero_a"), F.col("p_b")) - zero))
    own = shared.select("lang", "source", "term", "p", "zero")
    both = _paired(own, own, "lang", "term")
    both = both.withColumn("value", apart(F.col("p_a"), F.col("p_b")) - apart(F.col("p_a"), F.col("zero_b")) - apart(F.col("zero_a"), F.col("p_b")) + zero)
    corrections = [x.filter(F.col("value") != 0).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")) for x in (first, second, both)]
    parts = base
    for x in corrections:
        parts = parts.unionByName(x)
    summed = parts.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    rows = summed.select("lang", "value", F.explode(sides).alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return rows.withColumn("rank", F.row_number().over(_order()))


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _terms(shared: DataFrame) -> DataFrame:
    rows = shared.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= TOP_TERMS)
