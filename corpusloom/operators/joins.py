"""Joins and lookups: semi, anti, enrichment, nested children, citation verification, fallback chains.

No side is broadcast by hint: whether one is small is left to statistics and adaptive execution, which check its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numerals import article_key
from corpusloom.functions.text import law_name, let, text_of
from corpusloom.sources import sinks


def accepted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def unseen(df: DataFrame, *seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the earlier outputs."""
    for s in seen:
        df = df.join(s.select(key).distinct(), key, "left_anti")
    return df


def enriched(df: DataFrame, dim: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with the dimension's columns, null where it has no row."""
    return df.join(dim.select(key, *columns), key, "left")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in order; without children, an empty array."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def latest_child(parents: DataFrame, children: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Parents with the value of their newest child (the larger value of equally new ones), null without one."""
    newest = children.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(f"latest_{value}"))
    return parents.join(newest, key, "left")


#: Characters of the longest pieces by which names meet.
PIECE = 4


def pieces(c: Column, sizes: Sequence[int]) -> Column:
    """The distinct pieces of a text of the given sizes: as many as its characters for each size, whatever its length."""

    def of(size: int, letters: Column) -> Column:
        return F.array_compact(F.transform(letters, lambda x, i: F.concat(x, *(F.get(letters, i + k) for k in range(1, size)))))

    return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda letters: F.array_distinct(F.concat(*(of(size, letters) for size in sizes))))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(name, within) of distinct names where one of ``short`` (name) is a piece of one of ``long`` (within).

    Of a name the piece of ``PIECE`` characters that the fewest longer names have (the name itself, if it is no longer) is looked up
    among the longer names' pieces, and what meets is compared. A name with a piece that no longer name has is in none.
    """
    longer, shorter = long.withColumn("w", F.xxhash64("within")), short.withColumn("s", F.xxhash64("name"))
    keys = longer.select("w", F.explode(pieces(F.col("within"), range(1, PIECE + 1))).alias("piece"))
    counts = keys.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("name") <= PIECE, F.array("name")).otherwise(pieces(F.col("name"), [PIECE]))
    asked = shorter.select("s", F.explode(own).alias("piece")).join(counts, "piece", "left")
    rarest = asked.groupBy("s").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count_if(F.col("n").isNull()).alias("unknown")).filter("unknown = 0")
    # pieces carry a hash of their name, not the name; names that share one are told apart here
    met = rarest.join(keys, "piece").select("s", "w").distinct()
    return met.join(shorter, "s").join(longer, "w").filter(F.contains("within", F.col("name"))).select("name", "within")


def names_within(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, other) of distinct names of left (name) and right (other) where one is a piece of the other."""
    a, b = left.select("name").filter("name != ''").distinct(), right.select("other").filter("other != ''").distinct()
    longer = contained(a, b.select(F.col("other").alias("within"))).select("name", F.col("within").alias("other"))
    shorter = contained(b.select(F.col("other").alias("name")), a.select(F.col("name").alias("within"))).select(F.col("within").alias("name"), F.col("name").alias("other"))
    return longer.union(shorter.filter("name != other"))


def verify_citations(cited: DataFrame, store: DataFrame) -> DataFrame:
    """Checks cited (law, article, ...) against store (chunk_id, law, article, article_text).

    Exact on normalised law and article first; what is left matches if exactly one law of the store has the same article and a
    name that contains, or is in, the cited one, and without a cited law if just one law has the article. Rows without law and
    article are dropped; verified rows carry the store's text. Names meet once, as distinct names, and then distinct (law, article),
    so nothing is as large as the citations of an article times the laws that have it. The distinct (law, article) of both sides are written
    once, so that no step is planned again in each branch.
    """
    norm = lambda df: df.withColumn("__law", law_name(F.col("law"))).withColumn("__art", article_key(F.col("article")))
    wanted = norm(cited).filter((F.col("__law") != "") | (F.col("__art") != ""))
    known = norm(store).select(F.col("__law").alias("s_law"), F.col("__art").alias("__art"), F.struct("chunk_id", F.col("law").alias("law_name"), F.col("article").alias("article_no"), "article_text").alias("hit"))
    best = sinks.held(known.groupBy("s_law", "__art").agg(F.min_by("hit", "hit.chunk_id").alias("hit")), "articles")
    pairs = sinks.held(wanted.select("__law", "__art").distinct().join(best.select(F.col("s_law").alias("__law"), "__art", F.col("hit").alias("exact")), ["__law", "__art"], "left"), "cited")
    rest = pairs.filter("exact is null and __art != ''").select("__law", "__art")
    names = names_within(rest.select(F.col("__law").alias("name")), best.select(F.col("s_law").alias("other")))
    loose = rest.filter("__law != ''").join(names.select(F.col("name").alias("__law"), F.col("other").alias("s_law")), "__law").join(best, ["s_law", "__art"])
    either = loose.select("__law", "__art", "hit").unionAll(rest.filter("__law = ''").join(best, "__art").select("__law", "__art", "hit"))
    only = either.groupBy("__law", "__art").agg(F.count(F.lit(1)).alias("n"), F.min_by("hit", "hit.chunk_id").alias("fuzzy")).filter("n = 1").drop("n")
    decided = pairs.join(only, ["__law", "__art"], "left").withColumn("hit", F.coalesce("exact", "fuzzy"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("none")
    out = wanted.join(decided.select("__law", "__art", "hit", how.alias("how")), ["__law", "__art"])
    return out.select(*cited.columns, F.col("hit").isNotNull().alias("verified"), "how", F.col("hit.chunk_id").alias("chunk_id"), F.col("hit.article_text").alias("article_text"))


def lookup_status(wanted: DataFrame, store: DataFrame, name: str, item: str) -> DataFrame:
    """Looks items up in a store: found, not_in_law (the name is there, the item isn't) or not_in_store."""
    names = store.select(F.col(name)).distinct().withColumn("__name", F.lit(True))
    items = store.select(name, item).distinct().withColumn("__item", F.lit(True))
    out = wanted.join(names, name, "left").join(items, [name, item], "left")
    return out.withColumn("status", F.when(F.col("__item"), "found").when(F.col("__name"), "not_in_law").otherwise("not_in_store")).drop("__name", "__item")


def resolve(refs: DataFrame, items: DataFrame, scope: str, ref: str, exact: str, others: Sequence[Column], order: str) -> DataFrame:
    """The item of each reference in its scope: by its exact name, else the first by order that it names otherwise."""
    names = items.select(scope, F.struct(F.col(order).alias("at"), F.col(exact).alias("item")).alias("hit"), F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col(exact).cast("string").alias("name"))), F.array(*(F.struct(F.lit(1).alias("rank"), o.cast("string").alias("name")) for o in others))))).alias("n"))
    names = names.select(scope, "hit", "n.rank", F.col("n.name").alias(ref)).filter(text_of(F.col(ref)) != "")
    best = names.groupBy(scope, ref).agg(F.min_by("hit", F.struct("rank", "hit")).alias("hit"))
    return refs.join(best, [scope, ref], "left").select(*refs.columns, F.col("hit.item").alias("resolved"))


def fallback(rows: DataFrame, pages: DataFrame, key: str, urls: str, least: int) -> DataFrame:
    """The first of each row's urls whose page has ``least`` characters; rows without one keep null."""
    tries = rows.select(key, F.posexplode(urls).alias("pos", "url"))
    found = tries.join(pages.select("url", "body").filter(F.length("body") >= least), "url").groupBy(key).agg(F.min_by(F.struct("url", "body"), "pos").alias("hit"))
    return rows.join(found, key, "left").select(*rows.columns, F.col("hit.url").alias("source"), F.col("hit.body").alias("body"))


def longest_wins(rows: DataFrame, attachments: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's text, replaced by its longest attachment if that is longer."""
    longest = attachments.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), F.col(text))).alias("__longest"))
    out = rows.join(longest, key, "left")
    return out.withColumn(text, F.when(F.length("__longest") > F.length(text_of(F.col(text))), F.col("__longest")).otherwise(F.col(text))).drop("__longest")


def merged_datasets(existing: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """All rows by key, the generated one where both have it."""
    both = existing.withColumn("__rank", F.lit(1)).unionByName(generated.withColumn("__rank", F.lit(0)))
    w = Window.partitionBy(key).orderBy("__rank", *(c for c in generated.columns if c != key))
    return both.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__rank", "__nth")
