"""Aggregations: ordered concatenation, inverted index, catalogs, histograms, percentiles, profiles, trace statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text_of


def group_text(df: DataFrame, key: str, order: str, text: str, title: Sequence[str], mark: str = "\n") -> DataFrame:
    """Per key the first row's title (the first present of ``title``) and all texts in order."""
    head = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in title))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("said")))), lambda x: x["said"])
    return df.groupBy(key).agg(F.min_by(head, order).alias("title"), F.array_join(parts, mark).alias("body"), F.count(F.lit(1)).alias("n_parts"))


def inverted(df: DataFrame, key: str, item: str, order: Column) -> DataFrame:
    """Per key its distinct items in order of first mention; items are first reduced to one row each, map-side."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key, item).agg(F.min(order).alias("at"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", item))), lambda x: x[item])
    return firsts.groupBy(key).agg(items.alias("items"), F.count(F.lit(1)).alias("n_items"))


def catalog(df: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """Per key the number of rows and each field's first present value in order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *(F.min_by(f, F.when(text_of(F.col(f).cast("string")) != "", F.col(order))).alias(f) for f in fields))


def histogram(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def positional_percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], budget: int | None = None) -> DataFrame:
    """Per group min, max and the element at position min(n - 1, floor(n p)) of the sorted values; rows over ``budget``.

    Equal values are counted before anything is ordered, so what is sorted is the distinct values, not the rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    place = lambda p: F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(p)))
    out = [F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares]
    over = [F.coalesce(F.sum(F.when(F.col(value) > budget, F.col("n"))), F.lit(0)).alias("over_budget")] if budget is not None else []
    return upto.groupBy(*group).agg(F.max("all").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *out, *over)


def profile(df: DataFrame, measures: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """min, max and mean of each measure and count of rows with each flag."""
    out = [f(c).alias(f"{name}_{kind}") for name, c in measures.items() for kind, f in (("min", F.min), ("max", F.max), ("avg", lambda x: F.round(F.avg(x), 6)))]
    return df.agg(F.count(F.lit(1)).alias("n_docs"), *out, *(F.count_if(c).alias(f"with_{name}") for name, c in flags.items()))


def shapes(df: DataFrame, **parts: Column) -> DataFrame:
    """Documents by structure: the parts as a struct, counted."""
    return df.groupBy(F.concat_ws("|", *(c.cast("string") for c in parts.values())).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def trace_counts(df: DataFrame, trace: str, calls: str) -> tuple[DataFrame, DataFrame]:
    """Calls by name, and calls per trace (traces without calls count as traces)."""
    by_name = df.select(F.explode(calls).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    mean = df.agg(F.count_distinct(trace).alias("traces"), F.round(F.sum(F.size(F.coalesce(calls, F.array().cast("array<string>")))) / F.count_distinct(trace), 6).alias("calls_per_trace"))
    return by_name, mean


def variants(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds group_id (front of an md5), variant (from 1) and how many there are."""
    w = Window.partitionBy(*group)
    return df.withColumn("group_id", F.left(F.md5(F.concat_ws("|", *(F.col(g).cast("string") for g in group))), F.lit(12))).withColumn("variant", F.row_number().over(w.orderBy(*order))).withColumn("n_variants", F.count(F.lit(1)).over(w))


def nested_counts(opinions: Column) -> tuple[Column, Column]:
    """Citations and verified citations of an array of opinions with arrays of citations (verified boolean)."""
    n = F.aggregate(opinions, F.lit(0), lambda a, o: a + F.size(o["citations"]))
    ok = F.aggregate(opinions, F.lit(0), lambda a, o: a + F.size(F.filter(o["citations"], lambda c: c["verified"])))
    return n, ok


def gaps(parents: DataFrame, chosen: DataFrame, key: str, wanted: int) -> DataFrame:
    """Parents with fewer than ``wanted`` chosen rows, and how many they have."""
    counts = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return parents.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < wanted)
