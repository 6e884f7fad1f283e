"""Keep-rules and ordered computations over groups of rows.

Every order ends in a column that makes it total, so results don't depend on partitioning. Keep-rules that only need one row of a
key use aggregates with map-side combining (``max_by``-like), not window sorts: a hot key is then combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.functions.text import first_present, text_of


def _inverted(order: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))


def keep_least(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """Of the rows of each key the one with the least ``order`` columns; its row is carried through a partial aggregate."""
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    named = [k.alias(f"__k{n}") for n, k in enumerate(keys)]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    best = df.groupBy(*named).agg(F.min_by(row, _inverted(order)).alias("__row"))
    return best.select("__row.*")


def keep_first(df: DataFrame, fields: Sequence[str], position: Column) -> DataFrame:
    """The first row of each natural key: the first present of ``fields``."""
    return keep_least(df, [first_present(*(F.col(f).cast("string") for f in fields))], [position])


def keep_first_count(df: DataFrame, fields: Sequence[str]) -> Column:
    """How many rows :func:`keep_first` drops, as an aggregate over df."""
    return F.count(F.lit(1)) - F.count_distinct(F.coalesce(first_present(*(F.col(f).cast("string") for f in fields)), F.lit("")))


def keep_with_body(df: DataFrame, key: str, body: str, position: Column) -> DataFrame:
    """The first row of each key, one with a body before one without; rows with an empty key all stay."""
    keyless = text_of(F.col(key)) == ""
    kept = keep_least(df.filter(~keyless), [key], [text_of(F.col(body)) == "", position])
    return df.filter(keyless).unionByName(kept)


def route_duplicates(df: DataFrame, key: str, included: Column, order: Sequence[Column]) -> DataFrame:
    """Adds ``route``: included rows after the first of their key by ``order`` go to review; others as they are.

    order, ascending, tells rows apart: a key's first row is found by an aggregate, with which its rows are compared.
    """
    first = df.filter(included).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    out = df.join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
    route = F.when(~F.coalesce(included, F.lit(False)), "rejected").when(F.struct(*order) == F.col("__first"), "main").otherwise("review")
    return out.withColumn("route", route).drop("__key", "__first")


def neighbours(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """Adds previous and next ``item`` of the group, and both as an array without nulls."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("previous", F.lag(item).over(w)).withColumn("next", F.lead(item).over(w)).withColumn("neighbours", F.array_compact(F.array("previous", "next")))


def numbered(df: DataFrame, group: str, order: Sequence[Column | str], prefix: str = "") -> DataFrame:
    """Adds nth (from 1), total and an id ``prefix__0001``."""
    w = Window.partitionBy(group).orderBy(*order)
    out = df.withColumn("nth", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return out.withColumn("item_id", F.format_string(f"{prefix}%s__%04d", F.col(group).cast("string"), F.col("nth")))


def carry_path(df: DataFrame, group: str, order: str, level: str, heading: str, levels: int) -> DataFrame:
    """Adds ``path``: the headings in force at each row, a heading of one level ending those of deeper levels.

    level is null for rows that aren't headings.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts, valid_from = [], F.lit(-1).cast("long")
    for k in range(1, levels + 1):
        here = F.last(F.when(F.col(level) == k, F.struct(F.col(order).cast("long").alias("at"), F.col(heading).alias("text"))), ignorenulls=True).over(w)
        since = F.greatest(valid_from, F.coalesce(F.max(F.when(F.col(level) < k, F.col(order).cast("long"))).over(w), F.lit(-1)))
        parts.append(F.when(here["at"] > since, here["text"]))
    return df.withColumn("path", F.array_join(F.array_compact(F.array(*parts)), " > "))


def segments(df: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """Adds ``segment``: 0 before the first start, then one more at each row where ``starts`` holds."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def joined(df: DataFrame, keys: Sequence[str], order: str, text: str, mark: str = "\n") -> DataFrame:
    """Texts of each group joined in order, and how many."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(parts, mark).alias(text), F.count(F.lit(1)).alias("n_rows"))


def merge_short(df: DataFrame, group: str, order: str, text: str, kind: Column, weight: str, least: int = 10, short: int = 20, weak: int = 45) -> DataFrame:
    """Drops rows under ``least`` characters and merges short ones (and weak ones of no kind) into the row before them.

    Texts are joined by line ends; the weight stays the first row's.
    """
    n = F.length(F.col(text))
    rows = df.filter(n >= least).withColumn("merges", (n < short) | ((n < weak) & kind))
    w = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumn("begins", ~F.col("merges") | (F.row_number().over(w) == 1))
    rows = segments(rows, group, order, F.col("begins"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("said"))))
    return rows.groupBy(group, "segment").agg(F.array_join(F.transform(parts, lambda x: x["said"]), "\n").alias(text), F.min_by(weight, order).alias(weight), F.count(F.lit(1)).alias("merged_from"))


def running_offset(df: DataFrame, group: str, order: str, size: Column) -> DataFrame:
    """Adds ``offset``: 1 plus the sizes of all rows before."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.lit(1) + F.coalesce(F.sum(size).over(w), F.lit(0)))


def drop_repeats(df: DataFrame, window: WindowSpec, value: str) -> DataFrame:
    """Without rows that equal the row before them."""
    return df.withColumn("__last", F.lag(F.struct(F.col(value))).over(window)).filter(F.col("__last").isNull() | ~F.col(f"__last.{value}").eqNullSafe(F.col(value))).drop("__last")


def coalesced(df: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """One row of a key: each field is its first present value in order."""
    return df.groupBy(key).agg(*(F.min_by(f, F.when(text_of(F.col(f)) != "", F.col(order))).alias(f) for f in fields))


def capped(df: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("nth") <= most)


def stratified(df: DataFrame, label: str, labels: Sequence[str], limit: int, key: str, seed: str) -> DataFrame:
    """``limit`` rows in equal parts by label (the first labels one more), in hashed order; a short label isn't made up for."""
    quota = F.create_map(*(F.lit(x) for k, v in enumerate(labels) for x in (v, limit // len(labels) + (k < limit % len(labels)))))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    ranked = df.withColumn("nth", F.row_number().over(Window.partitionBy(label).orderBy(order, key)))
    # a literal bound is applied in each partition before rows are shuffled, so a label's rows aren't gathered
    ranked = ranked.filter(F.col("nth") <= -(-limit // max(1, len(labels))))
    return ranked.filter(F.col("nth") <= F.coalesce(F.try_element_at(quota, F.col(label).cast("string")), F.lit(0)))
