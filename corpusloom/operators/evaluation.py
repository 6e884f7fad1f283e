"""Evaluation analytics: confusion, precision and recall, miss rates, group deltas, paired comparison.

Everything is one pass of conditional counts with map-side combining; only the label dimension, a constant, is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels from harmless to severe.
LABELS = ("safe", "medium", "high")


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places, 0 where b is 0.

    Spark rounds half up on the shortest decimal that names the double, where exact rounding goes by its binary value: a quotient
    that reads as a half at the seventh place may differ by 0.000001, such as 1 / 2 000 000.
    """
    return F.when(b == 0, 0.0).otherwise(F.round(a.cast("double") / F.when(b == 0, 1).otherwise(b), 6))


def _level(c: Column, labels: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), c)


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("success") & F.col("predicted").isNotNull())


def confusion(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """A row of each gold label with a count of each predicted label, zero-filled, of df (gold, predicted, success)."""
    dims = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(labels)], "gold string, nth int")
    counts = valid(df).groupBy("gold").agg(*(F.count_if(F.col("predicted") == x).alias(f"pred_{x}") for x in labels))
    return dims.join(counts, "gold", "left").select("gold", *(F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in labels))


def per_label(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """label, precision, recall, f1 (of the rounded two) and support, from one aggregation."""
    both = lambda x: F.struct(
        F.lit(x).alias("label"),
        F.count_if((F.col("gold") == x) & (F.col("predicted") == x)).alias("tp"),
        F.count_if((F.col("gold") != x) & (F.col("predicted") == x)).alias("fp"),
        F.count_if((F.col("gold") == x) & (F.col("predicted") != x)).alias("fn"),
    )
    rows = valid(df).agg(F.array(*map(both, labels)).alias("all")).select(F.inline("all"))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("label", "precision", "recall", f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return per_label(df, labels).agg(ratio(F.sum("f1"), F.lit(len(labels))).alias("macro_f1"))


def rates(df: DataFrame, group: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """All rates of df (gold, predicted, success), in one aggregation, by group if one is given."""
    ok = F.col("success") & F.col("predicted").isNotNull()
    low, top = labels[0], labels[-1]
    count = lambda c: F.count_if(ok & c)
    gold, pred = F.col("gold"), F.col("predicted")
    n = count(F.lit(True))
    tp, fp, fn, tn = count((gold != low) & (pred != low)), count((gold == low) & (pred != low)), count((gold != low) & (pred == low)), count((gold == low) & (pred == low))
    highs, missed = count(gold == top), count((gold == top) & (pred != top))
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        n.alias("valid"),
        F.count_if(~F.col("success")).alias("failed"),
        ratio(count(gold == pred), n).alias("accuracy"),
        ratio(fp, count(gold == low)).alias("safe_false_positive_rate"),
        ratio(count(_level(pred, labels) < _level(gold, labels)), n).alias("severe_underestimate_rate"),
        ratio(missed, highs).alias("high_miss_rate"),
        F.when(highs == 0, 0.0).otherwise(F.round(1.0 - ratio(missed, highs), 6)).alias("high_recall"),
        ratio(count((gold == top) & (pred == low)), highs).alias("high_to_safe_rate"),
        ratio(tp, tp + fp).alias("risk_precision"),
        ratio(tp, tp + fn).alias("risk_recall"),
        ratio(tp + tn, n).alias("risk_accuracy"),
        ratio(F.count_if(~F.col("success")), F.count(F.lit(1))).alias("failure_rate"),
    )
    return out.withColumn("risk_f1", ratio(2 * F.col("risk_precision") * F.col("risk_recall"), F.col("risk_precision") + F.col("risk_recall")))


def engineering(df: DataFrame) -> DataFrame:
    """failure rate over all rows; mean seconds and opinions, and verified share of citations, over valid ones."""
    ok = F.col("success") & F.col("predicted").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return df.agg(
        ratio(F.count_if(~F.col("success")), F.count(F.lit(1))).alias("failure_rate"),
        ratio(total("seconds"), F.count_if(ok)).alias("avg_seconds"),
        ratio(total("opinions"), F.count_if(ok)).alias("avg_opinions"),
        ratio(total("verified"), total("citations")).alias("verified_ratio"),
    )


def delta(metrics: DataFrame, group: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """second minus first of each metric: rows (metric, first, second, delta) of metrics with a row for each group."""
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    rows = [F.struct(F.lit(c).alias("metric"), pick(first, c).alias("first"), pick(second, c).alias("second")) for c in columns]
    return metrics.agg(F.array(*rows).alias("all")).select(F.inline("all")).withColumn("delta", F.round(F.col("second") - F.col("first"), 6))


def paired(samples: DataFrame, first: DataFrame, second: DataFrame, key: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Both runs of each sample (key, gold) with category and flags. A failed run without a label still counts as a false alarm or a miss."""
    out = samples.join(first.select(key, F.col("predicted").alias("first")), key, "left").join(second.select(key, F.col("predicted").alias("second")), key, "left")
    right1, right2 = F.col("first").eqNullSafe(F.col("gold")), F.col("second").eqNullSafe(F.col("gold"))
    category = F.when(~right1 & right2, "improved").when(right1 & ~right2, "regressed").when(right1, "same_correct").otherwise("same_wrong")
    differs = ~F.col("second").eqNullSafe(F.col("gold"))
    return out.withColumn("category", category).withColumn("false_alarm", (F.col("gold") == labels[0]) & differs).withColumn("missed", (F.col("gold") == labels[-1]) & differs)


def distribution(df: DataFrame, column: str, levels: Sequence[str], none: str) -> DataFrame:
    """Count of each level, zero-filled, and of all that aren't ``none``."""
    counts = [F.struct(F.lit(x).alias("level"), F.count_if(F.col(column) == x).alias("n")) for x in levels]
    return df.agg(F.array(*counts).alias("all"), F.count_if(F.col(column) != none).alias("risky")).select(F.inline("all"), "risky")


def failures(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows that failed or whose label is below the gold one."""
    return df.filter(~F.col("success") | (_level(F.col("predicted"), labels) < _level(F.col("gold"), labels)))


def report(df: DataFrame, group: str) -> DataFrame:
    """(group, metric, value) of all rates, a row each, for a metrics file."""
    out = rates(df, [group])
    values = [c for c in out.columns if c != group]
    return out.select(group, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(group, values, "metric", "value")
