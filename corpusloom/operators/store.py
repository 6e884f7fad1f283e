"""Relational semantics over tables without transactions: upsert, insert-ignore, partial update, cascades, audits.

Each takes whole DataFrames and returns the table's new contents; writing them is one atomic overwrite by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.windows import keep_least
from corpusloom.sources.sinks import held


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The newest change of each key replaces its row, or is added."""
    newest = keep_least(changes.withColumn("__o", -F.col(order).cast("long")), key, [F.col("__o")]).drop("__o")
    return table.join(newest.select(*key), list(key), "left_anti").unionByName(newest.select(*table.columns))


def numbered(rows: DataFrame, order: Sequence[str], first: int = 1, as_: str = "id") -> DataFrame:
    """rows with gapless numbers from ``first`` in the order of columns, without one task that sorts all.

    Ranges are sorted side by side and written once with each row's place in its range; where a range starts follows from the counts
    of those before it, of which there is one a range. Rows that tie are in the order of all their columns, and equal rows, which
    may be a third of all, are dealt to many ranges. Of an empty table nothing is numbered.
    """
    whole = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rows.columns))
    tied = rows.select("*", whole.alias("__tie"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("__deal"))
    keys = [*(F.col(f"`{c}`") for c in order), F.col("__tie"), F.col("__deal")]
    place = F.monotonically_increasing_id()
    ranges = held(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", place).drop("__tie", "__deal"), "numbered")
    part = F.shiftright("__place", 33)
    counts = ranges.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    within = F.col("__place") - F.shiftleft(F.col("__part").cast("long"), 33)
    return ranges.withColumn("__part", part).join(F.broadcast(starts), "__part").select((F.col("__start") + within + F.lit(first)).alias(as_), *(F.col(f"`{c}`") for c in rows.columns))


def insert_returning(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with the rows, the rows as inserted): keys go on after the table's greatest, from 1 in an empty one, in the order of columns.

    rows have the table's columns but for the key; those that they lack are null.
    """
    last = table.agg(F.max(key)).first()[0] or 0
    added = numbered(rows, order, last + 1, key)
    return table.unionByName(added, allowMissingColumns=True), added


def insert_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key that the table doesn't have is added."""
    fresh = rows.join(table.select(*key), list(key), "left_anti")
    return table.unionByName(keep_least(fresh, key, order).select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-null changes replace values; null leaves them."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(new, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete_cascade(tables: Mapping[str, DataFrame], parents: Mapping[str, tuple[str, str, str]], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Deletes doomed keys of the root table and, by foreign key, all that hangs on them.

    parents: {child: (column, parent, parent's key)}, parents before children.
    """
    key = doomed.columns[0]
    gone, out = {root: doomed}, {root: tables[root].join(doomed, key, "left_anti")}
    for child, (column, parent, parent_key) in parents.items():
        if parent not in gone:
            out[child] = tables[child]
            continue
        ids = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        out[child] = tables[child].join(ids, column, "left_anti")
        gone[child] = tables[child].join(ids, column, "left_semi")
    return out


def audit(table: DataFrame, checks: Mapping[str, Column], unique: Mapping[str, Sequence[str]] | None = None, references: Mapping[str, tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """(constraint, violations): rows that fail each check, extra rows of unique keys, references without a target."""
    counted = table.agg(F.array(*(F.struct(F.lit(n).alias("constraint"), F.count_if(~F.coalesce(c, F.lit(False))).alias("violations")) for n, c in checks.items())).alias("all")).select(F.inline("all"))
    for name, key in (unique or {}).items():
        extra = table.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        counted = counted.unionByName(extra.select(F.lit(name).alias("constraint"), "violations"))
    for name, (column, parent, key) in (references or {}).items():
        lost = table.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        counted = counted.unionByName(lost.select(F.lit(name).alias("constraint"), "violations"))
    return counted


def migrated(table: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """A table of an older shape in a newer one: columns that are missing have their default, or null; others are cast and stay last."""
    own = {c: F.col(f"`{c}`") for c in table.columns}
    made = [own.get(f.name, F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields]
    return table.select(*made, *(c for n, c in own.items() if n not in schema.names))


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> None:
    """Creates a catalog table if it isn't there, and adds columns that it lacks; run again, it changes nothing."""
    columns = lambda fields: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns(schema.fields)}) USING parquet")
    there = set(spark.table(name).columns)
    if lacking := [f for f in schema.fields if f.name not in there]:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns(lacking)})")
