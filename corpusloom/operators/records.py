"""JSON records of an interface: decoded by a schema without losing what it doesn't know, and partial rows settled against full ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import let


def decoded(rows: DataFrame, column: str, schema: StructType) -> DataFrame:
    """rows with record (by the schema), rescued and malformed.

    rescued maps fields that the schema hasn't, and fields whose value doesn't fit its type, to their text (nested ones as JSON); JSON null
    is no value. malformed is true for what is no JSON object, with record and rescued null; null is null and not malformed.
    """
    names = F.array(*map(F.lit, schema.names)) if schema.names else F.array().cast("array<string>")
    both = F.struct(F.from_json(column, schema).alias("record"), F.from_json(column, "map<string,string>").alias("raw"))

    def told(b: Column) -> Column:
        unfit = F.array_compact(F.array(*(F.when(b["record"][n].isNull(), F.lit(n)) for n in schema.names))) if schema.names else F.array().cast("array<string>")
        rescued = F.map_filter(b["raw"], lambda k, v: v.isNotNull() & (~F.array_contains(names, k) | F.array_contains(unfit, k)))
        there = b["raw"].isNotNull()
        return F.struct(F.when(there, b["record"]).alias("record"), rescued.alias("rescued"), (F.col(column).isNotNull() & ~there).alias("malformed"))

    return rows.withColumn("__told", let(both, told)).select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("record", "rescued", "malformed")), "__told.*")


def content_of(response: Column, needs_one_of: Sequence[str]) -> Column:
    """The fields of a detail response, as a map; null for a refusal, a response without content, or one that has none of the fields needed.

    A response is ``{"code": 0, "data": {"data": {...}}}``; its code may be a number or a text. One that is beyond a quota has another code.
    """

    def checked(r: Column) -> Column:
        fields = r["data"]["data"]
        useful = F.exists(F.array(*map(F.lit, needs_one_of)), lambda n: F.coalesce(F.try_element_at(fields, n), F.lit("")) != "")
        return F.when((r["code"] == "0") & useful, fields)

    return let(F.from_json(response, "code string, data struct<data: map<string,string>>"), checked)


def with_content(items: DataFrame, responses: DataFrame, key: str, fields: dict[str, str], response: str = "response") -> DataFrame:
    """items with the fields of their content ({column: field}) and content_full; without a valid response a column keeps the item's own value.

    Of several valid responses to one key the one with the least text counts, so reruns agree; items whose key is null have none.
    """
    content = responses.select(F.col(key).alias("__key"), content_of(F.col(response), list(fields.values())).alias("__c"), F.col(response).alias("__r"))
    content = content.filter("__key IS NOT NULL AND __c IS NOT NULL").groupBy("__key").agg(F.min_by("__c", "__r").alias("__c"))
    out = items.join(content, F.col(key) == F.col("__key"), "left")
    said = lambda f: F.nullif(F.try_element_at("__c", F.lit(f)), F.lit(""))
    kept = [F.coalesce(said(fields[c]), F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in items.columns if c != "content_full"]
    new = [said(f).alias(c) for c, f in fields.items() if c not in items.columns]
    return out.select(*kept, *new, F.col("__c").isNotNull().alias("content_full"))


def settled(old: DataFrame, new: DataFrame, key: str, full: str = "content_full") -> DataFrame:
    """One row a key: a full one before a partial one, then a new one before an old one, then the least by all columns.

    So a later partial row never takes the place of a full one, and a full one replaces a partial one whenever it comes. Rows whose key
    is null are one key's. Rows are combined before the shuffle; columns that ``old`` hasn't are dropped. Maps have no order: none may be in ``old``.
    """
    both = old.withColumn("__age", F.lit(1)).unionByName(new.select(*(F.col(f"`{c}`") for c in old.columns)).withColumn("__age", F.lit(0)))
    partial = F.when(F.col(full), 0).otherwise(1)
    row = F.struct(*(F.col(f"`{c}`") for c in old.columns))
    return both.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(partial.alias("p"), F.col("__age").alias("a"), row.alias("row"))).alias("best")).select("best.row.*")
