"""Folds, bounded samples and batch mapping for the operators that learn."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm._store import give_back, modest_batches

#: A document is held out when the crc32 of its id, as text, leaves 0 by this.
FOLDS = 5


_KINDS = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType()}


def columns(**kinds: str) -> StructType:
    """Nullable columns by name and kind; unlike parsing DDL, it needs no session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in kinds.items()])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def thinned(df: DataFrame, by: str, most: int, ids_by: dict) -> DataFrame:
    """The rows of about ``most`` ids of each value of ``by`` (of all ids, if it has fewer), drawn by a 64-bit hash of doc_id: the same in each run.

    ids_by: about how many distinct ids each value has. The threshold has 64 bits too, so a value of any size keeps its share.
    """
    least = -(1 << 63)
    bounds = {v: least + (most << 64) // n for v, n in ids_by.items() if n > most}
    if not bounds:
        return df.filter(F.col(by).isin(*ids_by)) if ids_by else df.limit(0)
    bound = F.try_element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col(by))
    return df.filter(F.col(by).isin(*ids_by) & (bound.isNull() | (F.xxhash64("doc_id", F.lit("sample")) < bound)))


def ids_by(df: DataFrame, by: str) -> dict:
    """About how many distinct ids each value of ``by`` has: one row of sketches for each value, combined before the shuffle."""
    return {r[by]: max(1, r["n"]) for r in df.groupBy(by).agg(F.approx_count_distinct("doc_id").alias("n")).collect()}


def labelled(documents: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(doc_id, text, y): about ``most`` labelled documents of each class of ``target`` outside the held-out fold.

    Only labels is counted; the sampled ids, of a number bounded by ``most``, are broadcast to the documents. An id with both
    labels has 1. Of rows that repeat an id, the least text is taken, so that the sample is bounded however often one repeats.
    Raises ValueError if a class has labels, but none is drawn.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = ids_by(known, "y")
    ids = thinned(known, "y", most, counts).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("least"))
    drawn = ids.agg(*(F.max((F.col("y") == y) | (F.col("least") == y)).alias(f"has{y}") for y in (0, 1))).first()
    if any(not drawn[f"has{y}"] for y in counts):
        raise ValueError(f"no {target} label of a class was drawn")
    found = documents.select("doc_id", "text").join(F.broadcast(ids.drop("least")), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def with_columns(df: DataFrame, added: StructType, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with columns that ``compute`` makes of each Arrow batch; columns of df that have an added name are replaced."""
    modest_batches(df.sparkSession)
    own = df.drop(*added.names) if set(added.names) & set(df.columns) else df
    out = StructType([*own.schema.fields, *added.fields])

    def run(batches):
        for batch in batches:
            arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in compute(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added.names])
        give_back()

    return own.mapInArrow(run, out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[d]..first[d + 1] of values for each d, 0 for empty ranges; a range's sum doesn't depend on the others."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: first[-1]], first[some], axis=0)
    return out
