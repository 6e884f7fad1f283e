"""Event logs: sequence numbers, epochs, terminal events, idle gaps, latest states, replay.

Each exists as a batch computation over a log and, where state is needed, as a streaming one with bounded state a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def sequenced(log: DataFrame, key: str, order: Sequence[str], resets: Column | None = None) -> DataFrame:
    """Adds epoch and seq (from 1 in each epoch); a row where ``resets`` holds begins an epoch."""
    w = Window.partitionBy(key).orderBy(*order)
    out = log.withColumn("epoch", F.lit(0).cast("long") if resets is None else F.sum(F.when(resets, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(key, "epoch").orderBy(*order)))


def last_epoch(log: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """Rows of each key's newest epoch; those of earlier owners go."""
    newest = log.groupBy(key).agg(F.max(epoch).alias("__newest"))
    return log.join(newest, key).filter(F.col(epoch) == F.col("__newest")).drop("__newest")


def until_terminal(log: DataFrame, key: str, order: Sequence[str], terminal: Column) -> DataFrame:
    """Rows of each key up to its first terminal one, which is kept."""
    first = log.filter(terminal).groupBy(key).agg(F.min(F.struct(*order)).alias("__end"))
    return log.join(first, key, "left").filter(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).drop("__end")


def idle_gaps(log: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """Rows that come more than ``seconds`` after their key's last one."""
    w = Window.partitionBy(key).orderBy(at, tie)
    out = log.withColumn("last_at", F.lag(at).over(w)).withColumn("gap_seconds", F.unix_micros(F.col(at).cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_at").cast("timestamp")) / 1e6)
    return out.filter(F.col("gap_seconds") > seconds)


def sessions(log: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Sessions that ``gap`` without an event ends; also on streams with a watermark."""
    return log.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def latest_state(log: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("n_events"))


def timeline(log: DataFrame, key: str, order: str, kind: str, text: str, folded: Sequence[str]) -> DataFrame:
    """Neighbouring rows of the same kind, for kinds that fold, as one with their texts joined."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.coalesce(F.col(kind).isin(*folded) & (F.lag(kind).over(w) == F.col(kind)), F.lit(False))
    rows = log.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("said")))), lambda x: x["said"])
    return rows.groupBy(key, "block").agg(F.min(kind).alias(kind), F.array_join(parts, "").alias(text), F.count(F.lit(1)).alias("n"))


def calls(log: DataFrame, key: str, call: str, kind: str, start: str, end: str, at: str) -> DataFrame:
    """Tool calls with when they started and ended; open ones are closed without an end."""
    pick = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    return log.filter(F.col(kind).isin(start, end)).groupBy(key, call).agg(pick(start).alias("started"), pick(end).alias("ended")).withColumn("open", F.col("ended").isNull())


def replay(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A log's files as a stream from the start."""
    return spark.readStream.schema(schema).parquet(folder)


def sink_once(path: str, key: str):
    """A foreachBatch function that appends each key once, however often a batch is run again."""
    from corpusloom.sources.sinks import append_new

    return lambda batch, _: append_new(batch, path, key)


def until_terminal_stream(stream: DataFrame, key: str, order: str, kind: str, terminal: Sequence[str], keep_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Streaming form of :func:`sequenced` with :func:`until_terminal`: adds seq; what follows a terminal event goes.

    Events are put in order within a micro-batch only: one that comes in a later batch gets a later seq, whatever its order says, and
    goes if its key's terminal event came in an earlier batch. Sources that keep a key's order (one partition a key) need no more.

    State is two values a key, dropped ``keep_ms`` after its last event. With the availableNow trigger, set
    spark.sql.streaming.noDataMicroBatches.enabled to false: timeouts ask for further batches without end.
    """
    schema = StructType([*stream.schema.fields]).add("seq", "long")
    names = stream.columns

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, closed = state.get if state.exists else (0, False)
        parts = [f for f in frames if len(f)]
        if parts and not closed:
            frame = pd.concat(parts).sort_values(order, kind="stable").reset_index(drop=True)
            ends = frame.index[frame[kind].isin(tuple(terminal))]
            if len(ends):
                frame, closed = frame.iloc[: ends[0] + 1], True
            yield frame.assign(seq=range(seq + 1, seq + 1 + len(frame)))[[*names, "seq"]]
            seq += len(frame)
        state.update((seq, closed))
        state.setTimeoutDuration(keep_ms)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "seq long, closed boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, started, last, n) of each key's sessions: an event ends a session if ``gap`` passes without another.

    Events may come ``late`` at most; a session's state goes when that has passed too.
    """
    out = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("window"), key).agg(F.min(at).alias("started"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.drop("window")


def settled(totals: DataFrame, folder: str) -> DataFrame:
    """The whole result of an aggregated stream when all its input has been read, written to a folder and read from there."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(folder)
    totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return totals.sparkSession.read.schema(totals.schema).parquet(folder)
