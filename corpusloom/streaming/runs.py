"""Runs that pause for an answer and go on: a log of events and a stream of answers, as a batch and with durable state.

Rows of both are (key, at, id, kind), put in order by (at, id), where ``at`` is a long of microseconds.

* A run emits its events in order, each with the next sequence number of its key.
* An event of a kind that ``asks`` is emitted, and the run waits. While it waits, its events are held; another one that asks is part of the
  same question and goes.
* An answer ``resumes`` a run that waits: it is emitted, then what was held, and the run goes on. An answer ``cancels`` it: it is emitted, and
  what was held and all that follows goes. An answer to a run that doesn't wait goes.
* What is still held when the log ends stays held and isn't emitted.

Rows without a key or a time go. Rows that repeat one id stay apart, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps lists and timers of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"
_ROW = "at long, id long, kind string"


@dataclass(frozen=True)
class Kinds:
    """The kinds of rows that ask, that resume a run and that cancel it; all others are plain events."""

    asks: tuple[str, ...]
    resumes: tuple[str, ...]
    cancels: tuple[str, ...] = ()


def replayed(rows: DataFrame, kinds: Kinds) -> DataFrame:
    """The batch form: (key, seq, id, kind) of what all runs emit.

    Whether a run waits depends on its last row that asks or resumes alone, so windows over a key's rows are enough. A cancelling answer
    counts if the run waits; the first one ends it.
    """
    of, order = Window.partitionBy("key"), [F.col("at"), F.col("id")]
    before = of.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # what follows, read backwards: a running value is enough
    after = of.orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda names: F.col("kind").isin(*names) if names else F.lit(False)
    turn = F.when(is_(kinds.asks), True).when(is_(kinds.resumes), False)
    known = rows.select("key", "at", "id", F.coalesce("kind", F.lit("")).alias("kind")).filter("key is not null and at is not null")
    seen = known.withColumn("nth", F.row_number().over(of.orderBy(*order))).withColumn("waits", F.coalesce(F.last(turn, True).over(before), F.lit(False)))
    ended = seen.withColumn("end", F.min(F.when(is_(kinds.cancels) & F.col("waits"), F.col("nth"))).over(of)).filter("end is null or nth <= end")
    answer = is_(kinds.resumes) | is_(kinds.cancels)
    kept = ended.filter(~(is_(kinds.asks) & F.col("waits")) & ~(answer & ~F.col("waits")))
    held = F.col("waits") & ~answer
    out = kept.withColumn("due", F.when(~held, F.col("nth")).otherwise(F.min(F.when(is_(kinds.resumes), F.col("nth"))).over(after)))
    seq = F.row_number().over(of.orderBy("due", held.cast("int"), "nth"))
    return out.filter("due is not null").select("key", seq.cast("long").alias("seq"), "id", "kind")


class Run(StatefulProcessor):
    """A key's run: rows that the watermark hasn't passed, what is held, the next number and whether it waits or has ended."""

    def __init__(self, kinds: Kinds):
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", _ROW)
        self.held = handle.getListState("held", _ROW)
        self.phase = handle.getValueState("phase", "seq long, waits boolean, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [(int(a), None if pd.isna(i) else int(i), k) for f in rows for a, i, k in zip(f["at"], f["id"], f["kind"])]
        if come and not (self.phase.exists() and self.phase.get()[2]):
            self.early.appendList(come)
            self.handle.registerTimer(max(1, min(a for a, _, _ in come) // 1000 + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((a, i, k) for a, i, k in self.early.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        due = [r for r in rows if r[0] // 1000 < passed]
        rest = rows[len(due) :]
        if due:
            self.early.clear()
            if rest:
                self.early.put(rest)
                self.handle.registerTimer(max(1, rest[0][0] // 1000 + 1))
            out = self._gone_on(due)
            if out:
                seq, ids, kinds = zip(*out)
                yield pd.DataFrame({"key": [key[0]] * len(out), "seq": seq, "id": pd.array(ids, "Int64"), "kind": pd.Series(kinds, dtype=object)})

    def _gone_on(self, rows: list[tuple]) -> list[tuple]:
        seq, waits, ended = self.phase.get() if self.phase.exists() else (0, False, False)
        held, out = [], []
        was_held = bool(waits) and self.held.exists()

        def emit(row):
            nonlocal seq
            seq += 1
            out.append((seq, row[1], row[2]))

        for row in rows:
            kind = row[2]
            if ended:
                break
            if waits and kind in self.kinds.resumes:
                emit(row)
                for old in [*(self.held.get() if was_held else ()), *held]:
                    emit(tuple(old))
                held, waits, was_held = [], False, False
                self.held.clear()
            elif waits and kind in self.kinds.cancels:
                emit(row)
                held, ended, was_held = [], True, False
                self.held.clear()
            elif waits and kind not in self.kinds.asks:
                held.append(row)
            elif not waits and kind not in (*self.kinds.resumes, *self.kinds.cancels):
                emit(row)
                waits = kind in self.kinds.asks
        if held:
            self.held.appendList(held)
        if ended:
            self.early.clear()
        self.phase.update((seq, waits, ended))
        return out

    def close(self) -> None:
        pass


def streamed(events: DataFrame, answers: DataFrame, kinds: Kinds, late: str = "1 hour", key_type: str = "long") -> DataFrame:
    """The streaming form of :func:`replayed` over two streams of (key, at, id, kind).

    Rows wait until the watermark, ``late`` behind the newest row of the slower stream, has passed them, so their order and numbers don't
    depend on how they are dealt to micro-batches; what comes later than that is dropped. State is durable: started again on its
    checkpoint after a kill, the query goes on where it was. Needs :data:`STORE` as the session's state store, see :func:`durable`.
    """
    wide = [s.select("key", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), F.coalesce("kind", F.lit("")).alias("kind")).filter("key is not null and at is not null").withColumn("time", F.timestamp_micros("at")).withWatermark("time", late) for s in (events, answers)]
    both = wide[0].unionByName(wide[1])
    return both.groupBy("key").transformWithStateInPandas(Run(kinds), f"key {key_type}, seq long, id long, kind string", "Append", "EventTime")


class durable:
    """While it is open, the session's streams keep their state in :data:`STORE`, and timers that are due when all input is read still go off."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, {}

    def __enter__(self) -> None:
        for key, value in ((_CONF, STORE), ("spark.sql.streaming.noDataMicroBatches.enabled", "true")):
            self.before[key] = self.spark.conf.get(key, None)
            self.spark.conf.set(key, value)

    def __exit__(self, *_) -> None:
        for key, value in self.before.items():
            self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)


def settle(stream: DataFrame, folder: str, checkpoint: str, max_batches: int | None = None) -> None:
    """Runs a stream over all input that is there and appends what it emits to files of a folder, each row once, also if it is run again.

    max_batches: it is stopped after about so many micro-batches, as if it were killed between two of them.
    """
    query = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if max_batches is None:
        query.awaitTermination()
        return
    while query.isActive and len(query.recentProgress) < max_batches:
        query.awaitTermination(0.05)
    query.stop()
