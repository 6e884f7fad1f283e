"""Mixing sources to target weights along a curriculum that changes over training.

Every source has a weight and a schedule: a piecewise linear multiplier over training time 0..1. The weights fix how many
words the mix takes of each source (its target); the schedule fixes when. Training time is found by inverting the source's
cumulative demand: with the schedule's integral ``D`` and a document copy whose middle lies at the share ``u`` of its
source's target, its position is the time ``t`` with ``D(t) / D(1) = u``. Documents are range-sorted by position.

All of it is DataFrame expressions. Running sums within a source, however large, are two-level: a source's documents are
dealt to 16^``SLOT_DIGITS`` slots by the front of their md5, the slots are summed, and only the totals of slots with one front, of a
source's fronts, and the documents of one slot are ever ordered together. So one source with a third of all rows is many tasks, not one. :func:`mix_table` counts words
in one scan of the texts, writes them, and reads only narrow columns from then on; :func:`curriculum` reads the texts once to sum
the slots and once to deal them out.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, last; a source whose texts
are all empty has target 0; repeated rows (equal ids) are separate documents, which follow each other in an order of their texts; rows without an id are drawn
by their text; an empty table gives no row; other columns are ignored by :func:`mix_table` and kept by :func:`curriculum`, where
``mix_position`` and ``mix_pass`` are replaced if present. Memory: a task holds a text and, where the target cuts it, its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import kept

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules by weight class: (time, multiplier) knots. Heavy sources lead early, light ones are annealed in late.
SCHEDULES = (
    ((0.0, 1.3), (0.7, 1.0), (1.0, 0.4)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)),
)
#: Words of the mix per word of the corpus, and the most often that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Hexadecimal digits of a document's md5 that say which slot of its source it is in.
SLOT_DIGITS = 4


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each source.

    sizes: one row per source (source, source_size, source_rows). Returns it with weight_class and target. Sharing by weight,
    capping at ``most`` times the source's size and resharing the excess until none is above ends where every target is
    min(most x size, level x weight) for one common level. Sources fill up in ascending order of cap / weight, so with those
    below summed, the level is found directly from running sums. Only distinct sources are ordered, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fill_at", F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    kinds = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight_class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.get(kinds, F.col("weight_class"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    ranked = ranked.withColumn("fill_at", F.col("cap") / F.col("weight"))
    budget = F.lit(share) * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    # the level if exactly the sources below this one are capped; right for the first source that this level doesn't fill
    ranked = ranked.withColumn("level_here", (budget - capped) / open_weight).withColumn("nth", F.row_number().over(fill))
    level = F.min_by("level_here", F.when(F.col("level_here") <= F.col("fill_at"), F.col("nth"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select(*sizes.columns, "weight_class", "target")


def _time_of(share: Column, knots) -> Column:
    """The time at which a piecewise linear schedule has used the given share of its integral."""
    areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:])]
    total, done = sum(areas), 0.0
    when = None
    for ((t0, m0), (t1, m1)), area in zip(zip(knots, knots[1:]), areas):
        rest = share * total - F.lit(done)
        slope = (m1 - m0) / (t1 - t0)
        # m0 x + slope x^2 / 2 = rest, in the form that also holds for slope 0
        x = 2 * rest / (F.lit(m0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(m0 * m0) + F.lit(2 * slope) * rest)))
        done += area
        step = F.lit(t0) + x
        when = F.when(share * total <= done, step) if when is None else when.when(share * total <= done, step)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), when.otherwise(F.lit(1.0))))


def position(weight_class: Column, share: Column, schedules=SCHEDULES) -> Column:
    """Training time of the given share of a source's demand."""
    out = None
    for k, knots in enumerate(schedules):
        at = _time_of(share, knots)
        out = F.when(weight_class == k, at) if out is None else out.when(weight_class == k, at)
    return out


def _sized(documents: DataFrame, *carried: Column) -> DataFrame:
    """Of each document (doc_id, source, text): size, its source as a key, its slot there, and ``draw``, its place in the source's fixed order."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))
    draw = F.concat(draw, F.md5(F.coalesce("text", F.lit(""))))  # rows that share an id follow each other by their texts
    return documents.select(*carried, "doc_id", "source", key.alias("key"), draw.alias("draw"), words(F.col("text")).alias("size")).withColumn("slot", F.substring("draw", 1, SLOT_DIGITS))


def _placed(sized: DataFrame, weights, share, most) -> DataFrame:
    """sized with source_size, weight_class, target and ``begin``, the words of its source before it.

    Whatever else a row carries is shuffled once, by source and slot; the slots' totals are joined as that lies.
    """
    totals = kept(sized.groupBy("key", "source", "slot").agg(F.sum("size").alias("slot_size"), F.count(F.lit(1)).alias("slot_rows")), "slots")
    sizes = totals.groupBy("key", "source").agg(F.sum("slot_size").alias("source_size"), F.sum("slot_rows").alias("source_rows"))
    goals = targets(sizes, weights, share, most).select("key", "source_size", "weight_class", "target")
    # slots are summed up in two steps as well: those of one front, and the fronts of a source
    totals = totals.withColumn("front", F.substring("slot", 1, (SLOT_DIGITS + 1) // 2))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    fronts = totals.groupBy("key", "front").agg(F.sum("slot_size").alias("front_size"))
    fronts = fronts.select("key", "front", F.coalesce(F.sum("front_size").over(before("key", "front")), F.lit(0)).alias("front_begin")).join(goals, "key")
    begins = totals.select("key", "front", "slot", F.coalesce(F.sum("slot_size").over(before("key", "front", "slot")), F.lit(0)).alias("in_front")).join(fronts, ["key", "front"])
    begins = begins.withColumn("slot_begin", F.col("front_begin") + F.col("in_front")).drop("front", "front_begin", "in_front")
    inside = Window.partitionBy("key", "slot").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_slot", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(begins, ["key", "slot"])
    return placed.withColumn("begin", F.col("slot_begin") + F.col("in_slot")).drop("key", "slot", "slot_begin", "in_slot", "draw")


def _taken(begin: Column, pass_no: Column) -> Column:
    """Words that pass ``pass_no`` (0, 1, ...) over a source takes of the document that begins there."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - pass_no * F.col("source_size") - begin)).cast("long")


def _passes(most: float) -> int:
    return int(-(-most // 1))


def _middle(pass_no: Column, take: Column) -> Column:
    """The share of its source's target at which the middle of a copy lies."""
    return (F.col("begin") + pass_no * F.col("source_size") + take / 2) / F.floor("target")


def mix_table(documents: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per document (doc_id, source, text): size, source_size, target, ``taken``, its words in the mix, repeats counted, and positions.

    A source is passed over in a fixed hashed order until its target is met, so its taken words add up to the target rounded
    down; at most one document of a source is cut at a word, and none is taken more than ``most`` times. positions holds the
    training positions of its copies, none for a document that isn't taken. Rows are range-sorted by first position.
    """
    placed = _placed(kept(_sized(documents), "sized"), weights, share, most)
    takes = [_taken(F.col("begin"), F.lit(k)) for k in range(_passes(most))]
    taken = sum(takes[1:], takes[0])
    at = F.array(*(F.when(take > 0, position(F.col("weight_class"), _middle(F.lit(k), take), schedules)) for k, take in enumerate(takes)))
    out = placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "source", F.array_compact(at).alias("positions"))
    return out.repartitionByRange(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), F.col("doc_id")).sortWithinPartitions(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), "doc_id")


def curriculum(documents: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the columns of documents, a row for each pass that takes a document, range-sorted by training position.

    Adds mix_pass (0, 1, ...) and mix_position (0..1). A document that its source's target cuts keeps the words that are taken.
    """
    extra = [c for c in documents.columns if c not in ("mix_pass", "mix_position")]
    placed = _placed(_sized(documents, F.struct(*(F.col(f"`{c}`") for c in extra)).alias("row")), weights, share, most)
    placed = placed.withColumn("mix_pass", F.explode(F.array(*map(F.lit, range(_passes(most)))))).withColumn("take", _taken(F.col("begin"), F.col("mix_pass")))
    placed = placed.filter("take > 0")
    up_to_ends = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("take") < F.col("size"), F.array_join(F.slice(up_to_ends, F.lit(1), F.col("take").cast("int")), "")).otherwise(F.col("row.text"))
    placed = placed.withColumn("row", F.col("row").withField("text", cut)).withColumn("mix_position", position(F.col("weight_class"), _middle(F.col("mix_pass"), F.col("take")), schedules))
    out = placed.select("row.*", "mix_pass", "mix_position")
    return out.repartitionByRange(F.col("mix_position"), F.col("doc_id"), F.col("mix_pass")).sortWithinPartitions("mix_position", "doc_id", "mix_pass")
