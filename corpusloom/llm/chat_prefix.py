r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted turns before it are context, and its text alone is under the
loss mask. A turn is written ``<|im_start|>role\ntext<|im_end|>\n``; inside role and text a backslash is doubled and ``<|``
becomes ``<\|``, so no control string can arise from them, and reading back is exact (a line end in a role is ``\l``).
A conversation that doesn't end in an assistant turn has one more row, with all of its turns and nothing under the mask.

It is window functions and string expressions only: one shuffle by conversation. An example holds all turns before it, so its
output grows with the square of a conversation's turns by definition; rows are made one at a time, and a conversation is the
largest unit that is held.

Defined results: null text and null role are empty; rows are ordered by turn (null first), then role and text, and repeated
rows are turns of their own; a null conv_id is a conversation; only the role ``assistant`` is trained on; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\l", "$1\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars) of conversations (conv_id, turn, role, text).

    example counts from 0; the loss mask of text is loss_chars characters from loss_start (from 0).
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    turns = turns.withColumn("said", escape(F.col("said"))).withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trained = F.col("role") == TRAINED
    rows = turns.withColumn("prefix", F.collect_list(F.concat("head", "said", F.lit(CLOSE))).over(so_far))
    rows = rows.withColumn("after", F.lead(F.lit(1)).over(order)).withColumn("example", F.sum((trained | F.col("after").isNull()).cast("int")).over(so_far) - 1)
    rows = rows.filter(trained | F.col("after").isNull()).withColumn("text", F.array_join("prefix", ""))
    chars = F.when(trained, F.length("said")).otherwise(0)
    return rows.select("conv_id", F.col("example").cast("long").alias("example"), "text", (F.length("text") - len(CLOSE) - F.length("said")).alias("loss_start"), chars.alias("loss_chars"))


def turns_of(text: Column) -> Column:
    """The turns of an example's text as an array of (role, text) structs, as they were before formatting."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(text, r"<\|im_start\|>")) - 1))
    return F.transform(parts, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(CLOSE))).alias("text")))


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """What is under the loss mask of an example, unescaped."""
    return unescape(F.substring(text, start + 1, chars))


def digests(rows: DataFrame) -> DataFrame:
    """Read back from examples: per conversation n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    loss = F.struct(F.col("example"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("said"))
    grouped = rows.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.array_sort(F.collect_list(loss)).alias("losses"), F.sum(F.length("text")).alias("formatted_chars"))
    turns = grouped.withColumn("turns", turns_of(F.col("text"))).withColumn("lost", F.array_join(F.transform("losses", lambda x: x["said"]), ""))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
