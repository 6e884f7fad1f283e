"""Exact deduplication by Grace hashing: records are partitioned by hash to spill files until a bucket fits a table in memory.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. What decides is always the complete
content: a table with open addressing finds a slot by 64 bits of the content's SHA-256, and takes a record for known only if all its bytes
are those of the slot's content.

1. *Combine.* Each task puts its records through a table of at most ``ROOM`` bytes of content, so that of a group's copies, however many,
   one content a task is spilled, with a number of its own (``local``) that the task's records carry.
2. *Partition.* The spilled contents are dealt to buckets by the front of their hash, about ``ROOM`` / 2 bytes to a bucket, and each bucket
   goes through a table. A content for which the table has no room is spilled again. All copies of a content that has a place meet it in the
   same pass, so what is spilled has no equal among what is settled.
3. *Recurse.* Spilled contents go by the next bits of their hash, until none is left. A table always has room for its first content, so each
   round settles some of each bucket.
4. Records find their group by ``local``, of which a task has at most as many rows as it read: no key is hot.

Of a group, the record with the most code points in its original text stays, then the smallest doc_id (null last), then the least hash of
the original text. Repeated rows are records of their own, one of which stays. Null text counts as empty; empty texts are equal. An empty
table gives no row. Extra columns are ignored by :func:`groups` and kept by :func:`deduplicated`, whatever their names.
Memory: ``ROOM`` bytes of content and their table, a batch, and the longest text three times.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpusloom.llm._store import give_back, kept, modest_batches, scratch

#: Bytes of content that one table holds.
ROOM = 32 << 20
#: Bits of the hash by which a bucket that doesn't fit is partitioned again.
DIGITS = 4
#: Bytes of content in one Arrow batch that a task gives out.
BATCH_BYTES = 4 << 20
#: The characters that don't count.
BLANKS = b" \t\n\x0b\x0c\r"


class Table:
    """Open addressing over complete contents: linear probing, at most half of the slots taken."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int32)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """The entry of a content, or -1 - the slot that it would take."""
        slots, hashes, last = self.slots, self.hashes, len(self.slots) - 1
        at = h & last
        while (entry := int(slots[at])) >= 0:
            if hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & last
        return -1 - at

    def add(self, slot: int, h: int, content: bytes) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        slots = np.full(2 * len(self.slots), -1, np.int32)
        last = len(slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & last
            while slots[at] >= 0:
                at = (at + 1) & last
            slots[at] = entry
        self.slots = slots


def normalised(text: str | None) -> bytes:
    """What is compared: the text's UTF-8 without blanks."""
    return (text or "").encode().translate(None, BLANKS)


def name(content: bytes) -> tuple[bytes, int]:
    """The SHA-256 of a content, and its front as a signed number."""
    digest = hashlib.sha256(content).digest()
    return digest, int.from_bytes(digest[:8], "big", signed=True)


def _order(best: tuple) -> tuple:
    """The record that stays comes first: (code points, doc_id, hash of the text, row)."""
    chars, doc_id, tie, row = best
    return -chars, doc_id is None, doc_id if doc_id is not None else 0, tie, row


#: A record of a content: how many equal rows it stands for and which of them stays.
_BEST = ("rows", "chars", "best_id", "tie", "best_row")


def _packed(rows: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()


def combined(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Records and contents of each task, in one table.

    A record has (row, local, and the carried columns); a content has (local, sha, h, content and the best of its records so far).
    """
    key = documents.schema["doc_id"].dataType
    renamed = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carry)]
    source = documents.select("doc_id", "text", *renamed)
    carried = source.schema.fields[2:]
    out = StructType(
        [
            *(StructField(c, LongType()) for c in ("row", "local")),
            StructField("doc_id", key),
            *carried,
            *(StructField(c, BinaryType()) for c in ("sha", "content")),
            *(StructField(c, LongType()) for c in ("h", "rows", "chars")),
            StructField("best_id", key),
            *(StructField(c, LongType()) for c in ("tie", "best_row")),
        ]
    )
    arrow, n_carried = to_arrow_schema(out), len(carried)
    modest_batches(documents.sparkSession)

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        table, best, count, digests, locals_ = Table(), [], [], [], []
        row = local = first

        def contents():
            rows, size = [], 0
            for entry, content in enumerate(table.contents):
                chars, doc_id, tie, at = best[entry]
                rows.append([None, locals_[entry], None, *[None] * n_carried, digests[entry], content, table.hashes[entry], count[entry], chars, doc_id, tie, at])
                size += len(content)
                if size > BATCH_BYTES or len(rows) >= 1000:
                    yield from _packed(rows, arrow)
                    size = 0
            yield from _packed(rows, arrow)

        for batch in batches:
            ids, texts, mine = batch.column("doc_id").to_pylist(), batch.column("text"), []
            for k, doc_id in enumerate(ids):
                text = texts[k].as_py() or ""
                content = normalised(text)
                digest, h = name(content)
                now = (len(text), doc_id, xxhash.xxh3_64_intdigest(text.encode()) >> 1, row)
                entry = table.find(h, content)
                if entry < 0 and table.bytes and table.bytes + len(content) > ROOM:
                    yield from contents()
                    table, best, count, digests, locals_ = Table(), [], [], [], []
                    entry = table.find(h, content)
                if entry < 0:
                    entry = table.add(-1 - entry, h, content)
                    best.append(now)
                    count.append(0)
                    digests.append(digest)
                    locals_.append(local)
                    local += 1
                elif _order(now) < _order(best[entry]):
                    best[entry] = now
                count[entry] += 1
                mine.append((row, locals_[entry]))
                row += 1
            n = len(ids)
            if n:
                given = {"row": pa.array([a for a, _ in mine], pa.int64()), "local": pa.array([b for _, b in mine], pa.int64()), "doc_id": batch.column("doc_id")}
                given |= {f.name: batch.column(f.name) for f in carried}
                yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)
        yield from contents()
        give_back()

    return source.mapInArrow(run, out)


def settled(pending: DataFrame) -> DataFrame:
    """A pass of each bucket of contents through a table.

    A settled content gives for each ``local`` of it (local, sha, rows, and the best of its group); one without room in the
    table comes back as it was, with its content.
    """
    schema = pending.drop("bucket").schema
    arrow = to_arrow_schema(schema)
    modest_batches(pending.sparkSession)

    def run(batches):
        table, groups, bucket = Table(), [], None

        def close():
            rows = []
            for digest, total, best, members in groups:
                for local in members:
                    rows.append([local, digest, None, None, total, *best])
                    if len(rows) >= 1000:
                        yield from _packed(rows, arrow)
            yield from _packed(rows, arrow)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("bucket", "local", "sha", "h", *_BEST)}
            contents, spilled, size = batch.column("content"), [], 0
            for k, b in enumerate(cols["bucket"]):
                if b != bucket:
                    yield from close()
                    table, groups, bucket = Table(), [], b
                content, h = contents[k].as_py(), cols["h"][k]
                entry = table.find(h, content)
                best = tuple(cols[c][k] for c in _BEST[1:])
                if entry < 0 and table.bytes and table.bytes + len(content) > ROOM:
                    spilled.append([cols["local"][k], cols["sha"][k], content, h, cols["rows"][k], *best])
                    size += len(content)
                    if size > BATCH_BYTES:
                        yield from _packed(spilled, arrow)
                        size = 0
                    continue
                if entry < 0:
                    table.add(-1 - entry, h, content)
                    groups.append([cols["sha"][k], cols["rows"][k], best, [cols["local"][k]]])
                    continue
                group = groups[entry]
                group[1] += cols["rows"][k]
                group[2] = min(group[2], best, key=_order)
                group[3].append(cols["local"][k])
            yield from _packed(spilled, arrow)
        yield from close()
        give_back()

    return pending.mapInArrow(run, schema)


def rounds(contents: DataFrame, room: int | None = None) -> Iterator[DataFrame]:
    """The tables of :func:`settled`, a round each, until nothing is spilled."""
    size = contents.agg(F.sum("size")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, 2 * size / (room or ROOM)))))
    pending = contents.drop("size")
    while True:
        front = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
        dealt = pending.withColumn("bucket", front).repartition("bucket").sortWithinPartitions("bucket")
        done = kept(settled(dealt), "grace")
        yield done.filter(F.col("content").isNull())
        pending = done.filter(F.col("content").isNotNull())
        if pending.isEmpty():
            return
        bits = min(63, bits + DIGITS)


def _assigned(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each record with its carried columns, and of its group sha, rows, best_id and whether the record stays."""
    both = kept(combined(documents, carry), "records")
    contents = both.filter(F.col("content").isNotNull()).select("local", "sha", "content", "h", *_BEST, F.octet_length("content").alias("size"))
    links = None
    for done in rounds(contents):
        found = done.select("local", "sha", "rows", "best_id", "best_row")
        links = found if links is None else links.unionByName(found)
    records = both.filter(F.col("row").isNotNull()).select("row", "local", "doc_id", *(f"_{k}" for k in range(len(carry))))
    return records.join(links, "local")


def groups(documents: DataFrame) -> DataFrame:
    """Of each row its group: (doc_id, keep_id, group_size, kept, text_sha256).

    keep_id is the doc_id of the row that stays, text_sha256 the lowercase hex digest of the normalised text.
    """
    with scratch(documents.sparkSession):
        rows = _assigned(documents)
        found = rows.select("doc_id", F.col("best_id").alias("keep_id"), F.col("rows").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        return kept(found, "groups", outlives=True)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    with scratch(documents.sparkSession):
        names = documents.columns
        rows = _assigned(documents, tuple(names)).filter(F.col("row") == F.col("best_row"))
        return kept(rows.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(names))), "deduplicated", outlives=True)
