"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level runs of a symbol are merged, deterministic coin tossing gives every symbol a label
out of eight that differs from its left neighbour's (the lowest bit in which the two symbols differ, and its value, repeated on
the labels), and a phrase begins at each label that is larger than both neighbours. A phrase's name is a hash of its symbols,
and the names are the next level's symbols. Borders depend only on a few symbols around them, so equal substrings are parsed
alike inside, wherever they are. The fingerprint is the least ``KEEP`` names of level ``LEVEL`` and above (about 25 characters
and more each) and the likeness of two fingerprints estimates the Jaccard similarity of those phrase sets.

The edited text of a document needs the next document by doc_id. Documents are range-partitioned once; the first row of a
partition is also sent, as a guest, to the partition before it, so the only shuffle of texts is that one.

Defined results: null text is empty text, whose fingerprint is the empty string; two empty fingerprints have likeness 1, one
alone 0; doc_id may have any type with an order; rows of equal doc_id follow each other by text, in one task; a null doc_id comes
first; a lone document is its own next; an empty table gives no row; other columns are ignored. Memory: a text is parsed whole, at
about 73 bytes for each of its characters. There are ``spark.sql.shuffle.partitions`` ranges, a number to choose by the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import modest_batches
from corpusloom.llm._text import _power_tables, mix, seeds

#: The first level whose phrases count, the last, names kept of a document, and code points parsed at once.
LEVEL, TOP, KEEP, PIECE = 3, 12, 48, 1 << 19

_SALT = seeds(TOP + 2, 41)
_RUN = seeds(1, 42)[0]


def _toss(label: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One round of coin tossing; begin: positions without a left neighbour."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[begin] = ~label[begin]
    differ = label ^ left
    one = label.dtype.type(1)
    low = np.bitwise_count((differ - one) & ~differ)
    return (low << np.uint8(1)) | ((label >> low.astype(label.dtype)) & one).astype(np.uint8)


def _phrases(symbol: np.ndarray, offsets: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all documents of a level, and their offsets."""
    n = len(symbol)
    fresh = np.ones(n, bool)
    fresh[1:] = symbol[1:] != symbol[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    if not fresh.all():
        at = np.flatnonzero(fresh)
        length = np.diff(np.concatenate([at, [n]])).astype(np.uint64)
        offsets = np.searchsorted(at, offsets)
        symbol = symbol[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            symbol = np.where(length > 1, mix(symbol * _RUN + length), symbol)
        n = len(symbol)
    begin = offsets[:-1][np.diff(offsets) > 0]
    with np.errstate(over="ignore"):
        label = symbol
        for _ in range(3):
            label = _toss(label, begin)
        higher = np.ones(n, bool)
        higher[1:] = label[1:] > label[:-1]
        higher[:-1] &= label[:-1] > label[1:]
        higher[offsets[1:][np.diff(offsets) > 0] - 1] = False  # what follows a document's last symbol is another document's
        higher[begin] = True
        inner = begin + 1
        higher[inner[inner < n]] &= np.isin(inner[inner < n], begin)  # a document's first phrase has two symbols at least
        at = np.flatnonzero(higher)
        up, down = _power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbol.astype(np.uint64) + salt) * up[:n], out=total[1:])
        end = np.concatenate([at[1:], [n]])
        names = mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
    return names, np.searchsorted(at, offsets)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text: ascending unsigned 32-bit names, KEEP at most."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        size, stop = 0, start
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        part = texts[start:stop]
        start = stop
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        symbol = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        found: list[list[np.ndarray]] = [[] for _ in part]
        last = np.diff(offsets) > 0
        for level in range(1, TOP + 1):
            if not len(symbol):
                break
            symbol, offsets = _phrases(symbol, offsets, _SALT[level])
            count = np.diff(offsets)
            done = last & (count == 1)
            if level >= LEVEL:
                for d in np.flatnonzero(last):
                    found[d].append(symbol[offsets[d] : offsets[d + 1]])
            else:
                for d in np.flatnonzero(done):  # a short text: its topmost name
                    found[d].append(symbol[offsets[d] : offsets[d + 1]])
            if done.any():
                keep = np.repeat(last & ~done, count)
                symbol = symbol[keep]
                offsets = np.concatenate([[0], np.cumsum(np.where(last & ~done, count, 0))])
                last = last & ~done
        for names in found:
            out.append(np.unique((np.concatenate(names) >> np.uint64(32)).astype(np.uint32))[:KEEP] if names else np.zeros(0, np.uint32))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two fingerprints: of the least names of both, the share in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:KEEP] if len(a) == KEEP or len(b) == KEEP else np.union1d(a, b)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).sum() / len(least))


def as_text(names: np.ndarray) -> str:
    return names.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as much of the front of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_table(documents: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    modest_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a number is given, so that adaptive execution doesn't make one range of the small ids
    parts_wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = documents.select("doc_id").repartitionByRange(parts_wanted, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("low"))
    lows = sorted((r["low"] for r in ranges.collect()), key=lambda low: (low["named"], *([low["doc_id"]] if low["named"] else [])))  # one for each range
    named = np.array([low["doc_id"] for low in lows if low["named"]], object)
    nameless = len(lows) - len(named)  # 1 if the first range begins with rows without an id

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range of an id, and 1 more if its first row has that id."""
        out = np.zeros(len(ids), np.int64)
        some = ids.notna().to_numpy()
        values = ids.to_numpy(object)[some]
        p = np.maximum(np.searchsorted(named, values, "right") - 1 + nameless, 0)
        out[some] = 2 * p + np.array([k >= nameless and named[k - nameless] == v for k, v in zip(p.tolist(), values)], np.int64)
        out[~some] = nameless
        return pd.Series(out)

    def run(batches):
        waiting = None
        for batch in batches:
            items = list(zip(*(batch.column(c).to_pylist() for c in ("p", "guest", "doc_id", "text"))))
            if waiting is not None:
                items.insert(0, waiting)
            waiting = items[-1]
            if len(items) < 2:
                continue
            texts = [t for *_, t in items]
            marks = fingerprints(texts)
            real = [k for k in range(len(items) - 1) if not items[k][1]]
            changed = [edited(texts[k], texts[k + 1]) for k in real]
            changed_marks = fingerprints(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([items[k][2] for k in real], batch.column("doc_id").type),
                    pa.array([len(texts[k]) for k in real], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([as_text(marks[k]) for k in real], pa.string()),
                    pa.array([as_text(m) for m in changed_marks], pa.string()),
                    pa.array([likeness(marks[k], m) for k, m in zip(real, changed_marks)], pa.float64()),
                    pa.array([likeness(marks[k], marks[k + 1]) for k in real], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    own, n = F.shiftright("place", 1), max(1, len(lows))
    parts = F.when(F.col("place") % 2 == 1, F.array(own, F.pmod(own - 1, F.lit(n)))).otherwise(F.array(own))
    dealt = rows.withColumn("place", place("doc_id")).select("doc_id", "text", F.posexplode(parts).alias("guest", "p"))
    dealt = dealt.select(F.col("p"), (F.col("guest") > 0).alias("guest"), "doc_id", "text")
    dealt = dealt.repartitionById(n, "p").sortWithinPartitions("p", "guest", "doc_id", "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("p", "guest", "doc_id", "text").mapInArrow(run, schema)
