"""Quality classification by a factorisation machine.

The features of a text are its hashed words, each weighted by the root of its share, and bins of structure statistics and
metadata (symbols, digits, capitals, repeated words and lines, lengths). A score is

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

so all pairwise interactions, of rank ``RANK``, cost time linear in the number of features. Training is AdaGrad on the
driver over at most about ``SAMPLE`` labelled documents of each class outside the held-out fold; scoring is one map over the
documents with the model (``BUCKETS`` x ``RANK`` floats) in the task, without a shuffle.

Defined results: null text scores as empty text, which has its bins as features and no word; equal texts score equally; with no
usable label every score is 0.5; columns named score or predicted are replaced, all others kept.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corpusloom.llm._learn import labelled, sums, with_columns
from corpusloom.llm._store import modest_batches
from corpusloom.llm._text import Words, pieces, utf8

#: Labelled documents of each class that are learned from.
SAMPLE = 3000
#: Word buckets, bins of a statistic, rank of the interactions, passes over the sample, rows of a step, AdaGrad's rate, weight decay.
BUCKETS, BINS, RANK, PASSES, STEP_ROWS, RATE, DECAY = 1 << 15, 8, 8, 8, 64, 0.15, 1e-4
#: The score from which a document is kept.
THRESHOLD = 0.3
_BIN_VALUE = 0.5

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 space, 2 line end, 3 small letter or beyond ASCII, 4 capital, 5 digit, 6 usual mark, 7 odd mark
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[0x0A] = 2
_KIND[97:123] = _KIND[128:] = 3
_KIND[65:91] = 4
_KIND[48:58] = 5
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7


@dataclasses.dataclass
class Model:
    edges: np.ndarray  # statistics x (BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray


def statistics(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Structure statistics of each document of a piece."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = _KIND[data]
    share = [sums((kind == k).astype(np.float64), offsets) / np.maximum(size, 1) for k in (2, 4, 5, 6, 7)]
    count = words.counts.astype(np.float64)
    length = sums((words.end - words.start).astype(np.float64), words.first) / np.maximum(count, 1)
    doc = np.repeat(np.arange(n, dtype=np.uint64), words.counts)
    again = np.zeros(len(words.hash))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        named = np.sort((doc << np.uint64(40)) | (words.hash >> np.uint64(24)))
    fresh = np.ones(len(named))
    fresh[1:] = named[1:] != named[:-1]
    distinct = sums(fresh, words.first) / np.maximum(count, 1)
    odd_word = (words.end - words.start == 1) & (_KIND[data[words.start]] >= 6) if len(words.start) else np.zeros(0)
    return np.stack([np.log1p(size), np.log1p(count), length, *share, sums(again, words.first) / np.maximum(count, 1), distinct, sums(odd_word.astype(np.float64), words.first) / np.maximum(count, 1)], axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: distinct word buckets of all documents one after another, their values, n + 1 offsets, and the statistics."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), words.counts)
    code, count = np.unique(doc * BUCKETS + (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    at = code // BUCKETS
    first = np.searchsorted(at, np.arange(n + 1))
    value = np.sqrt(count / np.maximum(words.counts[at], 1))
    return code % BUCKETS, value, first, statistics(data, offsets, words)


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' bins, after the word buckets."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        out[:, k] = BUCKETS + k * BINS + np.searchsorted(edges[k], stats[:, k], "right")
    return out


def scores(model: Model, bucket, value, first, stats) -> np.ndarray:
    """Probabilities of label 1, by the sum-of-squares identity."""
    bins = _binned(stats, model.edges)
    linear = model.w0 + sums(model.w[bucket] * value, first) + _BIN_VALUE * model.w[bins].sum(axis=1)
    vx = model.v[bucket] * value[:, None]
    bv = model.v[bins] * _BIN_VALUE
    total = sums(vx, first) + bv.sum(axis=1)
    squares = sums((vx * vx).sum(axis=1), first) + (bv * bv).sum(axis=(1, 2))
    z = linear + 0.5 * ((total * total).sum(axis=1) - squares)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], passes: int = PASSES, seed: int = 7) -> Model:
    """Model of (buckets, values, statistics, label) rows; the rows' order doesn't matter beyond rounding if they come sorted."""
    if not rows or len({r[3] for r in rows}) < 2:
        k = len(rows[0][2]) if rows else 11
        return Model(np.zeros((k, BINS - 1)), 0.0, np.zeros(BUCKETS + k * BINS), np.zeros((BUCKETS + k * BINS, RANK)))
    stats = np.stack([r[2] for r in rows])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    bins = _binned(stats, edges)
    y = np.array([r[3] for r in rows], np.float64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    size = BUCKETS + stats.shape[1] * BINS
    w, v, w0 = np.zeros(size), rng.normal(0, 0.05, (size, RANK)), 0.0
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    ids = [np.concatenate([r[0], b]) for r, b in zip(rows, bins)]
    xs = [np.concatenate([r[1], np.full(len(b), _BIN_VALUE)]) for r, b in zip(rows, bins)]
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), STEP_ROWS):
            pick = order[lo : lo + STEP_ROWS]
            i, x = np.concatenate([ids[p] for p in pick]), np.concatenate([xs[p] for p in pick])
            lens = np.array([len(ids[p]) for p in pick])
            first = np.concatenate([[0], np.cumsum(lens)])
            doc = np.repeat(np.arange(len(pick)), lens)
            vi = v[i]
            vx = vi * x[:, None]
            total = np.add.reduceat(vx, first[:-1], axis=0)
            z = w0 + np.add.reduceat(w[i] * x, first[:-1]) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), first[:-1]))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick]) / len(pick)
            used, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, g[doc] * x, len(used)) + DECAY * w[used]
            step = (g[doc] * x)[:, None] * (total[doc] - vx)
            dv = np.stack([np.bincount(where, step[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            w0 -= RATE * g.sum() / np.sqrt(g0)
    return Model(edges, float(w0), w.astype(np.float32), v.astype(np.float32))


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Model:
    """Model of ``target`` from labels (doc_id, target) joined to documents (doc_id, text)."""
    modest_batches(documents.sparkSession)

    def collect(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, ys = batch.column("doc_id"), batch.column("y")
            for i, j in pieces(offsets):
                bucket, value, first, stats = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = [[a.tobytes() for a in (bucket[p:q].astype(np.uint16), value[p:q].astype(np.float32), s)] for p, q, s in zip(first, first[1:], stats)]
                columns = [pa.array([row[k] for row in packed], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.string()), ys.slice(i, j - i), *columns], names=["id", "y", "b", "x", "s"])

    drawn = labelled(documents, labels, target, sample).mapInArrow(collect, "id string, y int, b binary, x binary, s binary").collect()
    drawn.sort(key=lambda r: (r["id"] or "", r["y"], r["b"], r["x"]))
    return fit([(np.frombuffer(r["b"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64), np.frombuffer(r["s"], np.float64), r["y"]) for r in drawn])


ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def predict(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0..1, higher: label 1 is likelier) and predicted (1 from ``threshold`` on)."""

    def compute(batch):
        data, offsets = utf8(batch.column("text"))
        got = [scores(model, *features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in pieces(offsets)]
        out = np.concatenate(got) if got else np.zeros(0)
        return [pa.array(out, pa.float64()), pa.array((out >= threshold).astype(np.int32), pa.int32())]

    return with_columns(documents, ADDED, compute)


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, with documents' own columns."""
    own = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row")
    return predict(documents.select("text", own), model, threshold).filter("predicted = 1").select("__row.*")
