"""Toxicity classification, regularised by counterfactual identity swaps.

A logistic model over hashed word features (the word, and its first four and five bytes, so that inflected forms share
evidence) is fitted with the usual log loss plus

    COUNTERFACTUAL * mean over labelled texts with identity terms of (z(text) - z(text with the terms swapped))^2

where a swap replaces every identity term by another of its group. Weight on the terms themselves is what changes between the
two, so a neutral mention of a group raises no score; other words are left alone.

Learning reads at most about ``SAMPLE`` labelled documents of each class outside the held-out fold; scoring is one map over
the documents, without a shuffle. A text scores by which features it has, not how often, so a long text is not diluted.

Defined results: null text scores as empty text (the model's intercept); equal texts score equally; with no usable label
every score is 0; columns named score or predicted are replaced, all others kept.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corpusloom.llm._learn import labelled, sums, with_columns
from corpusloom.llm._store import modest_batches
from corpusloom.llm._text import NOT_LETTER, Words, pieces, utf8

#: Labelled documents of each class that are learned from.
SAMPLE = 3000
#: Feature buckets; the least absolute log ratio of a feature that is used; steps, rate and weight decay of the fit; weight of the swaps' penalty.
BUCKETS, LEAST_RATIO, STEPS, RATE, DECAY, COUNTERFACTUAL = 1 << 18, 1.6, 300, 0.3, 1e-3, 5.0
#: The score from which a text is called toxic.
THRESHOLD = 0.5
#: Terms that may stand for each other, by group.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen", "refugee"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


@dataclasses.dataclass
class Model:
    bias: float
    weight: np.ndarray  # by bucket; 0 for features that aren't used


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a piece's documents one after another, and n + 1 offsets."""
    words = Words(data, offsets, gaps=NOT_LETTER)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), words.counts) * BUCKETS
    kinds = (words.hash, words.heads(4) ^ np.uint64(1), words.heads(5) ^ np.uint64(2))
    code = np.unique(np.concatenate([doc + (h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in kinds]))
    return code % BUCKETS, np.searchsorted(code // BUCKETS, np.arange(n + 1))


def swapper(groups=IDENTITY_GROUPS):
    """A function that gives a text with all identity terms moved on to the next of their group, or None if it has none."""
    following = {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}
    pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, following), key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)

    def swap(text: str) -> str | None:
        out, n = pattern.subn(lambda m: following[m[0].lower()], text)
        return out if n else None

    return swap


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], penalty: float = COUNTERFACTUAL) -> Model:
    """Model of (feature buckets, those of the swapped text or None, label) rows."""
    y = np.array([r[2] for r in rows], np.float64)
    if not rows or y.min() == y.max():
        return Model(-1e9, np.zeros(BUCKETS, np.float32))

    def matrix(sets):
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        return (np.concatenate(sets) if sets else np.zeros(0, np.int64)).astype(np.int64), first

    ids, first = matrix([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    # evidence of each feature, as a log ratio; what is seen once or twice, or in both classes, is not used
    there = np.bincount(ids, y[doc], BUCKETS)
    ratio = np.log((there + 1) / (np.bincount(ids, minlength=BUCKETS) - there + 1) * (len(y) - y.sum() + 2) / (y.sum() + 2))
    pairs = [(r[0], r[1]) for r in rows if r[1] is not None]
    used = np.abs(ratio) >= LEAST_RATIO
    scale = np.where(used, ratio, 0.0)
    kept = used[ids]
    ids, doc = ids[kept], doc[kept]
    a, a_first = matrix([p[0] for p in pairs])
    b, b_first = matrix([p[1] for p in pairs])
    pair = np.concatenate([np.repeat(np.arange(len(pairs)), np.diff(f)) for f in (a_first, b_first)])
    sign = np.concatenate([np.ones(len(a)), -np.ones(len(b))])
    both = np.concatenate([a, b]).astype(np.int64)
    theta, bias = np.where(used, 0.1, 0.0), 0.0
    speed, speed0 = np.full(BUCKETS, 1e-8), 1e-8
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(STEPS):
        z = bias + np.bincount(doc, (theta * scale)[ids], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        d = np.bincount(ids, g[doc] * scale[ids], BUCKETS) + DECAY * theta * used
        if pairs:
            gap = np.bincount(pair, sign * (theta * scale)[both], len(pairs))
            d += penalty * 2 / len(pairs) * np.bincount(both, sign * gap[pair] * scale[both], BUCKETS)
        speed += d * d
        speed0 += g.sum() ** 2
        theta -= RATE * d / np.sqrt(speed) * used
        bias -= RATE * g.sum() / np.sqrt(speed0)
    return Model(float(bias), (theta * scale).astype(np.float32))


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, groups=IDENTITY_GROUPS, penalty: float = COUNTERFACTUAL) -> Model:
    """Model of ``target`` from labels (doc_id, target) joined to documents (doc_id, text)."""
    modest_batches(documents.sparkSession)

    def collect(batches):
        swap = swapper(groups)

        def rows_of(column):
            data, offsets = utf8(column)
            for i, j in pieces(offsets):
                bucket, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for p, q in zip(first, first[1:]):
                    yield bucket[p:q].astype(np.int32).tobytes()

        for batch in batches:
            swapped = pa.array([swap(t) if t else None for t in batch.column("text").to_pylist()], pa.string())
            other = [b if s else None for b, s in zip(rows_of(swapped), swapped.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("y"), pa.array(list(rows_of(batch.column("text"))), pa.binary()), pa.array(other, pa.binary())], names=["id", "y", "b", "c"])

    drawn = labelled(documents, labels, target, sample).mapInArrow(collect, "id string, y int, b binary, c binary").collect()
    drawn.sort(key=lambda r: (r["id"] or "", r["y"], r["b"]))
    return fit([(np.frombuffer(r["b"], np.int32).astype(np.int64), None if r["c"] is None else np.frombuffer(r["c"], np.int32).astype(np.int64), r["y"]) for r in drawn], penalty)


def scores(model: Model, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.bias + sums(model.weight[bucket].astype(np.float64), first), -700, 35)))


ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def predict(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0..1, higher: toxic is likelier) and predicted (1 from ``threshold`` on)."""

    def compute(batch):
        data, offsets = utf8(batch.column("text"))
        got = [scores(model, *features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in pieces(offsets)]
        out = np.concatenate(got) if got else np.zeros(0)
        return [pa.array(out, pa.float64()), pa.array((out >= threshold).astype(np.int32), pa.int32())]

    return with_columns(documents, ADDED, compute)
