"""Language identification as multilingual mixture inference.

A document is a mixture of languages: each of its words is drawn from one of them. Word likelihoods under a language come from
smoothed letter trigrams. For nested candidate sets (the best language, the best two, three, ...) expectation-maximisation
estimates the proportions, and a set's score is its likelihood, less a penalty for each language. Sets grow for as long as that
score does: nothing else bounds them. The prediction is the selected set's largest language and the score its proportion.

Learning counts trigrams in about ``SAMPLE`` documents of each language at most, outside the held-out fold; every language
that occurs there is learned. Prediction reads nothing but the text: it is one map over the documents, without a shuffle.

A model has ``BUCKETS`` floats a language. A text of more than ``_text.PIECE_BYTES`` is read in slices, again in each step of the
expectation-maximisation if its word likelihoods have more than ``CELLS`` numbers, so memory doesn't follow its length.

Defined results: null text and text without any letter (``str.isalpha``) are ``und`` with score 0; equal texts get equal results;
ties between languages go to the first by code point; with no usable training row, every text is ``und``; columns named
lang_pred, score or langs are replaced, all others kept; a language whose training rows are all lost raises ValueError.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from corpusloom.llm._learn import held_out, ids_by, sums, thinned, with_columns
from corpusloom.llm._store import modest_batches
from corpusloom.llm._text import PIECE_BYTES, pieces, utf8

#: Documents of each language that are learned from.
SAMPLE = 1500
#: Hash buckets of trigrams, and what each is counted to have besides.
BUCKETS, SMOOTH = 1 << 16, 0.5
#: Steps of expectation-maximisation, and the penalty of a language in half log words.
STEPS, PENALTY = 6, 4.0
#: Word likelihoods (words x languages) that are held at once.
CELLS = 1 << 22
#: A document is turned away when no language has this share of its words.
LEAST_SHARE = 0.4

_PLAIN = np.full(256, 0x20, np.uint32)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


@dataclasses.dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def _trigrams(data: np.ndarray, before: np.ndarray = np.zeros(0, np.uint8)) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte, and the lowered letters (others are spaces); before: up to two bytes that precede."""
    plain = _PLAIN[data]
    back = np.full(len(plain) + 2, 0x20, np.uint32)
    back[2:] = plain
    back[2 - len(before) : 2] = _PLAIN[before]
    code = (back[:-2] << np.uint32(16)) | (back[1:-1] << np.uint32(8)) | plain
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), plain


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Trigram model of each lang of documents (doc_id, text, lang), learned from rows that aren't held out."""
    usable = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = ids_by(usable, "lang")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    place = {lang: k for k, lang in enumerate(languages)}
    modest_batches(documents.sparkSession)

    def count(batches):
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for d, lang in enumerate(batch.column("lang").to_pylist()):
                k = place[lang]
                rows[k] = rows.get(k, 0) + 1
                for at in range(offsets[d], max(offsets[d + 1], offsets[d] + 1), PIECE_BYTES):
                    stop = min(at + PIECE_BYTES, offsets[d + 1])
                    bucket, plain = _trigrams(data[at:stop], data[max(at - 2, offsets[d]) : at])
                    total[k] = total.get(k, 0) + np.bincount(bucket[plain != 0x20], minlength=BUCKETS)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rows[k]], pa.int64()), pa.array([c.astype(np.int64).tobytes()], pa.binary())], names=["k", "n", "counts"])

    drawn = thinned(usable, "lang", sample, counts).select("lang", "text").repartition(8)
    table, seen = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.int64)
    for row in drawn.mapInArrow(count, "k int, n long, counts binary").toLocalIterator():
        table[:, row["k"]] += np.frombuffer(row["counts"], np.int64)
        seen[row["k"]] += row["n"]
    if not seen.all():
        raise ValueError(f"no row was drawn of {[lang for lang, n in zip(languages, seen) if not n]}")
    table += np.float32(SMOOTH)
    return Model(languages, np.log(table / table.sum(axis=0, dtype=np.float64)).astype(np.float32))


def _words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (words x languages) of the words of a piece, and the n + 1 offsets of its documents' words."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint8)  # two spaces before each document: its trigrams don't reach into the last
    shift = 2 * np.arange(1, n + 1)
    padded[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
    bucket, plain = _trigrams(padded)
    letter = plain != 0x20
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    first = np.searchsorted(start, offsets + np.concatenate([shift - 2, [2 * n]]))
    if not len(start):
        return np.zeros((0, len(model.languages))), first
    held = np.flatnonzero(letter)
    return np.add.reduceat(model.log_p[bucket[held]], np.searchsorted(held, start), axis=0).astype(np.float64), first


def _slices(model: Model, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Log likelihoods of the words of one text, a slice at a time; a word on a border is carried over."""
    carry = np.zeros((0, len(model.languages)))
    for at in range(0, len(data), size):
        bucket, plain = _trigrams(data[at : at + size], data[max(at - 2, 0) : at])
        letter = plain != 0x20
        begins = letter & ~np.concatenate([[len(carry) > 0], letter[:-1]])
        start, held = np.flatnonzero(begins), np.flatnonzero(letter)
        if len(carry) and letter[0]:
            start = np.concatenate([[0], start])
        if len(start):
            word = np.add.reduceat(model.log_p[bucket[held]], np.searchsorted(held, start), axis=0).astype(np.float64)
            if len(carry) and letter[0]:
                word[0] += carry[0]
            elif len(carry):
                yield carry
            open_end = bool(letter[-1])
            yield word[: len(word) - open_end]
            carry = word[len(word) - 1 :] if open_end else word[:0]
        elif len(carry):
            yield carry
            carry = carry[:0]
    if len(carry):
        yield carry


class _Batch:
    """The words of the documents of a piece, for expectation-maximisation in numpy passes."""

    def __init__(self, word: np.ndarray, first: np.ndarray):
        self.first, self.words = first, np.diff(first)
        self.total = sums(word, first)
        top = word.max(axis=1) if len(word) else np.zeros(0)
        self.peak = sums(top, first)
        self.like = np.exp(word - top[:, None])

    def of(self, some: np.ndarray) -> _Batch:
        """Some of the documents."""
        out = object.__new__(_Batch)
        doc = np.repeat(np.arange(len(self.words)), self.words)
        out.words, out.peak = self.words[some], self.peak[some]
        out.first = np.concatenate([[0], np.cumsum(out.words)])
        out.like = self.like[some[doc]]
        return out

    def step(self, mixed: np.ndarray) -> np.ndarray:
        part = self.like * np.repeat(mixed, self.words, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        return sums(part, self.first) / np.maximum(self.words, 1)[:, None]

    def fit(self, mixed: np.ndarray) -> np.ndarray:
        return self.peak + sums(np.log(np.maximum((self.like * np.repeat(mixed, self.words, axis=0)).sum(axis=1), 1e-300)), self.first)


class _Long:
    """The same of one long document, whose words are read again in each step."""

    def __init__(self, slices: Callable[[], Iterator[np.ndarray]], langs: int):
        self.slices = slices
        self.words, self.total, self.peak = np.zeros(1, np.int64), np.zeros((1, langs)), np.zeros(1)
        for word in slices():
            self.words[0] += len(word)
            self.total[0] += word.sum(axis=0)
            self.peak[0] += word.max(axis=1).sum() if len(word) else 0.0

    def of(self, some: np.ndarray) -> _Long:
        return self

    def step(self, mixed: np.ndarray) -> np.ndarray:
        out = np.zeros_like(mixed)
        for word in self.slices():
            part = np.exp(word - word.max(axis=1, initial=-np.inf, keepdims=True)) * mixed
            out[0] += (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        return out / np.maximum(self.words, 1)[:, None]

    def fit(self, mixed: np.ndarray) -> np.ndarray:
        out = self.peak.copy()
        for word in self.slices():
            out[0] += np.log(np.maximum((np.exp(word - word.max(axis=1, initial=-np.inf, keepdims=True)) * mixed).sum(axis=1), 1e-300)).sum()
        return out


def _mixtures(texts: _Batch | _Long) -> np.ndarray:
    """The proportions of all languages in each document, 0 outside the selected set."""
    n, langs = texts.total.shape
    share = np.zeros((n, langs))
    best = np.argsort(-texts.total, axis=1, kind="stable")[:, 0]
    share[np.arange(n), best] = 1.0
    score = texts.total[np.arange(n), best]
    price = PENALTY * np.log(np.maximum(texts.words, 2)) / 2
    if langs < 2:
        return share
    # the mixture of all languages orders the candidates; each nested set is then fitted by itself
    full = np.full((n, langs), 1.0 / langs)
    for _ in range(STEPS):
        full = texts.step(full)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    open_ = np.flatnonzero(texts.words > 0)
    for size in range(2, langs + 1):
        some = np.zeros(len(texts.words), bool)
        some[open_] = True
        if not some.any():
            break
        part = texts.of(some)
        mixed = np.where(rank[open_] < size, np.maximum(full[open_], 1e-6), 0.0)
        mixed /= mixed.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            mixed = part.step(mixed)
        worth = part.fit(mixed) - price[open_] * (size - 1)
        better = worth > score[open_]
        score[open_[better]] = worth[better]
        share[open_[better]] = mixed[better]
        open_ = open_[better]
    return share


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of a piece: the proportions of all languages (0 outside the selected set), its best language, its words."""
    n, langs = len(offsets) - 1, len(model.languages)
    if not langs:
        return np.zeros((n, 0)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 1 and len(data) > PIECE_BYTES:
        slices = lambda: _slices(model, data, max(1 << 12, min(PIECE_BYTES, CELLS // langs)))
        texts = _Long(slices, langs)
        if texts.words[0] * langs <= CELLS:
            read = list(slices())
            texts.slices = lambda: iter(read)
    else:
        texts = _Batch(*_words(model, data, offsets))
    share = _mixtures(texts)
    share[texts.words == 0] = 0.0
    return share, np.argmax(share, axis=1), texts.words


ADDED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("langs", ArrayType(StringType()))])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred, score (its share of the words) and langs (the selected set, by code point)."""

    def compute(batch):
        data, offsets = utf8(batch.column("text"))
        names, scores, sets = [], [], []
        for i, j in pieces(offsets, max(1 << 12, min(PIECE_BYTES, 4 * PIECE_BYTES // max(1, len(model.languages))))):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            share, best, words = infer(model, part, at)
            for d in range(j - i):
                raw = part[at[d] : at[d + 1]]
                known = bool(model.languages) and words[d] > 0
                if known and (raw >= 128).any() and not ((_PLAIN[raw] < 128) & (raw != 0x20) & (_PLAIN[raw] != 0x20)).any():
                    known = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
                names.append(model.languages[best[d]] if known else "und")
                scores.append(min(1.0, float(share[d, best[d]])) if known else 0.0)
                sets.append([model.languages[k] for k in np.flatnonzero(share[d] > 0.02)] if known else [])
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))]

    return with_columns(documents, ADDED, compute)


def accepted(documents: DataFrame, model: Model, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows whose language is known and has ``least_share`` of the words, with documents' own columns."""
    own = documents.columns
    named = documents.select("*", F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row")) if set(own) & set(ADDED.names) else None
    scored = predict(named if named is not None else documents, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_share))
    return scored.select("__row.*") if named is not None else scored.select(*(F.col(f"`{c}`") for c in own))
