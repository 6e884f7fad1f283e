"""Groups and links of two tokenizers' tokens of one text, aligned by the bytes that they cover.

Tokenizer A is a byte-level BPE file of the tokenizers library and reads a space and the text; B is a SentencePiece model, which puts a
space before the text itself. Tokens of both cover the same bytes; where tokens of A and of B end at the same byte, all before it is cut off as a
group. Each token of A is linked with each token of B in its group, occurrence by occurrence.

No token of either reaches from one word over a single space into the next, so a text is a list of parts, a part being a space and what
follows up to the next such place. A worker remembers the parts that it has met with their groups and links (:class:`Known`), up to ``REMEMBERED``,
and then begins anew; new parts of a block of texts are tokenised and aligned together, by searching the end arrays in each other. A document's
numbers are sums over its parts, its groups theirs in a row, its links theirs by pair (:func:`aligned`). Counting, ranking and joining pairs is Spark's.

A pair's count is how many documents hold it linked. Pairs that more than one in ``HUBS`` of all (document, pair) rows have, ``HUBS`` at most,
are broadcast to the documents, whose rows stay where they are; the rest meets its counts by a join, in which no key has more rows than that.

A text that is null or empty, or whose tokens' joined bytes aren't a space and the text for both, has no tokens: all its numbers are 0 and
its digest is ''. (B writes a space as U+2581, so that a text with U+2581 itself is one of these.) Strings of special tokens are plain text.
Repeated rows are documents of their own, an empty table gives no row, other columns are ignored.
Memory: a block is ``BLOCK_BYTES`` of text or one longer text; a task holds its tokens, groups and distinct links at once, about 100 bytes for each of
its bytes, beside what is remembered. The links of a group are the product of its tokens, as the result asks; they are held as the product of its
distinct tokens with how often each occurs.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm._store import give_back, kept, modest_batches, scratch
from corpusloom.llm.token_index import Encoder

#: Pairs whose counts are broadcast, at most: each has more than one in so many of all rows.
HUBS = 200_000
#: Bytes of text in a block, whose new parts are aligned at once, and bytes that a row counts for besides its text.
BLOCK_BYTES, ROW_BYTES = 1 << 20, 64
#: Characters that are tokenised at once.
ENCODED = 1 << 12
#: Parts, and their tokens and links, that a worker remembers before it begins anew.
REMEMBERED, HELD = 400_000, 8_000_000

_GAP = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_model: str, b_model: bytes):
        self.a = Encoder(a_model)
        self.a.whole.encode_special_tokens = True
        self.a.specials = []
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = {chr(letter): byte for byte, letter in self.a.letters.items()}
        added = {k: t.content for k, t in self.a.whole.get_added_tokens_decoder().items()}
        entries = {k: v for v, k in self.a.whole.get_vocab().items()}
        self.a_bytes = [b"" if k not in entries else added[k].encode() if k in added else bytes(back[c] for c in entries[k]) for k in range(max(entries) + 1)]
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.kind = np.dtype("<u2" if self.a.code == "H" else "<u4")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in all_], np.int64) for all_ in (self.a_bytes, self.b_bytes))
        #: Whether no token reaches over a space, so that a text may be cut there.
        self.cut = self.a.usual and not any("▁" in p.lstrip("▁") for p in names)

    def parts(self, text: str) -> list[str]:
        """The text cut at its single spaces, or whole where tokens may reach over them; none if it has no tokens for sure."""
        if not text or "▁" in text:
            return []
        return _GAP.split(text) if self.cut else [text]

    def tokens(self, parts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[bool]]:
        """The ids of parts as one text by A and B, the bytes of each part, and which have tokens: those whose bytes aren't theirs by both have none."""
        text = "".join([" " + p for p in parts])
        raw = text.encode()
        a = np.frombuffer(b"".join(self.a.encode([text])), self.kind).astype(np.int32)
        b = np.array(self.b.encode(text[1:], num_threads=1), np.int32)
        sizes = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        if self._bytes(self.a_bytes, a) == raw == self._bytes(self.b_bytes, b) and all(np.isin(np.cumsum(sizes), np.cumsum(size[x])).all() for size, x in ((self.a_sizes, a), (self.b_sizes, b))):
            return [a, b], sizes, [True] * len(parts)
        if len(parts) == 1:
            return [a[:0], b[:0]], np.zeros(1, np.int64), [False]
        half = len(parts) // 2
        (x, size_x, good_x), (y, size_y, good_y) = self.tokens(parts[:half]), self.tokens(parts[half:])
        return [np.concatenate(z) for z in zip(x, y)], np.concatenate([size_x, size_y]), good_x + good_y

    @staticmethod
    def _bytes(table: list[bytes], ids: np.ndarray) -> bytes:
        return b"".join([table[k] for k in ids.tolist()])


class Column:
    """Numbers that are added at the end."""

    def __init__(self, kind=np.int64):
        self.all, self.n = np.zeros(1 << 10, kind), 0

    def add(self, numbers: np.ndarray) -> None:
        end = self.n + len(numbers)
        if end > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(max(end, 3 * self.n // 2) - self.n, self.all.dtype)])
        self.all[self.n : end] = numbers
        self.n = end


def _before(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, then those of first[1], and so on."""
    return np.repeat(first - _before(np.cumsum(n)), n) + np.arange(n.sum())


class Known:
    """Parts with their tokens' numbers, groups as text, and links as distinct pairs with how often each occurs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.a_size, self.b_size = len(pair.a_bytes), len(pair.b_bytes)
        self.kind = np.int32 if self.a_size * self.b_size < 1 << 31 else np.int64
        #: How a token is written inside its side of a group, and at its end.
        self.written = np.array([f"{k}{end}" for n, last in ((self.a_size, "|"), (self.b_size, ";")) for k in range(n) for end in (",", last)], object)
        self.forget()

    def forget(self) -> None:
        self.place, self.names = {}, []
        self.good, self.n = Column(bool), {k: Column() for k in ("n_a", "n_b", "n_groups", "n_links")}
        self.first, self.pairs_of, self.pairs, self.times = Column(), Column(), Column(self.kind), Column()

    def full(self) -> bool:
        return len(self.names) > REMEMBERED or self.n["n_a"].all.sum() + self.n["n_b"].all.sum() + self.pairs.n > HELD

    def places(self, texts: list[str]) -> list[list[int]]:
        """The places of each text's parts, of which new ones are learnt."""
        place, n, out = self.place, len(self.place), []
        for text in texts:
            parts = text.split(" ") if self.pair.cut else [""]
            try:
                out.append([place[p] for p in parts])
            except KeyError:
                if any(not p or p != p.strip() for p in parts) or "▁" in text:
                    # a key with a space in front is none that split() gives
                    parts = [p if p.strip() == p and " " not in p else " " + p for p in self.pair.parts(text)]
                out.append([place.setdefault(p, len(place)) for p in parts])
        new = list(islice(place, n, None))
        self.learn([p[1:] if p[0] == " " else p for p in new])
        return out

    def learn(self, parts: list[str]) -> None:
        """Adds parts in this order; those with spaces at an end are tokenised alone, those with others inside apart from the rest."""
        kinds = [2 if p[0] == " " or p[-1] == " " else int(" " in p) for p in parts]
        order = sorted(range(len(parts)), key=kinds.__getitem__)
        found, some, size = [], [], 0
        for i, k in enumerate(order, 1):
            some.append(parts[k])
            size += len(parts[k])
            if i == len(order) or size > ENCODED or kinds[k] == 2 or kinds[order[i]] != kinds[k]:
                found.append(self.pair.tokens(some))
                some, size = [], 0
        if found:
            tokens, sizes, good = zip(*found)
            a, b = (np.concatenate(x).astype(np.int64) for x in zip(*tokens))
            self._align(a, b, np.cumsum(np.concatenate(sizes)), np.array([x for fine in good for x in fine]), np.argsort(order))
        self.pair.a.clear()  # what it remembers is remembered here

    def _align(self, a: np.ndarray, b: np.ndarray, part_ends: np.ndarray, good: np.ndarray, back: np.ndarray) -> None:
        """Adds parts whose tokens follow each other, in the order ``back``."""
        a_ends, b_ends = np.cumsum(self.pair.a_sizes[a]), np.cumsum(self.pair.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        cut = b_ends[at] == a_ends if len(b) else np.zeros(0, bool)
        a_until, b_until = np.flatnonzero(cut) + 1, at[cut] + 1
        a_from, b_from = _before(a_until), _before(b_until)
        n_a, n_b, groups = a_until - a_from, b_until - b_from, np.arange(len(a_until))
        a_group, b_group = np.repeat(groups, n_a), np.repeat(groups, n_b)
        # a group's tokens as they are written, those of A first
        codes = np.zeros(len(a) + len(b), np.int64)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_until - 1] = b_last[b_until - 1] = 1
        codes[np.arange(len(a)) + b_from[a_group]] = 2 * a + a_last
        codes[np.arange(len(b)) + a_until[b_group]] = 2 * (self.a_size + b) + b_last
        written = self.written[codes].tolist()
        # its links: each distinct token of A with each of B
        (a_key, a_times), (b_key, b_times) = (np.unique(g * size + x, return_counts=True) for g, size, x in ((a_group, self.a_size, a), (b_group, self.b_size, b)))
        own_a, own_b = (np.bincount(key // size, minlength=len(groups)) for key, size in ((a_key, self.a_size), (b_key, self.b_size)))
        n_pairs = own_a * own_b
        nth, width = _places(np.zeros(len(groups), np.int64), n_pairs), np.repeat(own_b, n_pairs)
        i = np.repeat(_before(np.cumsum(own_a)), n_pairs) + nth // width
        j = np.repeat(_before(np.cumsum(own_b)), n_pairs) + nth % width
        pairs, times = a_key[i] % self.a_size * self.b_size + b_key[j] % self.b_size, a_times[i] * b_times[j]
        # by parts
        until = np.searchsorted(a_ends[cut], part_ends, "right")
        upto = lambda n: np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])[until]
        ends = {"n_a": upto(n_a), "n_b": upto(n_b), "n_groups": until, "n_links": upto(n_a * n_b)}
        token_ends, pair_ends = ends["n_a"] + ends["n_b"], upto(n_pairs)
        names = ["".join(written[x:y])[:-1] for x, y in zip(_before(token_ends).tolist(), token_ends.tolist())]
        self.names += [names[k] for k in back.tolist()]
        self.good.add(good[back])
        for k, x in ends.items():
            self.n[k].add((x - _before(x))[back])
        self.first.add(self.pairs.n + _before(pair_ends)[back])
        self.pairs_of.add((pair_ends - _before(pair_ends))[back])
        self.pairs.add(pairs)
        self.times.add(times)

    def batch(self, doc_ids: list, texts: list[str], schema: pa.Schema) -> pa.RecordBatch:
        """The rows of :func:`aligned` for some documents."""
        if self.full() or len(self.place) > len(self.names):  # the latter after a failure
            self.forget()
        docs = self.places(texts)
        n, size = len(docs), self.a_size * self.b_size
        part, doc = np.array([p for d in docs for p in d], np.int64), np.repeat(np.arange(n), [len(d) for d in docs])
        bad = np.bincount(doc[~self.good.all[part]], minlength=n) > 0
        part, doc = part[~bad[doc]], doc[~bad[doc]]
        sums = [np.bincount(doc, x.all[part], n).astype(np.int64) for x in self.n.values()]
        groups = ["" if lost else ";".join([self.names[p] for p in d]) for lost, d in zip(bad.tolist(), docs)]
        own, often = np.unique(doc * max(1, len(self.names)) + part, return_counts=True)
        doc, part = np.divmod(own, max(1, len(self.names)))
        links = self.pairs_of.all[part]
        at = _places(self.first.all[part], links)
        key, times = np.repeat(doc, links) * size + self.pairs.all[at], self.times.all[at] * np.repeat(often, links)
        order = np.argsort(key)
        key, times = key[order], times[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[begins], np.add.reduceat(times, begins) if len(begins) else times
        doc, pair = np.divmod(key, size)
        edges = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)).cast(schema.field(c).type) for c, x in (("pairs", pair.astype(self.kind)), ("times", times))]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, schema.field("doc_id").type), *map(pa.array, sums), pa.array(groups, schema.field("groups").type), *lists], schema=schema)


@lru_cache(1)
def _known(a_model: str, b_model: bytes) -> Known:
    return Known(Pair(a_model, b_model))


def aligned(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, groups (text), pairs and times.

    ``pairs`` are A's id times the size of B and B's id, sorted and distinct; ``times`` says how many links each has.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_model, b_model = a.read(), b.read()
    modest_batches(documents.sparkSession)
    source = documents.select("doc_id", "text")
    pairs = IntegerType() if _known(a_model, b_model).kind == np.int32 else LongType()
    lists = [StructField(c, ArrayType(kind, False)) for c, kind in (("pairs", pairs), ("times", LongType()))]
    out = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), StructField("groups", StringType()), *lists])
    schema = to_arrow_schema(out)

    def run(batches):
        known, doc_ids, texts, size = _known(a_model, b_model), [], [], 0
        for batch in batches:
            column = batch.column("text")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                doc_ids.append(doc_id)
                texts.append(column[k].as_py() or "")
                size += len(texts[-1]) + ROW_BYTES
                if size >= BLOCK_BYTES:
                    yield known.batch(doc_ids, texts, schema)
                    doc_ids, texts, size = [], [], 0
        if doc_ids:
            yield known.batch(doc_ids, texts, schema)
        give_back()

    return source.mapInArrow(run, out)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs) of rows with distinct ``pairs``: how many of them hold a pair."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))


def _weighed(rows: DataFrame) -> DataFrame:
    """Sums of one document's links in rows (row, times, docs, best)."""
    return rows.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def alignment(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    n_best counts the links whose pair's count is the highest that their A id has in the corpus, ties included; count_sum sums the counts
    over all links. groups_sha256 is the hex digest of the groups as ``a1,a2|b1;a3|b2,b3``.
    """
    spark = documents.sparkSession
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    with scratch(spark):
        digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
        rows = kept(aligned(documents, a_path, b_path).select(F.monotonically_increasing_id().alias("row"), "*", digest.alias("groups_sha256")).drop("groups"), "aligned")
        of_a = Window.partitionBy(F.floor(F.col("pair") / b_size))
        counts = kept(pair_counts(rows).withColumn("best", F.col("docs") == F.max("docs").over(of_a)), "pairs")
        total = counts.agg(F.sum("docs")).first()[0] or 0
        often = F.col("docs") * HUBS > total
        hubs, rest = F.broadcast(counts.filter(often)), counts.filter(~often)
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = _weighed(each.join(hubs, "pair")).unionByName(_weighed(each.join(hubs, "pair", "left_anti").join(rest, "pair")))
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = rows.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
        return kept(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment", outlives=True)
