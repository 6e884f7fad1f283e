"""Token-id shards with a minimal perfect hash index.

Documents are range-sorted by doc_id; each task encodes its range and writes raw id payloads, little-endian unsigned integers of
16 bits (of 32, if the vocabulary has more ids) and nothing else, to shard files of about ``SHARD_BYTES``. The index is dealt to buckets of about ``BUCKET_KEYS`` keys
by hash, one file each: a minimal perfect hash over the bucket's keys (levels of bit arrays, in which a key takes the first
level where no other key hits its bit; its slot is the number of bits set before) and, by slot, the key's fingerprint, shard,
offset and length. A lookup reads one bucket, probes a constant expected number of levels, compares the fingerprint, and reads
just the payload's range.

A key is a doc_id with the number of the row among those of the same doc_id, by text. Files are written under a temporary name
and renamed when complete, so a task that is run again replaces its file with the same bytes. Order and contents of
all files follow from the documents alone.

Defined results: null text is encoded as empty text, just the end id; a null doc_id is a key like any other, first in order;
an empty table makes no file; other columns are ignored; a folder in a store other than ``STORES`` raises ValueError, as does one without a
scheme (:func:`stored` takes the shared folder with the scheme that Spark gives it). Rows of one doc_id follow each other, so they are one task's. Memory:
long texts are encoded in segments of about ``SEGMENT`` characters where they have single spaces to cut at; a text's ids are held.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from tokenizers import Tokenizer

from corpusloom.llm._store import kept, modest_batches, new_path
from corpusloom.llm._text import mix

#: Payload bytes of a shard file, and index keys of a bucket.
SHARD_BYTES, BUCKET_KEYS = 256 << 20, 1 << 15
#: Bits of a level for each of its keys, and levels before what is left is listed.
SPREAD, LEVELS = 2, 24
#: Text units whose ids a worker remembers.
REMEMBERED = 700_000
#: Characters from which a text is encoded in segments.
SEGMENT = 1 << 19
#: Keys of a bucket for each one asked for, up to which its file is read whole.
WHOLE_FROM = 64
#: Stores of shard files, by the scheme of their folder. A file:// folder has to be one that all machines share.
STORES = ("file", "hdfs")
#: The id that ends a document.
END_ID = 2

_HEAD, _HEAD_BYTES = "<4sIII", 16
_SLOT = np.dtype([("mark", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("n", "<u8")])
#: A block of a level's bits: how many are set before it in the bucket, in 4 bytes, and 480 bits.
_BLOCK_BITS, _BLOCK_BYTES = 480, 64
# The pattern of the byte-level pre-tokenizer, a fixed value, once as it is and once for ASCII.
_LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: What isn't printable ASCII, tab, line end or Latin script. On its classes engines may differ, so it goes through the library.
_STRANGE = re.compile("[^\t\n\x20-\x7e\u00a1-\u024f]")


def code_of(tokenizer: Tokenizer) -> str:
    """The array code of its ids: H for 16 bits, I for 32."""
    return "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"


#: A word in Latin script, with a mark after it or not.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)")


class Encoder(dict):
    """A byte-level BPE tokenizer of the tokenizers library that remembers the units it has met, as {unit: ids}.

    A unit is a space and what follows up to the next space; its key leaves the space out. No pre-token reaches over a single
    space from before it, so units are encoded alone; texts with two spaces in a row are encoded whole. Units in
    Latin script are cut to pre-tokens here, for which the library's model is called directly; others go through the whole library.
    All of that is so for the byte-level pre-tokenizer with its usual pattern, without a normalizer or dropout: with a file that says
    anything else, every text goes through the library.
    """

    def __init__(self, model: str):
        super().__init__()
        self.whole = Tokenizer.from_str(model)
        self.whole.no_padding()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
        self.code = code_of(self.whole)
        self.tokenize = self.whole.model.tokenize
        self.letters_space = chr(self.letters[0x20])
        self.marks = {m: array(self.code, [t.id for t in self.tokenize(m)]).tobytes() for m in ".,"}
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        said = json.loads(model)
        cut, merges = said.get("pre_tokenizer") or {}, said.get("model") or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and said.get("normalizer") is None
        usual = usual and said.get("truncation") is None and merges.get("type") == "BPE" and not merges.get("dropout")
        tokens = said.get("added_tokens") or []
        self.usual = bool(usual) and not any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")) and not any(" " in t["content"] for t in tokens)

    def __missing__(self, unit: str) -> bytes:
        plain = _PLAIN.fullmatch(unit)
        if plain is None:
            ids = self.alone(" " + unit)
        elif plain[2]:  # a mark is a pre-token of its own, and the word may be known
            ids = self[plain[1]] + self.marks[plain[2]]
        else:
            word = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.tokenize(self.letters_space + word)]).tobytes()
        if len(self) < REMEMBERED and len(unit) <= 64:
            self[unit] = ids
        return ids

    def alone(self, text: str) -> bytes:
        """The ids of a text that isn't remembered."""
        if _STRANGE.search(text) or any(s in text for s in self.specials):
            return array(self.code, self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        ids, tokenize, letters = array(self.code), self.tokenize, self.letters
        if text.isascii():
            words = [w.translate(letters) for w in _WORDS.findall(text)]
        else:
            words = [w.encode().decode("latin-1").translate(letters) for w in _LATIN_WORDS.findall(text)]
        for word in words:
            ids.extend([t.id for t in tokenize(word)])
        return ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of the width of ``code``."""
        if not self.usual:
            return [array(self.code, got.ids).tobytes() for got in self.whole.encode_batch(texts, add_special_tokens=False)]
        out, ids_of, odd = [], self.__getitem__, []
        for k, text in enumerate(texts):
            if len(text) > 2 * SEGMENT and (parts := list(segments(text)))[1:]:
                out.append(b"".join(self.encode([part])[0] for part in parts))
                continue
            if "  " in text or any(s in text for s in self.specials):
                odd.append(k)
                out.append(b"")
                continue
            first, *units = text.split(" ")
            out.append(self.alone(first) + b"".join(map(ids_of, units)))
        for k, got in zip(odd, self.whole.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = array(self.code, got.ids).tobytes()
        return out


_GAP = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str):
    """A long text, cut before single spaces between other characters: no pre-token reaches over such a place."""
    at = 0
    while len(text) - at > 2 * SEGMENT:
        gap = _GAP.search(text, at + SEGMENT)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def _encoder(model: str) -> Encoder:
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder with a scheme; a store that pyarrow and Spark wouldn't reach alike raises ValueError."""
    scheme, _, rest = folder.partition(":")
    if scheme not in STORES or not rest.startswith("/"):
        raise ValueError(f"shards can be written to {', '.join(STORES)} only, not to {folder}")
    return fs.FileSystem.from_uri("file://" + rest if scheme == "file" and not rest.startswith("//") else folder)


class _Shard:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.files, base = _opened(folder)
        self.files.create_dir(base, recursive=True)
        self.path, self.draft = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        self.bytes = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.draft, self.path)


def shard_name(shard: int) -> str:
    return f"shard-{shard >> 12:08d}-{shard & 4095:04d}.ids"


def write_shards(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shard files of documents (doc_id, text) and returns (doc_id, nth, shard, offset, n, start), one row each.

    offset counts the ids before it in the shard, start those in all shards; n counts the document's, with the end id.
    """
    _opened(folder)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    modest_batches(documents.sparkSession)

    def run(batches):
        encoder, part, seq = _encoder(model), TaskContext.get().partitionId(), 0
        end = array(encoder.code, [end_id]).tobytes()
        shard, last, nth = None, None, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            payloads = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            nths, shards, offsets, sizes = [], [], [], []
            for k, (doc_id, payload) in enumerate(zip(ids, payloads)):
                nth = nth + 1 if (doc_id,) == last else 0
                last = (doc_id,)
                if shard is None or shard.bytes >= SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                        seq += 1
                        if seq >= 4096:
                            raise ValueError("a task's range has more than 4096 shards: raise the number of ranges")
                    shard = _Shard(folder, shard_name(part << 12 | seq))
                nths.append(nth)
                shards.append(part << 12 | seq)
                offsets.append(shard.bytes // len(end))
                sizes.append(len(payload) // len(end) + 1)
                shard.write(payload + end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (nths, shards, offsets, sizes))], names=["doc_id", "nth", "shard", "offset", "n"])
        if shard is not None:
            shard.close()

    kind = documents.schema["doc_id"].dataType.simpleString()
    ranged = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = kept(ranged.mapInArrow(run, f"doc_id {kind}, nth long, shard long, offset long, n long"), "shards")
    totals = rows.groupBy("shard").agg(F.sum("n").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard file
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", "nth", "shard", "offset", "n", (F.col("base") + F.col("offset")).alias("start"))


def _level(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + mix(h2 + np.uint64(level * 0x9E3779B9 + 1))) % np.uint64(bits)).astype(np.int64)


def _blocks(bits: np.ndarray, before: int) -> np.ndarray:
    """Bits in blocks (n x 64 bytes), each after the number of bits set before it."""
    room = np.zeros(-(-len(bits) // _BLOCK_BITS) * _BLOCK_BITS, bool)
    room[: len(bits)] = bits
    cells = room.reshape(-1, _BLOCK_BITS)
    count = cells.sum(axis=1)
    rank = (before + np.concatenate([[0], np.cumsum(count)[:-1]])).astype("<u4")
    return np.concatenate([rank.view(np.uint8).reshape(-1, 4), np.packbits(cells, axis=1, bitorder="little")], axis=1)


def _in_blocks(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the block and bit of each key: whether the bit is set, and how many are before it."""
    bits = np.unpackbits(rows[:, 4:], axis=1, bitorder="little")
    rank = np.ascontiguousarray(rows[:, :4]).view("<u4")[:, 0].astype(np.int64)
    return bits[np.arange(len(at)), at] == 1, rank + (bits * (np.arange(_BLOCK_BITS) < at[:, None])).sum(axis=1)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes: n keys to 0..n - 1. sizes: the bits of each level."""

    def __init__(self, sizes: list[int], levels: list[np.ndarray], rest: np.ndarray, before: int):
        self.sizes, self.levels, self.rest, self.before = sizes, levels, rest, before

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels, before = [], [], 0
        for level in range(LEVELS):
            if not len(h1):
                break
            bits = max(64, SPREAD * len(h1))
            at = _level(h1, h2, level, bits)
            hits = np.bincount(at, minlength=bits)
            sizes.append(bits)
            levels.append(_blocks(hits == 1, before))
            before += int((hits == 1).sum())
            left = hits[at] > 1
            h1, h2 = h1[left], h2[left]
        return cls(sizes, levels, np.stack([h1, h2], axis=1).astype(np.uint64).reshape(-1, 2), before)

    def __len__(self) -> int:
        return self.before + len(self.rest)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that wasn't built in, any slot or -1."""
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (bits, blocks) in enumerate(zip(self.sizes, self.levels)):
            at = _level(h1[todo], h2[todo], level, bits)
            hit, rank = _in_blocks(blocks[at // _BLOCK_BITS], at % _BLOCK_BITS)
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        for k, (a, b) in enumerate(self.rest):
            out[todo[(h1[todo] == a) & (h2[todo] == b)]] = self.before + k
        return out

    def dump(self) -> bytes:
        """Numbers of levels, of keys in them and of keys besides, LEVELS sizes, the blocks, and the keys besides."""
        sizes = [*self.sizes, *[0] * (LEVELS - len(self.sizes))]
        return struct.pack(f"<III{LEVELS}I", len(self.sizes), self.before, len(self.rest), *sizes) + b"".join(x.tobytes() for x in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        sizes, before, rest, at = _dump_head(data)
        levels = []
        for size in sizes:
            n = -(-size // _BLOCK_BITS)
            levels.append(np.frombuffer(data, np.uint8, n * _BLOCK_BYTES, at).reshape(n, _BLOCK_BYTES))
            at += n * _BLOCK_BYTES
        return cls(sizes, levels, np.frombuffer(data, "<u8", 2 * rest, at).reshape(-1, 2), before), at + 16 * rest


_DUMP_HEAD = struct.calcsize(f"<III{LEVELS}I")


def _dump_head(data) -> tuple[list[int], int, int, int]:
    n, before, rest, *sizes = struct.unpack_from(f"<III{LEVELS}I", data)
    return sizes[:n], before, rest, _DUMP_HEAD


def probe(file, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a few keys, by small reads: of each, the entry and whether its fingerprint is the key's."""
    head = file.read_at(_HEAD_BYTES + _DUMP_HEAD, 0)
    _, n, size, _ = struct.unpack_from(_HEAD, head)
    sizes, before, rest, at = _dump_head(memoryview(head)[_HEAD_BYTES:])
    starts = _HEAD_BYTES + at + _BLOCK_BYTES * np.concatenate([[0], np.cumsum([-(-s // _BLOCK_BITS) for s in sizes])]).astype(np.int64)
    got, found = np.zeros(len(h1), _SLOT), np.zeros(len(h1), bool)
    for k in range(len(h1)):
        a, b, slot = h1[k : k + 1], h2[k : k + 1], -1
        for level, bits in enumerate(sizes):
            place = _level(a, b, level, bits)
            block = np.frombuffer(file.read_at(_BLOCK_BYTES, int(starts[level] + place[0] // _BLOCK_BITS * _BLOCK_BYTES)), np.uint8)
            hit, rank = _in_blocks(block[None], place % _BLOCK_BITS)
            if hit[0]:
                slot = int(rank[0])
                break
        else:
            if rest:
                others = np.frombuffer(file.read_at(16 * rest, int(starts[-1])), "<u8").reshape(-1, 2)
                same = np.flatnonzero((others[:, 0] == a[0]) & (others[:, 1] == b[0]))
                slot = before + int(same[0]) if len(same) else -1
        if slot >= 0:
            got[k] = np.frombuffer(file.read_at(_SLOT.itemsize, _HEAD_BYTES + size + _SLOT.itemsize * slot), _SLOT)[0]
            found[k] = got[k]["mark"] == int(b[0]) >> 32
    return got, found


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("doc_id").isNull(), F.col("nth").cast("long")]
    rows = keys.withColumn("h1", F.xxhash64(*key)).withColumn("h2", F.xxhash64(F.lit("second"), *key))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("h1"), F.lit(buckets)).cast("long"))


def _runs(batches, column: str):
    """Tables of the equal values of a sorted column, over batch borders."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        at = held.column(column).to_numpy()
        edges = np.concatenate([[0], 1 + np.flatnonzero(at[1:] != at[:-1])])
        for s, e in zip(edges, edges[1:]):
            yield held.slice(s, e - s)
        held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def write_index(rows: DataFrame, folder: str) -> int:
    """Writes the index files of rows (doc_id, nth, shard, offset, n) and returns how many buckets there are."""
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))

    def run(batches):
        for t in _runs(batches, "bucket"):
            h1, h2 = (t.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
            perfect = PerfectHash.build(h1, h2)
            table = np.zeros(len(perfect), _SLOT)
            table["mark"][slots := perfect.slots(h1, h2)] = (h2 >> np.uint64(32)).astype("<u4")
            for c in ("shard", "offset", "n"):
                table[c][slots] = t.column(c).to_numpy()
            hashes = perfect.dump()
            shard = _Shard(folder, f"index-{t.column('bucket')[0].as_py():08d}.mph")
            shard.write(struct.pack(_HEAD, b"MPH1", len(table), len(hashes), _SLOT.itemsize) + hashes + table.tobytes())
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int64())], names=["keys"])

    dealt = _hashed(rows.select("doc_id", "nth", "shard", "offset", "n"), buckets).repartition("bucket").sortWithinPartitions("bucket")
    dealt.select("bucket", "h1", "h2", "shard", "offset", "n").mapInArrow(run, "keys long").agg(F.sum("keys")).collect()
    return buckets


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """keys (doc_id, nth) with shard, offset and n of each from the index; null for keys that it doesn't hold."""
    kind = keys.schema["doc_id"].dataType.simpleString()

    def run(batches):
        files, base = _opened(folder)
        for t in _runs(batches, "bucket"):
            h1, h2 = (t.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
            path = f"{base}/index-{t.column('bucket')[0].as_py():08d}.mph"
            found, got = np.zeros(len(h1), bool), np.zeros(len(h1), _SLOT)
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_file(path) as f:
                    if WHOLE_FROM * len(h1) < struct.unpack_from(_HEAD, f.read_at(_HEAD_BYTES, 0))[1]:
                        got, found = probe(f, h1, h2)
                    else:
                        data = memoryview(f.read_at(f.size(), 0))
                        _, n, size, _ = struct.unpack_from(_HEAD, data)
                        perfect, _ = PerfectHash.load(data[_HEAD_BYTES : _HEAD_BYTES + size])
                        table = np.frombuffer(data, _SLOT, n, _HEAD_BYTES + size)
                        slots = perfect.slots(h1, h2)
                        got = table[np.maximum(slots, 0)]
                        found = (slots >= 0) & (got["mark"] == (h2 >> np.uint64(32)))
            cells = [pa.array(got[c].astype(np.int64), mask=~found) for c in ("shard", "offset", "n")]
            yield from pa.table([t.column("doc_id"), t.column("nth"), *cells], names=["doc_id", "nth", "shard", "offset", "n"]).to_batches()

    dealt = _hashed(keys.select("doc_id", F.col("nth").cast("long").alias("nth")), buckets).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "h1", "h2", "doc_id", "nth").mapInArrow(run, f"doc_id {kind}, nth long, shard long, offset long, n long")


def fetch(places: DataFrame, folder: str, code: str) -> DataFrame:
    """places (shard, offset, n, ...) with payload, the ids read at each as little-endian unsigned 32-bit integers.

    code: the width of the stored ids. A shard's reads follow each other in a task.
    """
    modest_batches(places.sparkSession)
    kind = np.dtype({"H": "<u2", "I": "<u4"}[code])
    places = places.drop("payload")

    def run(batches):
        files, base = _opened(folder)
        opened, file = None, None
        for batch in batches:
            payloads = []
            for shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n"))):
                if shard is None:
                    payloads.append(None)
                    continue
                if shard != opened:
                    if file is not None:
                        file.close()
                    opened, file = shard, files.open_input_file(f"{base}/{shard_name(shard)}")
                stored_ids = np.frombuffer(file.read_at(kind.itemsize * n, kind.itemsize * offset), kind)
                payloads.append(stored_ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], names=[*batch.schema.names, "payload"])
        if file is not None:
            file.close()

    near = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(run, StructType([*places.schema.fields, StructField("payload", BinaryType())]))


def stored(spark: SparkSession, documents: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes shards and index of documents, then reads every document back by its key: (doc_id, nth, shard, offset, n, start, payload)."""
    folder = folder or new_path(spark, "tokens")
    rows = kept(write_shards(documents, folder, tokenizer_path), "placed")
    buckets = write_index(rows, folder)
    numbered = Window.partitionBy("doc_id").orderBy(F.lit(0))
    keys = documents.select("doc_id").withColumn("nth", F.row_number().over(numbered).cast("long") - 1)
    bases = rows.groupBy("shard").agg(F.min(F.col("start") - F.col("offset")).alias("base"))
    # the payloads come last, so that no shuffle carries them
    places = lookup(keys, folder, buckets).join(bases, "shard", "left")
    places = places.select("doc_id", "nth", "shard", "offset", "n", (F.col("base") + F.col("offset")).alias("start"))
    return fetch(places, folder, code_of(Tokenizer.from_file(tokenizer_path)))
