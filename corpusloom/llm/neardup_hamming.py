"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles (fewer words: the whole sequence; no word: empty). Documents are linked
when 100 x intersection >= 75 x union of their full sets, and a group is what links connect. Shingles have 64-bit names, so that
two different shingles count as one with a chance of 2^-64 a pair; sets are told apart by 128 bits.

1. Documents with equal sets collapse into one class; everything after works on classes.
2. A class has ``INDEXED`` 16-bit and ``EXTRA`` 8-bit MinHash symbols. The indexed ones form ``CHUNKS`` chunks of four. Two
   signatures that differ in at most ``REACH`` indexed symbols must, by pigeonhole, have a chunk that differs in at most one;
   enumerating that one allowed error (each of the four symbols left out) gives keys of which such a pair shares at least one.
   At similarity 0.75 more than ``REACH`` differences have a chance of about 1.6e-4; above, far less.
3. Hot keys are not joined with themselves. First, each class is held only against the least class of its keys, the one with
   which it shares the most keys, and confirmed links give first groups. What is left are pairs of one key in different first
   groups. In keys of up to ``BLOCK`` classes they are compared by signature, each pair only at its first shared key, and a key
   emits a spanning forest of its agreeing pairs. In larger keys nothing is compared: every class is tied to the key's least.
4. What those ties connect are families, which a prefix filter on full sets cuts up: with a set's shingles in one fixed order,
   rare ones first, two sets of similarity 0.75 share one of their first n - ceil(0.75 n) + 1. Sets of a family that are connected
   by such shingles meet in pairs of blocks of about ``CELL`` sets (block pairs inside one first group are left out), where
   intersections are counted with an inverted index and links emit a spanning forest of the first groups they connect. So
   no step has more rows than keys, prefixes or blocks have members. Within a cut-up family the block pairs are still quadratic in
   its blocks; such a family has mutually similar sets only.
   Full sets are recomputed, once a step, from the texts concerned. Which texts those are reaches the scan as a Bloom filter with a
   size by their number, ``MOST_FILTER_BITS`` at most, and an exact join follows; beyond, that join does it all.
5. Groups are found by alternating large-star and small-star steps, each written to the shared folder.

Joins on a hot key don't gather its rows: a key with more rows than one in ``MOST_HUBS`` of all (and ``HUB``) is a hub; there are
``MOST_HUBS`` of them at most, so what belongs to them is broadcast, and only the others' rows are shuffled by key.

Defined results: null or blank text has n_shingles 0 and is a group of its own; equal sets are one group; rows with null doc_id
link others like any row, and a group of nothing else has a null component_id and isn't marked as kept; rows that repeat a doc_id
are separate rows, in the same group or not, as their texts are; :func:`deduplicated` keeps one row of each group, whatever its
ids; an empty table gives no row; further columns are ignored, whatever their names.

Memory: a text of more than ``_text.PIECE_BYTES`` is read in slices; its words take 8 bytes each and its set of names 8 more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import give_back, kept, modest_batches, scratch
from corpusloom.llm._text import mix, pieces, seeds, shingles, utf8, words_of

#: Symbols that are indexed, in chunks of four, and symbols that are only compared.
CHUNKS, CHUNK = 12, 4
INDEXED, EXTRA = CHUNKS * CHUNK, 144
#: Differences of indexed symbols up to which a pair is sure to share a key: fewer than two in each chunk on average.
REACH = 2 * CHUNKS - 1
#: Agreeing symbols from which a pair is confirmed on full sets: 4.5 standard deviations below the mean at similarity 0.75.
LEAST_AGREEING = 117
#: Keys shared with the least class from which that pair is tried first. Only order depends on it, no link does.
FIRST_TRY = 5
#: Classes of a key that are compared with each other.
BLOCK = 512
#: Full sets in a block of a family.
CELL = 512
#: Buckets in which shingles are counted to order them.
RARITY = 1 << 18
#: Bits of the filter of wanted texts for each of them, and at most: 32 MB.
FILTER_SHARE, MOST_FILTER_BITS = 16, 1 << 28
#: Rows of a key that one task takes in a join, and keys with more of them that are broadcast.
HUB, MOST_HUBS = 256, 1_000_000

_A = (seeds(INDEXED + EXTRA, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(INDEXED + EXTRA, 32) >> np.uint64(32)).astype(np.uint32)
_SLOT = seeds(INDEXED, 33)
_TRIPLES = [(c * CHUNK + o, [c * CHUNK + q for q in range(CHUNK) if q != o]) for c in range(CHUNKS) for o in range(CHUNK)]


def set_names(names: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set of shingle names."""
    with np.errstate(over="ignore"):
        both = np.array([mix(names ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x5DEECE66D, 0x9E6C63D0676A9A99)]) + np.uint64(len(names))
        return tuple(mix(both).astype(np.int64).tolist())


def signature(names: np.ndarray) -> bytes:
    low = np.full(INDEXED + EXTRA, 0xFFFFFFFF, np.uint32)
    x = (names >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 1024):
            np.minimum(low, (x[k : k + 1024, None] * _A + _B).min(axis=0), out=low)
        symbol = mix(low.astype(np.uint64))
    return symbol[:INDEXED].astype(np.uint16).tobytes() + symbol[INDEXED:].astype(np.uint8).tobytes()


def _sets(column):
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        yield from shingles(words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def text_hash() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text", F.length("text"))


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, node, check, signature) of each row of documents (doc_id, text); the last three are null for empty sets."""
    modest_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, nodes, checks, marks = [], [], [], []
            for names in _sets(batch.column("text")):
                node, check = set_names(names) if len(names) else (None, None)
                sizes.append(len(names))
                nodes.append(node)
                checks.append(check)
                marks.append(signature(names) if len(names) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(x, pa.int64()) for x in (sizes, nodes, checks)), pa.array(marks, pa.binary())], names=["doc_id", "th", "n_shingles", "node", "check", "signature"])
        give_back()

    ids = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, f"doc_id {ids}, th long, n_shingles long, node long, check long, signature binary")


def spread(rows: DataFrame, table: DataFrame, key: str, values: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined to ``values`` of table, which has a row for each ``key`` and says in ``n`` how many rows have it (``total`` in all).

    Rows of hubs and rows with a null key stay apart; what hubs have is broadcast, and there are MOST_HUBS of them at most.
    """
    hub = max(HUB, -(-total // MOST_HUBS))
    if total <= hub:  # there is no hub
        found = table.select(F.col(key).alias("__key"), *(F.col(v).alias(f"__{v}") for v in values))
        return rows.join(found, F.col(key) == F.col("__key"), how).select(*rows.columns, *(F.col(f"__{v}").alias(v) for v in values))
    hot = table.filter(F.col("n") > hub).select(F.col(key).alias("__hub"), F.struct(*values).alias("__hot"))
    cold = table.filter(F.col("n") <= hub).select(F.col(key).alias("__key"), F.struct(*values).alias("__cold"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hub"), "left")
    alone = F.xxhash64(F.monotonically_increasing_id())
    dealt = dealt.withColumn("__at", F.when(F.col("__hub").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone))
    found = F.when(F.col("__hub").isNotNull(), F.col("__hot")).when(F.col("__at") == F.col(key), F.col("__cold"))
    both = dealt.join(cold, F.col("__at") == F.col("__key"), "left").withColumn("__found", found)
    if how == "inner":
        both = both.filter("__found is not null")
    return both.select(*rows.columns, *(F.col(f"__found.{v}").alias(v) for v in values))


def symbols(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), 2 * INDEXED + EXTRA)
    return np.ascontiguousarray(raw[:, : 2 * INDEXED]).view(np.uint16), raw[:, 2 * INDEXED :]


def keys_of(indexed: np.ndarray) -> np.ndarray:
    """The keys of each signature, one column a slot; a key's lowest six bits are its slot."""
    wide = indexed.astype(np.uint64)
    out = np.empty((len(wide), INDEXED), np.uint64)
    with np.errstate(over="ignore"):
        for slot, (a, b, c) in _TRIPLES:
            out[:, slot] = mix((wide[:, a] | (wide[:, b] << np.uint64(16)) | (wide[:, c] << np.uint64(32))) + _SLOT[slot])
    return (out & ~np.uint64(63)) | np.arange(INDEXED, dtype=np.uint64)


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(symbols(batch.column("signature").to_pylist())[0])
                nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), INDEXED)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(nodes)], names=["key", "node"])
        give_back()

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def first_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of indexed signatures, the first slot of which they share the key; INDEXED if none."""
    same = (a == b).reshape(len(a), CHUNKS, CHUNK)
    missing = CHUNK - same.sum(axis=2)
    chunk = np.argmax(missing <= 1, axis=1)
    row = np.arange(len(a))
    inside = np.where(missing[row, chunk] == 0, 0, np.argmin(same[row, chunk], axis=1))
    return np.where(missing[row, chunk] <= 1, chunk * CHUNK + inside, INDEXED)


def compare(slot: int, label: np.ndarray, size: np.ndarray, wide: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one key with different labels and enough agreeing symbols, whose first shared key is ``slot``."""
    order = np.argsort(label, kind="stable")
    label, size, wide, narrow = label[order], size[order], wide[order], narrow[order]
    starts = np.concatenate([np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), [len(label)]])
    left, right = [], []
    for s, e in zip(starts[:-1], starts[1:-1]):
        for k in range(s, e, 64):
            stop = min(e, k + 64)
            fits = 4 * np.minimum(size[k:stop, None], size[e:]) >= 3 * np.maximum(size[k:stop, None], size[e:])
            p, q = np.nonzero(fits)
            if len(p):
                p, q = p + k, q + e
                for c in range(0, len(p), 1 << 15):
                    x, y = p[c : c + (1 << 15)], q[c : c + (1 << 15)]
                    agree = (wide[x] == wide[y]).sum(axis=1) + (narrow[x] == narrow[y]).sum(axis=1)
                    x, y = x[agree >= LEAST_AGREEING], y[agree >= LEAST_AGREEING]
                    here = first_slot(wide[x], wide[y]) == slot
                    left.append(order[x[here]])
                    right.append(order[y[here]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What edges connect, as edges from each node to the least node of its tree."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (jump := root[root]).tolist() != root.tolist():
            root = jump
        if (root[x] == root[y]).all():
            break
    inner = root != np.arange(len(names))
    return names[inner], names[root[inner]]


def _cells(batches, names: tuple[str, ...]):
    """Tables of the rows of equal ``names`` from sorted batches, several whole cells in each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(c)[held.num_rows - 1].as_py() for c in names]
        tail = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(names, last)])
        cut = int(np.argmax(tail))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _borders(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    change = np.logical_or.reduce([(c := table.column(n).to_numpy())[1:] != c[:-1] for n in names])
    return np.concatenate([[0], 1 + np.flatnonzero(change), [table.num_rows]])


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _alike(rows: DataFrame) -> DataFrame:
    """Forests (a, b) of the classes whose signatures agree, of rows (key, node, label, n_shingles, signature) of at most BLOCK a key."""

    def run(batches):
        for t in _cells(batches, ("key",)):
            at = _borders(t, ("key",))
            key, node, label, size = (t.column(c).to_numpy() for c in ("key", "node", "label", "n_shingles"))
            wide, narrow = symbols(t.column("signature").to_pylist())
            found = []
            for s, e in zip(at, at[1:]):
                x, y = compare(int(key[s]) & 63, label[s:e], size[s:e], wide[s:e], narrow[s:e])
                found.append(forest(node[s:e][x], node[s:e][y]))
            yield _edges(found)
        give_back()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def linked_labels(label: np.ndarray, first: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the labels that links of full sets connect; set k is names[first[k]:first[k + 1]]."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    _, word = np.unique(names, return_inverse=True)
    order = np.argsort(word, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(word))])
    a, b = [], []
    for k in range(len(size)):
        w = word[first[k] : first[k + 1]]
        n = begin[w + 1] - begin[w]
        at = np.arange(n.sum()) + np.repeat(begin[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(posting[at], minlength=len(size))
        hit = np.flatnonzero((100 * both >= 75 * (size[k] + size - both)) & (label != label[k]))
        a.append(np.full(len(hit), label[k]))
        b.append(label[hit])
    return forest(np.concatenate(a), np.concatenate(b))


def _late_links(late: DataFrame) -> DataFrame:
    """Links (a, b) between labels of late (node, family, label, names), by the full sets of all members."""
    counted = late.select(F.explode("names").alias("name")).groupBy(F.col("name").bitwiseAND(RARITY - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    often = np.zeros(RARITY, np.int64)
    for r in counted.collect():  # RARITY rows at most
        often[r["bucket"]] = r["n"]

    def prefixes(batches):
        for batch in batches:
            owners, found = [], []
            for k, names in enumerate(batch.column("names").to_pylist()):
                names = np.array(names, np.int64)
                rare = np.lexsort((names, often[names & (RARITY - 1)]))[: len(names) + (-75 * len(names)) // 100 + 1]
                owners.append(np.full(len(rare), k))
                found.append(names[rare])
            at = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
            columns = [batch.column(c).take(at) for c in ("node", "family", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["node", "family", "label", "name"])
        give_back()

    rare = late.mapInArrow(prefixes, "node long, family long, label long, name long").select("node", "label", F.xxhash64("family", "name").alias("name"))
    rare = kept(rare, "rare")
    shared = rare.groupBy("name").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1")
    ties = spread(rare.select("node", "name"), kept(shared, "shared"), "name", ["least"], rare.count())
    close = components(ties.select(F.col("node").alias("a"), F.col("least").alias("b"))).select("node", F.col("root").alias("part"))
    families = kept(late.select("node", "label").join(close, "node").select("node", F.col("part").alias("family"), "label"), "close")

    counts = families.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    pooled = counts.filter(F.col("n") < CELL).groupBy("family").agg(F.sum("n").alias("pool"))
    counts = counts.join(pooled, "family", "left")
    own = F.col("size") >= CELL
    both = F.xxhash64("family", "label")
    counts = kept(counts.select(both.alias("both"), "n", F.col("n").alias("size"), "pool"), "counts")
    placed = spread(families.withColumn("both", both), counts, "both", ["size", "pool"], families.count())
    # a label of CELL members or more has blocks of its own; smaller labels share blocks
    placed = placed.select("family", "node", "label", F.when(own, F.col("label")).alias("single"), F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CELL))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("pool") / CELL))).alias("part"))
    placed = kept(placed.withColumn("block", F.xxhash64("single", "part")), "placed")
    blocks = placed.select("family", "block", "single").distinct()
    pairs = blocks.join(blocks.select("family", F.col("block").alias("block2"), F.col("single").alias("single2")), "family")
    pairs = pairs.filter((F.col("block") <= F.col("block2")) & ~(F.coalesce(F.col("single") == F.col("single2"), F.lit(False))))
    seats = pairs.select("family", F.col("block").alias("x"), F.col("block2").alias("y"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    rows = placed.select("family", "block", "node", "label").join(seats, ["family", "block"]).join(late.select("node", "names"), "node")

    def run(batches):
        for t in _cells(batches, ("family", "x", "y")):
            at = _borders(t, ("family", "x", "y"))
            label, column = t.column("label").to_numpy(), t.column("names").combine_chunks()
            first, names = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
            yield _edges([linked_labels(label[s:e], first[s : e + 1] - first[s], names[first[s] : first[e]]) for s, e in zip(at, at[1:])])
        give_back()

    return rows.select("family", "x", "y", "label", "names").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(run, "a long, b long")


class _Filter:
    """A Bloom filter of 64-bit keys with one bit each, of a size by their number; too many keys for it: it lets all through."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = 1 << max(16, (FILTER_SHARE * n).bit_length())
        self.open = n > MOST_FILTER_BITS // 4
        self.bits = min(self.bits, MOST_FILTER_BITS)
        self.map = np.zeros(self.bits // 8, np.uint8)
        if self.open:
            return
        # bitmap_bucket_number and bitmap_bit_position number the values from 1
        rows = keys.select((self.place("key") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        for r in rows:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            at = (r["bucket"] - 1) * 4096
            self.map[at : at + len(part)] |= part

    def place(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def passes(self, key: str) -> Column:
        if self.open:
            return F.lit(True)
        bits = self.map

        @F.pandas_udf("boolean")
        def maybe(place):
            at = place.to_numpy()
            return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

        return maybe(self.place(key))


def full_sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """wanted (node, ...), a row for each class, with ``names``, its set of shingle names, from the class's least row."""
    places = wanted.join(classes.select("node", "check", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "node")
    places = kept(places.withColumn("key", F.xxhash64("rep_id", "rep_th")), "wanted")
    passes = _Filter(places.select("key"))
    rows = documents.select("doc_id", text_hash().alias("th"), "text").withColumn("row_key", F.xxhash64("doc_id", "th")).filter(passes.passes("row_key"))
    rows = rows.dropDuplicates(["row_key", "doc_id", "th"])
    found = rows.join(places, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).select("text", "check", *wanted.columns)
    modest_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            lists, right = [], []
            for names, check in zip(_sets(batch.column("text")), batch.column("check").to_pylist()):
                right.append(set_names(names)[1] == check)
                lists.append(names.astype(np.int64))
            columns = [*batch.columns[2:], pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[2:], "names"]).filter(pa.array(right, pa.bool_()))
        give_back()

    return kept(found.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", names array<long>"), name)


def confirmed(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked by their full sets; b may be in many pairs, a is in few."""
    sets = full_sets(documents, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "sets")
    # many pairs of one b are dealt out, and its set is sent to each part
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    many = kept(counts.filter("parts > 1"), "many")
    dealt = spread(pairs, many.withColumn("n", F.lit(HUB).cast("long") * F.col("parts")), "b", ["parts"], pairs.count(), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)).cast("long")))
    seats = sets.join(many, F.col("node") == F.col("b"), "left").select(F.col("node").alias("b"), F.col("names").alias("names_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("names").alias("names_a")), "a").join(seats, ["b", "part"])
    shared = F.size(F.array_intersect("names_a", "names_b"))
    linked = 100 * shared >= 75 * (F.size("names_a") + F.size("names_b") - shared)
    return both.filter(linked).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) touches: root is its group's least node."""
    def star_sum(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    seen = star_sum(edges)
    while seen[0]:
        around = edges.union(edges.select(F.col("b"), F.col("a")))
        least = around.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("low", F.least("low", "a"))
        least = least if 2 * seen[0] <= HUB else kept(least, "least")
        large = spread(around, least, "a", ["low"], 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = kept(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        least = least if 2 * seen[0] <= HUB else kept(least, "least")
        small = spread(large, least, "a", ["low"], 2 * seen[0]).select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        edges = kept(small, "edges")
        now = star_sum(edges)
        if now == seen:
            break
        seen = now
    # every edge now leads from a node to its group's least, which has none itself
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _classes(base: DataFrame) -> DataFrame:
    """(node, check, checks, rep, n_shingles, signature, n): rep is the class's least row, rows with an id before others."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th"))
    classes = base.filter("n_shingles > 0").groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("checks"), rep.alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    return kept(classes, "classes")


def _groups(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of documents, and the classes (node, n, best) with the least row of each one's group."""
    base = kept(features(documents), "features")
    classes = _classes(base)
    doubled = classes.filter("check != checks").select("node", "check", "n")
    if not doubled.isEmpty():
        # different sets with one first name: all but those of the least second name are renamed by both
        base = spread(base, doubled.withColumnRenamed("check", "lowest"), "node", ["lowest"], base.count(), "left")
        base = base.withColumn("node", F.when(F.col("lowest") < F.col("check"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("lowest")
        base = kept(base, "features")
        classes = _classes(base)
    keys = _keys(classes)
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = kept(spread(keys, kept(leaders, "leaders"), "key", ["leader"], INDEXED * classes.count()), "shared")
    tried = shared.filter("node != leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FIRST_TRY)
    tried = tried.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best")).select(F.col("node").alias("a"), F.col("best.leader").alias("b"))
    first = kept(components(confirmed(documents, classes, kept(tried, "tried"))), "first")

    labelled = kept(shared.join(first, "node", "left").select("key", "node", "leader", F.coalesce("root", "node").alias("label")), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("n")).filter("l0 != l1").select("key", "n", F.col("n").alias("members"))
    rows = kept(spread(labelled, kept(open_keys, "open_keys"), "key", ["members"], labelled.count()), "open")
    alike = _alike(rows.filter(F.col("members") <= BLOCK).select("key", "node", "label").join(classes.select("node", "n_shingles", "signature"), "node"))
    tied = rows.filter((F.col("members") > BLOCK) & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    families = components(alike.union(tied)).select("node", F.col("root").alias("family"))
    families = families.join(first, "node", "left").select("node", "family", F.coalesce("root", "node").alias("label"))
    second = components(_late_links(full_sets(documents, classes, families, "late")))
    second = second.select(F.col("node").alias("root1"), F.col("root").alias("root2"))
    rooted = classes.select("node", "n", "rep").join(first, "node", "left").withColumn("root1", F.coalesce("root", "node")).drop("root")
    rooted = kept(rooted.join(second, "root1", "left").select("node", "n", "rep", F.coalesce("root2", "root1").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min("rep").alias("best"), F.count(F.lit(1)).alias("n"))
    return base, kept(spread(rooted.select("node", F.col("n").alias("rows"), "root"), kept(best, "best"), "root", ["best"], classes.count()).select("node", F.col("rows").alias("n"), "best"), "named")


def _decided(documents: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, node, best) of each row of documents; best is the least row of its group, null for empty sets."""
    base, named = _groups(documents)
    base = base.select("doc_id", "th", "n_shingles", "node")
    return spread(base, named, "node", ["best"], base.count(), "left")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents (doc_id, text).

    component_id is the least doc_id of the row's group, and kept whether the row has it.
    """
    with scratch(documents.sparkSession):
        least = F.when(F.col("best").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id"))
        out = _decided(documents).withColumn("component_id", least)
        return kept(out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near", outlives=True)


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group, with all of its columns: the one with the least doc_id, null last.

    Of rows with that doc_id, the one with the least hash of its text stays, and of rows that have the text in common too, the
    least as JSON. Rows with an empty set all stay. Only rows that go, or are one of several, are looked up by a join; a filter
    lets all others through where they are, as long as it can hold the rows to look up.
    """
    with scratch(documents.sparkSession):
        stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
        decided = _decided(documents).filter("best is not null").groupBy("doc_id", "th").agg(F.bool_or(~stays).alias("goes"), F.count(F.lit(1)).alias("n"))
        doubtful = decided.filter("goes or n > 1").select(F.col("doc_id").alias("its_id"), F.col("th").alias("its_th"), "goes", F.xxhash64("doc_id", "th").alias("key"))
        doubtful = kept(doubtful, "doubtful", outlives=True)
        passes = _Filter(doubtful.select("key"))
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    marked = documents.select(row, F.col("doc_id").alias("own_id"), text_hash().alias("own_th")).withColumn("own_key", F.xxhash64("own_id", "own_th")).withColumn("maybe", passes.passes("own_key"))
    through = marked.filter(~F.col("maybe")).select("row.*")
    looked = marked.filter("maybe").join(doubtful, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("its_id")) & (F.col("own_th") == F.col("its_th")), "left")
    sure = looked.filter("key is null").select("row.*")
    once = looked.filter("key is not null and not goes").groupBy("own_id", "own_th").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return through.unionByName(sure).unionByName(once)
