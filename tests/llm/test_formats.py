import hashlib
import json
import re
import subprocess
import sys
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import chat_prefix, jpeg_media, lcp_fingerprint, piece_viterbi, token_index
from tests.llm.helpers import LONG, documents, empty, odd

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def pieces():
    return piece_viterbi.loaded(open(PIECES, "rb").read())


# token ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'sSt\n\t  é中٣_-.,!<|>9\x1fÑ²"), max_size=40))
def test_encoder_equals_library(text):
    encoder = token_index._encoder(open(TOKENIZER, encoding="utf-8").read())
    assert encoder.encode([text])[0] == array("H", encoder.whole.encode(text, add_special_tokens=False).ids).tobytes()


def check_stored(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    whole = Tokenizer.from_file(TOKENIZER)
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    read = token_index.stored(spark, docs, TOKENIZER).select("doc_id", "start", "n", F.crc32("payload").alias("crc"))
    assert sorted(map(tuple, read.collect()), key=str) == sorted(want, key=str)


def test_stored_ids(spark):
    check_stored(spark, documents(spark))


def test_stored_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_index, "BUCKET_KEYS", 3)
    check_stored(spark, odd(spark).withColumn("shard", F.lit("clash")).withColumn("n", F.lit(1)))


def test_stored_empty_table(spark):
    assert token_index.stored(spark, empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}])
def test_other_tokenizer_files(change):
    """A normalizer or another pre-tokenizer in the file counts."""
    model = json.dumps(json.load(open(TOKENIZER, encoding="utf-8")) | change)
    texts = ["Hello World", "HELLO, it's  two spaces", "a b"]
    whole = Tokenizer.from_str(model)
    assert token_index.Encoder(model).encode(texts) == [array("H", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_encoder_in_segments(monkeypatch):
    encoder = token_index.Encoder(open(TOKENIZER, encoding="utf-8").read())
    text = "it's a  text, with ÄÖ words\n and <|endoftext|> 中文 in it " * 40
    want = encoder.encode([text, "x" * 500])
    monkeypatch.setattr(token_index, "SEGMENT", 20)
    assert len(list(token_index.segments(text))) > 20 and encoder.encode([text, "x" * 500]) == want
    assert want[0] == array("H", encoder.whole.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("levels", [1, 24])
def test_probe_reads_little(tmp_path, monkeypatch, levels):
    """Single keys are found by a few small reads; also those that no level holds."""
    from pyarrow import fs

    monkeypatch.setattr(token_index, "LEVELS", levels)
    monkeypatch.setattr(token_index, "_DUMP_HEAD", 12 + 4 * levels)
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 2**63, (2, 3000)).astype(np.uint64)
    built = token_index.PerfectHash.build(h1, h2)
    table = np.zeros(len(built), token_index._SLOT)
    slots = built.slots(h1, h2)
    table["mark"][slots], table["n"][slots] = (h2 >> np.uint64(32)).astype("<u4"), np.arange(3000)
    hashes = built.dump()
    (tmp_path / "i").write_bytes(token_index.struct.pack("<4sIII", b"MPH1", len(table), len(hashes), table.itemsize) + hashes + table.tobytes())
    reads = []

    class File:
        def __init__(self, inner):
            self.inner = inner

        def read_at(self, n, at):
            reads.append(n)
            return self.inner.read_at(n, at)

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "i")) as f:
        got, found = token_index.probe(File(f), h1[:200], h2[:200])
        assert found.all() and got["n"].tolist() == list(range(200))
        if levels > 1:
            assert sum(reads) < 200 * 400
        assert not token_index.probe(f, h1[:20] + np.uint64(1), h2[:20] + np.uint64(1 << 40))[1].any()


def test_lookup_of_unknown_keys(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    rows = token_index.write_shards(documents(spark), folder, TOKENIZER)
    buckets = token_index.write_index(rows, folder)
    asked = spark.createDataFrame([(0, 0), (0, 1), (10**9, 0)], "doc_id long, nth long")
    for whole_from in (64, 0, 10**9):
        monkeypatch.setattr(token_index, "WHOLE_FROM", whole_from)
        found = {(r["doc_id"], r["nth"]): r["n"] for r in token_index.lookup(asked, folder, buckets).collect()}
        assert found[0, 0] > 0 and found[0, 1] is None and found[10**9, 0] is None


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    built = token_index.PerfectHash.build(h1, h2)
    again, size = token_index.PerfectHash.load(memoryview(built.dump()))
    assert size == len(built.dump()) and len(again) == n
    assert sorted(again.slots(h1, h2).tolist()) == list(range(n))


# SentencePiece


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the in ▁ed ing\n\tABéç中0."), st.characters(exclude_categories=["Cs"], exclude_characters="\x00▁")), max_size=30))
def test_pieces_equal_library(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = memoryview(pieces().encode(text)).cast("i").tolist() if text else []
    assert ids == library.encode(text)
    if "▁" not in text:
        assert pieces().decode(ids) == text


def test_unigram_viterbi_by_brute_force():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = False
    for text, score, kind in [("<unk>", 0, 2), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), ("ba", -3.1, 1), ("aba", -5, 1), ("bab", -4.4, 1)]:
        proto.pieces.add(piece=text, score=score, type=kind)
    model = piece_viterbi.Pieces(proto.SerializeToString())

    def best(text):
        if not text:
            return 0.0
        return max((model.scores[k] + best(text[len(p) :]) for p, k in model.ids.items() if text.startswith(p)), default=-1e9)

    for text in ("a", "abab", "babab", "aababba", "bbbaba"):
        ids = memoryview(model.encode(text)).cast("i").tolist()
        assert "".join(model.texts[k] for k in ids) == text
        assert sum(model.scores[k] for k in ids) == pytest.approx(best(text))


def test_unigram_equals_library(spark, tmp_path):
    """A unigram model over the same pieces, on the whole table, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    rng = np.random.default_rng(9)
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(np.float32(-4 - 10 * rng.random() - len(p.piece)))
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rows = piece_viterbi.decoded(piece_viterbi.encoded(documents(spark), str(path)), str(path)).collect()
    model = piece_viterbi.Pieces(proto.SerializeToString())
    for r in rows:
        ids, want = r["ids"], library.encode(r["text"])
        assert r["decoded"] == r["text"]
        # the library adds up 32-bit floats, so in long texts it may miss the best path by a little
        ours, theirs = (sum(model.scores[k] for k in x) for x in (ids, want))
        assert ids == want or theirs - 1e-4 <= ours <= theirs + 1e-6 * abs(theirs)


def test_pieces_apart_by_their_border():
    """What the merges next to a border tell is what merging both texts as a whole gives."""
    model, rng = pieces(), np.random.default_rng(3)
    whole = [t for t in model.ids if model._whole(t)]
    told = set()
    for _ in range(20_000):
        text = whole[rng.integers(len(whole))] + whole[rng.integers(len(whole))]
        at = rng.integers(1, len(text))
        if text[:at] in model.ids and text[at:] in model.ids and model._whole(text[:at]) and model._whole(text[at:]):
            assert model._separate(text[:at], text[at:]) == model._stay(text[:at], text[at:])
            told.add(model._stay(text[:at], text[at:]))
    assert told == {True, False}


def test_pieces_with_rising_scores():
    """A model in which a later merge has the better score is merged as a whole."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 2
    proto.normalizer_spec.remove_extra_whitespaces = False
    for text, score, kind in [("<unk>", 0, 2), ("a", -9, 1), ("b", -9, 1), ("c", -9, 1), ("ab", -5, 1), ("abc", -1, 1), ("cc", -3, 1), ("bc", -6, 1)]:
        proto.pieces.add(piece=text, score=score, type=kind)
    model = piece_viterbi.Pieces(proto.SerializeToString())
    assert not model._falls("abc") and model._falls("ab")
    for left in model.ids:
        for right in model.ids:
            assert model.apart(model.ids[left], model.ids[right]) == model._stay(left, right)


def test_pieces_of_marks():
    """Words are cut before marks that no piece joins to what is before them; the ids are the library's still."""
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), np.random.default_rng(4)
    signs = np.array(list("ab Z9é²,.;:!?()[]{}\"'`-_/\\*#%&$@+=<>|~^’“”…–— \t\n\u2581語"))
    for n in rng.integers(1, 40, 3000):
        text = "".join(rng.choice(signs, n))
        assert memoryview(pieces().encode(text)).cast("i").tolist() == library.encode(text)


def test_pieces_odd_rows(spark):
    rows = piece_viterbi.decoded(piece_viterbi.encoded(odd(spark).withColumn("ids", F.lit("old")), PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert piece_viterbi.encoded(empty(spark), PIECES).count() == 0


# chat


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant\\ <\\| \\\\<| $1 \\l"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user\nx\\l", None), (1, 3, "assistant", "<"), (1, 4, None, "tail"), (2, 0, "user", ""), (None, 0, "assistant", "x"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat_prefix.digests(chat_prefix.examples(chat(spark, rows).withColumn("example", F.lit("clash")))).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_prefix.examples(chat(spark, [])).count() == 0


def test_chat_examples(spark):
    rows = chat_prefix.examples(chat(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")])).orderBy("example").collect()
    assert [(r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]) for r in rows] == ["a", "b"]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[0]["text"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


# JPEG


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_jpeg_is_lossless(payloads):
    full = [p + bytes(max(64, -(-len(p) // 64) * 64) - len(p)) for p in payloads]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in full])])
    files = jpeg_media.store(np.frombuffer(b"".join(full), np.uint8), offsets, np.array([len(p) for p in payloads]))
    for file, got, raw, p in zip(files, jpeg_media.read_back(files), payloads, full):
        assert got[:6] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest())


def test_jpeg_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 64 * 157).astype(np.uint8)
    whole = jpeg_media.store(payload, np.array([0, payload.size]), np.array([payload.size - 5]))
    read = jpeg_media.read_back(whole)
    monkeypatch.setattr(jpeg_media, "SLICE", 10)
    assert jpeg_media.store(payload, np.array([0, payload.size]), np.array([payload.size - 5])) == whole
    assert jpeg_media.read_back(whole) == read and read[0][2] == hashlib.sha256(payload.tobytes()).hexdigest()
    torn = whole[0][:-40] + b"\xff\xd9"
    assert jpeg_media.read_back([torn]) == [None]


def test_jpeg_memory_of_a_long_text():
    """Storing and reading back one text of 24 MB takes less than 400 MB beyond what the child has before it.

    The kernel's peak of the child's own memory is cleared first: what a child reports without that begins at its parent's.
    """
    code = """
import numpy as np
from corpusloom.llm import jpeg_media

def peak():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) // 1024

n = 24 << 20
text = np.random.default_rng(0).integers(97, 123, n, np.uint8)
with open("/proc/self/clear_refs", "w") as f:
    f.write("5")
before = peak()
(file,) = jpeg_media.store(text, np.array([0, n]), np.array([n]))
assert jpeg_media.read_back([file])[0][0] == n
print(peak() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout) < 400


def test_jpeg_zero_runs():
    blocks = np.zeros((6, 64), np.int16)
    blocks[1, 63] = 5
    blocks[2, 20] = -7
    blocks[3, [0, 17, 50]] = (300, 1, -2)
    blocks[4, 1:] = 1
    data = (blocks + jpeg_media.SHIFT) & 0xFF
    blocks[3, 0] = data[3, 0] - jpeg_media.SHIFT  # a byte's range
    payload = (blocks + jpeg_media.SHIFT).astype(np.uint8).ravel()
    (file,) = jpeg_media.store(payload, np.array([0, payload.size]), np.array([payload.size]))
    picture = jpeg_media.parse(file)
    assert (jpeg_media.decode([picture])[0][:6] == blocks).all()


def test_jpeg_without_restarts_and_with_colours():
    """Two-by-two sampled colours in one interval, encoded here bit by bit."""
    dc, ac = jpeg_media._DC[2], jpeg_media._AC[2]
    rng = np.random.default_rng(5)
    blocks, bits, before = [], "", [0, 0, 0]
    for _ in range(2):  # MCUs
        for c in (0, 0, 0, 0, 1, 2):
            block = np.zeros(64, int)
            block[0] = rng.integers(-60, 60)
            block[rng.integers(1, 64, 3)] = rng.integers(1, 30, 3)
            blocks.append(block)
            code = lambda v: (int(abs(v)).bit_length(), v if v > 0 else v + (1 << int(abs(v)).bit_length()) - 1)
            size, low = code(int(block[0] - before[c]))
            before[c] = int(block[0])
            bits += f"{dc[size][0]:0{dc[size][1]}b}" + (f"{low:0{size}b}" if size else "")
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits += f"{ac[0xF0][0]:0{ac[0xF0][1]}b}"
                    run -= 16
                size, low = code(int(block[k]))
                bits += f"{ac[run << 4 | size][0]:0{ac[run << 4 | size][1]}b}{low:0{size}b}"
                run = 0
            if not block[63]:
                bits += f"{ac[0][0]:0{ac[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = re.sub(b"\xff", b"\xff\x00", int(bits, 2).to_bytes(len(bits) // 8, "big"))
    seg = jpeg_media._segment
    file = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, b"\x00" + jpeg_media._DC[0] + jpeg_media._DC[1]) + seg(0xC4, b"\x10" + jpeg_media._AC[0] + jpeg_media._AC[1]) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    picture = jpeg_media.parse(file)
    assert (picture.width, picture.height, picture.mcus) == (32, 16, (2, 1))
    got = jpeg_media.decode([picture])[0]
    assert (got == np.array(blocks)).all()
    small = jpeg_media.thumbnail(picture, got)
    want = [[blocks[0], blocks[1], blocks[6], blocks[7]], [blocks[2], blocks[3], blocks[8], blocks[9]]]
    assert small.tolist() == [[min(255, max(0, (int(b[0]) * 2 + 4) // 8 + 128)) for b in row] for row in want]
    assert jpeg_media.read_back([file])[0][:2] == (None, None)


def test_jpeg_odd_rows(spark):
    rows = jpeg_media.media_features(jpeg_media.stored(odd(spark).withColumn("feature", F.lit(1)))).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
    bad = spark.createDataFrame([(None,), (b"x",), (b"\xff\xd8\xff\xd9",)], "media binary")
    assert all(r["feature"] is None for r in jpeg_media.media_features(bad).collect())
    assert jpeg_media.media_features(jpeg_media.stored(empty(spark))).count() == 0


# fingerprints


def test_fingerprint_table(spark):
    for docs in (odd(spark).withColumn("p", F.lit("clash")), documents(spark)):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for k, (i, t) in enumerate(rows):
            e = lcp_fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
            (a, b, c) = lcp_fingerprint.fingerprints([t, e, rows[(k + 1) % len(rows)][1]])
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lcp_fingerprint.as_text(a), lcp_fingerprint.as_text(b), lcp_fingerprint.likeness(a, b), lcp_fingerprint.likeness(a, c)))
        got = lcp_fingerprint.fingerprint_table(docs).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert lcp_fingerprint.fingerprint_table(empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "double", "date"])
def test_fingerprints_by_any_id(spark, kind):
    """The next document is that of the next id in the order of its type."""
    ids = F.when(F.col("k") == 4, None).otherwise(F.date_add(F.lit("2000-01-01"), F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind))
    docs = spark.range(25).withColumnRenamed("id", "k").select(ids.alias("doc_id"), F.concat(F.lit("text number "), F.repeat(F.col("k").cast("string"), 3)).alias("text"))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    want = [(i, hashlib.sha256(lcp_fingerprint.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
    got = lcp_fingerprint.fingerprint_table(docs).select("doc_id", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_parsing_is_local():
    """Equal substrings have equal interior phrases, whatever is before and after them."""
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    core = text(4000)
    a, b, c = (set(lcp_fingerprint_all(t)) for t in (text(57) + core + text(31), text(900) + core, text(4000)))
    assert len(a & b) / len(a) > 0.9 and len(a & c) / len(a) < 0.02


def lcp_fingerprint_all(text):
    keep, lcp_fingerprint.KEEP = lcp_fingerprint.KEEP, 10**9
    try:
        return lcp_fingerprint.fingerprints([text])[0].tolist()
    finally:
        lcp_fingerprint.KEEP = keep


def test_fingerprints_in_batches_are_the_same():
    rng = np.random.default_rng(8)
    texts = ["", "a", "aaaa", "ab" * 500, LONG, "x\n" * 9, "the quick brown fox jumps over the lazy dog"]
    texts += ["".join(rng.choice(list("abcd ef"), n)) for n in rng.integers(0, 400, 60)]
    assert [x.tolist() for x in lcp_fingerprint.fingerprints(texts)] == [lcp_fingerprint.fingerprints([t])[0].tolist() for t in texts]
