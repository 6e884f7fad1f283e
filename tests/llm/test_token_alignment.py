"""Token alignment against a brute-force version that walks both tokenizers' tokens of each whole text."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import queries, token_alignment
from tests.llm.helpers import ODD, SF, documents, empty, odd

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "a▁b plain",
    "two  spaces   and \n\n lines \t tabs ",
    " leading",
    "trailing ",
    " ",
    "\n",
    "<|endoftext|> is plain <s> text </s>",
    "<0x41> \x00 \x7f  　x",
    "日本語のテキスト 😀👩‍👩‍👧 ñandú ﬁ ①",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    " " * 40 + "x",
    "same words same words same words",
]


def tokens(pair, text):
    """(ids by A, their bytes, ids by B, their bytes) of a text, or None."""
    t, sp, back = pair
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    a_bytes = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode() else None


def brute(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    pair = t, sentencepiece.SentencePieceProcessor(model_file=B), {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    docs, held = [], Counter()
    for doc_id, text in rows:
        groups, found = [], tokens(pair, text) if text else None
        if found:
            a, a_bytes, b, b_bytes = found
            i = j = at_a = at_b = 0
            mine = ([], [])
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    mine[0].append(a[i])
                    at_a, i = at_a + len(a_bytes[i]), i + 1
                else:
                    mine[1].append(b[j])
                    at_b, j = at_b + len(b_bytes[j]), j + 1
                if at_a == at_b:
                    groups.append(mine)
                    mine = ([], [])
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(links))
        docs.append((doc_id, groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        numbers = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links))
        out.append((doc_id, *numbers, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in token_alignment.alignment(df, A, B).collect()), key=repr)


def test_query(spark):
    got = sorted((tuple(r) for r in queries.op12_token_alignment(spark, SF).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in documents(spark).collect()])


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, texts that are no token's bytes, and an empty table."""
    table = [(r[0], r[1]) for r in ODD] + list(enumerate(HARD, 100))
    wide = odd(spark).select("doc_id", "text").union(spark.createDataFrame(table[len(ODD) :], "doc_id long, text string")).selectExpr("*", "1 as pair", "2 as links", "3 as row")
    assert run(wide.repartition(2)) == brute(table)
    assert run(empty(spark)) == []


@pytest.mark.parametrize("block, encoded, hubs", [(1, 1, 200_000), (200, 30, 1), (10_000, 1 << 16, 5)])
def test_blocks_and_hubs(spark, monkeypatch, block, encoded, hubs):
    """Small blocks, parts encoded one by one, and pairs that aren't broadcast give the same result."""
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "ENCODED", encoded)
    monkeypatch.setattr(token_alignment, "HUBS", hubs)
    table = [(k, HARD[k % len(HARD)] + (" hot words of a third" if k % 3 == 0 else f" word{k}")) for k in range(60)]
    assert run(spark.createDataFrame(table, "doc_id int, text string").repartition(3)) == brute(table)


def test_parts_that_fail_alone():
    """A part whose bytes aren't its tokens' leaves the other parts as they are."""
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        pair = token_alignment.Pair(a.read(), b.read())
    (a_ids, b_ids), sizes, good = pair.tokens(["one", "▁two", "three"])
    assert good == [True, False, True] and sizes.tolist() == [4, 0, 6]
    alone = [pair.tokens([p])[0] for p in ("one", "three")]
    assert a_ids.tolist() == [i for x, _ in alone for i in x] and b_ids.tolist() == [i for _, x in alone for i in x]


LISTS = {c: pa.list_(pa.field("element", kind, nullable=False)) for c, kind in (("pairs", pa.int32()), ("times", pa.int64()))}
SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), *LISTS.items()])


def known():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return token_alignment.Known(token_alignment.Pair(a.read(), b.read()))


def numbers(batches):
    """(doc_id, n_a, n_b, n_groups, n_links, digest) of rows, whose links are as many as their pairs' times."""
    rows = [r for b in batches for r in b.to_pylist()]
    assert all(sum(r["times"]) == r["n_links"] and r["pairs"] == sorted(set(r["pairs"])) for r in rows)
    return [(*(r[c] for c in SCHEMA.names[:5]), hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in rows]


def test_parts_of_other_blocks_are_not_tokenised_again():
    here, seen = known(), []
    tokens = here.pair.tokens
    here.pair.tokens = lambda parts: (seen.extend(parts), tokens(parts))[1]
    blocks = [["some words", "more words"], ["words more some", "some  words"], ["more", "some  words some other"]]
    for k, texts in enumerate(blocks):
        here.batch([k] * len(texts), texts, SCHEMA)
    assert sorted(seen) == ["more", "other", "some", "some  words", "words"]


@pytest.mark.parametrize("remembered, held, encoded, cut", [(400_000, 8_000_000, 4096, True), (3, 8_000_000, 1, True), (400_000, 40, 20, True), (400_000, 8_000_000, 4096, False)])
def test_what_is_remembered_changes_no_row(monkeypatch, remembered, held, encoded, cut):
    """Begun anew between blocks, or with texts that aren't cut: words after texts that are one part with their white space, and back."""
    monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(token_alignment, "HELD", held)
    monkeypatch.setattr(token_alignment, "ENCODED", encoded)
    here = known()
    here.pair.cut = here.pair.cut and cut
    table = list(enumerate([*HARD, "x y\n", "\nz", "x", "y\n \nz", "y\n z", "x x y", "", "a\t \tb a", *HARD[::-1], "b\u2581 words", "words"]))
    got = numbers(here.batch([k for k, _ in table[at : at + 3]], [t for _, t in table[at : at + 3]], SCHEMA) for at in range(0, len(table), 3))
    assert got == [(*r[:5], r[7]) for r in sorted(brute(table))]


def test_blocks_without_tokens():
    here = known()
    for texts in (["", ""], ["a\u2581b", ""], ["\ufb01", ""], []):
        assert numbers([here.batch(list(range(len(texts))), texts, SCHEMA)]) == [(*r[:5], r[7]) for r in brute(list(enumerate(texts)))]
