"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once; at each position its output links list all pieces that end there, and each relaxes the best
score of that position from the best of where it begins. One relaxation serves both models; the score of a path is a sum of one
term for each piece and one for each border between two pieces:

* For a unigram model a piece has its log probability, and a border 0.
* For a BPE model a piece has 0, and a border 0 if its two pieces would stay apart when their text alone is merged, else minus
  infinity. Greedy merging is decided locally, so the merge order is the only path with a finite score, up to each position, and
  Viterbi gives exactly the library's ids.

No piece has a space sign but at its front (runs of only space signs apart), and few have an ASCII mark after a letter, so a text
falls into words with their space sign, and marks that no piece joins to what is before them, which are encoded alone; each task remembers the words that it has met, up to ``REMEMBERED``.

Defined results: null text is encoded as empty text, without ids; characters that no piece covers become their UTF-8 bytes'
pieces; decoding an encoding gives the text back (a model's dummy prefix is taken off again), but for U+2581 in a text, which comes back as a
space, as with the library; columns named ids or n_pieces
are replaced, all others kept. Memory: a text's words and its ids, at 4 bytes each, are held at once.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from corpusloom.llm._learn import columns, with_columns

#: Words whose ids a worker remembers.
REMEMBERED = 400_000
_SIGN = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4


class Pieces:
    """A SentencePiece model: its pieces, automaton and normalisation. Models with a normalisation table are refused."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are known")
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("the model's normalisation isn't the identity")
        self.prefix = rules.add_dummy_prefix
        self.texts = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.spelled = [bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else p.piece.encode() if p.type in (_NORMAL, _USER) else b"" for p in proto.pieces]
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.spelled[self.unknown] = " ⁇ ".encode()
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        # a run of space signs with the word after it, up to a character that no piece has, or to a mark after a character that it
        # follows in no piece: nothing merges across these borders
        known = set("".join(self.ids))
        marks = {c for c in known if c.isascii() and not c.isalnum()}
        before = {x for piece in self.ids for x, y in zip(piece, piece[1:]) if y in marks} - {_SIGN}
        listed = lambda cs: "".join(map(re.escape, sorted(cs)))
        never, joined = listed(set(map(chr, range(128))) - known), f"|(?<=[{listed(before)}])[{listed(marks)}]" if before else ""
        self.cut = re.compile(f"{_SIGN}*[^{_SIGN}{never}](?:[^{_SIGN}{never}{listed(marks)}]+{joined})*|{_SIGN}+" + (f"|[{never}]" if never else ""))
        self.words = _Remembered(self)
        bpe = self.kind == _BPE
        # the last entries are those of a character that no piece covers, -1
        self.gains = [*self.scores, min(self.scores, default=0.0) - 10.0]
        self.sizes = [*(len(t) for t in self.texts), 1]
        self.letters = {t for t in self.ids if len(t) == 1}
        self._parts: dict[str, tuple[str, str] | None] = {}
        self._apart: dict[int, bool] = {}
        self._falling: dict[str, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, k in self.ids.items():
            if not bpe or self._whole(text):  # a piece that merging alone doesn't make is never one of BPE's
                self.automaton.add_word(text, (k, len(text)))
        self.automaton.make_automaton()

    # BPE: which two symbols make a piece, and whether two pieces stay apart next to each other

    def _made_of(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece from its characters, None for a character, or for a piece that merging doesn't make."""
        if piece not in self._parts:
            symbols = list(piece)
            last = None
            while len(symbols) > 1:
                best = None
                for k, (x, y) in enumerate(zip(symbols, symbols[1:])):
                    pair = self.ids.get(x + y)
                    if pair is not None and (best is None or self.scores[pair] > best[0]):
                        best = (self.scores[pair], k)
                if best is None:
                    last = None
                    break
                k = best[1]
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self._parts[piece] = last if len(symbols) == 1 else None
        return self._parts[piece]

    def _whole(self, piece: str) -> bool:
        """Whether merging alone makes this piece."""
        return len(piece) == 1 or self._made_of(piece) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces leaves just these two: no merge across their border comes before theirs."""
        key = left << 20 | right
        known = self._apart.get(key)
        if known is None:
            known = self._separate(self.texts[left], self.texts[right])
            if len(self._apart) < REMEMBERED:
                self._apart[key] = known
        return known

    def _falls(self, piece: str) -> bool:
        """Whether the merges that make a piece come with falling scores, as in every trained model."""
        known = self._falling.get(piece)
        if known is None:
            made = None if len(piece) == 1 else self._made_of(piece)
            score = self.scores[self.ids[piece]] if made else 0.0
            known = len(piece) == 1 or (made is not None and all(self._falls(m) and (len(m) == 1 or self.scores[self.ids[m]] >= score) for m in made))
            self._falling[piece] = known
        return known

    def _separate(self, left: str, right: str) -> bool:
        """What ``_stay`` tells of two pieces, from the merges next to their border alone.

        They are taken back, the latest first (of equal scores the right one, as merging starts at the left). Before each, the two
        symbols at the border could have merged instead, if their score is better than that merge's, or as good and further left.
        With falling scores no earlier moment needs a look; pieces with others are merged as a whole.
        """
        if not (self._falls(left) and self._falls(right)):
            return self._stay(left, right)
        ids, scores, made = self.ids, self.scores, self._made_of
        if left + right in ids:
            return False
        of_left = scores[ids[left]] if len(left) > 1 else None
        of_right = scores[ids[right]] if len(right) > 1 else None
        while of_left is not None or of_right is not None:
            if of_right is None or (of_left is not None and of_left < of_right):
                left = made(left)[1]
                pair = ids.get(left + right)
                if pair is not None and scores[pair] > of_left:
                    return False
                of_left = scores[ids[left]] if len(left) > 1 else None
            else:
                right = made(right)[0]
                pair = ids.get(left + right)
                if pair is not None and scores[pair] >= of_right:
                    return False
                of_right = scores[ids[right]] if len(right) > 1 else None
        return True

    def _stay(self, left: str, right: str) -> bool:
        symbols, border = list(left + right), len(left)
        while True:
            best, at = None, 0
            for k, (x, y) in enumerate(zip(symbols, symbols[1:])):
                pair = self.ids.get(x + y)
                if pair is not None and (best is None or self.scores[pair] > best):
                    best, at = self.scores[pair], k
            if best is None:
                return symbols == [left, right]
            start = sum(map(len, symbols[:at]))
            if start < border < start + len(symbols[at]) + len(symbols[at + 1]):
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def relaxed(self, text: str, hits) -> list[int]:
        """The piece that ends the best path to each position, -1 where there is none, by relaxing scores over output links.

        hits: (end, (piece, size)), a position's from the longest to the shortest. None stands for a score of minus infinity. In a
        BPE model no score is above 0, so a position that has one is settled.
        """
        bpe, gains, apart, settled = self.kind == _BPE, self.gains, self._apart, 0
        best: list[float | None] = [None] * (len(text) + 1)
        last = [-1] * (len(text) + 1)
        best[0] = 0.0
        for end, (k, size) in hits:
            if end < settled:
                continue
            begin = end + 1 - size
            score = best[begin]
            if score is None:
                continue
            if bpe:
                if begin:
                    before = last[begin]
                    if before < 0 or k < 0:
                        stay = self._stay(text[begin - self.sizes[before] : begin], text[begin : end + 1])
                    else:
                        stay = apart.get(before << 20 | k)
                        if stay is None:
                            stay = self.apart(before, k)
                    if not stay:
                        continue
                settled = end + 1
            else:
                score += gains[k]
                now = best[end + 1]
                if now is not None and score <= now:
                    continue
            best[end + 1] = score
            last[end + 1] = k
        return last

    def best_path(self, text: str) -> list[int]:
        """The pieces of the best path over a text; -1 for a character that no piece covers."""
        covered = self.kind == _BPE or self.letters.issuperset(text)
        last = self.relaxed(text, self.automaton.iter(text)) if covered and self.ids else None
        if last is None or (text and last[-1] < 0):
            found = self.automaton.iter(text) if self.ids else ()
            last = self.relaxed(text, sorted([*found, *((k, (-1, 1)) for k, c in enumerate(text) if c not in self.letters)], key=lambda h: (h[0], -h[1][1])))
        out, at, sizes = [], len(text), self.sizes
        while at:
            k = last[at]
            out.append(k)
            at -= sizes[k]
        out.reverse()
        return out

    def word_ids(self, word: str) -> list[int]:
        path = self.best_path(word)
        if -1 not in path:
            return path
        out: list[int] = []
        at, unknown = 0, False
        for k in path:
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in word[at].encode())
            elif not unknown:
                out.append(self.unknown)
            unknown, at = k < 0, at + self.sizes[k]
        return out

    def normal(self, text: str) -> str:
        return ((" " if self.prefix and text else "") + text).replace(" ", _SIGN)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.cut.findall(self.normal(text))))

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.spelled[k] for k in ids]).decode("utf-8", "replace").replace(_SIGN, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Remembered(dict):
    """The ids of the words that a model has met."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.pieces.word_ids(word)).tobytes()
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = ids
        return ids


_workers: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, once in a worker."""
    if model not in _workers:
        _workers.clear()
        _workers[model] = Pieces(model)
    return _workers[model]


ADDED = StructType([StructField("ids", ArrayType(IntegerType(), False)), StructField("n_pieces", LongType())])


def encoded(documents: DataFrame, model_path: str) -> DataFrame:
    """documents with ids, the piece ids of text, and n_pieces. The model file is read on the driver and sent to the tasks."""
    with open(model_path, "rb") as f:
        model = f.read()

    def compute(batch):
        pieces = loaded(model)
        lists = [pieces.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
        sizes = np.array([len(x) // 4 for x in lists], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.frombuffer(b"".join(lists), np.int32)
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=kind), pa.array(sizes)]

    return with_columns(documents, ADDED, compute)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (ids, ...) with decoded, the text of ids; null ids give null."""
    with open(model_path, "rb") as f:
        model = f.read()

    def compute(batch):
        pieces = loaded(model)
        return [pa.array([None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()], pa.string())]

    return with_columns(rows, columns(decoded="string"), compute)
