"""Media columns in baseline JPEG: lossless storage of bytes as coefficients, decoding, and thumbnail features.

Storage: 64 bytes are one 8x8 block, whose quantised coefficients, in zigzag order, are the bytes less ``SHIFT``. With a
quantisation table of ones and Huffman-coded differences nothing is lost: baseline JPEG loses bits only before this step. Each
block is a restart interval, so blocks can be decoded independently of each other. A comment segment holds the number of bytes.

Decoding reads any baseline file with one scan (grey or with subsampled colours, with or without restart intervals): markers are
parsed file by file, and the Huffman decoding of all restart intervals of a batch goes in lockstep, one symbol of each at a
time, in numpy. The luminance thumbnail has a pixel for each block, from its DC coefficient alone.

A text, or a picture with a restart interval for each block, of more than ``SLICE`` blocks is encoded and decoded in slices, so
it takes its payload, its file and a few numbers a block of memory; any other picture is decoded whole.

Defined results: null text is stored as 64 zero bytes; equal texts are stored alike; null media, or bytes that aren't a complete
baseline JPEG, have null features; columns with an added name are replaced, all others kept.
"""

from __future__ import annotations

import dataclasses
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from corpusloom.llm._learn import columns, with_columns
from corpusloom.llm._text import pieces, utf8

#: What is taken off a byte to make a coefficient: small letters come out near 0, and so short.
SHIFT = 96
#: Blocks of one long text that are encoded or decoded at once.
SLICE = 1 << 13
_COMMENT = b"bytes="

# Huffman code lengths by rule: sizes that text needs often get the short codes, everything else 13 bits (AC) or 7 (DC).
_SHORT = {5: 2, 4: 2, 3: 3, 7: 3, 1: 4, 2: 4, 6: 4}
_DC_LENGTHS = {size: _SHORT.get(size, 7) for size in range(12)}
_AC_LENGTHS = {run << 4 | size: _SHORT[size] if run == 0 and size in _SHORT else 13 for run in range(16) for size in range(1, 11)} | {0xF0: 13, 0x00: 6, 0x08: 6}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """A table's counts by length and its symbols in code order, as a DHT segment has them, and the code of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17))
    return counts, bytes(symbols), _codes(counts, bytes(symbols))


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for n in range(16):
        for _ in range(counts[n]):
            out[symbols[at]] = (code, n + 1)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC, _AC = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)


def _arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (c, n) in codes.items():
        code[symbol], length[symbol] = c, n
    return code, length


_DC_CODE, _DC_LEN = _arrays(_DC[2])
_AC_CODE, _AC_LEN = _arrays(_AC[2])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, n_bytes: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, _COMMENT + str(n_bytes).encode()),
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + _DC[0] + _DC[1]),
            _segment(0xC4, b"\x10" + _AC[0] + _AC[1]),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
        )
    )


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down of a picture with room for so many."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def _scan(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n x 64, zigzag order), each a byte-aligned interval with stuffing, and n + 1 offsets."""
    n = len(coefficients)
    block, k = np.nonzero(coefficients)
    value = coefficients[block, k].astype(np.int64)
    size = np.ceil(np.log2(np.abs(value) + 1)).astype(np.int64)
    bits = np.where(value > 0, value, value + (1 << size) - 1)
    ac = k > 0
    block_ac, k_ac = block[ac], k[ac]
    before = np.zeros(len(k_ac), np.int64)
    before[1:] = np.where(block_ac[1:] == block_ac[:-1], k_ac[:-1], 0)
    run = k_ac - before - 1
    long = run >> 4
    # tokens: (block, order in it, value, length)
    symbol = (run & 15) << 4 | size[ac]
    tokens = [(block_ac, k_ac * 4 + 3, _AC_CODE[symbol] << size[ac] | bits[ac], _AC_LEN[symbol] + size[ac])]
    for times in range(1, 4):
        more = np.flatnonzero(long >= times)
        if len(more):
            tokens.append((block_ac[more], k_ac[more] * 4 + times - 1, np.full(len(more), _AC_CODE[0xF0]), np.full(len(more), _AC_LEN[0xF0])))
    dc = coefficients[:, 0].astype(np.int64)
    dc_size = np.ceil(np.log2(np.abs(dc) + 1)).astype(np.int64)
    tokens.append((np.arange(n), np.zeros(n, np.int64), _DC_CODE[dc_size] << dc_size | np.where(dc > 0, dc, dc + (1 << dc_size) - 1), _DC_LEN[dc_size] + dc_size))
    end = np.flatnonzero(coefficients[:, 63] == 0)
    tokens.append((end, np.full(len(end), 63 * 4 + 3), np.full(len(end), _AC_CODE[0]), np.full(len(end), _AC_LEN[0])))
    block, order, value, length = (np.concatenate(x) for x in zip(*tokens))
    rank = np.argsort(block * 256 + order, kind="stable")
    block, value, length = block[rank], value[rank], length[rank]
    total = np.cumsum(length)
    bits_of = np.bincount(block, length, n).astype(np.int64)
    bytes_of = (bits_of + 7) >> 3
    start = np.concatenate([[0], np.cumsum(bytes_of)])
    at = 8 * start[block] + (total - length) - np.concatenate([[0], np.cumsum(bits_of)])[block]
    # a token has 24 bits at most, so it is inside the 32 bits from its first byte on
    shifted = value << (32 - length - (at & 7))
    out = np.zeros(start[-1] + 4, np.int64)
    for byte in range(4):
        out += np.bincount((at >> 3) + byte, (shifted >> (24 - 8 * byte)) & 255, len(out)).astype(np.int64)
    pad = -bits_of & 7
    out[start[1:] - 1] += (1 << pad) - 1
    raw = out[: start[-1]].astype(np.uint8)
    full = np.flatnonzero(raw == 255)
    stuffed = np.insert(raw, full + 1, 0)
    return stuffed, start + np.searchsorted(full, start)


def _intervals(blocks: np.ndarray, nth: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of blocks, and n + 1 offsets; a restart marker by a block's number (nth) follows the inner ones."""
    data, at = _scan(blocks)
    marks = np.stack([np.full(inner.sum(), 0xFF), 0xD0 + (nth[inner] & 7)], axis=1).astype(np.uint8).ravel()
    return np.insert(data, np.repeat(at[1:][inner], 2), marks), at + 2 * np.concatenate([[0], np.cumsum(inner)])


def _store_long(payload: np.ndarray, n_bytes: int) -> bytes:
    """The file of one payload, in slices."""
    across, down = grid(len(payload) // 64)
    room = across * down
    parts = [_head(8 * across, 8 * down, n_bytes)]
    for a in range(0, room, SLICE):
        nth = np.arange(a, min(a + SLICE, room))
        blocks = np.zeros((len(nth), 64), np.int16)
        own = payload[64 * a : 64 * (a + SLICE)].reshape(-1, 64)
        blocks[: len(own)] = own.astype(np.int16) - SHIFT
        parts.append(_intervals(blocks, nth, nth < room - 1)[0].tobytes())
    return b"".join([*parts, b"\xff\xd9"])


def store(payloads: np.ndarray, offsets: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
    """JPEG files of payloads (bytes one after another, offsets multiples of 64); n_bytes goes to each file's comment."""
    if len(offsets) == 2 and offsets[1] > 64 * SLICE:
        return [_store_long(payloads[: offsets[1]], int(n_bytes[0]))]
    counts = np.diff(offsets) // 64
    grids = [grid(int(c)) for c in counts]
    room = np.array([w * h for w, h in grids], np.int64)
    first = np.concatenate([[0], np.cumsum(room)])
    blocks = np.zeros((first[-1], 64), np.int16)
    place = np.arange(counts.sum()) + np.repeat(first[:-1] - offsets[:-1] // 64, counts)
    blocks[place] = payloads.reshape(-1, 64).astype(np.int16) - SHIFT
    nth = np.arange(first[-1]) - np.repeat(first[:-1], room)
    whole, at = _intervals(blocks, nth, nth < np.repeat(room, room) - 1)
    edge = at[first]
    return [_head(8 * w, 8 * h, int(n)) + whole[a:b].tobytes() + b"\xff\xd9" for (w, h), n, a, b in zip(grids, n_bytes, edge, edge[1:])]


@dataclasses.dataclass
class Picture:
    """What the markers of a baseline file say; parts of its scan are restart intervals."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # horizontal and vertical sampling, quantisation, DC and AC table
    quantisation: dict[int, np.ndarray]
    tables: dict[tuple[int, int], bytes]
    restart: int
    scan: bytes
    comment: bytes

    @property
    def layout(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [k for k, c in enumerate(self.components) for _ in range(c[0] * c[1])]

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.components) == 1 else (max(c[0] for c in self.components), max(c[1] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Picture:
    """Reads the markers of a baseline JPEG; ValueError if it isn't one, or isn't complete."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quantisation, tables, frame, restart, comment = 2, {}, {}, None, 0, b""
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise ValueError("segment cut off")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                cells = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1)
                quantisation[name] = cells.astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width or len(body) < 6 + 3 * n:
                raise ValueError("frame not supported")
            frame = (width, height, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)})
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            break
    if frame is None or not body or body[0] != len(frame[2]) or not data.endswith(b"\xff\xd9"):
        raise ValueError("no frame, no end, or more than one scan")
    components = []
    for k in range(body[0]):
        name, both = body[1 + 2 * k], body[2 + 2 * k]
        if name not in frame[2]:
            raise ValueError("component without frame")
        h, v, q = frame[2][name]
        if not (1 <= h <= 4 and 1 <= v <= 4) or q not in quantisation or (0, both >> 4) not in tables or (1, both & 15) not in tables:
            raise ValueError("component not supported")
        components.append((h, v, q, both >> 4, both & 15))
    return Picture(frame[0], frame[1], tuple(components), quantisation, tables, restart, data[at:-2], comment)


_tables: dict[bytes, np.ndarray] = {}


def _table(body: bytes) -> np.ndarray:
    """For each 16 bits, symbol << 8 | length of the code that they begin with; length 0: none."""
    if body not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        out = np.zeros(1 << 16, np.int32)
        for symbol, (code, n) in _codes(body[:16], body[16:]).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 8 | n
        _tables[body] = out
    return _tables[body]


def decode(pictures: list[Picture]) -> list[np.ndarray | None]:
    """Coefficients (blocks x 64, zigzag order, in scan order) of pictures that share tables and layout; None for broken scans."""
    model = pictures[0]
    layout = model.layout
    luts = np.concatenate([_table(model.tables[kind, model.components[c][3 + kind]]) for kind in (0, 1) for c in layout])
    per = len(layout)
    scan = np.frombuffer(b"".join(p.scan for p in pictures), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(p.scan) for p in pictures])])
    mark = np.flatnonzero(scan[:-1] == 255) if len(scan) > 1 else np.zeros(0, np.int64)
    after = scan[mark + 1]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.ones(len(scan), bool)
    drop[mark[after == 0] + 1] = False
    drop[restarts] = drop[restarts + 1] = False
    kept = np.concatenate([[0], np.cumsum(drop)])
    data = np.concatenate([scan[drop], np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = data[:-4] << np.uint32(24) | data[1:-3] << np.uint32(16) | data[2:-2] << np.uint32(8) | data[3:-1]
    starts = np.sort(np.concatenate([edges[:-1], restarts + 2]))
    owner = np.searchsorted(edges, starts, "right") - 1
    units = np.array([p.mcus[0] * p.mcus[1] for p in pictures], np.int64)
    each = np.array([p.restart or u for p, u in zip(pictures, units)], np.int64)
    intervals = np.bincount(owner, minlength=len(pictures))
    sound = intervals == -(-units // each)
    nth = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(intervals)])[owner]
    quota = np.where(sound[owner], np.minimum(each[owner], units[owner] - nth * each[owner]), 0) * per
    first = np.concatenate([[0], np.cumsum(np.where(sound, units, 0) * per)])
    out = np.zeros((first[-1], 64), np.int16)
    flat = out.reshape(-1)
    # state of the intervals that still run
    live = np.flatnonzero(quota > 0)
    who, bit = owner[live], kept[starts[live]] * 8
    last = kept[np.concatenate([starts[1:], [len(scan)]])[live]] * 8
    block, quota = first[who] + nth[live] * each[who] * per, quota[live]
    k, part = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    before = np.zeros((len(live), len(model.components)), np.int64)
    component = np.array(layout)
    bad = np.zeros(len(pictures), bool)
    while len(who):
        dc = k == 0
        code = (window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)
        found = luts[((~dc * per + part) << 16) + code]
        bit = bit + (found & 255)
        run, size = found >> 12, (found >> 8) & 15
        low = (window[np.minimum(bit >> 3, len(window) - 1)] << (bit & 7).astype(np.uint32)) >> np.uint32(1) >> (31 - size).astype(np.uint32)
        value = low.astype(np.int64)
        value = np.where((value >> np.maximum(size - 1, 0)) != 0, value, value - (1 << size) + 1)
        value[size == 0] = 0
        bit = bit + size
        if per == 1:
            before[dc, 0] += value[dc]
            value[dc] = before[dc, 0]
        else:
            c = component[part[dc]]
            rows = np.flatnonzero(dc)
            before[rows, c] += value[dc]
            value[dc] = before[rows, c]
        skip = ~dc & (size == 0)
        k = k + np.where(dc, 0, run)
        wrong = ((found & 255) == 0) | (bit > last) | ((k > 63) & ~skip) | (dc & (run > 0))
        ok = ~wrong & ~skip
        flat[block[ok] * 64 + k[ok]] = value[ok]
        k = np.where(skip & (run != 15), 64, k + 1)
        full = k > 63
        if full.any() or wrong.any():
            bad[who[wrong]] = True
            k[full] = 0
            block, quota, part = block + full, quota - full, np.where(full, (part + 1) % per, part)
            go = (quota > 0) & ~wrong
            if not go.all():
                who, bit, last, block, quota, k, part, before = (x[go] for x in (who, bit, last, block, quota, k, part, before))
    return [out[a:b] if s and not x else None for a, b, s, x in zip(first, first[1:], sound, bad)]


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC alone: a pixel for each block of the first component."""
    across, down = picture.mcus
    h, v, q = (1, 1, picture.components[0][2]) if len(picture.components) == 1 else picture.components[0][:3]
    per = len(picture.layout)
    dc = coefficients[:, 0].astype(np.int64).reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h)[: -(-picture.height // 8), : -(-picture.width // 8)]
    return np.clip((dc * int(picture.quantisation[q][0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)


def feature(picture: Picture, coefficients: np.ndarray) -> str:
    """Dimensions, average hash of 8 x 8 cells, and crc32 of the thumbnail."""
    small = thumbnail(picture, coefficients)
    rows, across = (np.arange(8) * n // 8 for n in small.shape)
    down = np.add.reduceat(small.astype(np.float64), rows, axis=0) if small.shape[0] >= 8 else small.astype(np.float64)[rows]
    cells = np.add.reduceat(down, across, axis=1) if small.shape[1] >= 8 else down[:, across]
    weight = np.outer(np.diff(np.concatenate([rows, [small.shape[0]]])) if small.shape[0] >= 8 else np.ones(8), np.diff(np.concatenate([across, [small.shape[1]]])) if small.shape[1] >= 8 else np.ones(8))
    cells = cells / weight
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{picture.width}x{picture.height}:{bits}:{zlib.crc32(small.tobytes()):08x}"


STORED = columns(media="binary")
READ = columns(n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", width="int", height="int", feature="string")


def stored(documents: DataFrame) -> DataFrame:
    """documents with media: text as UTF-8, filled up with zero bytes to a positive multiple of 64, as a JPEG."""

    def compute(batch):
        data, offsets = utf8(batch.column("text"))
        out: list[bytes] = []
        for i, j in pieces(offsets, 1 << 19):
            size = np.diff(offsets[i : j + 1])
            room = np.maximum(64, -(-size // 64) * 64)
            at = np.concatenate([[0], np.cumsum(room)])
            payload = np.zeros(at[-1], np.uint8)
            part = data[offsets[i] : offsets[j]]
            if j - i == 1:
                payload[: len(part)] = part
            else:
                payload[np.arange(len(part)) + np.repeat(at[:-1] - (offsets[i:j] - offsets[i]), size)] = part
            out += store(payload, at, size)
        return [pa.array(out, pa.binary())]

    return with_columns(documents, STORED, compute)


def _payload_size(picture: Picture) -> int | None:
    """Bytes of text that a file of :func:`store` says to hold; None in other pictures."""
    return int(picture.comment[len(_COMMENT) :]) if picture.comment.startswith(_COMMENT) else None


def _read_long(picture: Picture, file: bytes) -> tuple | None:
    """What :func:`read_back` gives for a grey picture with an interval for each block, in slices."""
    scan = np.frombuffer(picture.scan, np.uint8)
    full = np.flatnonzero(scan[:-1] == 255)
    marks = full[(scan[full + 1] & 0xF8) == 0xD0]
    units = picture.mcus[0] * picture.mcus[1]
    if len(marks) + 1 != units:
        return None
    starts, ends = np.concatenate([[0], marks + 2]), np.concatenate([marks, [len(scan)]])
    n_bytes, digest, tail = _payload_size(picture), hashlib.sha256(), b""
    used = 0 if n_bytes is None else max(1, -(-n_bytes // 64))
    dc = np.zeros((units, 1), np.int16)
    for a in range(0, units, SLICE):
        b = min(a + SLICE, units)
        part = dataclasses.replace(picture, width=8 * (b - a), height=8, scan=picture.scan[starts[a] : ends[b - 1]])
        (blocks,) = decode([part])
        if blocks is None:
            return None
        dc[a:b] = blocks[:, :1]
        if used > a:
            tail = (blocks[: used - a] + SHIFT).astype(np.uint8).tobytes()
            digest.update(tail)
    told = (None,) * 4 if n_bytes is None else (n_bytes, 64 * used, digest.hexdigest(), zlib.crc32(tail[-64:]))
    return (*told, len(file), hashlib.sha256(file).hexdigest(), picture.width, picture.height, feature(picture, dc))


def read_back(files: list[bytes | None]) -> list[tuple | None]:
    """For each file the columns of READ; None for null or unsound files. Payload columns are null without a byte count."""
    pictures: list[Picture | None] = []
    for f in files:
        try:
            pictures.append(None if f is None else parse(f))
        except (ValueError, struct.error, IndexError):
            pictures.append(None)
    out: list[tuple | None] = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for n, p in enumerate(pictures):
        if p is not None and len(p.components) == 1 and p.restart == 1 and p.mcus[0] * p.mcus[1] > SLICE:
            out[n] = _read_long(p, files[n])
        elif p is not None:
            groups.setdefault((p.components, tuple(sorted(p.tables.items()))), []).append(n)
    for members in groups.values():
        for n, blocks in zip(members, decode([pictures[m] for m in members])):
            if blocks is None:
                continue
            p, f = pictures[n], files[n]
            n_bytes = _payload_size(p)
            payload = None if n_bytes is None else (blocks[: max(1, -(-n_bytes // 64))] + SHIFT).astype(np.uint8).tobytes()
            told = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if payload is not None else (None,) * 4
            out[n] = (*told, len(f), hashlib.sha256(f).hexdigest(), p.width, p.height, feature(p, blocks))
    return out


def media_features(rows: DataFrame) -> DataFrame:
    """rows (media, ...) with what is read back from media: byte counts, digests, dimensions and thumbnail hashes."""

    def compute(batch):
        column = batch.column("media")
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], np.int64)
        got: list[tuple | None] = []
        for i, j in pieces(np.concatenate([[0], np.cumsum(sizes)]), 1 << 20):
            got += read_back(column.slice(i, j - i).to_pylist())
        return [pa.array([None if g is None else g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))]

    return with_columns(rows, READ, compute)
