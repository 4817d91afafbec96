"""Media columns: baseline JPEG files, written and read with numpy.

The reader is a general one for baseline Huffman-coded files with one interleaved scan: it parses the
markers, cuts the scan at its restart markers, and decodes the segments of all files that share
tables in lock-step, one symbol of every segment at a time. From the coefficients it reconstructs a
thumbnail of the luminance DC terms, one pixel a block. The writer stores bytes losslessly in the
format's unit, the quantised coefficient: a byte b becomes the coefficient b - 128, 192 bytes an MCU of
three blocks, with a restart marker after each MCU.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_texts

UNIT = 192
#: MCUs that are coded at a time.
CHUNK = 8192
MOST_ACROSS = 8191


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: diagonals, upwards on even ones."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * r + c for r, c in order])


def canonical(bits: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as the format defines it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dc_table() -> tuple[list[int], list[int]]:
    """Sizes 0 to 11 with codes of 4 bits."""
    return [0, 0, 0, 12] + [0] * 12, list(range(12))


def _ac_table() -> tuple[list[int], list[int]]:
    """End of block and run 0 with codes of 4 bits, all other runs and sizes with 9."""
    short = [0x00, *range(0x01, 0x0B)]
    rest = [16 * run + size for run in range(1, 16) for size in range(1, 11)] + [0xF0]
    return [0, 0, 0, len(short), 0, 0, 0, 0, len(rest)] + [0] * 7, short + rest


def _lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """By the next 16 bits: 256 * length + symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(bits, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _size_of(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64) * (values != 0)


def _codes(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, n in canonical(*table):
        code[symbol], length[symbol] = c, n
    return code, length


class JpegWriter:
    """Writes bytes as the coefficients of a baseline file."""

    def __init__(self) -> None:
        self.dc, self.ac = _codes(_dc_table()), _codes(_ac_table())

    def _mcus(self, coefficients: np.ndarray, first: int) -> bytes:
        """The entropy-coded bytes of (n, 3, 64) coefficients in scan order, each MCU after a restart."""
        n = len(coefficients)
        flat = coefficients.reshape(-1, 64).astype(np.int64)
        rows, cols = np.nonzero(flat[:, 1:])
        cols = cols + 1
        new = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        run = cols - np.where(new, 0, np.r_[0, cols[:-1]] if len(cols) else cols) - 1
        long = run // 16
        # symbols in scan order: (block, position, code, length); runs of 16 zeros stand before their symbol
        value = flat[rows, cols]
        size = _size_of(value)
        symbol = 16 * (run % 16) + size
        bits = np.where(value < 0, value + (1 << size) - 1, value)
        zrow, zcol = np.repeat(rows, long), np.repeat(cols, long)
        dc = flat[:, 0]
        dsize = _size_of(dc)
        dbits = np.where(dc < 0, dc + (1 << dsize) - 1, dc)
        ended = flat[:, 63] == 0
        eob = np.flatnonzero(ended)
        every = np.arange(len(flat))
        key = np.concatenate([every * 256, rows * 256 + 2 * cols + 1, zrow * 256 + 2 * zcol, eob * 256 + 255])
        code = np.concatenate([(self.dc[0][dsize] << dsize) | dbits, (self.ac[0][symbol] << size) | bits, np.full(len(zrow), self.ac[0][0xF0]), np.full(len(eob), self.ac[0][0])])
        length = np.concatenate([self.dc[1][dsize] + dsize, self.ac[1][symbol] + size, np.full(len(zrow), self.ac[1][0xF0]), np.full(len(eob), self.ac[1][0])])
        order = np.argsort(key, kind="stable")
        mcu, code, length = key[order] // (256 * 3), code[order], length[order]
        total = np.bincount(mcu, weights=length, minlength=n).astype(np.int64)
        whole = -(-total // 8)
        start = np.r_[0, np.cumsum(whole)[:-1]] * 8
        ends = np.cumsum(length)
        at = start[mcu] + ends - length - np.r_[0, np.cumsum(total)[:-1]][mcu]
        pad = whole * 8 - total
        at, length = np.concatenate([at, start + total]), np.concatenate([length, pad])
        shifted = np.concatenate([code, (1 << pad) - 1]) << (64 - length - (at & 31)).clip(0, 63)
        # codes are disjoint, so adding up what falls into each 32-bit word sets its bits
        n_words = int(whole.sum()) // 4 + 2
        high = np.bincount(at >> 5, weights=(shifted >> 32) & 0xFFFFFFFF, minlength=n_words)
        low = np.bincount((at >> 5) + 1, weights=shifted & 0xFFFFFFFF, minlength=n_words)
        words = (high[:n_words] + low[:n_words]).astype(np.int64).astype(">u4")
        data = np.frombuffer(words.tobytes(), np.uint8)[: int(whole.sum())]
        # a zero after each 0xFF, a restart marker after each MCU
        ff = np.flatnonzero(data == 0xFF)
        data = np.insert(data, ff + 1, 0)
        edge = np.cumsum(whole)
        edge = edge + np.searchsorted(ff, edge)
        marks = np.empty((n, 2), np.uint8)
        marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + (first + np.arange(n)) % 8
        return np.insert(data, np.repeat(edge, 2), marks.ravel()).tobytes()

    def write(self, payload: bytes) -> bytes:
        """payload: a positive multiple of 192 bytes. The comment segment holds its length."""
        n = len(payload) // UNIT
        wide = min(MOST_ACROSS, max(1, int(np.ceil(np.sqrt(n)))))
        high = -(-n // wide)
        if high > MOST_ACROSS or n < 1 or len(payload) % UNIT:
            raise ValueError("the payload must hold a positive multiple of 192 bytes, 12.8 GB at most")
        quant = bytes([8] + [1] * 63)
        head = [b"\xff\xd8", _segment(0xFE, str(len(payload)).encode()), _segment(0xDB, b"\0" + quant)]
        head.append(_segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])))
        head += [_segment(0xC4, bytes([16 * kind, *bits[:16], *symbols])) for kind, (bits, symbols) in enumerate((_dc_table(), _ac_table()))]
        head += [_segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))]
        body = []
        for at in range(0, n, CHUNK):
            own = np.frombuffer(payload, np.uint8, count=min(CHUNK, n - at) * UNIT, offset=at * UNIT)
            body.append(self._mcus(own.reshape(-1, 3, 64).astype(np.int16) - 128, at))
        for at in range(n, wide * high, CHUNK):
            body.append(self._mcus(np.zeros((min(CHUNK, wide * high - at), 3, 64), np.int16), at))
        return b"".join(head) + b"".join(body)[:-2] + b"\xff\xd9"


@dataclass
class Frame:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    interval: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    scan: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each component
    data: bytes = b""

    def blocks(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [k for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def mcus(self) -> tuple[int, int]:
        """Across and down."""
        across, down = (max(c[k] for c in self.components) if len(self.components) > 1 else 1 for k in (1, 2))
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))


def parse(data: bytes) -> Frame:
    """Reads the markers of a baseline file up to its scan. ValueError for what is not baseline."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            frame.comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                frame.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                frame.tables[body[0]] = (bits, list(body[17 : 17 + sum(bits)]))
                body = body[17 + sum(bits) :]
        elif marker == 0xC0:
            depth, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if depth != 8:
                raise ValueError("not 8 bits a sample")
            if not frame.width or not frame.height or not 1 <= n <= 4:
                raise ValueError("a frame without samples")
            if any(not 1 <= c[k] <= 4 for c in frame.components for k in (1, 2)) or len(frame.blocks()) > 10:
                raise ValueError("sampling factors out of range")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            (frame.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if body[0] != len(frame.components) or not frame.components:
                raise ValueError("the scan must hold all components of one frame")
            by_id = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(body[0])}
            frame.scan = [by_id[c[0]] for c in frame.components]
            end = data.rfind(b"\xff\xd9")
            frame.data = data[at : end if end >= at else len(data)]
            across, down = frame.mcus()
            # a block takes two bits or more, so what a frame declares is bounded by its data
            if across * down * len(frame.blocks()) > 4 * len(frame.data):
                raise ValueError("the scan is too short for its frame")
            return frame
    raise ValueError("no scan")


def _decode_segments(segments: list[bytes], mcus: np.ndarray, blocks: list[int], scan: list[tuple[int, int]], lookups: dict[int, np.ndarray]) -> np.ndarray:
    """Coefficients (segment, MCU, block, 64) in scan order; all segments move on one symbol at a time."""
    n, most = len(segments), int(mcus.max())
    lengths = np.fromiter(map(len, segments), np.int64, n)
    starts = np.r_[0, np.cumsum(lengths + 8)[:-1]]
    raw = np.frombuffer(b"".join(s + b"\xff" * 8 for s in segments), np.uint8).astype(np.uint32)
    words = np.zeros(len(raw), np.uint32)  # the 32 bits from each byte on
    words[:-3] = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, last = 8 * starts, 8 * (starts + lengths) + 32
    out = np.zeros((n, most, len(blocks), 64), np.int16)
    flat = out.reshape(n, -1)
    pred = np.zeros((n, len(scan)), np.int64)

    def symbol(which: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run/size symbols and the values that follow them."""
        bit = at[which]
        if (bit > last[which]).any():
            raise ValueError("the scan ends early")
        seen = table[(words[bit >> 3].astype(np.int64) >> (16 - (bit & 7))) & 0xFFFF]
        if not seen.all():
            raise ValueError("no such Huffman code")
        bit, found = bit + (seen >> 8), seen & 255
        size = (found & 15).astype(np.int64)
        value = ((words[bit >> 3].astype(np.int64) >> (16 - (bit & 7))) & 0xFFFF) >> (16 - size)
        at[which] = bit + size
        return found, np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)

    for m in range(most):
        alive = np.flatnonzero(mcus > m)
        if (np.abs(pred) > 32767).any():
            raise ValueError("DC terms out of range")
        for b, component in enumerate(blocks):
            dc, ac = scan[component]
            base = (m * len(blocks) + b) * 64
            _, change = symbol(alive, lookups[dc])
            pred[alive, component] += change
            flat[alive, base] = pred[alive, component]
            place, which = np.ones(len(alive), np.int64), alive
            while len(which):
                found, value = symbol(which, lookups[ac])
                run, size = found >> 4, found & 15
                ended = (size == 0) & (run != 15)
                place = place + run
                store = (size > 0) & (place < 64)
                flat[which[store], base + place[store]] = value[store]
                place = place + 1
                stay = ~ended & (place < 64)
                which, place = which[stay], place[stay]
    return out


def decode(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Each file's frame and its coefficients (MCU, block, 64) in scan order.

    Files that share tables and layout are decoded together.
    """
    frames = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        tables = tuple((t, tuple(f.tables[t][0]), tuple(f.tables[t][1])) for t in sorted({x for pair in f.scan for x in pair}))
        groups.setdefault((tables, tuple(f.scan), tuple(f.blocks())), []).append(k)
    out: list = [None] * len(files)
    for (tables, scan, blocks), members in groups.items():
        lookups = {t: _lookup(list(bits), list(symbols)) for t, bits, symbols in tables}
        segments: list[bytes] = []
        mcus: list[int] = []
        spans = []
        for k in members:
            f = frames[k]
            total = f.mcus()[0] * f.mcus()[1]
            own = _cut(f.data) if f.interval else [f.data.replace(b"\xff\x00", b"\xff")]
            each = f.interval or total
            if len(own) != -(-total // each):
                raise ValueError("restart markers are missing")
            spans.append((k, len(segments), len(own)))
            segments += own
            mcus += [each] * (len(own) - 1) + [total - each * (len(own) - 1)]
        counts, parts, at = np.array(mcus), [], 0
        while at < len(segments):
            # as many segments as hold CHUNK MCUs, each as long as the longest of them
            most = np.maximum.accumulate(counts[at : at + CHUNK])
            to = at + max(1, int(np.count_nonzero(most * np.arange(1, len(most) + 1) <= CHUNK)))
            parts.append(_decode_segments(segments[at:to], counts[at:to], list(blocks), list(scan), lookups))
            at = to
        for k, first, n in spans:
            got, seen = [], 0
            for p in parts:
                a, b = max(first - seen, 0), min(first + n - seen, len(p))
                if a < b:
                    # what segments hold of the MCUs of the longest one beside them
                    got.append(p[a:b][np.arange(p.shape[1]) < counts[seen + a : seen + b, None]])
                seen += len(p)
            out[k] = (frames[k], np.concatenate(got) if len(got) > 1 else got[0])
    return out


def _cut(data: bytes) -> list[bytes]:
    """The segments between restart markers, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, int)
    marks = ff[(raw[ff + 1] & 0xF8) == 0xD0]
    edges = [-2, *marks.tolist(), len(data)]
    return [data[a + 2 : b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, edges[1:], strict=False)]


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC terms alone: one 8-bit pixel for each block of the first component that shows the image."""
    across, down = frame.mcus()
    first = frame.components[0]
    h, v = (first[1], first[2]) if len(frame.components) > 1 else (1, 1)
    dc = coefficients[:, : h * v, 0].astype(np.int64) * frame.quant[first[3]][0]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most = [max(c[k] for c in frame.components) if len(frame.components) > 1 else 1 for k in (1, 2)]
    grid = grid[: -(-frame.height * v // (8 * most[1])), : -(-frame.width * h // (8 * most[0]))]
    return np.clip(np.floor_divide(grid + 4, 8) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 8 grid of means is above the mean of the grid."""
    rows, cols = (np.minimum(np.arange(9) * n // 8, n) for n in pixels.shape)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    means = sums / np.outer(r1 - r0, c1 - c0)
    return np.packbits(means > means.mean()).tobytes().hex()


def payload_of(frame: Frame, coefficients: np.ndarray) -> bytes:
    """The bytes that JpegWriter stored."""
    return (coefficients.reshape(-1) + 128).astype(np.uint8).tobytes()[: int(frame.comment)]


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text as UTF-8, and those bytes with spaces up to a positive multiple of 192."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % UNIT if data else UNIT)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as a JPEG file. Null text counts as empty."""

    def make() -> Callable:
        writer = JpegWriter()

        def work(ids: list, texts: list) -> list:
            stored = [padded(t) for t in texts]
            return [ids, [n for n, _ in stored], [writer.write(p) for _, p in stored]]

        return work

    return map_texts(docs, make, "doc_id long, n_bytes long, media binary", ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], id_col, text_col)


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, thumb binary, thumb_hash): one row for each row.

    The rest is null for null, empty and unreadable files: what is no baseline JPEG with one interleaved
    scan, is cut off, or declares more blocks than its bytes can hold. Repeated rows stay, equal in all
    columns, and so do null ids. An empty table gives an empty one. Other columns are not read.
    """

    def make() -> Callable:
        def one(data: bytes | None) -> tuple:
            try:
                frame, coefficients = decode([data or b""])[0]
                pixels = thumbnail(frame, coefficients)
            except (ValueError, KeyError, IndexError, struct.error):
                return None, None, None, None
            return frame.width, frame.height, pixels.tobytes(), thumbnail_hash(pixels)

        return lambda ids, files: [ids, *map(list, zip(*map(one, files), strict=True))] if ids else [[]] * 5

    return map_texts(df, make, "doc_id long, width int, height int, thumb binary, thumb_hash string", ["doc_id", "width", "height", "thumb", "thumb_hash"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()], id_col, media_col)


def stored_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Writes each text as store_texts does, reads the file back as media_columns does, and keeps digests
    of the file and of the payload read from it; feature is width x height : hash of the thumbnail.
    Null text counts as empty and gives 192 spaces. Repeated rows and null ids stay. Other columns are
    not read.
    """

    def make() -> Callable:
        writer = JpegWriter()

        def work(ids: list, texts: list) -> list:
            stored = [padded(t) for t in texts]
            files = [writer.write(p) for _, p in stored]
            read = decode(files)
            payloads = [payload_of(*r) for r in read]
            features = [f"{f.width}x{f.height}:{thumbnail_hash(thumbnail(f, c))}" for f, c in read]
            digest = lambda x: hashlib.sha256(x).hexdigest()
            return [ids, [n for n, _ in stored], list(map(len, payloads)), list(map(digest, payloads)), [zlib.crc32(p[-16:]) for p in payloads], list(map(len, files)), list(map(digest, files)), features]

        return work

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return map_texts(docs, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", names, types, id_col, text_col)


#: The payloads alone: texts as bytes, filled up with spaces to a positive multiple of 192.
PAYLOAD_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, x, n, greatest(192, 192 * ((n + 191) // 192)) AS whole FROM t)
SELECT doc_id, n::BIGINT AS n_bytes, whole::BIGINT AS payload_bytes, sha256(concat(x, repeat(' ', whole - n))) AS payload_sha256 FROM p
"""
