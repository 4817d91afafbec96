import hashlib
import random
import zlib

import numpy as np
import pytest

from personweave.llm import media


def test_round_trip_of_any_bytes():
    writer, rng = media.JpegWriter(), np.random.default_rng(0)
    payloads = [bytes(192), bytes([128]) * 192, bytes(range(192)), bytes([255]) * 384, bytes([128]) * 190 + b"ab", rng.integers(0, 256, 192 * 37, dtype=np.uint8).tobytes(), b" " * 192 * 9000]
    files = [writer.write(p) for p in payloads]
    assert [media.payload_of(*r) for r in media.decode(files)] == payloads  # together
    assert [media.payload_of(*media.decode([f])[0]) for f in files] == payloads  # one by one


def test_writer_refuses_other_lengths():
    with pytest.raises(ValueError):
        media.JpegWriter().write(b"x")


def reference_decode(frame):
    """A bit-by-bit decoder of one scan without restarts or with one MCU each."""
    codes = {t: {(n, c): s for s, c, n in media.canonical(*frame.tables[t])} for t in frame.tables}
    out = []
    segments = media._cut(frame.data)
    for data in segments:
        bits = "".join(f"{b:08b}" for b in data)
        at = 0

        def symbol(table):
            nonlocal at
            code = n = 0
            while (n, code) not in codes[table] or n == 0:
                code, n, at = 2 * code + int(bits[at]), n + 1, at + 1
            return codes[table][n, code]

        def value(size):
            nonlocal at
            if not size:
                return 0
            v = int(bits[at : at + size], 2)
            at += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for dc, ac in frame.scan:
            block = [0] * 64
            block[0] = value(symbol(dc))
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            out.append(block)
    return np.array(out).reshape(-1, len(frame.scan), 64)


def test_lock_step_decoder_against_bit_by_bit():
    rng = np.random.default_rng(1)
    payload = np.where(rng.random(192 * 6) < 0.7, 128, rng.integers(0, 256, 192 * 6)).astype(np.uint8).tobytes()
    frame, coefficients = media.decode([media.JpegWriter().write(payload)])[0]
    assert (reference_decode(frame) == coefficients).all()


def test_predicted_dc_without_restarts():
    """Two MCUs of one grey component in one segment: the second DC adds to the first."""
    dc, ac = media._dc_table(), media._ac_table()
    code = {0: {s: (c, n) for s, c, n in media.canonical(*dc)}, 16: {s: (c, n) for s, c, n in media.canonical(*ac)}}
    put = lambda t, s: f"{code[t][s][0]:0{code[t][s][1]}b}"
    bits = put(0, 3) + "101" + put(16, 0) + put(0, 2) + "00" + put(16, 0)  # 5, then 5 - 3
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([16] + [1] * 63)) + seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += b"".join(seg(0xC4, bytes([16 * k, *t[0][:16], *t[1]])) for k, t in enumerate((dc, ac))) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    frame, coefficients = media.decode([head + body + b"\xff\xd9"])[0]
    assert coefficients[:, 0, 0].tolist() == [5, 2]
    assert media.thumbnail(frame, coefficients).tolist() == [[138, 132]]


#: The format's own example tables for luminance, as (codes of each length, symbols).
STANDARD_DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
STANDARD_AC = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)


def encode(width, height, components, mcus, interval=0, tables=(STANDARD_DC, STANDARD_AC)):
    """A file of (MCU, block, 64) coefficients in scan order, written bit by bit; components: (across, down)."""
    code = [{s: f"{c:0{n}b}" for s, c, n in media.canonical(*t)} for t in tables]
    of = [k for k, (h, v) in enumerate(components) for _ in range(h * v)] if len(components) > 1 else [0]
    magnitude = lambda x: (n := abs(x).bit_length(), f"{x if x > 0 else x + (1 << n) - 1:0{n}b}" if n else "")
    out, bits, pred = [], "", [0] * len(components)

    def close():
        data = bits + "1" * (-len(bits) % 8)
        return bytes(int(data[i : i + 8], 2) for i in range(0, len(data), 8)).replace(b"\xff", b"\xff\x00")

    for m, blocks in enumerate(mcus.tolist()):
        if interval and m and m % interval == 0:
            out += [close(), bytes([0xFF, 0xD0 + (m // interval - 1) % 8])]
            bits, pred = "", [0] * len(components)
        for block, k in zip(blocks, of, strict=True):
            n, value = magnitude(block[0] - pred[k])
            pred[k] = block[0]
            bits += code[0][n] + value
            run = 0
            last = max((i for i in range(1, 64) if block[i]), default=0)
            for x in block[1 : last + 1]:
                if not x:
                    run += 1
                    continue
                while run > 15:
                    bits += code[1][0xF0]
                    run -= 16
                n, value = magnitude(x)
                bits += code[1][16 * run + n] + value
                run = 0
            if last < 63:
                bits += code[1][0]
    seg = media._segment
    head = [b"\xff\xd8", seg(0xDB, b"\0" + bytes([8] + [1] * 63))]
    head.append(seg(0xC0, bytes([8, *divmod(height, 256), *divmod(width, 256), len(components)]) + b"".join(bytes([k + 1, 16 * h + v, 0]) for k, (h, v) in enumerate(components))))
    head += [seg(0xC4, bytes([16 * k, *t[0], *t[1]])) for k, t in enumerate(tables)]
    head += [seg(0xDD, bytes(divmod(interval, 256)))] * bool(interval)
    head.append(seg(0xDA, bytes([len(components), *(b for k in range(len(components)) for b in (k + 1, 0)), 0, 63, 0])))
    return b"".join([*head, *out, close(), b"\xff\xd9"])


@pytest.mark.parametrize("components", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 2), (1, 1)], [(1, 1), (2, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3, 100])
def test_files_of_other_writers(components, interval):
    """Standard tables, subsampled chroma, restarts of any interval, sizes that are no multiple of an MCU."""
    rng = np.random.default_rng(len(components) * 7 + interval)
    for width, height in ((1, 1), (37, 21), (64, 16)):
        most = [max(c[k] for c in components) if len(components) > 1 else 1 for k in (0, 1)]
        across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
        per = sum(h * v for h, v in components) if len(components) > 1 else 1
        mcus = np.where(rng.random((across * down, per, 64)) < 0.15, rng.integers(-255, 256, (across * down, per, 64)), 0)
        mcus[..., 0] = rng.integers(-128, 128, mcus.shape[:2])
        frame, found = media.decode([encode(width, height, components, mcus, interval)])[0]
        assert (frame.width, frame.height) == (width, height) and (found == mcus).all()
        h, v = components[0] if len(components) > 1 else (1, 1)
        pixels = media.thumbnail(frame, found)
        assert pixels.shape == (-(-height * v // (8 * most[1])), -(-width * h // (8 * most[0])))
        for y in range(pixels.shape[0]):
            for x in range(pixels.shape[1]):
                dc = mcus[(y // v) * across + x // h, (y % v) * h + x % h, 0]
                assert pixels[y, x] == min(255, max(0, dc + 128))


def test_files_of_unlike_sizes_together():
    rng = np.random.default_rng(8)
    made = [np.where(rng.random((n, 1, 64)) < 0.1, 5, 0) for n in (1, 400, 2, 30, 1)]
    files = [encode(8 * len(m), 8, [(1, 1)], m, interval) for m, interval in zip(made, (0, 7, 1, 0, 1), strict=True)]
    assert all((found == m).all() for (_, found), m in zip(media.decode(files), made, strict=True))


def test_any_bytes_give_a_defined_result(spark, docs):
    """Flipped, cut and made-up bytes, in the frame header above all: null columns or some image, never an error."""
    rng = random.Random(9)
    whole = [media.JpegWriter().write(media.padded("some text " * 40)[1]), encode(37, 21, [(2, 2), (1, 1), (1, 1)], np.ones((6, 6, 64), int), 2)]
    files: list[bytes | None] = [None, b"", b"\xff\xd8", b"\xff" * 50, b"\xff\xd8" + b"\xff\xc0\x00\x02" * 3]
    for data in whole:
        header = data.index(b"\xff\xc0")
        files += [data[:n] for n in range(0, len(data), max(1, len(data) // 60))]
        for at in range(header, header + 19):
            files += [data[:at] + bytes([b]) + data[at + 1 :] for b in (0, 1, 0x11, 0x55, 0x7F, 0xFF)]
        for _ in range(1500):
            own = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.randrange(256)
            files.append(bytes(own))
    df = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "doc_id long, media binary")
    rows = media.media_columns(df).collect()
    assert len(rows) == len(files)
    assert all((r["width"] is None) == (r["thumb"] is None) == (r["thumb_hash"] is None) for r in rows)
    assert all(r["width"] is None for r in rows if r["doc_id"] < 5) and any(r["width"] for r in rows)
    # a small file cannot make the reader allocate a large image
    large = bytearray(whole[0])
    at = large.index(b"\xff\xc0")
    large[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    with pytest.raises(ValueError):
        media.parse(bytes(large))


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media.zigzag()[-1] == 63


def test_digests(spark, docs):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (2, ""), (None, "é漢🙂" * 100), (3, "x" * 192), (4, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(5000))), (5, "long " * 60_000)]
    found = sorted(map(tuple, media.stored_digests(docs(rows).selectExpr("*", "1 AS media")).collect()), key=str)
    expected = []
    for doc, text in rows:
        n, payload = media.padded(text)
        expected.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert [r[:5] for r in found] == sorted(expected, key=str)
    assert len({r[5:] for r in found if r[1] == 0}) == 1  # equal texts, equal values
    assert media.stored_digests(docs(rows).limit(0)).count() == 0


def test_columns_of_files(spark, docs):
    stored = media.store_texts(docs([(1, "abc"), (2, "x" * 2000)]))
    found = {r["doc_id"]: r for r in media.media_columns(stored.union(spark.createDataFrame([(3, 0, None), (4, 0, bytearray(b"no"))], stored.schema))).collect()}
    assert (found[1]["width"], found[1]["height"], found[1]["thumb"]) == (8, 8, b"a")
    assert (found[2]["width"], found[2]["height"]) == (32, 24)
    assert found[3]["width"] is None and found[4]["thumb_hash"] is None
