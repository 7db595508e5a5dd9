import hashlib
import zlib

import numpy as np
import pytest

from lattica.llm import queries, tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 32])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("big_endian", [False, True])
def test_round_trip(compression, tile, predictor, big_endian):
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, (70, 45), np.uint8), np.full((200, 300), 7, np.uint8), rng.integers(0, 3, (150, 211), np.uint8), np.array([[9]], np.uint8)]
    data = tiff.write(made, compression=compression, predictor=predictor, tile=tile, rows_per_strip=17, big_endian=big_endian)
    found = list(tiff.read(data))
    assert [(p.height, p.width) for p in found] == [m.shape for m in made]
    assert [p.samples for p in found] == [m.tobytes() for m in made]


def test_broken_media_and_empty_tables(spark):
    good = tiff.write([np.zeros((2, 3), np.uint8)] * 2)
    df = spark.createDataFrame([(1, good, 5), (2, None, None), (3, b"", 1), (4, b"II*\0junkjunk", 1)], "doc_id long, media binary, other int")
    got = sorted(((r.doc_id, r.page if r.page is not None else -1, r.error is None) for r in tiff.pages(df).collect()))
    assert got == [(1, 0, True), (1, 1, True), (4, -1, False)]
    assert tiff.pages(spark.createDataFrame([(1, good), (1, good)], "doc_id long, media binary")).count() == 4
    with pytest.raises(tiff.TiffError):
        list(tiff.read(good[:30]))
    assert tiff.pages(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        tiff.pages(df.withColumnRenamed("other", "page"), keep=("page",))


def test_query_gives_the_payload_back(spark, data):
    got = {r.doc_id: r for r in queries.op5_tiff_media(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        raw = (r.text or "").encode()
        full = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def by_hand(order, entries, blocks):
    """A file put together field by field: data first, then one directory; ``entries``: (tag, type, values)."""
    import struct

    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    spots = []
    for b in blocks:
        spots.append(len(out))
        out += b + b"\0" * (len(b) % 2)
    rows = b""
    for tag, kind, values in sorted(entries):
        values = spots if values == "offsets" else [len(b) for b in blocks] if values == "sizes" else values
        raw = struct.pack(order + str(len(values)) + {1: "B", 3: "H", 4: "I"}[kind], *values)
        if len(raw) > 4:
            at = len(out)
            out += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack(order + "I", at)
        rows += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(entries)) + rows + b"\0\0\0\0")


#: The worked examples of the PackBits note, and LZW codes of nine bits: clear, 7, 258, 8, 8, 258, 6, 6, end.
PACKED = bytes.fromhex("feaa02 80002a fdaa03 80002a22 f7aa")
UNPACKED = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
CODES, PLAIN = (256, 7, 258, 8, 8, 258, 6, 6, 257), bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def nine_bits(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_that_the_writer_did_not_make(order):
    size = lambda w, h: [(256, 3, [w]), (257, 4, [h]), (258, 3, [8]), (262, 3, [1])]
    strips = [(273, 4, "offsets"), (279, 4, "sizes")]
    read = lambda entries, blocks: next(tiff.read(by_hand(order, entries, blocks)))
    assert read([*size(24, 1), (259, 3, [32773]), *strips], [PACKED]).samples == UNPACKED
    assert read([*size(3, 3), (259, 3, [5]), (277, 3, [1]), *strips], [nine_bits(CODES)]).samples == PLAIN  # no rows per strip: one strip
    two = read([*size(2, 3), (259, 3, [1]), (278, 3, [2]), *strips], [b"abcd", b"ef"])
    assert (two.samples, two.width, two.height, two.tiled) == (b"abcdef", 2, 3, False)
    colour = read([(256, 1, [2]), (257, 1, [1]), (258, 3, [8, 8, 8]), (262, 3, [2]), (259, 3, [8]), (277, 3, [3]), (317, 3, [2]), *strips], [zlib.compress(bytes([1, 2, 3, 1, 1, 255]))])
    assert colour.samples == bytes([1, 2, 3, 2, 3, 2]) and colour.channels == 3
    tiles = [bytes([k]) * 256 for k in range(4)]
    tiled = read([*size(17, 18), (259, 3, [1]), (322, 3, [16]), (323, 3, [16]), (324, 4, "offsets"), (325, 4, "sizes")], tiles)
    want = bytes((y // 16) * 2 + x // 16 for y in range(18) for x in range(17))
    assert tiled.samples == want and tiled.tiled


def test_damaged_files_are_errors_only(spark):
    rng = np.random.default_rng(5)
    good = tiff.write([rng.integers(0, 9, (40, 30), np.uint8)] * 2, compression=tiff.LZW, predictor=2)
    for _ in range(400):
        bad = bytearray(good)
        for at in rng.integers(0, len(bad), 4):
            bad[at] = rng.integers(0, 256)
        try:
            list(tiff.read(bytes(bad[: rng.integers(8, len(bad))])))
        except tiff.TiffError:
            pass


def test_long_and_repeated_texts(spark):
    rows = [(1, "x" * 2_000_000, 0), (2, "é", 0), (2, "é", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = tiff.pages(tiff.store_texts(df), keep=("doc_id", "n_bytes")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.samples)) for r in got) == [(0, 0, 576), (1, 2_000_000, 576 * 3473), (2, 2, 576), (2, 2, 576)]
    assert tiff.store_texts(df.filter("false")).count() == 0
