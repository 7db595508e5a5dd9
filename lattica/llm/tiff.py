"""TIFF media columns: a writer for single-sample pages and a reader that gives one row per page.

The reader walks the image file directories of either byte order, decodes strips or tiles stored plainly or under
PackBits, LZW or deflate, undoes horizontal differencing and crops tiles to the page. Only 8-bit samples are read.

A null or empty media value has no pages. Anything else that isn't a readable TIFF gives one row whose page is null and
whose ``error`` says why, after the pages that could be read; under ``strict`` it raises ``TiffError``. Rows are
independent, so repeated rows give repeated pages; empty tables give none. Files and texts of any length are read and
written whole. Columns that would clash with those that are made raise ``ValueError``; others are ignored unless kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices

#: Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class TiffError(ValueError):
    pass


class Page(NamedTuple):
    index: int
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tiled: bool
    samples: bytes


# -- codecs ---------------------------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        end = at + 1
        while end < n and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 2:
            out += bytes((257 - (end - at), data[at]))
            at = end
            continue
        while end < n and end - at < 128 and (end + 1 >= n or data[end] != data[end + 1]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, the width growing one code early."""
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    codes, width, prefix = {bytes((b,)): b for b in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        longer = prefix + bytes((b,))
        if longer in codes:
            prefix = longer
            continue
        put(codes[prefix], width)
        codes[longer] = len(codes) + 2
        prefix = bytes((b,))
        if len(codes) + 2 > 4094:
            put(codes[prefix], width)
            put(256, width)
            codes, width, prefix = {bytes((b,)): b for b in range(256)}, 9, b""
        elif len(codes) + 2 >= (1 << width):
            width += 1
    if prefix:
        put(codes[prefix], width)
        codes[prefix + b"\0\0"] = 0  # the reader has made one more entry by now
        if len(codes) + 2 >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, entries, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for b in data:
        held, bits = (held << 8) | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            entries, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, None
            continue
        if not entries:
            raise TiffError("LZW data doesn't start with a clear code")
        if last is None:
            got = entries[code]
        else:
            if code < len(entries):
                got = entries[code]
            elif code == len(entries):
                got = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            entries.append(last + got[:1])
            if len(entries) + 1 >= (1 << width) and width < 12:
                width += 1
        out += got
        last = got
    return bytes(out[:size])


def _pack(data: bytes, compression: int, level: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, level)
    raise TiffError(f"unknown compression {compression}")


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"unknown compression {compression}")


# -- writing --------------------------------------------------------------------------------------------------------


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: int = 0, big_endian: bool = False, level: int = 1) -> bytes:
    """A TIFF of 2-dimensional uint8 arrays; ``tile``: the side of square tiles (a multiple of 16), 0 for strips."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        page = np.ascontiguousarray(page, np.uint8)
        height, width = page.shape
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            full[:height, :width] = page
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = _pack(block.tobytes(), compression, level)
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(fields.items()):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR)
            raw = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, spot = struct.pack(f"{order}I", len(out)), raw
                out += spot
            entries.append(struct.pack(f"{order}HHI", tag, 3 if short else 4, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- reading --------------------------------------------------------------------------------------------------------


def read(data: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF, one image file directory after the other."""
    if not data:
        return
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen, index = struct.unpack_from(f"{order}I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("the chain of directories is broken")
        seen.add(at)
        fields, at = _directory(data, order, at)
        try:
            page = _page(data, fields, index)
        except (LookupError, TypeError, ArithmeticError, MemoryError) as e:
            raise TiffError(f"a page is incomplete: {type(e).__name__} {e}") from e
        yield page
        index += 1


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    try:
        n = struct.unpack_from(f"{order}H", data, at)[0]
        fields: dict[int, list[int]] = {}
        for k in range(n):
            spot = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, spot)
            if kind not in (1, 3, 4):
                continue
            size = TYPE_SIZE[kind] * count
            where = spot + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, spot + 8)[0]
            fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where))
        return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"a directory is cut short: {e}") from e


def _page(data: bytes, fields: dict[int, list[int]], index: int) -> Page:
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, channels = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, tiled = one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in fields
    if not width or not height:
        raise TiffError("a page has no size")
    if any(b != 8 for b in fields.get(BITS, [1])) or predictor not in (1, 2) or channels > 1 and one(PLANAR, 1) != 1:
        raise TiffError("only interleaved 8-bit samples are read")
    if tiled:
        wide, high, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        wide, high, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height), fields[STRIP_OFFSETS], fields[STRIP_BYTES]
    across = -(-width // wide)
    if len(offsets) < across * -(-height // high):
        raise TiffError("blocks are missing")
    out = np.empty((height, width, channels), np.uint8)
    for k in range(across * -(-height // high)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        raw = _unpack(data[offsets[k] : offsets[k] + sizes[k]], compression, rows * wide * channels)
        if len(raw) < rows * wide * channels:
            raise TiffError("a block is cut short")
        block = np.frombuffer(raw, np.uint8).reshape(rows, wide, channels)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + wide] = block[: height - y, : width - x]
    return Page(index, width, height, channels, compression, predictor, tiled, out.tobytes())


# -- columns --------------------------------------------------------------------------------------------------------


def store_texts(df: DataFrame, width: int = 576, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to full rows (one at least), as a page."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        raw = [(t or "").encode() for t in rows[text]]
        full = [r + b"\xff" * (-len(r) % width or (0 if r else width)) for r in raw]
        return {key: rows[key], "n_bytes": [len(r) for r in raw], "media": [write([np.frombuffer(f, np.uint8).reshape(-1, width)], **options) for f in full]}

    return map_slices(df, f"`{key}` {kind}, n_bytes long, media binary", work, [key, text])


def pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), strict: bool = False) -> DataFrame:
    """One row per page: the kept columns, the media column, page, width, height, channels, compression, predictor,
    tiled, samples (row by row), feature, a summary of the samples, and error, null for what could be read."""
    kinds = dict(df.dtypes)
    fields = {"page": "int", "width": "int", "height": "int", "channels": "int", "compression": "int", "predictor": "int", "tiled": "boolean", "samples": "binary", "feature": "string", "error": "string"}
    if clash := set(fields) & {*keep, media}:
        raise ValueError(f"columns would clash: {sorted(clash)}")

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in (*keep, media, *fields)}
        for k, data in enumerate(rows[media]):
            found: list[tuple] = []
            try:
                for p in read(data):
                    found.append((*p, feature(p), None))
            except TiffError as e:
                if strict:
                    raise
                found.append((*[None] * (len(fields) - 1), str(e)))
            for p in found:
                for c in (*keep, media):
                    out[c].append(rows[c][k])
                for c, v in zip(fields, p, strict=True):
                    out[c].append(v)
        return out

    columns = [*keep, media]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{c} {t}" for c, t in fields.items())])
    return map_slices(df, schema, work, columns, rows=256)


def feature(page: Page) -> str:
    """Size, mean, deviation and the shares of eight equal brightness ranges."""
    x = np.frombuffer(page.samples, np.uint8)
    n = np.bincount(x, minlength=256)
    mean = float((n * np.arange(256)).sum() / x.size)
    spread = float(np.sqrt(max(0.0, (n * np.arange(256) ** 2.0).sum() / x.size - mean * mean)))
    return f"{page.width}x{page.height} mean={mean:.4f} sd={spread:.4f} hist=" + ",".join(f"{v / x.size:.4f}" for v in n.reshape(8, 32).sum(1))
