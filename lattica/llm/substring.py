"""Repeated passages across documents, found with fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window. Their hashes go into a bit table of fixed size,
beside a second one for blocks that more than one document has. Every rolling window of a block's length probes it: a
window of ``WINDOW`` words that two documents share holds a whole block of either, so in both documents one of its
probes hits (at a document's own blocks, the second table decides). Hits are extended to the windows around them, and
these are compared by two hashes of 64 bits each: each window's smallest document is found, and overlapping windows
that a smaller document has join to maximal repeats.

The table is a filter: however full it gets, it can only let through windows that turn out not to repeat, so results
don't depend on its size. It is the only thing sent to all executors. Windows meet in boxes whose number grows with
the words, so that a box stays as large as it is. What goes is dealt to as many boxes of documents, which are read as
a stream, so that a worker holds the windows that go from one box, and never its texts.

Words are the runs of anything but ASCII white space. Null and empty texts have none. Rows that repeat a document's id
are parts of one document and don't make each other repeats; rows with a null id are left whole and count for no
other. Texts shorter than a window are left whole; very long ones are treated like any other. Other columns, whatever
their names, are ignored unless ``row`` asks for them; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Hashes, lean, small_batches, words_of

WINDOW = 50
BLOCK = WINDOW // 2
#: The anchor tables: chunks, bits of a chunk as a power of two (2**28 bits in each table), bits set by a block.
CHUNKS, CHUNK_BITS, PROBES = 512, 19, 3
#: Words gathered before a worker hands on what it has; words, of all documents, for each box that windows meet in, and
#: for each part that documents are dealt to.
GATHER, BOX_WORDS, PART_WORDS = 1 << 20, 1 << 20, 1 << 22

_words = Hashes(lambda w: xxhash.xxh64_intdigest(w, 1))
#: The bases of the two hashes, and their powers and inverse powers.
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xC2B2AE3D27D4EB4F | 5))
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64."""
    known, base = _powers[which], _BASES[which]
    if len(known[0]) < n:
        size, inverse = 1 << (n - 1).bit_length(), np.uint64(pow(int(base), -1, 2**64))
        for k, step in enumerate((base, inverse)):
            known[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, step)]), dtype=np.uint64)
    return known[0][:n], known[1][:n]


def rolling(words: np.ndarray, widths: tuple[int, ...], which: int = 0) -> list[np.ndarray]:
    """Hashes of all runs of so many word hashes."""
    up, down = powers(len(words) + 1, which)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)])
    out = []
    for width in widths:
        n = max(0, len(words) - width + 1)
        h = (sums[width:] - sums[: len(sums) - width])[:n] * down[:n] if n else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
    return out


def window_hashes(words: np.ndarray, bits: int = 64) -> np.ndarray:
    """Both hashes of all windows, a row for each; ``bits``: those kept of the first one (all, but in tests)."""
    mixed = (words ^ (words >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    first, second = rolling(words, (WINDOW,))[0], rolling(mixed ^ (mixed >> np.uint64(29)), (WINDOW,), 1)[0]
    return np.stack([first >> np.uint64(64 - bits), second], 1)


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The bits of a block's hash, as places within its chunk."""
    mask = np.uint64((1 << CHUNK_BITS) - 1)
    return [((h >> np.uint64(CHUNK_BITS * k)) & mask).astype(np.int64) for k in range(PROBES)]


def chunk_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CHUNKS.bit_length() + 1)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Ids and word hashes of the documents that are long enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if key is not None and text and len(text) >= 2 * WINDOW - 1 and len(words := words_of(text)) >= WINDOW:
                    yield key, _words.array(words)


def _parcels(h: np.ndarray, doc: np.ndarray, box: np.ndarray) -> pa.RecordBatch:
    """(box, hashes, docs): what goes to each box, as bytes."""
    order = np.argsort(box, kind="stable")
    h, doc, box = h[order], doc[order], box[order]
    edge = np.flatnonzero(np.diff(box)) + 1
    cuts = list(zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(box)]]), strict=True)) if len(box) else []
    arrays = [pa.array([int(box[s]) for s, _ in cuts], pa.int64()), pa.array([h[s:e].tobytes() for s, e in cuts], pa.binary()), pa.array([doc[s:e].tobytes() for s, e in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["box", "hashes", "docs"])


PARCEL = "box long, hashes binary, docs binary"


def _parcels_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for box, h, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield box, np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64)


def anchors(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The two bit tables: blocks of any document, blocks of several; and the words of all documents of a window or
    more. ``df``: id, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def hand_on() -> pa.RecordBatch:
            h, doc = np.concatenate([x for _, x in held]), np.repeat(np.array([k for k, _ in held], np.int64), [len(x) for _, x in held])
            return _parcels(h, doc, chunk_of(h))

        for key, words in _texts(batches):
            total += len(words)
            held.append((key, np.unique(rolling(words, (BLOCK,))[0][::BLOCK])))
            size += len(held[-1][1])
            if size >= GATHER // 4:
                yield hand_on()
                held, size = [], 0
        if held:
            yield hand_on()
        yield _parcels(np.array([total], np.uint64), np.zeros(1, np.int64), np.array([CHUNKS]))  # no chunk: a count

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of one chunk after the other; parcels are taken in as they come."""
        now, low, high = None, np.zeros(0), np.zeros(0)

        def bits() -> pa.RecordBatch:
            arrays = [pa.array([now], pa.int64()), *(pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in (low <= high, low < high))]
            return pa.RecordBatch.from_arrays(arrays, names=["box", "hashes", "docs"])

        for box, h, doc in _parcels_in(batches):
            if box == CHUNKS:
                yield _parcels(h, doc, np.array([CHUNKS]))
                continue
            if box != now:
                if now is not None:
                    yield bits()
                now, low, high = box, np.full(1 << CHUNK_BITS, np.iinfo(np.int64).max), np.full(1 << CHUNK_BITS, np.iinfo(np.int64).min)
            for at in slots(h):
                np.minimum.at(low, at, doc)
                np.maximum.at(high, at, doc)
        if now is not None:
            yield bits()

    some, several = (np.zeros((CHUNKS, 1 << CHUNK_BITS - 3), np.uint8) for _ in range(2))
    total = 0
    for r in df.mapInArrow(lean(cut), PARCEL).repartition(64, "box").sortWithinPartitions("box").mapInArrow(lean(collect), PARCEL).toLocalIterator():
        if r.box == CHUNKS:
            total += int(np.frombuffer(r.hashes, np.uint64)[0])
        else:
            some[r.box], several[r.box] = np.frombuffer(r.hashes, np.uint8), np.frombuffer(r.docs, np.uint8)
    return some.ravel(), several.ravel(), total


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    base, out = chunk_of(h) << CHUNK_BITS, np.ones(len(h), bool)
    for at in slots(h):
        spot = base + at
        out &= (table[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
    return out


def candidates(words: np.ndarray, some: np.ndarray, several: np.ndarray, bits: int = 64) -> np.ndarray:
    """Hashes of the windows around the places where a probe hits a block of another document."""
    (probes,) = rolling(words, (BLOCK,))
    hit = holds(some, probes)
    hit[::BLOCK] = holds(several, probes[::BLOCK])
    before = np.concatenate([[0], np.cumsum(hit)])
    n = len(words) - WINDOW + 1
    near = before[WINDOW - BLOCK + 1 :][:n] > before[:n]
    return different(window_hashes(words, bits)[near]) if near.any() else np.zeros((0, 2), np.uint64)


def different(h: np.ndarray) -> np.ndarray:
    """The windows, sorted, without repeats."""
    h = h[np.lexsort((h[:, 1], h[:, 0]))]
    return h[np.concatenate([[True], (h[1:] != h[:-1]).any(1)])] if len(h) else h


def ordered(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By window and document."""
    order = np.lexsort((doc, h[:, 0]))
    a, b = h[order, 0], h[order, 1]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # windows that differ in the second hash only
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
    return h[order], doc[order]


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same window; by window and document."""
    first = np.concatenate([[True], (h[1:] != h[:-1]).any(1)])
    return doc > doc[first][np.cumsum(first) - 1]


def repeats(df: DataFrame, bits: int = 64) -> tuple[DataFrame, int, int]:
    """Parcels (box of the document, hashes, docs) of the windows that a smaller document has; the number of boxes, and
    of partitions for them. ``df``: id, text."""
    *tables, total = anchors(df)
    sent = df.sparkSession.sparkContext.broadcast(tables)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxes, partitions = max(4 * partitions + 1, total // BOX_WORDS + 1), max(partitions, total // PART_WORDS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, several = sent.value
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            """Of each window, the smallest document goes to the window's box; the others, which repeat it, go straight
            to their documents', under negative numbers. So a box gets a window once from each of these calls."""
            h, doc = ordered(np.concatenate([x for _, x in held]), np.repeat(np.array([k for k, _ in held], np.int64), [len(x) for _, x in held]))
            return _parcels(h, doc, np.where(repeated(h, doc), -1 - doc % boxes, ((h[:, 0] ^ h[:, 1]) % np.uint64(boxes)).astype(np.int64)))

        for key, words in _texts(batches):
            if len(found := candidates(words, some, several, bits)):
                held.append((key, found))
                size += len(found)
            if size >= GATHER:
                yield hand_on()
                held, size = [], 0
        if held:
            yield hand_on()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for box, parcels in groupby(_parcels_in(batches), key=lambda p: p[0]):
            # what goes straight to documents is handed on as it comes; a window's box is compared as a whole
            for h, doc in [_join(list(parcels))] if box >= 0 else ((h.reshape(-1, 2), doc) for _, h, doc in parcels):
                if box >= 0:
                    h, doc = ordered(h, doc)
                    again = repeated(h, doc)
                    h, doc = h[again], doc[again]
                held.append((h, doc))
                size += len(h)
                if size >= GATHER:
                    yield to_documents(held)
                    held, size = [], 0
        if size:
            yield to_documents(held)

    def to_documents(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, doc = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        return _parcels(h, doc, doc % boxes)

    dealt = df.mapInArrow(lean(probe), PARCEL).repartition(partitions, "box").sortWithinPartitions("box")
    return dealt.mapInArrow(lean(compare), PARCEL), boxes, partitions


def _join(parcels: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([h for _, h, _ in parcels]).reshape(-1, 2), np.concatenate([d for *_, d in parcels])


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", row: bool = False, bits: int = 64) -> DataFrame:
    """(key, n_words, n_removed, removed, kept) for every row: removed holds the starts and ends, in words, of the
    maximal repeats that go; kept is what stays, words joined by one space. ``row``: beside them the whole row of
    ``df``, as a struct column."""
    docs = small_batches(df).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[F.struct("*").alias("row")] * row)
    found, boxes, partitions = repeats(docs.select("key", "text"), bits)
    schema = T.StructType.fromDDL("key long, n_words long, n_removed long, removed array<int>, kept string")
    kinds = to_arrow_schema(schema)
    if row:
        schema = schema.add("row", df.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes from a box's documents comes before their texts."""
        now, parcels, gone, of = None, [], np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("row").field(text) if row else part.column("text")
                out: dict[str, list] = {f.name: [] for f in kinds}
                own = []
                for i, (box, k, h, d, t) in enumerate(zip(*(part.column(c).to_pylist() for c in ("box", "key", "hashes", "docs")), texts.to_pylist(), strict=True)):
                    if box != now:
                        now, parcels, gone, of = box, [], gone[:0], of[:0]
                    if h is not None:
                        parcels.append((box, np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64)))
                        continue
                    if parcels:
                        gone, of = _join(parcels)
                        order = np.argsort(of, kind="stable")
                        parcels, gone, of = [], gone[order], of[order]
                    words = words_of(t)
                    spans, kept = [], words
                    if k is not None and (s := np.searchsorted(of, k, "left")) < (e := np.searchsorted(of, k, "right")):
                        spans, kept = without(words, gone[s:e], bits)
                    own.append(i)
                    for c, v in zip(out, (k, len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")), strict=True):
                        out[c].append(v)
                made = [pa.array(out[f.name], f.type) for f in kinds]
                if row:
                    made.append(part.column("row").take(pa.array(own, pa.int32())))
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    box = F.pmod(F.coalesce("key", F.xxhash64("row" if row else "text")), F.lit(boxes).cast("long"))  # rows without an id go anywhere
    here = docs.select(box.alias("box"), "key", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("docs"), "row" if row else "text")
    there = found.select(*[F.col(c) if c in found.columns else F.lit(None).cast(here.schema[c].dataType).alias(c) for c in here.columns])
    dealt = here.unionAll(there).repartition(partitions, "box").sortWithinPartitions("box", F.col("hashes").isNull())
    return dealt.mapInArrow(lean(cut), schema).withColumnRenamed("key", key)


def without(words: list[bytes], gone: np.ndarray, bits: int = 64) -> tuple[list[int], list[bytes]]:
    """The repeats, as starts and ends, and the other words."""
    if len(words) < WINDOW:
        return [], words
    starts = np.flatnonzero(among(window_hashes(_words.array(words), bits), different(gone)))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    spans = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]))).tolist()
    return spans, [words[k] for k in np.flatnonzero(~covered)]


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether windows are among known ones, which are sorted and differ."""
    out, at = np.zeros(len(h), bool), np.searchsorted(known[:, 0], h[:, 0])
    if not len(known):
        return out
    same = np.flatnonzero(np.concatenate([[True], known[1:, 0] != known[:-1, 0], [True]]))
    for step in range(int(np.diff(same).max())):  # known windows of one first hash; one, but for collisions
        spot = np.minimum(at + step, len(known) - 1)
        out |= (known[spot] == h).all(1)
    return out


#: DuckDB SQL over documents (doc_id, text): the digests of what stays, from all windows.
DIGEST_SQL = """
with d as (
  select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)
), first as (
  select h, min(doc_id) as least from windows group by h
), gone as (
  select distinct doc_id, i + k as p from (select doc_id, i, unnest(range(0, 50)) as k from windows join first using (h) where least < doc_id)
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)
"""
