"""Near-duplicate documents by SimHash fingerprints, searched with pivot distance tables.

Every distinct fingerprint is written into fifteen bins: cut into six runs of bits, two fingerprints that differ in at
most four bits agree on two whole runs, so each such pair meets in a bin. Within a bin the distances to the reference
fingerprints (pivots) form a table; a pair whose distances to any one pivot differ by more than four can't be within
four bits of each other, so a bin sorted by the first pivot is compared only in a window, what the other pivots rule
out is discarded, and only survivors are verified. Bins hand on a spanning forest of their links, never all pairs. A
bin of more than ``BIN_ROWS`` fingerprints is split into parts, every two of which meet once.

Pivots alone couldn't replace the bins: distances to a random reference differ by at most four for over half of all
pairs of unrelated fingerprints, so comparisons would still grow with the square of the input.

Words are the runs of anything but ASCII white space, A-Z in lower case. Texts with fewer words than a shingle are one
shingle; null texts and texts without words have fingerprint zero and link like any other. Repeated rows share a
component. The smallest id of the component is its name; null ids are members but never names. Other columns are
ignored; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_counted, lean, map_slices, materialise, words_of
from .components import connected, local_roots

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Lengths of the runs of bits; MAX_BITS + 2 runs, any two of which make a bin.
RUNS = (11, 11, 11, 11, 10, 10)
PIVOTS = np.random.default_rng(11).integers(0, 2**64, 16, np.uint64)
#: Fingerprints of a bin that one part may hold.
BIN_ROWS = 32_768
#: Bins up to this size are compared offset by offset, all at once; rows gathered before bins are worked on.
SMALL, GATHER = 64, 100_000


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row; fp holds the 64 bits as a signed long."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {key: rows[key], "fp": np.array([fingerprint(t) for t in rows[text]], np.uint64).view(np.int64)}

    return map_slices(df, f"`{key}` {kind}, fp long", work, [key, text])


def bins(fp: str = "fp") -> F.Column:
    """The keys of the bins of a fingerprint: which two runs of bits, and what they hold."""
    parts, at = [], 0
    for size in RUNS:
        parts.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << size) - 1)))
        at += size
    return F.array(*[F.lit(k << 24).cast("long") + F.shiftleft(parts[i], 11) + parts[j] for k, (i, j) in enumerate(combinations(range(len(RUNS)), 2))])


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances for each pivot."""
    return np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int16)


def _survive(table: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the pairs that no pivot rules out and whose distance is small."""
    at = np.arange(len(i))
    for row in table:
        at = at[np.abs(row[i[at]] - row[j[at]]) <= max_bits]
    return at[np.bitwise_count(fp[i[at]] ^ fp[j[at]]) <= max_bits]


def _forest(fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that span the components of one large bin: each node found is compared only with those not yet found."""
    order = np.argsort(table[0], kind="stable")
    left, a, b = order, [], []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            first = table[0][left]
            low, high = np.searchsorted(first, table[0][x] - max_bits, "left"), np.searchsorted(first, table[0][x] + max_bits, "right")
            near = left[low:high]
            found = near[_survive(table, fp, np.full(len(near), x), near, max_bits)]
            if len(found):
                a += [x] * len(found)
                b += found.tolist()
                todo += found.tolist()
                left = left[~np.isin(left, found)]
    return a, b


def bin_links(bin_of: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of the links within bins; rows come sorted by bin."""
    table = distances(fp)
    edge = np.flatnonzero(np.diff(bin_of)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
    sizes = np.repeat(end - start, end - start)
    last = np.repeat(end, end - start)
    a, b = [], []
    at = np.flatnonzero(sizes <= SMALL)
    for step in range(1, SMALL):
        at = at[at + step < last[at]]
        if not len(at):
            break
        kept = at[_survive(table, fp, at, at + step, max_bits)]
        a.append(kept)
        b.append(kept + step)
    for s, e in zip(start, end, strict=True):
        if e - s > SMALL:
            x, y = _forest(fp[s:e], table[:, s:e], max_bits)
            a.append(np.array(x, np.int64) + s)
            b.append(np.array(y, np.int64) + s)
    if not a:
        return fp[:0], fp[:0]
    nodes, number = np.unique(fp, return_inverse=True)
    root = local_roots(len(nodes), number[np.concatenate(a)], number[np.concatenate(b)])
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within ``max_bits`` bits."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the bins find pairs within {MAX_BITS} bits")
    rows = distinct.select("fp", F.explode(bins()).alias("bin"))
    large = rows.groupBy("bin").count().filter(F.col("count") > bin_rows).select("bin", F.ceil(F.col("count") / bin_rows).cast("int").alias("parts"))
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:  # every two parts of a large bin meet in a bin of their own
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own).cast("long") * 1_000_000 + F.greatest(x, own) + 1)
        rows = rows.join(large, "bin", "left").select("fp", "bin", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("long")))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table, end: int) -> pa.RecordBatch:
            t = t.slice(0, end)
            key, part, fp = (t.column(c).to_numpy() for c in ("bin", "part", "fp"))
            number = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(part) != 0))])
            a, b = bin_links(number, fp.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= GATHER:
                t = pa.Table.from_batches(held)
                key, part = t.column("bin").to_numpy(), t.column("part").to_numpy()
                end = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
                if end:
                    yield work(t, end)
                    held = t.slice(end).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield work(t, t.num_rows)

    dealt = rows.select("bin", "part", "fp").repartition("bin", "part").sortWithinPartitions("bin", "part")
    return dealt.mapInArrow(lean(run), "a long, b long")


def cluster(df: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id) for every row. Neither the copies of a text nor the fingerprints of a component gather
    in one task."""
    own = materialise(fingerprints(df, text, key))
    distinct = materialise(own.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    roots = connected(links(distinct, max_bits))
    rooted = materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    names = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    named = materialise(join_counted(rooted.select("fp", "n", "root"), names, "root", "m").select("fp", "n", "component_id"))
    drop(rooted, names, distinct)
    return join_counted(own, named, "fp").select(key, "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
