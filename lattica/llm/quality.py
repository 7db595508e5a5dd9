"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Every word, a run of anything but ASCII white space, has an entry for itself (in lower case, without signs at its ends)
and one for its shape, both by hash; a word like the one before it has the shape of a repetition. Each entry has a
fixed sparse random index vector; the vector of an entry is the sum of the index vectors of the entries of its kind
around all its occurrences in all documents. A document is the mean of the unit vectors of its words, and of their
shapes. The network learns on a bounded sample of labelled rows; a temperature fitted on rows it didn't learn from
calibrates its probabilities.

Null and empty texts pool to zeros and are scored like any other. Repeated labels of one document count as their mean,
rounded (a tie is 1); null labels and null ids teach nothing. Repeated rows are documents each, scored alike. Without
labels, or on an empty table, every score is 0.5 and an empty table gives no rows. Whole texts count, in stretches that
overlap; other columns, whatever their names, are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashes, lean, map_slices, small_batches, words_of

#: Entries for tokens and for shapes, numbers in a vector, signs set in an index vector, tokens to either side.
TOKENS, SHAPES, SIZE, SIGNS, REACH = 1 << 14, 1 << 11, 64, 2, 2
ENTRIES = TOKENS + SHAPES
#: The entry of the shape of words that repeat the word before.
AGAIN = ENTRIES - 1
#: Labelled rows, about, that the network learns from.
LABELLED_ROWS = 5000
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-3
#: Rows of the table of vectors that travel together.
CHUNK = ENTRIES // 64
#: Words handled at a time, which bounds memory for very long texts; words after which a task hands on its sums, which
#: then fit 32 bits (a word adds less than 16 to any of them).
STRETCH, MOST_WORDS = 1 << 17, 1 << 26
#: Signs cut from the ends of words; what stands for a capital, a small letter (or any other byte above 127), a digit.
SIGNS_AT_ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
KINDS = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c > 127 else 57 if 48 <= c <= 57 else c for c in range(256))
REPEATED = re.compile(rb"(.)\1{2,}", re.DOTALL)


def shape_of(word: bytes) -> bytes:
    return REPEATED.sub(rb"\1\1+", word.translate(KINDS))


def entries_of(word: bytes) -> int:
    """Both entries of a word in one number."""
    at = zlib.crc32(word.lower().strip(SIGNS_AT_ENDS) or word) % TOKENS
    return at << 32 | TOKENS + zlib.crc32(shape_of(word)) % (SHAPES - 1)


_known = Hashes(entries_of)


def entries(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The word entry and the shape entry of each word; a word like the one before it has a shape of its own."""
    both = _known.array(words_of(text))
    shapes = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    shapes[1:][both[1:] == both[:-1]] = AGAIN
    return (both >> np.uint64(32)).astype(np.int64), shapes


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each entry's index vector."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((ENTRIES, SIZE)), axis=1)[:, :SIGNS], rng.choice([-1.0, 1.0], (ENTRIES, SIGNS))


def contexts(tokens: np.ndarray, shapes: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray, total: np.ndarray, first: int) -> None:
    """Adds to ``total`` (entries x size) what stands around each token of the same document: all pairs whose earlier
    token is one of the ``first``."""
    flat, weight = [], []
    for step in range(1, REACH + 1):
        same = np.flatnonzero(doc[step:][:first] == doc[:-step][:first])
        for here, there in ((same, same + step), (same + step, same)):
            for kind in (tokens, shapes):
                own, near = kind[here] * SIZE, kind[there]
                for k in range(SIGNS):
                    flat.append(own + places[near, k])
                    weight.append(signs[near, k])
    if flat:
        total += np.bincount(np.concatenate(flat), np.concatenate(weight), minlength=total.size)


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all entries, from all rows. Tasks add up their own texts, chunks of the table are added up
    across tasks as they arrive, and the driver gets the table, whose size is fixed. Sums are whole numbers, so they
    don't depend on how rows are dealt to tasks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, held, size, added = np.zeros(ENTRIES * SIZE), [], 0, 0

        def add() -> None:
            if held:
                tokens, shapes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                doc = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
                for at in range(0, len(doc), STRETCH):
                    part = slice(at, at + STRETCH + REACH)  # pairs may end in the next stretch
                    contexts(tokens[part], shapes[part], doc[part], places, signs, total, STRETCH)
                held.clear()

        def table() -> pa.RecordBatch:
            rows = total.astype(np.int32).reshape(-1, CHUNK * SIZE)
            return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["chunk", "sums"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    held.append(entries(t))
                    size += len(held[-1][0])
                    if size >= STRETCH:
                        add()
                        size, added = 0, added + size
                        if added >= MOST_WORDS:
                            yield table()
                            total[:], added = 0, 0
        add()
        if total.any():
            yield table()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_py(), np.int32).astype(np.int64)
                total[c] = total[c] + x if (c := batch.column(0)[k].as_py()) in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "sums"])

    schema = "chunk int, sums binary"
    sums = small_batches(df).select(F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(lean(gather), schema)
    out = np.zeros((ENTRIES // CHUNK, CHUNK * SIZE))
    for r in sums.repartition(ENTRIES // CHUNK // 4, "chunk").mapInArrow(lean(add_up), schema).collect():
        out[r.chunk] = np.frombuffer(r.sums, np.int64)
    out = out.reshape(ENTRIES, SIZE)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Means of the token vectors and of the shape vectors."""
    out = np.zeros(2 * SIZE)
    tokens, shapes = entries(text)
    if len(tokens):
        for half, at in enumerate((tokens, shapes)):
            n = np.bincount(at - half * TOKENS, minlength=1)
            used = np.flatnonzero(n)
            out[half * SIZE : (half + 1) * SIZE] = n[used] @ vectors[used + half * TOKENS] / len(at)
    return out


class Network:
    """One hidden layer of rectifiers on standardised numbers, a logit out."""

    def __init__(self, width: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.w = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        """Full-batch gradient steps with moment estimates, on four fifths; the rest calibrates."""
        kept = np.arange(len(y)) % 5 == 4
        if kept.all() or not kept.any():
            kept = np.zeros(len(y), bool)
        a, b = x[~kept], y[~kept]
        self.mean, self.scale = a.mean(0), a.std(0) + 1e-6
        a = (a - self.mean) / self.scale
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, EPOCHS + 1):
            h = np.maximum(a @ self.w[0] + self.w[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -500, 500))) - b) / len(b)
            dh = np.outer(d, self.w[2]) * (h > 0)
            for k, g in enumerate((a.T @ dh + DECAY * self.w[0], dh.sum(0), h.T @ d + DECAY * self.w[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if kept.any():
            z, t = self.logits(x[kept]), y[kept]
            grid = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
            self.temperature = float(min(grid, key=lambda q: np.logaddexp(0, np.where(t > 0, -z, z) / q).mean()))


def fit(df: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = LABELLED_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all rows of ``df``; the network from about ``rows`` of the labelled ones where
    ``learn_from`` (over ``key``) holds, chosen by a hash of the key."""
    vectors = word_vectors(df, text)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learn_from).groupBy(key).agg((F.avg(label) >= 0.5).cast("double").alias("__y"))
    n = known.count()
    if not n:
        return vectors, None
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    chosen = known.filter(draw < rows / n)  # about `rows` small rows whatever the table's size
    some = df.select(F.col(key), F.col(text)).join(F.broadcast(chosen), key)
    sent = df.sparkSession.sparkContext.broadcast(vectors)

    def work(part: dict[str, list]) -> dict[str, list]:
        return {"k": part["__k"], "h": part["__h"], "y": part["__y"], "x": [pooled(t, sent.value) for t in part["__text"]]}

    shown = some.select(F.col(key).cast("string").alias("__k"), F.xxhash64(text).alias("__h"), "__y", F.col(text).alias("__text"))
    got = map_slices(shown, "k string, h long, y double, x array<double>", work, ["__k", "__h", "__y", "__text"])
    found = got.toPandas().sort_values(["k", "h"], kind="stable")
    if not len(found):
        return vectors, None
    net = Network(2 * SIZE)
    net.learn(np.stack(found.x.to_numpy()), found.y.to_numpy())
    return vectors, net


def score(df: DataFrame, model: tuple[np.ndarray, Network | None], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        vectors, net = sent.value
        if net is None:
            return {key: rows[key], "score": [0.5] * len(rows[key])}
        return {key: rows[key], "score": net.score(np.array([pooled(t, vectors) for t in rows[text]])).tolist()}

    return map_slices(df, f"`{key}` {kind}, score double", work, [key, text])


def keep_good(df: DataFrame, model: tuple[np.ndarray, Network | None], least: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is ``least`` or more, all their columns; everything stays if nothing was learned."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if net is not None:
                    x = np.array([pooled(t, vectors) for t in part.column(at).to_pylist()])
                    part = part.filter(pa.array(net.score(x) >= least))
                yield part

    return small_batches(df).mapInArrow(lean(run), df.schema)
