"""Language identification: multinomial logistic regression over TF-IDF weighted character n-grams.

N-grams of one to three code points of the lower-cased text are hashed to ``DIMENSIONS`` columns. Document
frequencies count every row with a text and a label. The weights are learned on a bounded sample of rows by the
follow-the-regularised-leader rule with an elastic-net penalty, which leaves most of them exactly zero; a temperature
fitted on rows kept out of the sample's learning part calibrates the probabilities.

A null text, or one without a letter, is ``und`` with score 0. Without any labelled row every text is. Ties go to the
alphabetically first language. Repeated rows count, and are predicted, each; an empty table gives no rows. Whole texts
count; other columns, whatever their names, are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, map_slices, small_batches

DIMENSIONS = 1 << 15
#: Rows of each language, about, that the weights are learned from.
ROWS_PER_LANGUAGE = 900
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 4
LETTER = regex.compile(r"\p{L}")
#: Code points handled at a time, which bounds memory for very long texts.
STRETCH = 1 << 18


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(points), STRETCH):
        x = points[at : at + STRETCH + 2]
        n = min(STRETCH, len(points) - at)
        grams = x
        for width in (1, 2, 3):
            if width > 1:
                grams = grams[: len(x) - width + 1] * np.uint64(0x9E3779B97F4A7C15) + x[width - 1 :]
            mixed = (grams[:n] + np.uint64(width)) * np.uint64(0xD6E8FEB86659FD93)
            out += np.bincount((mixed >> np.uint64(64 - 15)).astype(np.int64), minlength=DIMENSIONS)
    return out


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and unit-length TF-IDF values."""
    n = counts(text)
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each n-gram, and documents, over all rows; no more than DIMENSIONS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    total += counts(t) > 0
                    rows += 1
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(total[at[:-1]], rows), pa.int64())], names=["gram", "n"])

    found = small_batches(df).select(F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out, rows = np.zeros(DIMENSIONS, np.int64), int(found.n[found.gram < 0].sum())
    found = found[found.gram >= 0]
    out[found.gram.to_numpy()] = found.n.to_numpy()
    return out, rows


class Model:
    """Languages, inverse document frequencies, weights (dimensions x languages), biases and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*features(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, coordinate by coordinate, over the rows in the order given."""
    z, n = np.zeros((DIMENSIONS + 1, languages)), np.zeros((DIMENSIONS + 1, languages))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, x, label in rows:
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from the rows of ``df``; those that teach weights are chosen by a hash of ``key``."""
    labelled = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    frequency, n = document_frequencies(labelled, text)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    shares = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows_per_language / sizes[name]))])
    share = F.element_at(shares, F.col(label))
    number = {name: k for k, name in enumerate(languages)}

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = [features(t, idf) for t in rows["text"]]
        return {"draw": rows["draw"], "label": [number[x] for x in rows["label"]], "at": [a.astype(np.int32) for a, _ in found], "x": [x.astype(np.float32) for _, x in found]}

    drawn = labelled.filter(draw < share).select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(F.lit("order"), F.col(key).cast("string")).alias("draw"))
    got = map_slices(drawn, "draw long, label int, at array<int>, x array<float>", work, ["text", "label", "draw"]).toPandas()
    got = got.sort_values(["draw", "label"], kind="stable")
    rows = list(zip((np.asarray(a) for a in got["at"]), (np.asarray(x, np.float64) for x in got["x"]), got["label"], strict=True))
    kept = [r for k, r in enumerate(rows) if k % 5 == 4]
    model = Model(languages, idf, *learn_weights([r for k, r in enumerate(rows) if k % 5 != 4] or rows, len(languages)))
    model.temperature = fit_temperature(np.array([model.logits(a, x) for a, x, _ in kept]), np.array([y for *_, y in kept], int))
    return model


def predict(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = [sent.value.predict(t) for t in rows[text]]
        return {key: rows[key], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

    return map_slices(df, f"`{key}` {kind}, lang_pred string, score double", work, [key, text])


def identify(df: DataFrame, learn_from: Column, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score): fitted on the rows where ``learn_from`` holds, predicted for all."""
    return predict(df, fit(df.filter(learn_from), text, label, key), text, key)
