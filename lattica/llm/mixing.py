"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A naive Bayes classifier, learned from a labelled table, gives every document posteriors over the domains, in
thousandths. Rates r >= ``lowest`` then minimise the squared distance of sum(r x tokens x posterior), per domain, from
the targets; of all such rates they are those nearest 1. They are one projected gradient step from r = 1, whose scale
is found by Newton's method from the domains x domains moments until the totals meet the targets within
``TOLERANCE``; where no rates meet them, the least distance is kept and a warning gives what is left. Documents with
equal posteriors have equal rates, so this runs over the table of distinct posteriors and its token totals; only one
number per pair of domains reaches the driver. All of it over rows is DataFrame functions.

Words are the runs of anything but white space, in lower case; a document's tokens are its words. Null and empty texts
have none, and the domains' own shares as posteriors. Rows without a label don't teach. Repeated rows are documents
each. Without any labelled row there are no domains, and every rate is 1. Other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled rows, about, that the classifier is learned from; words in its table.
LABELLED_ROWS, VOCABULARY = 4_000, 1_500
#: Words that count towards a posterior at most, as a weight: longer texts are not surer than this many words.
EVIDENCE = 200.0
#: Most evaluations of the totals, after which what is left is reported; largest miss of a target, as a share of all
#: tokens; weights of the rates' distance from 1 against that of the totals from the targets, one after the other.
STEPS, TOLERANCE = 400, 1e-4
NEARNESS = (1e-4, 1e-5, 1e-6, 1e-7, 1e-8)


def words(text: str) -> Column:
    """The words of a text, after a null that marks the row itself; empty strings may stand at the ends."""
    return F.concat(F.array(F.lit(None).cast("string")), F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"))


def classifier(labelled: DataFrame, text: str, label: str, key: str, rows: int = LABELLED_ROWS, vocabulary: int = VOCABULARY) -> tuple[list[tuple[str, float]], DataFrame | None]:
    """The domains with their shares, and the table (word, lp): log probabilities of a word by domain."""
    known = labelled.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sizes = known.groupBy("label").count().collect()  # every label is a domain
    if not sizes:
        return [], None
    total = sum(r["count"] for r in sizes)
    domains = sorted((r["label"], r["count"] / total) for r in sizes)
    draw = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < rows / total)
    counted = some.select("label", F.explode(words("text")).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == d).alias(f"n{k}") for k, (d, _) in enumerate(domains)])
    top = materialise(counted.orderBy(F.desc("n"), "word").limit(vocabulary))
    sums = top.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(domains))]).first()
    lp = [F.log((F.col(f"n{k}") + 0.5) / (sums[k] + 0.5 * vocabulary)).alias(f"lp{k}") for k in range(len(domains))]
    return domains, materialise(top.select("word", *lp))


def posteriors(df: DataFrame, domains: list[tuple[str, float]], table: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_tokens, posterior) for every row: posterior in thousandths, ints in the order of the domains."""
    many = range(len(domains))
    each = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.explode(words(text)).alias("word"))
    met = each.join(F.broadcast(table), "word", "left")  # no more rows than the vocabulary has
    sums = met.groupBy("k", "h").agg(
        F.count_if(F.col("word").isNull()).alias("times"), F.count_if(F.col("word") != "").alias("n"), F.count("lp0").alias("seen"), *[F.coalesce(F.sum(f"lp{j}"), F.lit(0.0)).alias(f"s{j}") for j in many]
    )
    weight = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.col("seen"), F.lit(1)))
    scores = F.array(*[F.col(f"s{j}") * weight + math.log(domains[j][1]) for j in many])
    keyed = sums.select("k", "times", (F.col("n") / F.col("times")).cast("long").alias("n_tokens"), scores.alias("s"))
    keyed = keyed.select("k", "times", "n_tokens", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    keyed = keyed.withColumn("posterior", F.transform("e", lambda x: F.round(1000 * x / whole).cast("int")))
    each_row = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    return keyed.select(F.col("k").alias(key), "n_tokens", "posterior", each_row).drop("copy")


def rate_of(posterior: str, steps: list[list[float]], lowest: float) -> Column:
    """The rate after the gradient steps taken; every step holds one number per domain."""
    rate = F.lit(1.0)
    for g in steps:
        rate = F.greatest(F.lit(float(lowest)), rate - slope(posterior, g))
    return rate


def slope(posterior: str, step: list[float]) -> Column:
    return F.aggregate(F.zip_with(posterior, F.array(*map(F.lit, step)), lambda p, x: p * x / 1000.0), F.lit(0.0), lambda a, x: a + x)


def totals(cells: DataFrame, step: list[float], lowest: float) -> tuple[np.ndarray, np.ndarray, float]:
    """After a step: the domains' tokens, the moments of the posteriors whose rates aren't at the lowest, and the
    integral of the tokens over the step, less its sign."""
    many, most = len(step), 1.0 - lowest
    at = F.filter(F.transform("posterior", lambda p, i: F.struct(i.alias("i"), (p / 1000.0).alias("p"))), lambda x: x["p"] > 0)
    each = cells.select(F.col("n").cast("double").alias("n"), at.alias("at"), slope("posterior", step).alias("x"), rate_of("posterior", [step], lowest).alias("r"))
    integral = F.when(F.col("x") < most, F.col("x") * F.col("x") / 2 - F.col("x")).otherwise(-lowest * F.col("x") - most * most / 2)
    each = each.select("at", (F.col("n") * F.col("r")).alias("m"), F.when(F.col("x") < most, F.col("n")).otherwise(0.0).alias("free"), (F.col("n") * integral).alias("v"))
    entry = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.alias("v"))
    first = F.transform("at", lambda a: entry(a["i"], F.lit(-1), F.col("m") * a["p"]))
    second = F.flatten(F.transform("at", lambda a: F.transform("at", lambda b: entry(a["i"], b["i"], F.col("free") * a["p"] * b["p"]))))
    rows = each.select(F.explode(F.concat(first, second, F.array(entry(F.lit(-1), F.lit(-1), F.col("v"))))).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v"))
    now, moments, value = np.zeros(many), np.zeros((many, many)), 0.0
    for i, j, v in rows.collect():
        if i < 0:
            value = v
        elif j < 0:
            now[i] = v
        else:
            moments[i, j] = v
    return now, moments, value


def fit_rates(found: DataFrame, domains: list[tuple[str, float]], targets: dict[str, float] | float, lowest: float = 0.0, shrink: bool = True) -> tuple[list[list[float]], dict[str, float]]:
    """The gradient steps, and the targets as shares of all tokens.

    ``targets``: a weight for each domain, or a power: the domains' own shares to that power. ``shrink``: the total
    stays what it is; else it is the smallest one under which no domain has to lose tokens."""
    cells = materialise(found.groupBy("posterior").agg(F.sum("n_tokens").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [], {}
    none = [0.0] * len(domains)
    share = list(map(float, totals(cells, none, 0.0)[0] / total))
    weights = [max(0.0, targets.get(d, 0.0)) if isinstance(targets, dict) else s**targets for (d, _), s in zip(domains, share, strict=True)]
    weights = [w / (sum(weights) or 1.0) for w in weights]
    scale = 1.0 if shrink else max((s / w for s, w in zip(share, weights, strict=True) if w and s > 1e-3), default=1.0)
    aim = [w * scale for w in weights]
    step, left = newton(lambda g: tuple(x / total for x in totals(cells, g, lowest)), np.array(aim))
    if left >= TOLERANCE:
        warnings.warn(f"mixing: no rates of at least {lowest} were found that meet the targets; a domain's total misses its own by {left:.6f} of all tokens", stacklevel=2)
    return [step], {d: t for (d, _), t in zip(domains, aim, strict=True)}


def newton(evaluate: Callable[[list[float]], tuple[np.ndarray, np.ndarray, float]], aim: np.ndarray) -> tuple[list[float], float]:
    """The step after which the totals are ``aim``, or nearest to it, and the largest miss. The step minimises a convex
    function, quadratic in pieces, whose gradient is ``aim`` less the totals; steps of Newton's method are shortened
    until it falls."""
    step, used = np.zeros(len(aim)), 1
    now, moments, value = evaluate(step.tolist())
    best, reached = step, now
    for near in NEARNESS:
        while np.abs(now - aim).max() >= TOLERANCE and used < STEPS:
            slope_ = aim - now + near * step
            if np.abs(slope_).max() < TOLERANCE / 10:
                break
            way = -np.linalg.solve(moments + near * np.eye(len(aim)), slope_)
            size, before = 1.0, value + aim @ step + near / 2 * step @ step
            while True:
                new = step + size * way
                got, used = evaluate(new.tolist()), used + 1
                if got[2] + aim @ new + near / 2 * new @ new <= before + 1e-4 * size * (slope_ @ way) + 1e-12 or size < 1e-6 or used >= STEPS:
                    break
                size /= 4
            step, (now, moments, value) = new, got
            if np.linalg.norm(now - aim) < np.linalg.norm(reached - aim):
                best, reached = step, now
    return best.tolist(), float(np.abs(reached - aim).max())


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float] | float, text: str = "text", label: str = "lang", key: str = "doc_id", lowest: float = 0.0, shrink: bool = True) -> DataFrame:
    """(key, n_tokens, domain, posterior, rate) for every row; domain is the likeliest, the first of equals."""
    domains, table = classifier(labelled, text, label, key)
    if not domains:
        tokens = F.size(F.filter(words(text), lambda w: w != "")).cast("long")
        return df.select(key, tokens.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    found = materialise(posteriors(df, domains, table, text, key))
    steps, _ = fit_rates(found, domains, targets, lowest, shrink)
    names = F.array(*[F.lit(d) for d, _ in domains])
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    rated = found.select(key, "n_tokens", likeliest.alias("domain"), "posterior", rate_of("posterior", steps, lowest).alias("rate"))
    return rated.withColumn("posterior", F.transform("posterior", lambda p: p / 1000.0))


def drawn(df: DataFrame, rates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` as often as their rates say: the whole part always, one more by a hash of the key. Rates are
    hashed, so that texts are neither sorted nor held."""
    names = [f"{key}~{k}" for k in range(len(df.columns) + 3)]
    other, rate, copy = [n for n in names if n not in df.columns][:3]  # no names of the table's own
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    per = rates.groupBy(F.col(key).alias(other)).agg(F.avg("rate").alias(rate))
    r = F.coalesce(F.col(rate), F.lit(1.0))
    met = df.join(per.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(other)), "left")
    times = F.floor(r).cast("int") + (draw < r - F.floor(r)).cast("int")
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in df.columns])
