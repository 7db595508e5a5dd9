from pyspark.sql import functions as F

from lattica.llm import mixing, queries


def test_totals_meet_the_targets(spark):
    data = "/root/testdata/sf0.01"
    rows = queries.op1_source_mixing(spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.n_tokens == len(docs[r.doc_id].text.split()) and r.rate >= 0 and abs(sum(r.posterior) - 1) < 0.01 for r in rows)
    assert sum(r.domain == docs[r.doc_id].lang for r in rows) > 0.97 * len(rows)
    total, names = sum(r.n_tokens for r in rows), sorted(queries.MIX_TARGETS)
    for k, name in enumerate(names):
        share = sum(r.n_tokens * r.posterior[k] * r.rate for r in rows) / total
        assert abs(share - queries.MIX_TARGETS[name]) < 0.002, (name, share)


def test_nothing_is_lost_when_no_domain_may_shrink(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rates = mixing.mix(df, df, {"en": 0.4, "de": 0.4, "fr": 0.1, "es": 0.1}, lowest=1.0, shrink=False)
    out = mixing.drawn(df, rates)
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == df.count()
    tokens = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    whole = sum(tokens.values())
    assert all(abs(tokens[k] / whole - w) < 0.06 for k, w in {"en": 0.4, "de": 0.4, "fr": 0.1, "es": 0.1}.items())


def test_odd_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat", "en"), ("der hund", "de")] * 5)]
    rows += [(50, None, None), (51, "", "en"), (52, "the " * 50_000, None), (0, "the cat", "en"), (0, "another", None), (None, " the  dog ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit(7)).withColumn("k", F.lit(1))
    got = mixing.mix(df, df, {"en": 0.5, "de": 0.5})
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got.collect()) == sorted((k if k is not None else -1, len((t or "").split())) for k, t, _ in rows)
    assert {r.doc_id: r.domain for r in got.collect()}[52] == "en"
    assert mixing.mix(df.filter("false"), df, 1.0).count() == 0
    assert {r.rate for r in mixing.mix(df, df.filter("false"), 1.0).collect()} == {1.0}


def test_the_plan_is_native(spark, data):
    plan = queries.op1_source_mixing(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def skewed(spark, shares, n=2000):
    """Documents of ten words each, of which the domain's own share is the given one, known for certain."""
    rows = [([1000 * (k == j) for j in range(len(shares))], 10) for k, s in enumerate(shares) for _ in range(round(s * n))]
    return spark.createDataFrame(rows, "posterior array<int>, n_tokens long")


def reached(found, steps, lowest, many):
    from pyspark.sql import functions as F

    whole = found.agg(F.sum("n_tokens")).first()[0]
    m = F.col("n_tokens") * mixing.rate_of("posterior", steps, lowest)
    return [x / whole for x in found.agg(*[F.sum(m * F.col("posterior")[k] / 1000) for k in range(many)]).first()]


def test_scarce_domains_meet_their_targets(spark):
    names, aim = ["a", "b", "c", "d"], {"a": 0.4, "b": 0.25, "c": 0.2, "d": 0.15}
    for shares in ((0.9, 0.07, 0.02, 0.01), (0.7, 0.2, 0.08, 0.02)):
        found = skewed(spark, shares)
        domains = list(zip(names, shares, strict=True))
        steps, targets = mixing.fit_rates(found, domains, aim)
        assert targets == aim
        assert all(abs(a - aim[d]) < 2e-4 for a, d in zip(reached(found, steps, 0.0, 4), names, strict=True))
        steps, targets = mixing.fit_rates(found, domains, 0.7, lowest=1.0, shrink=False)
        assert all(abs(a - targets[d]) < 2e-4 for a, d in zip(reached(found, steps, 1.0, 4), names, strict=True))


def test_what_no_rates_reach_is_reported(spark):
    import pytest

    found = skewed(spark, (0.9, 0.1))
    with pytest.warns(UserWarning, match="misses its own by 0.4"):
        steps, _ = mixing.fit_rates(found, [("a", 0.9), ("b", 0.1)], {"a": 0.5, "b": 0.5}, lowest=1.0)
    assert [round(x, 3) for x in reached(found, steps, 1.0, 2)] == [0.9, 0.5]


def test_every_label_is_a_domain(spark):
    names = [f"d{k:02}" for k in range(70)]
    df = spark.createDataFrame([(k, f"{names[k % 70]} own{names[k % 70]}", names[k % 70]) for k in range(280)], "doc_id long, text string, lang string")
    domains, table = mixing.classifier(df, "text", "lang", "doc_id")
    assert [d for d, _ in domains] == names and table.count() == 140
    found = spark.createDataFrame([([1000 * (k == j) for j in range(70)], 2) for k in range(70)], "posterior array<int>, n_tokens long")
    aim = {d: (2 if d == "d69" else 1) / 71 for d in names}
    steps, targets = mixing.fit_rates(found, domains, aim)
    assert abs(reached(found, steps, 0.0, 70)[69] - aim["d69"]) < 2e-4 and targets == aim
