import zlib

from pyspark.sql import functions as F

from lattica.llm import langid, quality, queries


def outside(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_rows_not_learned_from(spark):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, data).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == outside(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    df = spark.createDataFrame([*rows, (100, None, "en"), (101, "", None), (102, " 12 !", None), (103, "the dog " * 200_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, F.lit(True)).collect()}
    assert [got[k].lang_pred for k in (0, 1, 100, 101, 102, 103)] == ["en", "de", "und", "und", "und", "en"]
    assert langid.identify(df.filter("false"), F.lit(True)).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_quality_of_rows_not_learned_from(spark):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = queries.op10_quality_classifier(spark, data).collect()
    assert all(r.held_out == outside(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held), held


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 300_000, 3), (4, "word word", None), (4, "word word", None)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (3, None), (4, 0), (4, 1), (9, 1)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels, F.lit(True))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.score(df, quality.fit(df, labels.filter("false"), F.lit(True))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(df.filter("false"), quality.fit(df.filter("false"), labels, F.lit(True))).count() == 0


def test_every_language_is_learned(spark):
    texts = {f"l{k:03}": "".join(chr(0x4E00 + 30 * k + i) for i in range(30)) for k in range(203)}
    df = spark.createDataFrame([(10 * k + i, t, name) for k, (name, t) in enumerate(texts.items()) for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == sorted(texts)
    assert model.predict(texts["l202"])[0] == "l202"


def test_clashing_names_and_repeated_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 12)]
    rows += [rows[0], rows[0], (None, "the dog", None), (None, "der hund", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("lang_pred", "score", "draw", "label", "at", "x", "__y", "__k", "held_out"):
        df = df.withColumn(name, F.lit(1))
    got = langid.identify(df, F.lit(True)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.lang_pred) for r in got if r.doc_id is None} == {(None, "en"), (None, "de")}
    labels = spark.createDataFrame([(k, k % 2, 5) for k in range(24)] + [(None, 1, 5)], "doc_id long, quality int, __y int")
    scored = quality.score(df, quality.fit(df, labels, F.lit(True))).collect()
    assert len(scored) == len(rows) and len({round(r.score, 12) for r in scored if r.doc_id == 0}) == 1
    assert {r.held_out for r in df.select(queries.held_out().alias("held_out")).collect()} == {True, False}
