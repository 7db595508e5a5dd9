from brute_force import slow_components, slow_fingerprint, slow_repeats
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from lattica.llm import queries


def test_every_stage_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    columns = docs.columns
    good = spark.createDataFrame(p.keep_good(spark, docs, data).collect(), docs.schema)
    ids = {r.doc_id for r in good.collect()}
    wrong = [k for k, q in labels.items() if (k in ids) != bool(q)]
    assert good.columns == columns and len(wrong) <= 0.1 * len(labels)
    apart = spark.createDataFrame(p.drop_near_copies(spark, good, data).collect(), docs.schema)
    name = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in good.collect()])
    assert {r.doc_id for r in apart.collect()} == set(name.values()) and apart.columns == columns
    cut = spark.createDataFrame(p.drop_repeats(spark, apart, data).collect(), docs.schema)
    want = slow_repeats([(r.doc_id, r.text) for r in apart.collect()])
    own = {r.doc_id: r for r in apart.collect()}
    assert {r.doc_id: len(r.text.encode().split()) for r in cut.collect()} == {k: n - m for k, (n, m, _) in want.items()}
    assert all(r.text == own[r.doc_id].text or want[r.doc_id][1] for r in cut.collect()) and cut.columns == columns
    mixed = spark.createDataFrame(p.mix(spark, cut, data).collect(), docs.schema)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in cut.collect()} and mixed.columns == columns
    theirs = Tokenizer.from_file(queries.tokenizer_path())
    out = p.encode(spark, mixed, data).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == mixed.count() and all(r.same and r.n_tokens == len(r.ids) for r in out)
    assert all(list(r.ids) == theirs.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)
    assert p.run(spark, data).count() == len(out)


ODD = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n ", "de", None, 3), (4, "good plain words " * 30, "en", "b", 510), (4, "good plain words " * 30, "en", "b", 510), (4, "something else here", "en", "b", 19)]
ODD += [(None, "no id " * 60, "en", "c", 360), (None, None, None, None, None), (5, "good plain words " * 30 + "and a tail of its own", "en", "b", 530), (6, "der hund und die katze " * 20_000, "de", "a", 460_000), (7, "der hund " * 3, "de", "a", 27)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like what the stages make."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "kept", "__rate", "__copy", "__key", "score", "fp", "component_id", "n_removed", "rate", "key", "hashes"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.mark.parametrize("name, stage", p.STAGES, ids=[n for n, _ in p.STAGES])
def test_stages_on_odd_rows(spark, data, odd, name, stage):
    out = stage(spark, odd, data)
    rows, empty = out.collect(), stage(spark, odd.filter("false"), data)
    assert empty.count() == 0 and empty.columns == out.columns
    ids = sorted(str(r.doc_id) for r in rows)
    before = sorted(str(r[0]) for r in ODD)
    if name != p.STAGES[-1][0]:
        assert out.columns == odd.columns and all(r.row == "own row" and r.__getitem__("__rate") == "own __rate" for r in rows)
    if name == "quality classifier":
        assert set(ids) <= set(before)
    elif name == "SimHash near-dedup":  # all empty texts are one group, whose smallest id stays; rows without an id stay
        assert "1" in ids and "2" not in ids and "3" not in ids and ids.count("None") == 2
    elif name == "substring dedup":
        assert ids == before
        by = {r.doc_id: r for r in rows if r.doc_id in (1, 5, 6)}
        assert by[1].text is None and by[5].text.endswith("and a tail of its own") and len(by[5].text) < 530 and by[6].text.startswith("der hund")
    elif name == "mixing":
        assert set(ids) == set(before) and all(ids.count(x) >= before.count(x) for x in before)
    else:
        assert ids == before and all(r.same for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
