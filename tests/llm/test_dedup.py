import hashlib
import random

import numpy as np
from brute_force import slow_components, slow_fingerprint, slow_repeats

from lattica.llm import components, queries, simhash, substring


def test_simhash_query_against_all_pairs(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    fps = [(k, slow_fingerprint(t)) for k, t in docs]
    want = slow_components(fps)
    got = queries.op7_simhash_dedup(spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{f:016x}", want[k]) for k, f in fps}


def test_links_of_dense_bins_and_their_parts(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)}
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    want = slow_components(list(enumerate(fps)))
    df = spark.createDataFrame([(f, k) for k, f in rows], "fp long, least long")
    for bin_rows in (100, simhash.BIN_ROWS):
        roots = {r.node: r.root for r in components.connected(simhash.links(df, bin_rows=bin_rows)).collect()}
        groups = {}
        for k, f in rows:
            groups.setdefault(roots.get(f, f), []).append(k)
        assert {k: min(g) for g in groups.values() for k in g} == want


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (5, "One two", 2), (5, "One two", 2), (6, "one TWO", 3), (None, "one two", 4), (9, "x " * 100_000, 4)], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.cluster(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (5, 5), (5, 5), (6, 5), (None, 5), (9, 9)], key=str)
    assert simhash.cluster(df.filter("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100)] + [(1000, k) for k in range(2000, 2100)] + [(7, 7), (3, 4)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(101)} | {k: 1000 for k in [1000, *range(2000, 2100)]}


def test_substring_query_against_all_windows(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op8_substring_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == slow_repeats(docs)
    assert sum(r.n_removed for r in got) > 0


def test_substring_planted_and_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    text = lambda n: " ".join(word() for _ in range(n))
    p = [text(n) for n in (49, 50, 51, 74, 130)]
    docs = [(k, " \n".join(rng.sample(p, rng.randrange(4)) + [text(rng.randrange(120))])) for k in range(60)]
    docs += [(100, None), (101, ""), (102, p[1]), (103, p[0]), (104, "ab " * 500), (105, "ab " * 300), (106, "é\x85 " * 60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(df).collect()}
    assert got == slow_repeats(docs)
    for bits in (1, 3):  # nearly all windows collide in the first hash
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(df, bits=bits).collect()}
        assert got == slow_repeats(docs)
    again = substring.remove_repeats(spark.createDataFrame([(1, p[4]), (1, p[4]), (None, p[4])], "doc_id long, text string")).collect()
    assert [r.n_removed for r in again] == [0, 0, 0]
    assert substring.remove_repeats(df.filter("false")).count() == 0


def test_windows_that_collide_in_one_hash():
    h = np.array([[1, 5], [1, 4], [1, 5], [2, 4], [1, 5]], np.uint64)
    doc = np.array([3, 1, 2, 0, 2])
    assert substring.different(h).tolist() == [[1, 4], [1, 5], [2, 4]]
    sorted_, docs = substring.ordered(h, doc)
    assert list(zip(map(tuple, sorted_.tolist()), docs.tolist(), substring.repeated(sorted_, docs).tolist())) == [((1, 4), 1, False), ((1, 5), 2, False), ((1, 5), 2, False), ((1, 5), 3, True), ((2, 4), 0, False)]
    assert substring.among(h, substring.different(h[[0, 3]])).tolist() == [True, False, True, True, True]
    assert substring.among(h, h[:0]).tolist() == [False] * 5


def test_rows_without_ids_and_boxes(spark, monkeypatch):
    """Boxes and parts that grow with the words, rows without ids, and whole rows beside what is found."""
    monkeypatch.setattr(substring, "BOX_WORDS", 50)
    monkeypatch.setattr(substring, "PART_WORDS", 700)
    rng = random.Random(4)
    shared = [" ".join("".join(rng.choices("abcd", k=5)) for _ in range(60)) for _ in range(5)]
    docs = [(k if k % 3 else None, f"{shared[k % 5]} own{k} {shared[(k + k // 5) % 5]}", "x") for k in range(45)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string")
    got = substring.remove_repeats(df, row=True).collect()
    want = slow_repeats([(k, t) for k, t, _ in docs if k is not None])
    assert len(got) == len(docs) and all(r.row.text in {t for k, t, _ in docs if k == r.doc_id} and r.row.row == "x" for r in got)
    assert all((r.n_removed, r.kept) == (0, " ".join(r.row.text.split())) for r in got if r.doc_id is None)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got if r.doc_id is not None} == want
