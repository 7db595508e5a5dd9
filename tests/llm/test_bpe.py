import hashlib

from tokenizers import Tokenizer

from lattica.llm import bpe, queries

TEXTS = [None, "", " ", "  \n\n\t x", "Hello world's <|endoftext|>'ll 123 été 😀", "a" * 3000, "aaaaabaaab" * 50, "՘Ᲊ࢏ ½²³", "<|endoftext|><|endoftext|> tail", "ein Wörterbuch", "ein Wörterbuch"]


def test_ids_and_texts_are_the_librarys():
    path = queries.tokenizer_path()
    own, theirs = bpe.Vocabulary(path), Tokenizer.from_file(path)
    for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert ids == theirs.encode(text or "", add_special_tokens=False).ids, text
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert own.decode([220, 136, 50256]) == theirs.decode([220, 136, 50256], skip_special_tokens=False)


def test_query_over_whole_texts(spark, data):
    theirs = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in queries.op2_bpe_codec(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_and_empty_tables(spark):
    path = queries.tokenizer_path()
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None)], "doc_id long, text string, ids string")
    ids = bpe.encode(df, path)
    assert sorted((r.doc_id, r.text) for r in bpe.decode(ids, path).collect()) == [(1, "a b"), (1, "a b"), (2, "")]
    assert bpe.encode(df.filter("false"), path).count() == 0


def test_very_long_texts():
    path = queries.tokenizer_path()
    own, theirs = bpe.Vocabulary(path), Tokenizer.from_file(path)
    for text in ("the quick brown fox 12345 " * 20_000, "ab" * 40_000, "\U0001f600 é" * 20_000):
        (ids,) = own.encode([text])
        assert ids == theirs.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_copies_in_a_slice(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", None, "a b", "", "c", "c", None])], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.same) for r in bpe.encode_checked(df, queries.tokenizer_path()).collect()}
    assert got[0] == got[2] and got[1] == got[3] == got[6] == (0, [], True) and got[4] == got[5] and got[0][0] == 2
