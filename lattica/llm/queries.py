"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, mixing, quality, simhash, substring, tiff, wrapper
from .common import held_out, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Domains are languages; their target weights as shares of all tokens.
MIX_LABEL, MIX_TARGETS = "lang", {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", MIX_LABEL)
    return mixing.mix(docs, docs, MIX_TARGETS, label=MIX_LABEL)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, sf_dir, "documents"), width=576, compression=tiff.DEFLATE, predictor=2, rows_per_strip=64)
    found = tiff.pages(stored, keep=("doc_id", "n_bytes"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


#: A conversation that holds control strings, beside those of the table.
PLANTED = ((-7, 0, "user"), (-7, 1, "assistant"))
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(len(PLANTED)).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text")
    )
    return chat.digests(chat.examples(own.unionByName(planted)))


OP6_SQL = chat.DIGEST_SQL.format(
    turns="select conv_id, turn, role, text from conversations union all "
    + " union all ".join(f"select {c}, {t}, '{r}', '{PLANTED_TEXT}'" for c, t, r in PLANTED)
)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_language_id": op3_language_id,
    "op4_anisotropic_ann": op4_anisotropic_ann,
    "op5_tiff_media": op5_tiff_media,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {"op4_anisotropic_ann": ann.EXACT_SQL, "op6_chat_formatting": OP6_SQL, "op8_substring_dedup": substring.DIGEST_SQL}
