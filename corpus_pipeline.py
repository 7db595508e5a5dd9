"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``docs``; a stage's decisions take effect on its rows or texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, quality, queries, simhash, substring
from lattica.llm.common import held_out, materialise, table

#: Documents that score less go.
LEAST_QUALITY = 0.3
#: Target weights of the languages: their own shares to this power; no language loses tokens.
MIX_POWER = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    return quality.keep_good(docs, model, LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id stays. Rows without an id stay, and
    so do rows that repeat the id that stays."""
    found = simhash.cluster(docs.select("doc_id", "text"))
    gone = materialise(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a smaller document's windows cover; what stays is joined by one space. Texts without repeats
    stay as they are. No document goes."""
    found = substring.remove_repeats(docs, row=True)
    changed = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages short of tokens are repeated until their shares are those of the targets; no document goes."""
    rates = mixing.mix(docs.select("doc_id", "text", "lang"), docs, MIX_POWER, lowest=1.0, shrink=False)
    return mixing.drawn(docs, rates)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, same): the ids of every text, and whether they decode to it."""
    return bpe.encode_checked(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing", mix),
    ("BPE encoding and decoding", encode),
]
#: No SQL expresses the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
