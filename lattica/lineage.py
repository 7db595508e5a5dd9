"""Cutting lineage by tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later plans start from files, so they neither recompute it nor draw random
    numbers or ids anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    void = {f.name: f.dataType for f in df.schema if f.dataType.typeName() == "void"}
    shown = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void})
    shown.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(shown.schema).parquet(path).withColumns({c: F.lit(None) for c in void}).select(*[f"`{c}`" for c in df.columns])
    out._written_to = None if void else path
    return out


def materialise_some(df: DataFrame, *marks: str) -> tuple[DataFrame, list[bool]]:
    """``df`` materialised; whether it has rows, and for each mark whether it has rows where that column isn't null. That
    is observed as the rows are written, so it costs no job of its own."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(marks)]))
    got = seen.get
    return out, [got["n"] > 0, *[got[f"n{k}"] > 0 for k in range(len(marks))]]


def together(tables: list[DataFrame]) -> DataFrame:
    """All rows of materialised tables of one schema: one scan, however many they are."""
    first = tables[0]
    if all(getattr(t, "_written_to", None) and t.schema == first.schema for t in tables):
        return first.sparkSession.read.schema(first.schema).parquet(*[t._written_to for t in tables])
    out = first
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Partitions up to which their offsets are written into the plan.
FEW_PARTITIONS = 64


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` materialised, with a dense number from 0 for each row, and the count of rows. Rows are written once, with
    their partition and place in it; one number per partition reaches the driver, and rows are neither sorted nor
    moved."""
    df = materialise(df.withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in df.groupBy(part).count().collect())
    start, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, start))
        start += n
    if len(offsets) <= FEW_PARTITIONS:
        offset = F.lit(0)
        for k, at in offsets[1:]:
            offset = F.when(part == k, at).otherwise(offset)
        return df.withColumn(name, (offset + place).cast("long")), start
    known = df.sparkSession.createDataFrame(offsets, "__part long, __start long")  # a row for each partition
    met = df.withColumn("__part", part).join(F.broadcast(known), "__part")
    return met.withColumn(name, (F.col("__start") + place).cast("long")).select(*[f"`{c}`" for c in df.columns]), start
