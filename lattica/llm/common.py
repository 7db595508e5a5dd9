"""What the operators share: reading tables, cutting lineage, words and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import pathlib
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow slice that an operator turns into Python objects at a time.
SLICE_ROWS = 512
#: Bytes of an Arrow batch, about: long texts don't come ten thousand at a time.
BATCH_BYTES = 8 << 20
#: Rows from which a key can be hot, and the most keys that count as hot.
HOT_ROWS, HOT_KEYS = 100, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, so lost executors
    cost no recomputation beyond it. The files go when the driver exits, or when they are dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        return


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and, in column ``n``, how many rows of ``left``
    have it. Keys with more than 1 / HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are broadcast, so
    that no key's rows gather in one task. Both sides are read twice: they should be tables."""
    total = right.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = right.filter(F.col(n) > most).drop(n), right.filter(F.col(n) <= most).drop(n)
    there = left.join(F.broadcast(hot), key)
    return there.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold BATCH_BYTES at most and whose workers can import this package."""
    ship(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name).strip().lower())
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


#: Applications whose executors have got the package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors of a session, once: Spark's own file server hands it out."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lattica.zip", "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(f"{folder}/lattica.zip")
    _shipped.add(sc.applicationId)


def lean(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives back what it doesn't need until its next task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    for known in _hashes:
        known.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, schema: str | T.StructType, work: Callable[[dict[str, list]], dict[str, list]], columns: list[str], rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow of ``work`` over slices of ``rows`` rows of ``columns``, so that Python objects stay bounded
    whatever the batch size is. ``work`` gets and returns columns as lists."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work({c: part.column(k).to_pylist() for k, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(lean(run), kind)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8; bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by five: these rows never teach a model, nor do rows without an
    id, which count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: All tables of hashes in this process.
_hashes: weakref.WeakSet[Hashes] = weakref.WeakSet()


class Hashes(dict):
    """64-bit hashes of words, kept while there are fewer than ``most`` of them."""

    __hash__ = object.__hash__  # by identity, for _hashes

    def __init__(self, hash_of: Callable[[bytes], int], most: int = 300_000) -> None:
        super().__init__()
        self.hash_of, self.most = hash_of, most
        _hashes.add(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.hash_of(word)
        return got

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
