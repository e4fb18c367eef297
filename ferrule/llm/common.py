"""Helpers shared by the training-data operators: shared-folder tables, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import time
import types
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions of this subpackage travel inside the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 2_000_000
#: Rows in an Arrow batch while an operator's own jobs run; documents are some kilobytes each.
BATCH_ROWS = 1000

_OWN_DIR: list[str] = []
_COLLECTED = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all runs on one machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if found := spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="ferrule-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and gives the
    optimizer real sizes. The files go when the session ends. Shuffle files that
    only led up to the table are unreachable now; a collection on the driver, at
    most every few seconds, has them deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark):
        df.write.parquet(path)
    atexit.register(discard, spark, path)
    if time.monotonic() - _COLLECTED[0] > 5:
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()
    return spark.read.parquet(path)


def small_batches(spark: SparkSession):
    """Keep Arrow batches small while a job runs: texts are long and workers have a few hundred MB."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffles_deleted(spark: SparkSession):
    """Delete a job's shuffle files when it ends, not when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """One setting while a job runs. The session's own comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialize``; quiet if the session has ended."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame):
    """All columns of ``docs`` as one, ``row``: a user's names then clash with none of ours, and ``row.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def ranked(rows: DataFrame, order: list, name: str, by: list[str] = ()) -> DataFrame:
    """``rows`` with ``name``: the place of each by ``order``, gapless from 0, within each value of the columns ``by``.

    ``order`` begins with the order of ``by``. Rows are dealt by range of it, with
    a salt so that equal rows are dealt out too; no value of ``by`` meets in one
    task. Sizes of the parts give each part its first place. Names that begin
    with _ranked_ are for use within.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = rows.withColumn("_ranked_salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "_ranked_salt")
    parts = materialize(parts.drop("_ranked_salt").withColumn("_ranked_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(*by, "_ranked_part").agg(F.count(F.lit(1)).alias("_ranked_rows"))
    # At most a row for each part in each window.
    first = F.sum("_ranked_rows").over(Window.partitionBy(*by).orderBy("_ranked_part")) - F.col("_ranked_rows")
    firsts = materialize(counts.select(*[F.col(c).alias(f"_ranked_{i}") for i, c in enumerate(by)], F.col("_ranked_part").alias("_ranked_own"), first.alias("_ranked_first")), "ranked-firsts")
    spot = F.row_number().over(Window.partitionBy(*by, "_ranked_part").orderBy(*keys)) - 1
    on = F.col("_ranked_part") == F.col("_ranked_own")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_ranked_{i}"))
    out = parts.withColumn("_ranked_at", spot).join(firsts, on).withColumn(name, (F.col("_ranked_first") + F.col("_ranked_at")).cast("long"))
    return out.drop("_ranked_part", "_ranked_at", "_ranked_first", "_ranked_own", *[f"_ranked_{i}" for i in range(len(by))])


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def crc_ids(ids: pa.Array) -> np.ndarray:
    """``crc_of_id`` for an Arrow column."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()), np.int64, len(ids))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8).copy()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Slices (first row, end row, bytes, offsets) of about ``size`` bytes, whole texts each."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Multiplier of the polynomial hashes, odd and so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def process_cache() -> dict:
    """A dictionary of this process; it never travels with a pickled function."""
    return vars(sys.modules.setdefault("_ferrule_cache", types.ModuleType("_ferrule_cache")))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    cache = process_cache()
    if len(cache.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            cache[key] = np.multiply.accumulate(out)
    return cache["up"][:n], cache["down"][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; ``spans`` reads hashes of ranges from them."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the ranges [start, end) of what ``running`` has read."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit word for each byte."""
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


def word_table(kind: str) -> np.ndarray:
    """For each byte what it is in a word: itself with A-Z lower-cased, or 0 where it separates.

    ``blank``: words are runs of anything but space and 09-0D. ``alnum``: runs
    of letters, digits and non-ASCII characters. (A zero byte inside a blank
    word takes the code of A, which folding leaves free.)
    """
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    if kind == "blank":
        fold[0] = 65
        fold[[9, 10, 11, 12, 13, 32]] = 0
    elif kind == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        fold[~keep] = 0
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    return fold


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the offsets of each text's words."""
    folded = table[raw]
    inside = folded != 0
    edge = np.empty(len(raw) + 1, bool)
    edge[-1] = False
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(raw)]
    edge[cut] = inside[cut]
    start = np.flatnonzero(edge)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:]
    cut = at[1:][at[1:] > 0]
    stop[cut] = inside[cut - 1]
    end = np.flatnonzero(stop)
    codes = byte_codes()
    prefix = running(codes[folded])
    return spans(prefix, start, end), start, end, np.searchsorted(start, at)
