"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ferrule.errors import ExecutionError

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and all runs on one machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ExecutionError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="ferrule-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage is cut and survives lost executors. It goes when the session ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex[:12]}"
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    safe.write.parquet(path)
    atexit.register(delete, spark, path)
    again = spark.read.parquet(path)
    return again.select([again[f"c{i}"].alias(f.name, metadata=f.metadata) if f.metadata else again[f"c{i}"].alias(f.name) for i, f in enumerate(schema)])


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    try:
        fs, where = file_system(spark, path)
        fs.delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        return


def joined(spark: SparkSession, parts: str, path: str, before: str = "", after: str = "", skip: int = 0) -> None:
    """Join the parts that a job wrote to one file, in their order; ``skip``: bytes left out of the first."""
    fs, folder = file_system(spark, parts)
    _, target = file_system(spark, path)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(target, True)
    try:
        out.write(before.encode())
        names = [f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
        names.sort(key=lambda name: int(name.rpartition("/part-")[2].split("-")[0]))
        for i, name in enumerate(names):
            stream = fs.open(file_system(spark, name)[1])
            if i == 0 and skip:
                stream.skip(skip)
            copy(stream, out, 1 << 20, False)
            stream.close()
        out.write(after.encode())
    finally:
        out.close()
