"""Queries over files as they arrive, by Structured Streaming.

A folder that gains files is a table like any other; filters, projections,
joins with fixed tables, grouping and unions run on it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ferrule.errors import ExecutionError
from ferrule.functions.typed import marked
from ferrule.session import Engine

TEXT_OPTIONS = {"csv": {"header": True, "escape": '"'}, "tsv": {"header": True, "escape": '"', "sep": "\t"}, "json": {}}


def arriving(spark: SparkSession, folder: str, schema: StructType | str, form: str = "parquet", files_a_batch: int | None = None, late_column: str | None = None, late_by: str = "0 seconds") -> DataFrame:
    """The files of a folder, those to come included, as a streaming DataFrame.

    ``late_column``: the event time; state of groups older than ``late_by`` is dropped.
    """
    if form not in ("parquet", *TEXT_OPTIONS):
        raise ExecutionError(f"cannot follow files of the form {form}")
    reader = spark.readStream.schema(schema).options(**TEXT_OPTIONS.get(form, {}))
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.format("csv" if form == "tsv" else form).load(folder)
    rows = rows if form == "parquet" else marked(rows)
    return rows.withWatermark(late_column, late_by) if late_column else rows


def follow(engine: Engine, text: str, checkpoint: str, into: str | None = None, name: str | None = None, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Run a query that names a streaming table.

    Results go to Parquet files in ``into``, or to an in-memory table ``name``.
    ``mode``: append, or complete for groups without an event time. ``once``:
    end when what is there now has been read.
    """
    df = engine.sql(text)
    if not df.isStreaming:
        raise ExecutionError("the query names no streaming table")
    writer = df.toDF(*[c if c.isidentifier() else f"c{i}" for i, c in enumerate(df.columns)]).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.format("parquet").start(into) if into else writer.format("memory").queryName(name or "result").start()
