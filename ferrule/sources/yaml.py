"""YAML lists of flat mappings, by Spark's text reader with items as records, so large files split among tasks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.errors import ExecutionError
from ferrule.functions.typed import marked
from ferrule.sources.text import first_file


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """An item begins with ``-`` at the indent of the first one; each of its lines is ``key: value``.

    Lines end in LF or CRLF. Comment lines and blank ones, and what stands before
    the first item of a file, are skipped. One pair of quotes around a value is
    taken off. Of a key that an item repeats the last value counts. Items that lack a
    key have null there. Columns are in the order in which the keys first occur.
    """
    first_file(spark, path)
    item = r"^([ \t]*)-"
    first = spark.read.text(path).filter(F.col("value").rlike(item)).first()
    if not first:
        raise ExecutionError(f"{path} has no list items")
    mark = f"{re.match(item, first.value)[1]}-"
    records = spark.read.option("lineSep", f"\n{mark}").text(path).select("value", F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"))
    # A file's first record is what stands before its first item, or that item with its mark.
    starts = records.groupBy("file").agg(F.min("id").alias("start"))
    records = records.join(F.broadcast(starts.select("start")), F.col("id") == F.col("start"), "left")
    records = records.filter(F.col("start").isNull() | F.startswith("value", F.lit(mark)))
    text = F.when(F.col("start").isNotNull(), F.substring("value", len(mark) + 1, 1 << 30)).otherwise(F.col("value"))
    lines = F.filter(F.split(text, "\r?\n|\r$"), lambda x: F.trim(x).rlike(r"^[^#\s]") & (F.instr(x, ":") > 0))
    key = lambda x: F.trim(F.regexp_replace(F.substring_index(x, ":", 1), r"""^\s*["']?|["']?\s*$""", ""))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"""(?s)^(["'])(.*)\1$""", "$2")
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    rows = records.select("id", entries.alias("e"))
    last = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda y: y["k"] == x["k"]))
    pairs = rows.select("id", F.map_from_entries(last).alias("m")).filter(F.size("m") > 0)
    keys = rows.select("id", F.posexplode("e.k").alias("at", "k")).groupBy("k").agg(F.min(F.struct("id", "at")).alias("first")).orderBy("first").collect()
    if not keys:
        raise ExecutionError(f"{path} has no keys")
    return marked(pairs.select([F.element_at("m", F.lit(r.k)).alias(r.k) for r in keys]))
