"""Results as files and as text."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.typed import quoted
from ferrule.operators.tables import delete, file_system, joined
from ferrule.sources.registry import check_path

SEPARATORS = {".csv": ",", ".tsv": "\t"}


def export(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write ``df`` as its suffix says: CSV, TSV, JSON array or Parquet.

    All tasks write parts side by side, in the order of the rows. With
    ``single_file`` the parts are then joined by the file system's own streams to
    one file (a header or brackets around them); without it the folder of parts
    is the result (JSON: an object a line), which is the way for large results.
    """
    check_path(path)
    suffix = "." + path.rpartition(".")[2].lower()
    if suffix not in (*SEPARATORS, ".json", ".parquet"):
        raise ExecutionError(f"cannot write {path}: use .csv, .tsv, .json or .parquet")
    plain = df.select([F.col(quoted(f.name)) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) or suffix in (".json", ".parquet") else F.to_json(F.col(quoted(f.name))).alias(f.name) for f in df.schema])
    spark, new = df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}"
    parts = f"{new}.parts"
    # Everything is read and written before what stood there goes, for it may be the source.
    try:
        if suffix == ".parquet":
            plain.write.parquet(new)
        elif not single_file:
            plain.write.json(new) if suffix == ".json" else plain.write.option("header", True).option("sep", SEPARATORS[suffix]).option("escape", '"').csv(new)
        elif suffix == ".json":
            row = F.to_json(F.struct(*[F.col(quoted(c)) for c in plain.columns]), {"ignoreNullFields": "false"})
            plain.select(F.concat(F.lit(",\n"), row).alias("value")).write.option("lineSep", " ").text(parts)
            joined(spark, parts, new, "[", "\n]\n", skip=1)
        else:
            sep = SEPARATORS[suffix]
            plain.write.option("sep", sep).option("escape", '"').option("emptyValue", "").csv(parts)
            joined(spark, parts, new, next(separated([plain.columns], sep)))
        _swap(spark, new, path)
    finally:
        delete(spark, parts)
        delete(spark, new)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put ``new`` in the place of ``path``; what stood there is kept until then."""
    fs, target = file_system(spark, path)
    if fs.exists(target):
        old = file_system(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")[1]
        if not fs.rename(target, old):
            raise ExecutionError(f"cannot replace {path}")
        if not fs.rename(file_system(spark, new)[1], target):
            fs.rename(old, target)
            raise ExecutionError(f"cannot write {path}")
        fs.delete(old, True)
    elif not fs.rename(file_system(spark, new)[1], target):
        raise ExecutionError(f"cannot write {path}")


# Text


def separated(rows: Iterable[Iterable], sep: str) -> Iterator[str]:
    for row in rows:
        line = io.StringIO()
        csv.writer(line, delimiter=sep, lineterminator="\n").writerow(["" if v is None else _text(v) for v in row])
        yield line.getvalue()


def _text(value) -> str:
    """A value as printed: whole numbers without a fraction, others with up to six decimals."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".") if abs(value) < 1e300 else str(value)
    return str(value)


def rendered(df: DataFrame, form: str = "csv") -> Iterator[str]:
    """The result as text, piece by piece; rows come a partition at a time, so only the table form holds them all."""
    names, rows = df.columns, df.toLocalIterator()
    if form in ("csv", "tsv"):
        yield from separated([names], "," if form == "csv" else "\t")
        yield from separated(rows, "," if form == "csv" else "\t")
    elif form == "json":
        yield "["
        for i, row in enumerate(rows):
            yield (",\n" if i else "\n") + json.dumps({n: v if v is None or isinstance(v, (bool, int, float, str)) else _text(v) for n, v in zip(names, row, strict=True)}, ensure_ascii=False)
        yield "\n]\n"
    elif form == "table":
        cells = [["NULL" if v is None else _text(v) for v in row] for row in rows]
        widths = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+\n"
        line = lambda row: "|" + "|".join(f" {c:<{w}} " for c, w in zip(row, widths, strict=True)) + "|\n"
        yield from [rule, line(names), rule, *map(line, cells), rule]
    else:
        raise ExecutionError(f"unknown format: {form}")
