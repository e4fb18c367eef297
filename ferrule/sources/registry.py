"""Sources by name: what a path's suffix says about how to read it.

``register`` adds a suffix of your own: a function of (spark, path) to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.errors import ExecutionError, SecurityError
from ferrule.limits import Limits
from ferrule.operators.tables import file_system
from ferrule.sources.sqlite import read_sqlite
from ferrule.sources.text import read_csv, read_json, read_tsv, read_xml
from ferrule.sources.yaml import read_yaml

Reader = Callable[[SparkSession, str], DataFrame]

READERS: dict[str, Reader] = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".json": read_json,
    ".yaml": read_yaml,
    ".yml": read_yaml,
    ".xml": read_xml,
    ".parquet": lambda spark, path: spark.read.parquet(path),
}
#: These may stand anywhere in the name: a table can follow after a colon.
CONTAINED: dict[str, Reader] = {".sqlite": read_sqlite, ".db": read_sqlite}

#: Readers that take the wanted columns.
PRUNING = {read_sqlite}


def register(suffix: str, reader: Reader) -> None:
    READERS[suffix] = reader


def check_path(path: str) -> None:
    """Reject paths that climb out of their folder."""
    if ".." in path.replace("\\", "/").split("/"):
        raise SecurityError(f"path traversal is not allowed: {path}")


def open_source(spark: SparkSession, name: str, limits: Limits, wanted: set[str] | None = None) -> DataFrame:
    """The source of that name; ``wanted``: the columns that the query mentions (None: all), for readers that Catalyst cannot prune."""
    check_path(name)
    reader = next((r for s, r in READERS.items() if name.lower().endswith(s)), None) or next((r for s, r in CONTAINED.items() if s in name.lower()), None)
    if reader is None:
        raise ExecutionError(f"Unsupported source: {name}")
    if limits.file_bytes is not None:
        check_size(spark, name, limits.file_bytes)
    try:
        return reader(spark, name, wanted) if reader in PRUNING else reader(spark, name)
    except (ExecutionError, SecurityError):
        raise
    except Exception as e:
        raise ExecutionError(f"cannot read {name}: {str(e).strip().splitlines()[0]}") from e


def check_size(spark: SparkSession, name: str, most: int) -> None:
    path = name
    fs, where = file_system(spark, path)
    if not fs.exists(where) and ":" in name:
        fs, where = file_system(spark, name.rpartition(":")[0])
    if fs.exists(where) and (size := fs.getContentSummary(where).getLength()) > most:
        raise SecurityError(f"{name} has {size} bytes; the limit is {most}")
