"""SQLite tables by a Python data source over the standard library, split by ranges of rowid."""

from __future__ import annotations

import json
import sqlite3
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ferrule.errors import ExecutionError
from ferrule.functions.suggest import edits
from ferrule.functions.typed import marked

#: Rows to a partition.
RANGE = 250_000
#: Rows to an Arrow batch.
BATCH = 10_000


def connect(path: str) -> sqlite3.Connection:
    plain = path.removeprefix("file://").removeprefix("file:")
    return sqlite3.connect(f"file:{quote(plain)}?mode=ro", uri=True)


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.columns = options["path"], options["table"], columns

    def partitions(self):
        """Ranges of rowid of equal width, as many as the number of rows asks for."""
        db = connect(self.path)
        try:
            low, high, rows = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {identifier(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table without rowid
            return [Range(None, None)]
        finally:
            db.close()
        if not rows:
            return [Range(None, None)]
        parts = -(-rows // RANGE)
        edges = [low + (high + 1 - low) * i // parts for i in range(parts + 1)]
        return [Range(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition):
        db = connect(self.path)
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        where = "" if partition.low is None else f" WHERE rowid BETWEEN {int(partition.low)} AND {int(partition.high)}"
        text = lambda v: v if v is None or isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v)
        try:
            found = db.execute(f"SELECT {', '.join(map(identifier, self.columns)) or 'NULL'} FROM {identifier(self.table)}{where}")
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(map(text, c), pa.string(), size=len(rows)) for c in zip(*rows, strict=True)], names=self.columns)
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ferrule_sqlite"

    def schema(self):
        """All columns, or those of the option ``columns``."""
        if self.options.get("columns"):
            return ", ".join(f"`{n.replace('`', '``')}` string" for n in json.loads(self.options["columns"]))
        db = connect(self.options["path"])
        try:
            names = [r[1] for r in db.execute(f"PRAGMA table_info({identifier(self.options['table'])})")]
        finally:
            db.close()
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema):
        return SqliteReader(self.options, schema.names)


def read_sqlite(spark: SparkSession, name: str, wanted: set[str] | None = None) -> DataFrame:
    """``file`` or ``file:table``; without a table the first one. Nulls stay null; values are texts.

    ``wanted``: names that the query mentions; other columns are not read.
    """
    path, _, table = name.rpartition(":") if ":" in name.rpartition("/")[2] else (name, "", "")
    try:
        db = connect(path)
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY rowid")]
        table = table or (tables[0] if tables else "")
        names = [r[1] for r in db.execute(f"PRAGMA table_info({identifier(table)})")]
        db.close()
    except sqlite3.Error as e:
        raise ExecutionError(f"cannot read {path}: {e}") from e
    if table not in tables:
        raise ExecutionError(f"no such table: {table or path}")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("ferrule_sqlite").option("path", path).option("table", table)
    if wanted is not None:
        # Near misses stay, for the message to suggest.
        near = {n for n in names for w in wanted if n == w or w not in names and edits(n, w) < 3}
        reader = reader.option("columns", json.dumps([n for n in names if n in near] or names[:1]))
    return marked(reader.load())
