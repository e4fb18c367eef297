"""The engine: query text in, DataFrame out."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ferrule.errors import SecurityError
from ferrule.limits import Limits
from ferrule.operators.sinks import export, rendered
from ferrule.plans.parser import parse
from ferrule.plans.planner import Planner
from ferrule.sources.registry import open_source

log = logging.getLogger("ferrule")


class Engine:
    """Runs queries on a Spark session.

    ``tables``: DataFrames that queries can name. ``base``: a folder that
    relative paths are in.
    """

    def __init__(self, spark: SparkSession, limits: Limits | None = None, base: str | None = None):
        self.spark, self.limits, self.base, self.tables = spark, limits or Limits(), base, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}" if self.base and not name.startswith("/") and "://" not in name else name

    def open(self, name: str, wanted: set[str] | None = None) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return open_source(self.spark, self.path(name), self.limits, wanted)

    def sql(self, text: str) -> DataFrame:
        """The query as a lazy DataFrame; an into clause plays no part here."""
        return Planner(self.open, self.limits).plan(parse(text, self.limits))

    def run(self, text: str, form: str = "csv", single_file: bool = True) -> Iterator[str]:
        """Run a query under the limits: write its file if it says into, else give the result as text."""
        query = parse(text, self.limits)
        with self.deadline():
            df = Planner(self.open, self.limits).plan(query)
            self.check_rows(df)
            if query.into is not None:
                log.info("writing %s", query.into)
                export(df, self.path(query.into), single_file)
                return
            yield from rendered(df, form)

    def check_rows(self, df: DataFrame) -> None:
        if self.limits.rows is not None and df.limit(self.limits.rows + 1).count() > self.limits.rows:
            raise SecurityError(f"the result has more than {self.limits.rows} rows")

    @contextmanager
    def deadline(self):
        """Interrupt the jobs started within after ``timeout_ms``."""
        if self.limits.timeout_ms is None:
            yield
            return
        if self.limits.timeout_ms <= 0:
            raise SecurityError("timeout: 0 ms")
        tag, over = f"ferrule-{uuid.uuid4().hex}", threading.Event()

        def stop():
            over.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(self.limits.timeout_ms / 1000, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            yield
        except Exception as e:
            if over.is_set():
                raise SecurityError(f"timeout: {self.limits.timeout_ms} ms") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        if over.is_set():
            raise SecurityError(f"timeout: {self.limits.timeout_ms} ms")
