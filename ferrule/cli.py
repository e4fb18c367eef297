"""Command line: ``python -m ferrule "from f.csv select *"``, ``run file...``, or nothing for a shell."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from dataclasses import replace

from ferrule.errors import QueryError
from ferrule.limits import Limits

VERSION = "0.1.0"
PROMPT = "ferrule> "


def positive(text: str) -> int:
    try:
        value = int(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a number: {text!r}") from None
    if value < 0:
        raise argparse.ArgumentTypeError(f"must not be negative: {text}")
    return value


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferrule", description="Query CSV, TSV, JSON, YAML, XML, Parquet and SQLite files with Spark.")
    p.add_argument("query", nargs="*", help='a query, or "run" and query files; without any, a shell')
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--format", choices=("csv", "tsv", "json", "table"), default="csv")
    p.add_argument("--time", action="store_true", help="print how long each query took")
    p.add_argument("--quiet", action="store_true", help="print no results")
    p.add_argument("--verbose", action="store_true", help="log what is done")
    p.add_argument("--max-file-size", type=positive, metavar="BYTES")
    p.add_argument("--max-rows", type=positive, metavar="N")
    p.add_argument("--timeout", type=positive, metavar="MS")
    p.add_argument("--parts", action="store_true", help="into: leave a folder of parts instead of one file")
    return p


def spark_session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("ferrule").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def execute(engine, text: str, options) -> bool:
    """Run a query and print what comes; errors go to stderr. True if it succeeded."""
    began, fine = time.time(), True
    try:
        for piece in engine.run(text, options.format, not options.parts):
            if not options.quiet:
                sys.stdout.write(piece)
    except QueryError as e:
        print(f"Error: {e}", file=sys.stderr)
        fine = False
    except Exception as e:  # noqa: BLE001  what Spark says of bad data
        print(f"Error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        fine = False
    if options.time:
        print(f"Execution time: {(time.time() - began) * 1000:.3f} ms", file=sys.stderr)
    return fine


def shell(engine, options, lines=None) -> None:
    """A query a line, until exit or quit."""
    while True:
        try:
            line = (next(lines, "exit") if lines is not None else input(PROMPT)).strip().rstrip(";")
        except (EOFError, KeyboardInterrupt):
            return
        if line.lower() in ("exit", "quit"):
            return
        if line:
            execute(engine, line, options)
            sys.stdout.flush()


def main(argv: list[str] | None = None) -> int:
    options = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO if options.verbose else logging.WARNING, format="%(levelname)s %(message)s")
    from ferrule.session import Engine

    limits = replace(Limits(), file_bytes=options.max_file_size, rows=options.max_rows, timeout_ms=options.timeout)
    engine = Engine(spark_session(), limits)
    if not options.query:
        shell(engine, options)
        return 0
    if options.query[0] == "run":
        texts = []
        for name in options.query[1:]:
            try:
                texts.append(open(name, encoding="utf-8").read())
            except OSError as e:
                print(f"Error: {e}", file=sys.stderr)
                return 1
    else:
        texts = [" ".join(options.query)]
    return 0 if all([execute(engine, t, options) for t in texts]) else 1
