"""Large JSON arrays: read by many tasks, each a bounded piece of the file."""

from __future__ import annotations

import atexit
import json
import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.typed import quoted
from ferrule.operators.tables import delete, file_system, joined, shared_folder

# Functions travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: No JSON text holds this character, so it may stand between any two.
RECORD = "\x1e"
#: Bytes of a file that a task separates, at most.
PART = 32 << 20
#: Lines and pieces may be long, and workers have a few hundred MB.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: A bracket, an object and what follows it, each on a line of its own.
BEGINS_A_LINE = re.compile(r"\s*\[[ \t]*\r?\n[ \t]*\{[^\n]*\}[ \t]*,?[ \t]*\r?\n")
KINDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kinds", pa.string())])


def runs(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], tuple]]:
    """The texts of a batch, those of a split together, with what the other columns say of it."""
    begin, splits = 0, batch.columns[1:]
    constant = batch.num_rows > 0 and all(pc.count_distinct(column).as_py() == 1 for column in splits)
    for end in [batch.num_rows] if constant else range(1, batch.num_rows + 1):
        yield batch.column(0)[begin:end].to_pylist(), tuple(column[begin].as_py() for column in splits)
        begin = end


# An object a line


def kind(line: bytes) -> str:
    """A bracket; a comma for an object with one after it; ``o`` for an object alone; empty for a blank line; ``x`` for any other."""
    line = line.strip(b" \t")
    if line in (b"", b"[", b"]"):
        return line.decode()
    if line[:1] != b"{":
        return "x"
    comma = line.endswith(b",")
    try:
        json.loads(line[:-1].decode() if comma else line.decode())  # one value and nothing after it
    except (ValueError, RecursionError):
        return "x"
    return "," if comma else "o"


def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the kinds of its lines, commas in a row as one, up to the first that can't be in its place."""
    found: dict[tuple[str, int], str] = {}
    for batch in batches:
        for lines, split in runs(batch):
            text = found.get(split, "")
            for line in lines:
                if len(text) > 8 or text.endswith("x"):
                    break
                new = kind(line)
                text = text if new == "," and text.endswith(",") else text + new
            found[split] = text
    yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "kinds": text} for (file, start), text in found.items()], schema=KINDS)


def is_object_a_line(spark: SparkSession, path: str) -> bool:
    """Whether each file is ``[``, an object a line with commas between, and ``]``, by one parallel pass."""
    lines = spark.read.text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    with settings(spark, SMALL_BATCHES):
        found = lines.mapInArrow(kinds, "file string, start long, kinds string").collect()
    files: dict[str, str] = {}
    for r in sorted(found):
        files[r.file] = files.get(r.file, "") + r.kinds
    return bool(files) and all(re.fullmatch(r"\[(,*o)?\]", text) for text in files.values())


def read_object_a_line(reader: DataFrameReader, path: str, schema: T.StructType) -> DataFrame:
    """The objects of such files. The brackets' lines alone are no records; any other fails, as in FAILFAST mode."""
    corrupt = next(n for n in (f"line {i}" for i in range(len(schema) + 1)) if n.lower() not in {f.name.lower() for f in schema})
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).json(path)
    line = F.col(quoted(corrupt))
    # A data column must be mentioned: the reader refuses to give the corrupt lines alone.
    bracket = F.col(quoted(schema.fields[0].name)).isNull() & F.btrim(line, F.lit(" \t")).isin("[", "]")
    return df.filter(F.when(line.isNull(), True).when(bracket, False).otherwise(F.raise_error(F.concat(F.lit(f"broken JSON in {path}: "), F.substring(line, 1, 200))).cast("boolean"))).drop(corrupt)


# Any other form

#: A string, closed or up to the end of a piece; the group of its kind of quotes is what ends it.
STRING = re.compile(rb""""[^"\\]*(?:\\.[^"\\]*)*("|\\?\Z)|'[^'\\]*(?:\\.[^'\\]*)*('|\\?\Z)""", re.S)
REST = {q: re.compile(rb"[^%b\\]*(?:\\.[^%b\\]*)*%b" % (q, q, q), re.S) for q in (b'"', b"'")}
BRACKET = re.compile(rb"[\[\]{]")
BLANKS = rb"[ \t\r\n]*"
BEFORE_FIRST = re.compile(BLANKS + rb"\[" + BLANKS + rb"(?:(?=\{)|\])")
BEFORE_NEXT = re.compile(BLANKS + rb"(?:," + BLANKS + rb"(?=\{)|\])")
NEVER = 1 << 60
EFFECT = pa.schema([("start", pa.int64()), ("quote", pa.binary()), ("after", pa.binary()), ("change", pa.int64()), ("least", pa.int64())])


def step(piece: bytes, quote: bytes) -> tuple[bytes, int, int]:
    """What a piece and the ``}`` after it do, begun within a string of ``quote`` or outside (empty).

    (quote at its end, change of depth, lowest depth reached, from that of the beginning).
    """
    if quote:
        end = REST[quote].match(piece)
        if end is None:
            return quote, 0, NEVER
        piece = piece[end.end() :]
    after = b""
    if b"'" not in piece and b"\\" not in piece:
        parts = piece.split(b'"')
        after, outside = b"" if len(parts) % 2 else b'"', parts[::2]
    else:
        parts = STRING.split(piece)
        outside = parts[::3]
        if len(parts) > 1:
            after = b'"' if parts[-3] is not None and parts[-3] != b'"' else b"'" if parts[-2] is not None and parts[-2] != b"'" else b""
    depth, least = 0, NEVER
    for bracket in BRACKET.findall(b"".join(outside)):
        depth += -1 if bracket == b"]" else 1
        least = min(least, depth)
    return (after, depth, least) if after else (b"", depth - 1, min(least, depth - 1))


def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split what it does, begun outside of strings or within one of either kind."""
    found: dict[int, dict[bytes, list]] = {}
    for batch in batches:
        for pieces, (start,) in runs(batch):
            states = found.setdefault(start, {q: [q, 0, NEVER] for q in (b"", b'"', b"'")})
            for piece in pieces:
                done: dict[bytes, tuple] = {}
                for state in states.values():
                    quote = state[0]
                    if quote not in done:
                        done[quote] = step(piece, quote)
                    after, change, least = done[quote]
                    state[0], state[1], state[2] = after, state[1] + change, min(state[2], state[1] + least)
    rows = [(start, q, *state) for start, states in found.items() for q, state in states.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(EFFECT.names, row, strict=True)) for row in rows], schema=EFFECT)


def separator_at(piece: bytes, depth: int) -> re.Match:
    """The comma or the bracket that stands before an object, or the bracket that ends the array."""
    found = (BEFORE_NEXT if depth else BEFORE_FIRST).match(piece)
    if found is None:
        raise ValueError(f"broken JSON array: {piece[:200]!r}")
    return found


def separate(starts: dict[int, tuple[bytes, int]]):
    """The pieces with ``RECORD`` for all that stands between objects; what follows the array is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out = []
            for pieces, (start,) in runs(batch):
                if start != at:
                    at, (quote, depth) = start, starts[start]
                for piece in pieces:
                    if depth < 0:
                        break
                    between = not quote and depth < 2
                    quote, change, _ = step(piece, quote)
                    if between:
                        gap = separator_at(piece, depth)
                        if gap[0].endswith(b"]"):
                            depth = -1
                            break
                        piece = (RECORD.encode() if depth else b"") + piece[gap.end() :]
                    depth += change
                    if depth < 1:
                        raise ValueError(f"broken JSON array: {piece[:200]!r}")
                    out.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings while jobs run. The session's own come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def separated_copy(spark: SparkSession, path: str) -> str:
    """A copy of a file's array, of any form, with ``RECORD`` between the objects; it goes when the session ends.

    The file is read in pieces that end in ``}``, which split among tasks. A first pass
    finds what each split does to the depth and to strings, from which follows where
    each begins; a second one puts the separators. The parts are joined by streams.
    """
    fs, where = file_system(spark, path)
    parts = max(-(-fs.getFileStatus(where).getLen() // PART), spark.sparkContext.defaultParallelism)
    copy = f"{shared_folder(spark)}/array-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, copy)
    # Both passes must see the same splits, whatever executors come or go.
    with settings(spark, {"spark.sql.files.minPartitionNum": str(parts)} | SMALL_BATCHES):
        pieces = spark.read.option("lineSep", "}").text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("start"))
        found = pieces.mapInArrow(survey, "start long, quote binary, after binary, change long, least long").collect()
        effects = {(r.start, bytes(r.quote)): (bytes(r.after), r.change, r.least) for r in found}
        starts, quote, depth = {}, b"", 0
        for start in sorted({r.start for r in found}):
            starts[start] = (quote, depth)
            if depth >= 0:
                after, change, least = effects[start, quote]
                quote, depth = (b"", -1) if depth + least <= 0 else (after, depth + change)
        if depth >= 0:
            raise ExecutionError(f"{path} has an array that does not end")
        try:
            pieces.mapInArrow(separate(starts), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "}").text(f"{copy}.parts")
            joined(spark, f"{copy}.parts", copy)
        finally:
            delete(spark, f"{copy}.parts")
    return copy
