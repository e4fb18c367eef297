"""CSV, TSV, JSON and XML by Spark's readers. All values are texts, marked as untyped."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.typed import marked
from ferrule.operators.tables import file_system
from ferrule.sources import arrays

#: Files up to this size are one task anyway, so they are read with line breaks in quotes at once.
ONE_SPLIT = 4 << 20
#: Bytes of a file that are looked at first.
HEAD = 1 << 16


def first_file(spark: SparkSession, path: str):
    """(file system, file): the path itself, or the first file of a folder; None for an empty folder."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        raise ExecutionError(f"no such file: {path}")
    if not fs.getFileStatus(where).isDirectory():
        return fs, where
    files = sorted((f.getPath().toString(), f) for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    return fs, files[0][1].getPath() if files else None


def plain_files(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """(name, bytes) of the files of a path; None if folders are among them."""
    fs, where = file_system(spark, path)
    found = [f for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", "."))]
    return None if any(f.isDirectory() for f in found) else sorted((f.getPath().toString(), f.getLen()) for f in found)


def heads(spark: SparkSession, path: str, size: int = HEAD) -> Iterator[str]:
    """Ever longer beginnings of a file, or of the first file of a folder; the last one is the whole."""
    fs, where = first_file(spark, path)
    if where is None:
        return
    length = fs.getFileStatus(where).getLen()
    while True:
        stream = fs.open(where)
        try:
            yield bytes(stream.readNBytes(min(size, length))).decode("utf-8", "ignore")
        finally:
            stream.close()
        if size >= length:
            return
        size *= 4


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, where = file_system(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


_FACTS: dict[tuple, object] = {}


def fact(spark: SparkSession, what: str, path: str, find):
    """What ``find()`` says of a file, asked again only when the file's size or time has changed."""
    fs, where = file_system(spark, path)
    key = (what, path, *((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in ([fs.getFileStatus(where), *fs.listStatus(where)] if fs.exists(where) else [])))
    if key not in _FACTS:
        if len(_FACTS) >= 1000:
            _FACTS.clear()
        _FACTS[key] = find()
    return _FACTS[key]


def forget() -> None:
    """Ask files anew."""
    _FACTS.clear()


def _has_broken_lines(spark: SparkSession, path: str) -> bool:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(F.col("value").contains('"') & (quotes % 2 == 1)).isEmpty()


def _separated(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Quoted fields may hold separators, doubled quotes and line breaks; short rows end in nulls, cells beyond the header are dropped.

    A field with a line break shows as a line with an odd number of quotes. Large
    files are searched for one, and without it are split among tasks.
    """
    broken = total_bytes(spark, path) <= ONE_SPLIT or fact(spark, "broken lines", path, lambda: _has_broken_lines(spark, path))
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", broken).option("inferSchema", False)
    return marked(reader.csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, ",")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, "\t")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, an object a line, or one object. The first two split among tasks in any form (``arrays``).

    Spark's reader of objects over several lines is left to files in other encodings
    than UTF-8 and to folders of folders: it is one task a file, and reads a buffer anew for every value that is no string.
    """
    head = next((h for h in heads(spark, path) if h.strip()), "").lstrip()
    start = head[:1]
    if start and start not in "[{":
        raise ExecutionError(f"{path} is no JSON array of objects")

    def reader(record: str | None = None):
        options = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST")
        return options.option("lineSep", record) if record else options

    def find() -> tuple[str, str | list[str], T.StructType]:
        """The form, where it is read, and the schema; one object over several lines fails as lines."""
        if start == "{":
            try:
                return "lines", path, reader().json(path).schema
            except (PySparkException, Py4JJavaError):
                pass
        files = plain_files(spark, path)
        if not start or "\0" in head or files is None:
            return "whole", path, reader().option("multiLine", True).json(path).schema
        if start == "[" and total_bytes(spark, path) > ONE_SPLIT:
            if arrays.BEGINS_A_LINE.match(head) and arrays.is_object_a_line(spark, path):
                if (schema := reader().option("mode", "DROPMALFORMED").json(path).schema).fields:
                    return "array lines", path, schema
            where = [arrays.separated_copy(spark, name) if size > ONE_SPLIT else name for name, size in files]
        else:
            where = path
        return "records", where, reader(arrays.RECORD).json(where).schema

    form, where, schema = fact(spark, f"JSON of {spark.sparkContext.applicationId}", path, find)
    if form == "array lines":
        return marked(arrays.read_object_a_line(reader(), path, schema))
    options = reader(arrays.RECORD) if form == "records" else reader().option("multiLine", form == "whole")
    return marked(options.schema(schema).json(where))


def row_tag(spark: SparkSession, path: str) -> str:
    """The element within the root: the second start tag, comments and declarations aside."""
    for text in heads(spark, path):
        text = re.sub(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<!(?!--|\[CDATA)[^>\[]*(\[[^\]]*\])?[^>]*>", "", text, flags=re.S)
        text = re.sub(r"<[!?].*", "", text, flags=re.S)  # one that ends further on
        tags = re.findall(r"<([A-Za-z_][\w.:-]*)(?=[\s/>])", text)
        if len(tags) > 1:
            return tags[1]
    raise ExecutionError(f"{path} has no rows in a root element")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows are the elements within the root, columns their child elements; attributes are dropped."""
    tag = row_tag(spark, path)
    reader = spark.read.option("rowTag", tag).option("inferSchema", False).option("mode", "FAILFAST").option("excludeAttribute", True)
    df = reader.xml(path)
    nested = [f.name for f in df.schema if f.dataType.simpleString() != "string"]
    if nested:
        raise ExecutionError(f"nested elements are not supported: {', '.join(nested)}")
    return marked(df)
