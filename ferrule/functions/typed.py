"""Type-directed columns: numbers by value, texts as texts, and texts that hold numbers as numbers where both sides do.

Columns of text sources (CSV and the like) are strings that may hold numbers.
They carry the mark ``untyped`` in their metadata, which Spark passes on through
projections, joins and grouping. Columns of typed sources are compared natively,
so that filters reach the Parquet reader.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNTYPED = "untyped"
NUMERIC = (T.NumericType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Typed:
    """A column with what is known of it; ``literal``: its text if it is a constant."""

    column: Column
    kind: T.DataType
    untyped: bool = False
    literal: str | None = None

    @property
    def numeric(self) -> bool:
        return isinstance(self.kind, NUMERIC)

    @property
    def string(self) -> bool:
        return isinstance(self.kind, (T.StringType, T.NullType))

    @property
    def temporal(self) -> bool:
        return isinstance(self.kind, TEMPORAL)

    def number(self) -> Column:
        """As a number; null where a text is none."""
        if self.numeric:
            return self.column
        if self.literal is not None:
            return F.lit(number_in(self.literal)).cast("double")
        return parsed(self.column) if self.string else self.column.cast("double")

    def text(self) -> Column:
        return self.column if self.string else self.column.cast("string")


# What a number's text looks like; nothing may follow it, no suffix and no blank.
BLANK = r"[ \t\n\x0B\f\r]*"
PLAIN = BLANK + r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
SPECIAL = BLANK + r"[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
HEXADECIMAL = BLANK + r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)([pP][+-]?[0-9]+)?"


def parsed(column: Column) -> Column:
    """The number that a text holds, or null.

    A failed cast and a pattern are slow, so texts are looked at first: plain
    numbers begin with a blank, a sign, a point or a digit, all of which sort
    before the colon, and end in a digit or a point. The cast refuses what is left of
    other texts, but for hexadecimal ones, which it takes with an exponent only.
    """
    last = F.substring(column, -1, 1)
    plain = F.when((column < ":") & (last >= ".") & (last <= "9"), column.try_cast("double"))
    special = F.when(last.isin("n", "N", "f", "F", "y", "Y") & column.rlike(f"^{SPECIAL}$"), column.try_cast("double"))
    with_exponent = F.when(F.contains(F.lower(column), F.lit("p")), column).otherwise(F.concat(column, F.lit("p0")))
    hexadecimal = F.when(F.contains(F.lower(column), F.lit("x")) & column.rlike(f"^{HEXADECIMAL}$"), with_exponent.try_cast("double"))
    return F.coalesce(plain, special, hexadecimal)


def number_in(text: str) -> float | None:
    """The number that a constant text spells, or None; the same texts as for ``parsed``."""
    if re.fullmatch(PLAIN, text) or re.fullmatch(SPECIAL, text):
        return float(text)
    return float.fromhex(text.strip()) if re.fullmatch(HEXADECIMAL, text) else None


def marked(df: DataFrame) -> DataFrame:
    """``df`` with all its string columns marked as untyped."""
    return df.select([F.col(quoted(f.name)).alias(f.name, metadata={UNTYPED: True}) if isinstance(f.dataType, T.StringType) else F.col(quoted(f.name)) for f in df.schema])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field_of(df: DataFrame, name: str) -> Typed:
    field = df.schema[name]
    return Typed(F.col(quoted(name)), field.dataType, bool((field.metadata or {}).get(UNTYPED)))


COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def compare(op: str, a: Typed, b: Typed, key: bool = False) -> Column:
    """``a op b``: by value if both are numbers, else as texts.

    ``key``: the comparison links two sources; texts then match as texts, which
    keeps it an equi-join.
    """
    do = COMPARE[op]
    if a.numeric and b.numeric or type(a.kind) is type(b.kind) and not a.string:
        return do(a.column, b.column)
    for one, other, turn in ((a, b, do), (b, a, lambda x, y: do(y, x))):
        if one.temporal and other.literal is not None and other.string:
            return turn(one.column, F.lit(other.literal).cast(one.kind))
        if one.temporal and other.string:
            return turn(one.column, other.column.try_cast(one.kind))
        if one.numeric and other.literal is not None and other.string:
            value = number_in(other.literal)
            return turn(one.text(), other.column) if value is None else turn(one.column, F.lit(value))
        if one.numeric and other.string:
            return turn(one.column, other.number()) if key else F.coalesce(turn(one.column, other.number()), turn(one.text(), other.column))
    if a.string and b.string and not key:
        constants = [x for x in (a, b) if x.literal is not None]
        if not any(number_in(x.literal) is None for x in constants):
            return F.coalesce(do(a.number(), b.number()), do(a.column, b.column))
    return do(a.text(), b.text()) if type(a.kind) is not type(b.kind) else do(a.column, b.column)
