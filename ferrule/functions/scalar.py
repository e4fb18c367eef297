"""Scalar functions by name: arity and the column they give."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.typed import Typed


class Scalar(NamedTuple):
    least: int
    most: int | None
    build: Callable[..., Typed]


def _string(column) -> Typed:
    return Typed(column, T.StringType())


def _number(x: Typed):
    """As a number; a text that is none raises."""
    if x.numeric:
        return x.column
    text = x.text()
    return F.coalesce(x.number(), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")))


def _absolute(x: Typed) -> Typed:
    return Typed(F.abs(_number(x)), x.kind if x.numeric else T.DoubleType())


def _rounded(x: Typed) -> Typed:
    return Typed(F.round(_number(x)), x.kind if x.numeric else T.DoubleType())


def _date_part(part):
    def build(x: Typed) -> Typed:
        return Typed(part(x.column.try_cast("date") if x.string else x.column), T.IntegerType())

    return build


def _now() -> Typed:
    return _string(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


SCALARS = {
    "upper": Scalar(1, 1, lambda x: _string(F.upper(x.text()))),
    "lower": Scalar(1, 1, lambda x: _string(F.lower(x.text()))),
    "concat": Scalar(0, None, lambda *xs: _string(F.concat_ws("", *[x.text() for x in xs]) if xs else F.lit(""))),
    "length": Scalar(1, 1, lambda x: Typed(F.length(x.text()), T.IntegerType())),
    "octet_length": Scalar(1, 1, lambda x: Typed(F.octet_length(x.text()), T.IntegerType())),
    "abs": Scalar(1, 1, _absolute),
    "round": Scalar(1, 1, _rounded),
    "now": Scalar(0, 0, _now),
    "year": Scalar(1, 1, _date_part(F.year)),
    "month": Scalar(1, 1, _date_part(F.month)),
    "day": Scalar(1, 1, _date_part(F.dayofmonth)),
}
