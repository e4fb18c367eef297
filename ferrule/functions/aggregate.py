"""Aggregate functions over a typed argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.typed import Typed


def build(name: str, arg: Typed | None, distinct: bool) -> Column:
    """The aggregate as a column.

    count counts rows whatever its argument (distinct: different values). sum
    and avg skip what is no number. min and max compare numbers by value, the
    texts of text sources as far as they are numbers, other texts and dates as
    such.
    """
    if name == "count":
        return F.count_distinct(arg.column) if distinct and arg else F.count(F.lit(1))
    if name in ("sum", "avg"):
        do = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((name, distinct)) or (lambda c: F.sum_distinct(c) / F.count_distinct(c))
        return do(arg.number())
    do = F.min if name == "min" else F.max
    return do(arg.number() if arg.string and arg.untyped else arg.column)
