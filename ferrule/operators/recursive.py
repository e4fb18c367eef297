"""Recursive common table expressions, a round of new rows at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.errors import ExecutionError, SecurityError
from ferrule.operators.tables import written


def _renamed(rows: DataFrame, like: DataFrame) -> DataFrame:
    if len(rows.columns) != len(like.columns):
        raise ExecutionError(f"union of {len(like.columns)} and {len(rows.columns)} columns")
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).select([F.col(f"c{i}").cast(f.dataType).alias(f.name, metadata=f.metadata) for i, f in enumerate(like.schema)])


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], keep_all: bool, levels: int) -> DataFrame:
    """All rows that ``anchor`` and repeated ``step`` give; each round sees the rows that the last one added.

    Each round is a written table, so plans stay short and lost executors cost a
    round at most. Without ``keep_all`` rows known already are dropped, which
    ends cycles.
    """
    new = written(anchor if keep_all else anchor.distinct())
    rounds, level = [new], 0
    while not new.isEmpty():
        level += 1
        if level > levels:
            raise SecurityError(f"recursion is deeper than {levels} levels")
        rows = _renamed(step(new), anchor)
        if not keep_all:
            rows = rows.subtract(_all(rounds))
        new = written(rows)
        rounds.append(new)
    return _all(rounds)


def _all(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out
