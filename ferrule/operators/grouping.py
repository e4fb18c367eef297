"""Grouping with aggregates wherever they stand: in the output, in having, in the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.aggregate import build
from ferrule.functions.typed import Typed, field_of, quoted
from ferrule.plans.lowering import Scope, fail
from ferrule.plans.syntax import AGGREGATES, Call, Name, Node, Star, children, text_of

BARE_COUNT = "count"
PLACE = "place of the row"


def aggregate_in(node: Node, columns: list[str]) -> bool:
    """Whether an expression holds an aggregate; a bare ``count`` is one unless a column has that name."""
    if text_of(node) in columns and not isinstance(node, Call):
        return False
    if isinstance(node, Call) and node.key in AGGREGATES and text_of(node) not in columns:
        return True
    if isinstance(node, Name) and node.name == BARE_COUNT and node.name not in columns:
        return True
    return any(aggregate_in(c, columns) for c in children(node))


def grouped(df: DataFrame, keys: tuple[Node, ...], wanted: list[Node]) -> Scope:
    """Group ``df`` and return (rows, scope) in which the ``wanted`` expressions can be lowered.

    Each distinct aggregate is computed once. A column that is neither key nor
    aggregated takes its value in the first row of the group.
    """
    scope = Scope.of(df)
    names, known, computed, finals, firsts = [], {}, [], {}, []
    for i, key in enumerate(keys):
        lowered = scope.lower(key)
        names.append(lowered.column.alias(f"key {i}"))
        known[text_of(key)] = Typed(F.col(f"`key {i}`"), lowered.kind, lowered.untyped)

    def need(node: Node) -> None:
        text = text_of(node)
        if text in known or isinstance(node, Star):
            return
        call = node if isinstance(node, Call) and node.key in AGGREGATES else Call(BARE_COUNT, ()) if isinstance(node, Name) and node.name == BARE_COUNT and node.name not in df.columns else None
        if call is not None and text not in df.columns:
            if call.key != "count" and (len(call.args) != 1 or isinstance(call.args[0], Star)):
                fail(f"{call.key} takes 1 argument, not {len(call.args)}", node)
            if len(call.args) > 1:
                fail("count takes at most 1 argument", node)
            if any(aggregate_in(a, df.columns) for a in call.args):
                fail(f"aggregate within an aggregate: {text}", node)
            arg = scope.lower(call.args[0]) if call.args and not isinstance(call.args[0], Star) else None
            spot = f"value {len(computed)}"
            computed.append(build(call.key, arg, call.distinct).alias(spot))
            finals[text] = spot
            known[text] = Typed(F.col(f"`{spot}`"), T.NullType())
        elif isinstance(node, Name):
            found = scope.find(node)
            firsts.append(node)
            spot = f"value {len(computed)}"
            computed.append((F.first(found.column) if df.isStreaming else F.min_by(found.column, F.col(PLACE))).alias(spot))
            finals[text] = spot
            known[text] = Typed(F.col(f"`{spot}`"), found.kind, found.untyped)
        else:
            for child in children(node):
                need(child)

    for node in wanted:
        need(node)
    if not computed:
        computed.append(F.count(F.lit(1)).alias("value 0"))
    rows = (placed(df) if firsts and not df.isStreaming else df).groupBy(*names).agg(*computed)
    for text, spot in finals.items():
        known[text] = Typed(F.col(f"`{spot}`"), field_of(rows, spot).kind, known[text].untyped)
    return rows, Scope(known)


def placed(df: DataFrame) -> DataFrame:
    """``df`` with the place of each row: tasks read a file's splits in order, so places follow the file."""
    return df.withColumn(PLACE, F.monotonically_increasing_id())


def first_rows(df: DataFrame, keys: tuple[Node, ...]) -> DataFrame:
    """The first whole row of each group."""
    if not all(isinstance(k, Name) for k in keys):
        raise ExecutionError("select * with group by needs columns as keys")
    for k in keys:
        Scope.of(df).find(k)
    if df.isStreaming:
        return df.dropDuplicates([k.name for k in keys])
    row = F.struct(*[F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema)])
    first = placed(df).groupBy(*[F.col(quoted(k.name)).alias(f"key {i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(PLACE)).alias("row"))
    return first.select([F.col(f"row.c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema)])
