"""Joins that merge columns of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.typed import Typed, compare, field_of, quoted
from ferrule.plans.lowering import Scope
from ferrule.plans.syntax import Binary, Name, Node

LEFT, RIGHT = "left of ", "right of "


def _tagged(df: DataFrame, names: set[str], tag: str) -> DataFrame:
    return df.select([F.col(quoted(c)).alias(tag + c) if c in names else F.col(quoted(c)) for c in df.columns])


def conjuncts(node: Node) -> list[Node]:
    if isinstance(node, Binary) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def joined(left: DataFrame, right: DataFrame, how: str, condition: Node | None) -> DataFrame:
    """Join two sources; a column that both have appears once, at its left place, with the right value.

    A name in the condition means the side that has it; if both have it, in
    ``name == name`` the left one on the left and the right one on the right,
    elsewhere the right value. (In outer joins a side that is missing gives way
    to the other.) Conjuncts are lowered one by one, so that equalities between
    the sides become join keys, whatever else the condition holds.
    """
    both = set(left.columns) & set(right.columns)
    names = list(left.columns) + [c for c in right.columns if c not in both]
    a, b = _tagged(left, both, LEFT), _tagged(right, both, RIGHT)
    sides = {c: field_of(a, c) for c in a.columns} | {c: field_of(b, c) for c in b.columns}
    merged = {c: sides[c] if c not in both else sides[RIGHT + c] for c in names}
    scope = Scope(merged)

    def one(node: Node) -> Column:
        match node:
            case Binary("==", Name(x), Name(y)) if x == y and x in both:
                return compare("==", sides[LEFT + x], sides[RIGHT + x], key=True)
        return scope.condition(node, key=True)

    on = None
    for node in conjuncts(condition) if condition is not None else []:
        on = one(node) if on is None else on & one(node)
    if on is None:
        out = a.crossJoin(b)
    else:
        out = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return out.select([F.col(quoted(LEFT + c)).alias(c) if c in both else F.col(quoted(c)) for c in left.columns])

    def value(c: str) -> Column:
        if c not in both:
            return F.col(quoted(c))
        known: Typed = sides[RIGHT + c]
        column = F.coalesce(F.col(quoted(RIGHT + c)), F.col(quoted(LEFT + c))) if how in ("left", "full") else F.col(quoted(RIGHT + c))
        return column.alias(c, metadata={"untyped": True}) if known.untyped else column.alias(c)

    return out.select([value(c) for c in names])
