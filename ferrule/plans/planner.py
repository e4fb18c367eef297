"""Queries to DataFrames. Nothing is executed here but recursive rounds; Catalyst optimizes the whole."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.typed import UNTYPED, Typed, compare, field_of, quoted
from ferrule.limits import Limits
from ferrule.operators.grouping import aggregate_in, first_rows, grouped
from ferrule.operators.joins import conjuncts, joined
from ferrule.operators.recursive import fixpoint
from ferrule.plans.lowering import Scope
from ferrule.plans.syntax import InQuery, Join, Name, Node, Output, Query, Simple, Star, Union, is_condition, text_of, walk


#: Name of an in query's column while it is joined.
MEMBER = "member of the query"


def mentioned(q: Simple) -> set[str] | None:
    """The names in a query's expressions, all that its sources need to give; None if it selects ``*``."""
    nodes = [*(o.expr for o in q.select), q.where, q.having, *q.group, *(e for e, *_ in q.order), *(j.condition for j in q.joins)]
    if isinstance(nodes[0], Star):
        return None
    return {x.name for node in nodes if node is not None for x in walk(node) if isinstance(x, Name)}


class Planner:
    """Plans with one set of sources: ``open_source`` reads a named one and is told which columns are wanted."""

    def __init__(self, open_source: Callable[[str, set[str] | None], DataFrame], limits: Limits):
        self.open_source, self.limits = open_source, limits

    def plan(self, query: Query, env: dict[str, DataFrame] | None = None) -> DataFrame:
        env = dict(env or {})
        for name, inner in query.ctes:
            if query.recursive and isinstance(inner.body, Union) and self.mentions(inner.body.right, name):
                anchor = self.body(inner.body.left, env)
                recur = inner.body.right
                env[name] = fixpoint(anchor, lambda new, n=name, r=recur: self.simple(r, env | {n: new}), inner.body.keep_all, self.limits.recursion_levels)
            else:
                env[name] = self.plan(inner, env)
        return self.body(query.body, env)

    def mentions(self, simple: Simple, name: str) -> bool:
        sources = [simple.source, *(j.source for j in simple.joins)]
        return any(s == name or isinstance(s, Query) and self.inside(s.body, name) for s in sources)

    def inside(self, body, name: str) -> bool:
        return self.inside(body.left, name) or self.mentions(body.right, name) if isinstance(body, Union) else self.mentions(body, name)

    def body(self, body, env: dict) -> DataFrame:
        if isinstance(body, Simple):
            return self.simple(body, env)
        left, right = self.body(body.left, env), self.simple(body.right, env)
        if len(left.columns) != len(right.columns):
            raise ExecutionError(f"{body.op} of {len(left.columns)} and {len(right.columns)} columns")
        match body.op, body.keep_all:
            case "intersect", keep:
                return left.intersectAll(right) if keep else left.intersect(right)
            case "except", keep:
                return left.exceptAll(right) if keep else left.subtract(right)
        out = left.union(right)
        return out if body.keep_all else out.distinct()

    def source(self, source, env: dict, wanted: set[str] | None) -> DataFrame:
        if isinstance(source, Query):
            return self.plan(source, env)
        return env[source] if source in env else self.open_source(source, wanted)

    def simple(self, q: Simple, env: dict) -> DataFrame:
        wanted = mentioned(q)
        df = self.source(q.source, env, wanted)
        for join in q.joins:
            df = self.join(df, join, env, wanted)
        if q.where is not None:
            for part in conjuncts(q.where):
                if isinstance(part, InQuery):
                    df = self.among(df, part, env)
            rest = [part for part in conjuncts(q.where) if not isinstance(part, InQuery)]
            if rest:
                self.no_constants(q.where)
            for part in rest:
                df = df.filter(Scope.of(df).condition(part))
        outputs = [o.expr for o in q.select]
        star = isinstance(outputs[0], Star)
        wanted = [*([] if star else outputs), *([q.having] if q.having is not None else []), *(e for e, *_ in q.order)]
        has_aggregate = any(aggregate_in(e, df.columns) for e in wanted)
        if q.group and star and not has_aggregate:
            df = first_rows(df, q.group)
            scope = Scope.of(df)
        elif q.group or has_aggregate:
            if star:
                raise ExecutionError("select * cannot be combined with aggregates")
            aliases = {o.alias or text_of(o.expr): o.expr for o in q.select}
            wanted = [aliases.get(text_of(e), e) for e in wanted]
            df, scope = grouped(df, q.group, wanted)
        else:
            scope = Scope.of(df)
        if q.having is not None:
            if not (q.group or has_aggregate):
                raise ExecutionError("having needs group by or an aggregate", q.having.line, q.having.column)
            df = df.filter(scope.condition(q.having))
        return self.finish(q, df, scope, star, aggregated=has_aggregate)

    def join(self, df: DataFrame, join: Join, env: dict, wanted: set[str] | None) -> DataFrame:
        try:
            return joined(df, self.source(join.source, env, wanted), join.how, join.condition)
        except ExecutionError as e:
            raise e if e.line else ExecutionError(e.message, join.line, join.column) from e

    def among(self, df: DataFrame, node: InQuery, env: dict) -> DataFrame:
        """Rows whose value is in a query's column (semi join), or surely not in it (null-aware anti join)."""
        found = self.plan(node.query, env)
        if len(found.columns) != 1:
            raise ExecutionError(f"in (query) needs one column, not {len(found.columns)}", node.line, node.column)
        field = found.schema[0]
        option = found.select(F.col(quoted(field.name)).alias(MEMBER, metadata=field.metadata))
        equal = compare("==", Scope.of(df).lower(node.operand), field_of(option, MEMBER), key=True)
        return df.join(option, equal | equal.isNull(), "left_anti") if node.negated else df.join(option, equal, "left_semi")

    def no_constants(self, node: Node) -> None:
        if not any(isinstance(x, Name) for x in walk(node)):
            raise ExecutionError("a condition needs a field", node.line, node.column)

    def finish(self, q: Simple, df: DataFrame, scope: Scope, star: bool, aggregated: bool) -> DataFrame:
        """Order, project and cut. The order may use columns that are not selected, so it comes first."""
        named = {} if star else {o.alias: o.expr for o in q.select if o.alias}

        def output(o: Output) -> Typed:
            lowered = scope.lower(o.expr)
            if aggregated and is_condition(o.expr):
                return Typed(lowered.column.cast("int"), T.IntegerType())
            return lowered

        def ordered(rows: DataFrame, of: Scope) -> DataFrame:
            keys = []
            for expr, descending, nulls in q.order:
                expr = named.get(text_of(expr), expr) if text_of(expr) not in of.known else expr
                value = of.lower(expr)
                columns = [value.number().isNull(), value.number(), value.column] if value.untyped and value.string else [value.column]
                if nulls:
                    keys.append(value.column.isNull().desc() if nulls == "first" else value.column.isNull().asc())
                keys += [c.desc() if descending else c.asc() for c in columns]
            return rows.orderBy(*keys) if keys else rows

        def project(rows: DataFrame) -> DataFrame:
            if star:
                return rows
            columns, used = [], set()
            given = [o.alias or text_of(o.expr) for o in q.select]
            for o, name in zip(q.select, given, strict=True):
                if name in used:
                    name = next(n for i in count(2) if (n := f"{name}_{i}") not in used and n not in given)
                used.add(name)
                lowered = output(o)
                keep = lowered.untyped and lowered.string
                columns.append(lowered.column.alias(name, metadata={UNTYPED: True}) if keep else lowered.column.alias(name))
            return rows.select(*columns)

        if q.distinct:
            df = project(df).distinct()
            df = ordered(df, Scope.of(df))
        else:
            df = project(ordered(df, scope))
        df = df.offset(q.offset) if q.offset else df
        return df.limit(q.limit) if q.limit is not None else df
