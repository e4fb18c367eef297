"""Expressions to columns, within a scope of known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import ExecutionError
from ferrule.functions.scalar import SCALARS
from ferrule.functions.suggest import hint
from ferrule.functions.typed import Typed, compare, field_of, number_in
from ferrule.plans.syntax import AGGREGATES, COMPARISONS, Among, Between, Binary, Call, IsNull, Name, Negative, Node, Not, Number, Text, is_condition, text_of

ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b}


def fail(message: str, node: Node):
    raise ExecutionError(message, node.line, node.column)


class Scope:
    """Names and what they stand for; derived columns are known by the text of their expression."""

    def __init__(self, known: dict[str, Typed]):
        self.known = known

    @classmethod
    def of(cls, df: DataFrame) -> Scope:
        return cls({name: field_of(df, name) for name in df.columns})

    def find(self, node: Name) -> Typed:
        if node.name not in self.known:
            fail(f"Unknown field: {node.name}{hint(node.name, list(self.known))}", node)
        return self.known[node.name]

    def lower(self, node: Node, key: bool = False) -> Typed:
        """The column of an expression; ``key``: comparisons link two sources."""
        if not isinstance(node, (Number, Text)) and (found := self.known.get(text_of(node))):
            return found
        match node:
            case Name():
                return self.find(node)
            case Number(text):
                return Typed(F.lit(float(text)), T.DoubleType(), literal=text) if "." in text else Typed(F.lit(int(text)), T.LongType() if int(text) > 2**31 - 1 else T.IntegerType(), literal=text)
            case Text(value):
                return Typed(F.lit(value), T.StringType(), literal=value)
            case Call():
                return self.call(node)
            case Negative(operand):
                inner = self.lower(operand)
                return Typed(-inner.number(), inner.kind if inner.numeric else T.DoubleType(), literal=f"-{inner.literal}" if inner.literal else None)
            case Binary(op, left, right) if op in ("and", "or"):
                a, b = self.condition(left, key), self.condition(right, key)
                return Typed(a & b if op == "and" else a | b, T.BooleanType())
            case Binary("like", left, right):
                # A backslash is no escape here, so the escape is a character that texts don't hold.
                return Typed(F.like(self.lower(left).text(), self.lower(right).text(), F.lit("\x00")), T.BooleanType())
            case Binary(op, left, right) if op in COMPARISONS:
                return Typed(compare(op, self.lower(left), self.lower(right), key), T.BooleanType())
            case Binary(op, left, right):
                a, b = self.lower(left), self.lower(right)
                kind = T.DoubleType() if op == "/" or not (a.numeric and b.numeric) or isinstance(a.kind, T.DoubleType) else b.kind if isinstance(b.kind, T.DoubleType) else T.LongType()
                return Typed(ARITHMETIC[op](a.number(), b.number()), kind)
            case Not(operand):
                return Typed(~self.condition(operand, key), T.BooleanType())
            case IsNull(operand, negated):
                column = self.lower(operand).column
                return Typed(column.isNotNull() if negated else column.isNull(), T.BooleanType())
            case Among(operand, options, negated):
                value, found = self.lower(operand), F.lit(False)
                for option in options:
                    found = found | compare("==", value, self.lower(option))
                return Typed(~found if negated else found, T.BooleanType())
            case Between(operand, low, high, negated):
                value = self.lower(operand)
                inside = compare(">=", value, self.lower(low)) & compare("<=", value, self.lower(high))
                return Typed(~inside if negated else inside, T.BooleanType())
        return fail(f"not an expression here: {text_of(node)}", node)

    def call(self, node: Call) -> Typed:
        if node.key in AGGREGATES:
            fail(f"aggregate not allowed here: {text_of(node)}", node)
        if node.key not in SCALARS:
            fail(f"Unsupported function: {node.name}{hint(node.key, [*SCALARS, *AGGREGATES])}", node)
        function = SCALARS[node.key]
        if len(node.args) < function.least or function.most is not None and len(node.args) > function.most:
            fail(f"{node.key} takes {function.least if function.most == function.least else f'{function.least} or more'} arguments, not {len(node.args)}", node)
        args = [self.lower(a) for a in node.args]
        if node.key in ("abs", "round") and args[0].literal is not None and args[0].string and number_in(args[0].literal) is None:
            fail(f"{node.key} needs a number, not {args[0].literal!r}", node)
        return function.build(*args)

    def condition(self, node: Node, key: bool = False) -> Column:
        """The column of a condition."""
        lowered = self.lower(node, key)
        if not is_condition(node) and not isinstance(lowered.kind, T.BooleanType):
            fail(f"not a condition: {text_of(node)}", node)
        return lowered.column
