"""The syntax tree: immutable nodes, each with the place where it began."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    line: int = field(default=0, compare=False, kw_only=True)
    column: int = field(default=0, compare=False, kw_only=True)


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Number(Node):
    text: str


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False

    @property
    def key(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class Negative(Node):
    operand: Node


@dataclass(frozen=True)
class IsNull(Node):
    operand: Node
    negated: bool


@dataclass(frozen=True)
class Among(Node):
    operand: Node
    options: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Node):
    """Membership in the one column of a query."""

    operand: Node
    query: object
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    operand: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class Output:
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    how: str
    source: object  # a path or name, or a Query
    condition: Node | None
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Simple:
    """One from ... select ... with its clauses."""

    source: object
    select: tuple[Output, ...]
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[tuple[Node, bool, str | None], ...] = ()  # (expression, descending, where nulls go: first or last)
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class Union:
    """Two queries put together: op is union, intersect or except; ``keep_all`` keeps repeated rows."""

    left: object
    right: Simple
    keep_all: bool
    op: str = "union"


@dataclass(frozen=True)
class Query:
    body: object  # Simple or Union
    ctes: tuple[tuple[str, Query], ...] = ()
    recursive: bool = False
    into: str | None = None


COMPARISONS = {"==", "!=", ">", "<", ">=", "<="}
CONDITIONS = COMPARISONS | {"and", "or", "like"}
SET_OPERATIONS = ("union", "intersect", "except")
AGGREGATES = {"count", "sum", "avg", "min", "max"}


def text_of(node: Node) -> str:
    """The canonical text of an expression, which names an output column."""
    match node:
        case Name(name):
            return name
        case Number(text):
            return text
        case Text(value):
            return value
        case Star():
            return "*"
        case Call(name, args, distinct):
            return f"{name}({'distinct ' if distinct else ''}{', '.join(map(text_of, args))})"
        case Binary(op, left, right):
            return f"{text_of(left)} {op} {text_of(right)}"
        case Not(operand):
            return f"not {text_of(operand)}"
        case Negative(operand):
            return f"-{text_of(operand)}"
        case IsNull(operand, negated):
            return f"{text_of(operand)} is {'not ' if negated else ''}null"
        case Among(operand, options, negated):
            return f"{text_of(operand)} {'not ' if negated else ''}in ({', '.join(map(text_of, options))})"
        case InQuery(operand, _, negated):
            return f"{text_of(operand)} {'not ' if negated else ''}in (query)"
        case Between(operand, low, high, negated):
            return f"{text_of(operand)} {'not ' if negated else ''}between {text_of(low)} and {text_of(high)}"
    raise TypeError(f"not an expression: {node!r}")


def children(node: Node) -> tuple[Node, ...]:
    match node:
        case Call(_, args):
            return args
        case Binary(_, left, right):
            return left, right
        case Not(operand) | Negative(operand) | IsNull(operand) | InQuery(operand):
            return (operand,)
        case Among(operand, options):
            return operand, *options
        case Between(operand, low, high):
            return operand, low, high
    return ()


def walk(node: Node):
    yield node
    for child in children(node):
        yield from walk(child)


def is_condition(node: Node) -> bool:
    return isinstance(node, (Not, IsNull, Among, Between, InQuery)) or isinstance(node, Binary) and node.op in CONDITIONS
