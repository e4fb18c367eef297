"""Errors of the query language; each knows where in the text it arose, if anywhere."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all errors that a query can cause."""

    kind = "Error"

    def __init__(self, message: str, line: int = 0, column: int = 0):
        self.message, self.line, self.column = message, line, column
        super().__init__(f"{self.kind}: {message}" + (f" (line {line}, column {column})" if line else ""))


class LexerError(QueryError):
    kind = "Lexer error"


class ParserError(QueryError):
    kind = "Parser error"


class SecurityError(QueryError):
    """A limit was exceeded or a path is not allowed."""

    kind = "Security error"


class ExecutionError(QueryError):
    """A name, type, arity or source is wrong."""

    kind = "Runtime error"
