"""Suggestions for misspelt names."""

from __future__ import annotations


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def hint(name: str, known: list[str]) -> str:
    """`` (Did you mean 'x'?)`` for the nearest known name, if it is fewer than three edits away."""
    near = min(((edits(name, k), k) for k in known), default=(3, ""))
    return f" (Did you mean '{near[1]}'?)" if near[0] < 3 else ""
