"""Small helpers to embed Python constants into oracle SQL text."""

from __future__ import annotations


def s(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    seen, out = set(), []
    for v in values:
        if v not in seen:
            seen.add(v)
            out.append(s(v))
    return "(" + ", ".join(out) + ")"


def str_list(values) -> str:
    return "CAST([" + ", ".join(s(v) for v in values) + "] AS VARCHAR[])"
