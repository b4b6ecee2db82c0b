"""Values put into SQL text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any


def literal(value: Any) -> str:
    """A value as SQL. Strings go as their bytes, so no quote or backslash in them, and no setting of the parser, matters."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return f"({value!r})" if value == value and abs(value) != float("inf") else f"double('{value!r}')"
    return f"decode(X'{str(value).encode().hex()}', 'UTF-8')"


_HOLE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\w+)", re.S)


def filled(text: str, values: dict[str, Any]) -> str:
    """The text with each $name as its value, in one pass; strings, quoted names and comments stay as they are."""

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in values:
            raise ValueError(f"no value for ${m[1]}")
        return literal(values[m[1]])

    return _HOLE.sub(put, text)


def bind(text: str, args: Sequence[Any]) -> str:
    """The text with $1, $2, ... as literals."""
    return filled(text, {str(k + 1): v for k, v in enumerate(args)})
