"""Errors of the dialect, with a place in the text and a hint."""

from __future__ import annotations

import difflib


class SqlError(ValueError):
    def __init__(self, kind: str, message: str, line: int = 0, column: int = 0, hint: str = ""):
        self.kind, self.line, self.column, self.hint = kind, line, column, hint
        where = f" at line {line}, column {column}" if line else ""
        super().__init__(f"{kind}: {message}{where}" + (f" ({hint})" if hint else ""))


def near(word: str, known) -> str:
    found = difflib.get_close_matches(word.lower(), [k.lower() for k in known], 1)
    return f"did you mean {found[0]}?" if found else ""
