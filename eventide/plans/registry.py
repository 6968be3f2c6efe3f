"""Where registered queries and their SQL meet."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.scalar import off_grid

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def rounded_alike(sql: str) -> str:
    """The SQL with every round(x, digits) as scalar.rounded rounds."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue  # inside one that was rewritten
        depth, comma, i = 1, None, m.end()
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out.append(f"{sql[at : m.start()]}round(({rounded_alike(sql[m.end() : comma])}) + {off_grid(digits)!r}::DOUBLE, {digits})")
        at = i
    return "".join([*out, sql[at:]])


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL for the same rows where there is one."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = rounded_alike(sql)
        return f

    return keep
