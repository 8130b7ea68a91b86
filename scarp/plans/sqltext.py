"""Named SQL fragments for the check queries. A query lists only its own body; fragments it names are pulled in."""
from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in FRAGMENTS if n in words]


def query(body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(FRAGMENTS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _needs(body):
        visit(name)
    body = body.strip()
    own = ""
    if body.upper().startswith("WITH RECURSIVE"):
        own, body = "RECURSIVE", body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        body = body[len("WITH"):]
    elif order:
        body = "\n" + body
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" for n in order) + body
    else:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" for n in order)
    return f"WITH {own} " + (head + ",\n" if head else "") + body


def r6(*cols: str, d: int = 6) -> str:
    """round(col, d) AS col for each column; '+ 0.0' turns a negative zero into zero."""
    return ", ".join(f"round({c}, {d}) + 0.0::DOUBLE AS {c}" for c in cols)


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"
