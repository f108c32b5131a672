"""Builds one SQL statement from a final SELECT and the named views it needs."""

from __future__ import annotations

import re

from oracles.views import VIEWS

_WORD = re.compile(r"\b[a-z_][a-z0-9_]*\b")


def statement(final: str) -> str:
    ordered: list[str] = []

    def need(sql: str, inside: str = "") -> None:
        for name in dict.fromkeys(_WORD.findall(sql)):
            if name in VIEWS and name not in ordered and name != inside:
                need(VIEWS[name], name)
                ordered.append(name)

    need(final)
    if not ordered:
        return final.strip()
    body = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in ordered)
    final = final.strip()
    if final.startswith("WITH "):
        return f"WITH {body},\n{final[5:]}"
    return f"WITH {body}\n{final}"
