"""Assembling oracle SQL from the view texts.

Oracle queries are plain SQL over the driver's tables; the derived views are
prepended as CTEs in dependency order.
"""

from __future__ import annotations

from lurescope.sources.fixtures import VIEW_DEPS, VIEW_SQL


def _closure(names: list) -> list:
    out: list = []

    def visit(n):
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views: list, body: str, extra: list | None = None) -> str:
    """``WITH <views in order>, <extra (name, sql)...> <body>``."""
    parts = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in _closure(views)]
    for name, sql in extra or []:
        parts.append(f"{name} AS ({sql.strip()})")
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
