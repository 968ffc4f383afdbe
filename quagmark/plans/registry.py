"""All core queries by name, and the SQL of those that SQL can say."""

from __future__ import annotations

from quagmark.plans import book, dealt, fields, grids, live, nets, numbers, series  # noqa: F401


def queries() -> dict[str, book.Query]:
    return {**dealt.queries(), **book.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**dealt.oracle_sql(), **book.SQL}
