"""The driver contract, and queries against their SQL over the smallest tables."""

from __future__ import annotations

import importlib
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quagmark.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(small).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return str(t.tz_localize(None) if t.tzinfo else t)
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return v if isinstance(v, str) else bool(v)
    return None if math.isnan(v) else round(float(v), 6) + 0.0


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    mine, theirs = registry.queries()[name](spark, small).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_llm(monkeypatch):
    real = importlib.import_module

    def without(name, *a):
        if name.startswith("quagmark.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert entry.queries().keys() == registry.queries().keys()


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).parent
    for p in (root / "quagmark").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quagmark.llm" not in p.read_text(), p
