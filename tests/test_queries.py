"""Every registered query against its DuckDB oracle on the smallest tables."""

import importlib
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.normalize() if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query_equals_oracle(spark, sf, duck, name):
    df = registry.queries[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    found = duck.execute(registry.oracle[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    rows = lambda x: sorted(repr([plain(r[c]) for c in sorted(names)]) for r in x)
    assert rows(got) == rows(want)


def test_each_operator_is_named_once_at_least():
    ids = {i for c in registry.covers.values() for i in c}
    assert len(ids) > 200
    assert set(registry.oracle) == set(registry.queries)


def names_used(f, module, seen):
    """Names that a function uses, and those of the helpers of its module that it calls."""
    found, codes = set(), [f.__code__]
    while codes:
        code = codes.pop()
        codes += [c for c in code.co_consts if hasattr(c, "co_names")]
        found |= set(code.co_names)
    for name in set(found):
        helper = getattr(module, name, None)
        if callable(helper) and getattr(helper, "__module__", "").startswith("ledgerloom.plans") and hasattr(helper, "__code__") and name not in seen:
            seen.add(name)
            found |= names_used(helper, importlib.import_module(helper.__module__), seen)
    return found


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query_calls_the_library(name):
    """A query that claims an item runs an operator, function, source or stream of the library, not a plan of its own."""
    f = registry.queries[name]
    public = set()
    for package in ("operators", "functions", "sources", "streaming"):
        for p in (Path(__file__).parent.parent / "ledgerloom" / package).glob("[a-z]*.py"):
            module = importlib.import_module(f"ledgerloom.{package}.{p.stem}")
            public |= {n for n, v in vars(module).items() if callable(v) and getattr(v, "__module__", "") == module.__name__}
    assert names_used(f, importlib.import_module(f.__module__), set()) & public, name
