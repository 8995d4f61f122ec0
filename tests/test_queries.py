"""Every query against its SQL in DuckDB, on the smallest tables."""

import functools
import inspect
import sys

import duckdb
import pytest

from factloom import plans, registry, session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(names, rows):
    """Column names in order, and rows in order, floats rounded."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(repr([round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


def from_spark(df):
    return comparable(df.columns, [tuple(r) for r in df.collect()])


def from_duck(con, sql):
    done = con.execute(sql)
    return comparable([d[0] for d in done.description], done.fetchall())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


#: Functions of this library that each query called.
CALLED: dict[str, set[str]] = {}


@pytest.fixture(scope="module")
def calls():
    """The set that calls of operators, parsers, sessions and the catalogue are noted in, as module.function."""
    seen, patch = set(), pytest.MonkeyPatch()
    mine = [m for n, m in sys.modules.items() if n.startswith("factloom.") and not n.startswith("factloom.llm")]

    def noting(name, f):
        @functools.wraps(f)
        def run(*args, **kw):
            seen.add(name)
            return f(*args, **kw)

        return run

    for m in mine:
        if m.__name__.split(".")[1] in ("operators", "sources", "functions", "registry"):
            for name, f in list(vars(m).items()):
                if inspect.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_"):
                    new = noting(f"{m.__name__.split('.')[-1]}.{name}", f)
                    for other in mine:
                        for k, v in list(vars(other).items()):
                            if v is f:
                                patch.setattr(other, k, new)
    for name, f in list(vars(session.Workspaces).items()):
        if inspect.isfunction(f) and not name.startswith("_"):
            patch.setattr(session.Workspaces, name, noting(f"session.{name}", f))
    yield seen
    patch.undo()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, small, duck, calls, name):
    calls.clear()
    assert from_spark(plans.QUERIES[name](spark, small)) == from_duck(duck, plans.SQL[name])
    CALLED[name] = set(calls)


def test_catalogue_rows_have_queries_of_their_own_that_call_their_operators():
    """Each capability that isn't outside names an operator and a query that calls it; no two share a query."""
    rows = [(c, operator, q) for _, c, kind, operator, q in registry.CATALOGUE if kind != "outside"]
    assert all(operator and q in plans.QUERIES for _, operator, q in rows)
    shared = [q for _, _, q in rows]
    assert len(shared) == len(set(shared))
    missing = [(c, operator, q) for c, operator, q in rows if q in CALLED and operator not in CALLED[q]]
    assert missing == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
