"""Every query that has SQL agrees with DuckDB; the catalogue stands without the optional packages."""

import math
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from scenery.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6g}" if isinstance(v, (int, float, Decimal)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert canonical(got.select(*names).collect()) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry_points_stand_alone():
    """Hiding the training-data package leaves the other queries."""
    code = (
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith(('scenery.llm', 'corpus_pipeline')) else real(n, *a)\n"
        "import __spark_entry__ as e, sys\n"
        "assert len(e.queries()) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
        "assert not any(m.startswith('scenery.llm') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
