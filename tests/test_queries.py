"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import pytest

import mnemolake.plans.insight_queries  # noqa: F401
import mnemolake.plans.more_queries  # noqa: F401
import mnemolake.plans.panel_queries  # noqa: F401
import mnemolake.plans.range_queries  # noqa: F401
import mnemolake.plans.record_queries  # noqa: F401
import mnemolake.plans.rule_queries  # noqa: F401
import mnemolake.plans.search_queries  # noqa: F401
import mnemolake.plans.similarity_queries  # noqa: F401
import mnemolake.plans.source_queries  # noqa: F401
from mnemolake.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
