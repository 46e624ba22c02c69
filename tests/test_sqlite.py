"""SQLite files as a data source."""

from __future__ import annotations

import datetime
import random
import sqlite3

import pytest

from mnemolake.sources import sqlite as Q


@pytest.fixture
def store(tmp_path):
    """Gaps among rowids, negative ones, values of other types than their columns'."""
    path = tmp_path / "a store#1.db"
    db = sqlite3.connect(path)
    db.execute("create table items(k integer primary key, name text, x, blob_ blob)")
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-500, 5000), 900))
    rows = [(i, None if i % 7 == 0 else f"n{i % 5}é", [None, 1.5, "2.5", "word", 7][i % 5], bytes([i % 256]) if i % 3 else None) for i in ids]
    db.executemany("insert into items values (?, ?, ?, ?)", rows)
    db.execute('create table "odd ""name"(v integer)')
    db.executemany('insert into "odd ""name" values (?)', [(1,), (2,)])
    db.execute("create table flat(k text primary key, v integer) without rowid")
    db.executemany("insert into flat values (?, ?)", [("b", 2), ("a", 1)])
    db.execute("create table none(k integer)")
    db.commit()
    db.close()
    return str(path), rows


SCHEMA = "k long, name string, x double, blob_ binary, missing string"


@pytest.mark.parametrize("rows", [10, 333, 10**6])
def test_ranges_of_rowids(spark, store, rows):
    path, want = store
    df = Q.sqlite_table(spark, path, "items", SCHEMA, rows)
    real = lambda v: None if v is None else {"2.5": 2.5, "word": 0.0}.get(v, v) if isinstance(v, str) else float(v)
    assert sorted((r["k"], r["name"], r["x"], None if r["blob_"] is None else bytes(r["blob_"]), r["missing"]) for r in df.collect()) == sorted((k, n, real(x), b, None) for k, n, x, b in want)
    assert df.rdd.getNumPartitions() == -(-(want[-1][0] - want[0][0] + 1) // rows)
    assert df.select("name").distinct().count() == 6 and df.count() == len(want)


def test_pushed_comparisons(spark, store):
    path, want = store
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for text, keep in (
            ("k >= 100 and k < 900 and name = 'n3é'", lambda k, n, x, b: 100 <= k < 900 and n == "n3é"),
            ("name is null or k = 4", lambda k, n, x, b: n is None or k == 4),
            ("name is null and k <> 14", lambda k, n, x, b: n is None and k != 14),
            ("k in (7, 8, 9, 10, 11) and name is not null", lambda k, n, x, b: k in (7, 8, 9, 10, 11) and n is not None),
            ("name > 'n2' and x = 1.5", lambda k, n, x, b: n is not None and n > "n2" and x == 1.5),
            ("missing is null and k < 0", lambda k, n, x, b: k < 0),
            ("missing = 'x'", lambda k, n, x, b: False),
            ("name <=> null", lambda k, n, x, b: n is None),
        ):
            got = Q.sqlite_table(spark, path, "items", SCHEMA, 100).filter(text)
            assert sorted(r["k"] for r in got.collect()) == sorted(r[0] for r in want if keep(*r)), text
        reader = Q.PushingReader(Q.sqlite_table(spark, path, "items", SCHEMA).schema, {"path": path, "table": "items"})
        from pyspark.sql.datasource import EqualTo, StringContains

        left = list(reader.pushFilters([EqualTo(("k",), 5), StringContains(("name",), "n")]))
        assert len(left) == 1 and reader.values == [5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tables_of_all_kinds(spark, store, tmp_path):
    path, _ = store
    assert sorted(r["v"] for r in Q.sqlite_table(spark, path, 'odd "name', "v int").collect()) == [1, 2]
    assert sorted(map(tuple, Q.sqlite_table(spark, path, "flat", "k string, v boolean").collect())) == [("a", True), ("b", True)]
    assert Q.sqlite_table(spark, path, "none", "k long").collect() == [] == Q.sqlite_table(spark, path, "absent", "k long").collect()
    sums = spark.read.format("sqlite").schema("n long, total double").option("query", "SELECT count(*) AS n, sum(v) AS total FROM flat").load(path)
    assert [tuple(r) for r in sums.collect()] == [(2, 3.0)]
    for options in ({"query": "select 1; drop table flat"}, {"query": "delete from flat"}, {}, {"query": "select 1", "table": "flat"}):
        with pytest.raises(ValueError):
            Q.SQLiteReader(sums.schema, {"path": path, **options})
    with pytest.raises(ValueError, match="mounted"):
        Q.local_path("viewfs://store/x.db")
    db = Q.opened(path)
    with pytest.raises(sqlite3.OperationalError):
        db.execute("insert into flat values ('c', 3)")
    db.close()


def state(path, messages="id integer primary key, session_id text, role text, content text, tool_call_id text, tool_calls text, tool_name text, timestamp real, platform_message_id text, active integer", rows=(), sessions=True):
    db = sqlite3.connect(path)
    db.execute(f"create table messages({messages})")
    db.executemany(f"insert into messages values ({','.join('?' * len(messages.split(',')))})", rows)
    if sessions:
        db.execute("create table sessions(id text, cwd text)")
        db.executemany("insert into sessions values (?, ?)", [("s1", "/w"), ("s2", "")])
    db.commit()
    db.close()


def test_state_databases(spark, tmp_path):
    state(
        tmp_path / "new.db",
        rows=[
            (1, "s1", "user", "hi", None, None, None, 1704164645.5, "p1", None),
            (2, "s1", "assistant", "", "c1", '[{"x":1}]', "grep", 1704164646000.0, None, 1),
            (3, "s1", "tool", "found", "c1", None, "grep", 1704164647, None, 1),
            (4, "s2", "assistant", "gone", None, None, None, 1704164648, None, 0),
            (5, "s2", "robot", "x", None, None, None, 1704164648, None, 1),
            (6, "s3", "system", "sys", None, None, None, 1704164649, None, 1),
            (7, "s3", "user", None, None, None, None, 1704164650, None, 1),
            (8, "s2", "assistant", "both", "c2", "[1]", None, 1704164651, None, 1),
        ],
    )
    got = {r["message_id"]: (r["conversation_id"], r["role"], r["content"], r["workspace_path"]) for r in Q.state_messages(spark, str(tmp_path / "new.db"), rows=2).collect()}
    assert got == {
        "p1": ("s1", "user", "hi", "/w"),
        "s1:2": ("s1", "tool", 'Tool: grep\n\nCall ID: c1\n\nInput:\n[{"x":1}]', "/w"),
        "s1:3": ("s1", "tool", "Tool: grep\n\nCall ID: c1\n\nOutput:\nfound", "/w"),
        "s3:6": ("s3", "system", "sys", None),
        "s2:8": ("s2", "assistant", "both", None),
    }
    at = {r["store_id"]: r["created_at"] for r in Q.state_messages(spark, str(tmp_path / "new.db")).collect()}
    assert at[1] == datetime.datetime(2024, 1, 2, 3, 4, 5, 500000) and at[2] == datetime.datetime(2024, 1, 2, 3, 4, 6)
    state(tmp_path / "old.db", "id integer primary key, session_id text, role text, content text, timestamp real", [(1, "s1", "user", "old", 1.0)], sessions=False)
    assert [(r["message_id"], r["workspace_path"]) for r in Q.state_messages(spark, str(tmp_path / "old.db")).collect()] == [("s1:1", None)]
    state(tmp_path / "other.db", "id integer primary key, body text", [(1, "x")])
    assert Q.state_messages(spark, str(tmp_path / "other.db")).collect() == []
