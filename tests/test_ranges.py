"""Ordered windows in ranges, and files read in byte ranges, against one group in one task."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import ranges as R
from mnemolake.operators import sessions as C
from mnemolake.sources import histories as H
from mnemolake.sources import readers as D


def steps(spark, n=900, seed=1):
    """One key holds two thirds of all rows; a null key; gaps and ties in the steps."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "cold", None]), rng.randrange(600), rng.random() < 0.6, rng.choice([None, rng.randrange(9)]), i) for i in range(n)]
    return spark.createDataFrame(rows, "tool string, step long, failed boolean, v long, id long")


@pytest.mark.parametrize("rows", [40, 7, 10_000])
def test_windows_in_ranges(spark, rows):
    df = steps(spark)
    own = R.dealt(df, "tool", "step", rows)
    assert own.filter("_halo").count() == 0 and own.count() == 900
    widest = own.groupBy("tool", "range").count().agg(F.max("count")).first()[0]
    assert widest <= max(2 * rows, 25) if rows < 900 else widest > 400
    order, keys = ["step", "id"], ["tool"]
    w = W.partitionBy("tool").orderBy("step", "id")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    want = df.select("id", (F.row_number().over(w) - 1).alias("n"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", ignorenulls=True).over(upto).alias("c"), F.lag("v").over(w).alias("p")).orderBy("id").collect()
    got = R.numbered(own, keys, order, "n")
    got = R.summed(got, keys, order, F.col("v"), "s")
    got = R.carried(got, keys, order, {"c": F.col("v")})
    got = R.previous(got, keys, order, {"p": F.col("v")})
    assert got.select("id", "n", "s", "c", "p").orderBy("id").collect() == want


@pytest.mark.parametrize("rows", [30, 9, 10_000])
def test_failure_bursts_of_a_hot_tool(spark, rows):
    df = steps(spark, seed=2)
    w = W.partitionBy("tool").orderBy("step").rangeBetween(-4, 0)
    want = df.withColumn("f", F.sum(F.col("failed").cast("int")).over(w)).withColumn("g", F.sum((~F.col("failed")).cast("int")).over(w)).filter("failed and f >= 3 and g = 0")
    got = C.failure_bursts(df, "tool", "step", "failed", rows=rows)
    assert sorted((r["id"], r["failures"]) for r in got.collect()) == sorted((r["id"], r["f"]) for r in want.collect()) != []


def test_credit_in_ranges(spark):
    df = steps(spark).withColumn("alpha", F.coalesce("v", F.lit(0)) / 10.0)
    want = C.credit(df, "tool", ["step", "id"], "alpha", F.lit(1.0))
    got = C.credit(R.dealt(df, "tool", "step", 50), "tool", ["step", "id"], "alpha", F.lit(1.0), range_col="range")
    pairs = got.select("id", "value").join(want.select("id", F.col("value").alias("w")), "id").collect()
    assert len(pairs) == 900 and all(abs(r["value"] - r["w"]) < 1e-12 for r in pairs)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
def test_files_in_byte_ranges(spark, tmp_path, small_splits, size):
    """Lines longer than a range, blank and malformed ones, both line ends, letters of many bytes."""
    rng = random.Random(size)
    want, carried = [], []
    for f in range(5):
        lines = []
        for i in range(rng.randrange(60) if f else 0):
            kind = rng.randrange(8)
            lines.append("" if kind == 0 else "{broken" if kind == 1 else "[1]" if kind == 2 else json.dumps({"type": "session", "id": f"s{i}", "cwd": "é" * i}, ensure_ascii=False) if kind == 3 else json.dumps({"type": "message", "n": i, "text": "語" * rng.choice((1, 5, 90))}, ensure_ascii=False))
        (tmp_path / f"f{f}.jsonl").write_bytes("".join(x + rng.choice(("\n", "\r\n")) for x in lines).encode() + (b'{"last": 1}' if f % 2 else b""))
        lines += ['{"last": 1}'] * (f % 2)
        session = cwd = None
        for i, x in enumerate(lines):
            if x.startswith("{") and x != "{broken":
                want.append((f"f{f}", i, x))
                o = json.loads(x)
                if o.get("type") == "session":
                    session, cwd = o["id"], o["cwd"]
                else:
                    carried.append((f"f{f}", i, session, cwd))
    small_splits(size)
    rows = D.json_lines(spark, str(tmp_path))
    name = F.regexp_extract("file", "(f[0-9])", 1)
    assert sorted(map(tuple, rows.select(name, "line_no", "json").collect())) == sorted(want)
    assert size > 400 or rows.select("file", "range").distinct().count() > 10
    assert sorted(map(tuple, D.with_carried_session(rows).select(name, "line_no", "session_id", "cwd").collect()), key=repr) == sorted(carried, key=repr)
    order = {}
    for f, i, _ in sorted(want):
        order[f, i] = 1 + sum(1 for g, j, _ in want if g == f and j < i)
    got = H.numbered_lines(rows.withColumn("was", F.col("line_no"))).select(name, "was", "line_no").collect()
    assert {(r[0], r[1]): r[2] for r in got} == order


def test_no_file_is_one_task(spark, tmp_path, small_splits):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(20_000)))
    small_splits(1 << 14)
    rows = D.json_lines(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() > 10
    assert rows.filter(F.get_json_object("json", "$.n").cast("long") != F.col("line_no")).count() == 0 and rows.count() == 20_000


def test_a_row_looks_up_its_range_by_halving(spark):
    """As many bounds as there are, and no scan of all of them for each row."""
    for n in (1, 2, 3, 7, 8, 100):
        d = spark.range(-1, 2 * n + 2).selectExpr("id", f"transform(sequence(1, {n}), x -> 2L * x) as b")
        got = {r["id"]: r["k"] for r in d.select("id", R._reached(F.col("b"), F.col("id"), n).alias("k")).collect()}
        assert got == {i: sum(b <= i for b in range(2, 2 * n + 1, 2)) for i in got}
    e = spark.range(50_000).selectExpr("cast(null as string) as key", "id")
    dealt = R.dealt(e, "key", "id", 100)
    assert dealt.select("range").distinct().count() > 400
    assert "filter(_bounds" not in dealt._jdf.queryExecution().analyzed().toString()
