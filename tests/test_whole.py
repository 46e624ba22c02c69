"""Queries count every row of their tables, told without their SQL; graphs are walked to the end."""

from __future__ import annotations

import __spark_entry__ as entry
from mnemolake.operators import graph as G
from pyspark.sql import functions as F
from tests.test_queries import DATA, duck  # noqa: F401


def test_every_row_counts(spark, duck):  # noqa: F811
    """Facts of the tables, told without the queries' SQL."""
    one = lambda q: duck.execute(q).fetchall()[0][0]
    q = {name: entry.queries()[name](spark, DATA) for name in ("fts_postings", "config_redaction", "vector_hydrate", "pending_trials", "retry_upsert", "merge_targets", "resonance")}
    events = one("SELECT count(*) FROM events")
    assert q["fts_postings"].select("doc_id").distinct().count() == one("SELECT count(*) FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')") > 50
    assert q["config_redaction"].count() == events > 500
    assert q["vector_hydrate"].count() == one("SELECT count(*) FROM embeddings") > 100
    assert q["pending_trials"].filter("feedback_id >= 300").count() > 0
    assert q["retry_upsert"].count() == events
    assert q["merge_targets"].count() == one("SELECT count(DISTINCT o_custkey) FROM orders")
    assert q["resonance"].count() > 39


def test_customers_beyond_1500(spark, tmp_path):
    """1,500 customers of one nation, told by hand: the tables of the other tests are too small."""
    c = spark.range(1501, 3001).selectExpr("id as c_custkey", "0 as c_nationkey", "cast(id as double) as c_acctbal")
    c.write.parquet(str(tmp_path / "customer.parquet"))
    q = {name: entry.queries()[name] for name in ("graph_reach", "graph_cycle", "graph_root", "graph_context", "graph_active_path")}
    rows = {name: f(spark, str(tmp_path)).collect() for name, f in q.items()}
    step = lambda k: [k + 25 * (k % 3 + 1)] + [k + 25] * (k % 5 == 0)
    want = {}
    for k in range(3000, 1500, -1):
        want[k] = {k}.union(*[want.get(t, {t}) for t in step(k)])
    assert {r["root"]: (r["n"], r["furthest"]) for r in rows["graph_reach"]} == {k: (len(v), max(v)) for k, v in want.items()}
    assert {r["target"]: r["cycle"] for r in rows["graph_cycle"]} == {k: k + 25 * (k % 9) in want[k] for k in want}
    tasks = [k for k in range(1505, 3001, 7) if k % 4 in (0, 3)]
    root = max(tasks, key=lambda k: (k * 13 % 97, k))
    assert [r["id"] for r in rows["graph_root"]] == [root]
    assert [r["n"] for r in rows["graph_context"]] == [len([k for k in range(1501, 3001) if k % 7 == 0 or k % 4 in (0, 3)])]
    assert rows["graph_active_path"][0]["path"][0] == root


def test_all_suppliers_and_memories(spark, duck):  # noqa: F811
    n = duck.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchall()[0][0]
    assert entry.queries()["overlap_coefficient"](spark, DATA).count() == n * (n - 1) // 2


def test_long_chain(spark):
    """300 steps, a branch that joins it again, and a ring: no bound on steps."""
    edges = spark.range(300).selectExpr("1L as graph", "id as source", "id + 1 as target").unionByName(spark.createDataFrame([(1, 5, 250), (2, 1, 2), (2, 2, 1)], "graph long, source long, target long"))
    asked = spark.createDataFrame([(1, 300, 0), (1, 301, 0), (2, 1, 1), (2, 3, 1)], "graph long, source long, target long")
    assert {(r["graph"], r["source"]): r["cycle"] for r in G.makes_cycle(asked, edges).collect()} == {(1, 300): True, (1, 301): False, (2, 1): True, (2, 3): False}


def test_merge_targets_of_equal_sets_are_sought_once(spark):
    """20,000 drafts and 2,000 models of the same 40 policies: 1.6 billion rows if each met each."""
    from mnemolake.operators import lifecycle as L

    every = F.sequence(F.lit(0), F.lit(39))
    drafts = spark.range(20_000).select(F.col("id").alias("key"), every.alias("policy_ids"))
    models = spark.range(2_000).select(F.col("id"), (F.col("id") + 10**6).alias("key"), every.alias("policy_ids"), F.when(F.col("id") % 100 == 7, 0.9).otherwise(0.5).alias("confidence"))
    told = L.merge_target(drafts, models).groupBy("model").count().collect()
    assert [tuple(r) for r in told] == [(7, 20_000)]


def test_overlaps_are_all_pairs_copies_as_well(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 30 as l_suppkey", "id div 30 % 20 + id % 30 % 3 as l_partkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["overlap_coefficient"](spark, str(tmp_path)).collect())
    assert got == [(a, b, 1 - 0.05 * abs(a % 3 - b % 3)) for a in range(30) for b in range(a + 1, 30)]


def test_overlaps_by_bits_and_by_items(spark):
    """Both ways tell what sets tell: few items and many, nulls, pairs that share none."""
    import random

    from mnemolake.operators import lifecycle as L

    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(150)])) for k in range(60) for _ in range(rng.randint(1, 20))] + [(None, 3), (99, None)]
    sets = {}
    for k, i in rows:
        sets.setdefault(k, set()).add(i)
    del sets[None]
    want = {(a, b): len((sets[a] & sets[b]) - {None}) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (sets[a] & sets[b]) - {None}}
    df = spark.createDataFrame(rows, "key long, item long")
    plans = [L.overlaps(df, wide) for wide in (1024, 10)]
    for told in plans:
        assert {(r["a"], r["b"]): r["score"] for r in told.collect()} == want
    assert L.overlaps(df.filter("false")).collect() == []
    # by bits, no pair is shuffled: what is exchanged lies below the join
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_bursts_of_a_folder_of_files_in_any_order(spark, tmp_path):
    """The table is a folder, and a tool's rows come late steps first, over many blocks."""
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"))
    for part in (2, 0, 1):
        rows.filter(F.col("event_id") % 3 == part).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    rows = [r["step"] for r in entry.queries()["stream_failure_bursts"](spark, str(tmp_path)).collect()]
    # of any 15 consecutive steps some are good, so a burst needs a window before the first good one
    assert rows == []
    from mnemolake.streaming.pipelines import _bursts

    class State:
        exists = False

        def update(self, new):
            self.new = new

    import pandas as pd

    blocks = [pd.DataFrame({"step": s, "failed": [True] * len(s)}) for s in ([30, 31, 32], [1, 2, 3], [34, 33])]
    out = pd.concat(_bursts(5, 3)(("t",), blocks, State()))
    assert out[["step", "failures"]].values.tolist() == [[3, 3], [32, 3], [33, 4], [34, 5]]


def test_patterns_have_ascii_edges_and_either_case(spark):
    from mnemolake.operators import lifecycle as L

    d = spark.createDataFrame([("élicence",), ("a LICENSE",), ("alicense",), (None,), ("x@MAIL",)], "text string")
    got = {r["name"]: r["n"] for r in L.pattern_counts(d, "text", {"license": r"\blicen[sc]e", "mail": "@mail"}).collect()}
    assert got == {"license": 2, "mail": 1}


def test_ranks_of_more_hits_than_a_route_holds(spark, tmp_path):
    """Every hit is ranked, ties by id, over ranges that several tasks hold."""
    from mnemolake.operators import retrieval as X

    hits = spark.range(3000).selectExpr("cast(1 as long) as query_id", "concat('m', id) as id", "if(id % 2 = 0, 'tier1', 'tier2') as tier", "if(id % 3 = 0, 'vec', 'fts') as channel", "cast(id div 100 % 7 as double) as raw")
    got = {r["id"]: (r["rank"], r["score"]) for r in X.all_ranks(hits, str(tmp_path / "ranks")).collect()}
    groups = {}
    for r in hits.collect():
        groups.setdefault((r["tier"], r["channel"]), []).append((-r["raw"], r["id"]))
    want = {i: (n, -raw if channel == "vec" else 1 / (n + 1)) for (_, channel), own in groups.items() for n, (raw, i) in enumerate(sorted(own))}
    assert len(want) == 3000 and got == want
