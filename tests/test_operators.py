"""Operators on tiny frames."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import memory as M
from mnemolake.functions import rules as R
from mnemolake.functions import scoring as S
from mnemolake.functions import text as T
from mnemolake.functions import vector as V
from mnemolake.operators import graph as G
from mnemolake.operators import lifecycle as L
from mnemolake.operators import queues as Q
from mnemolake.operators import retrieval as X
from mnemolake.operators import sessions as C
from mnemolake.sources import readers as D
from mnemolake.streaming import pipelines as Z


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = X.vector_topk(df, F.array(F.lit(1.0), F.lit(0.0)), "id", "v", 2).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (2, 0.8)]
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_centroid_counts_odd_lengths(spark):
    df = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [1.0]), (2, 0, [0.0, 0.0])], "g long, o long, v array<double>")
    got = {r["g"]: list(r["centroid"]) for r in V.centroids(df, "g", "v", "o").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_window_before_scores(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "id long, v array<double>")
    got = X.vector_topk(df, F.array(F.lit(1.0), F.lit(0.0)), "id", "v", 1, newest="id", window=3).collect()
    assert [r["id"] for r in got] == [7]


def test_credit(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (1, 3, 0.0), (2, 1, 0.0)], "g long, t long, alpha double")
    got = {(r["g"], r["t"]): r["value"] for r in C.credit(df, "g", ["t"], "alpha", F.lit(1.0)).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.0, (2, 1): 0.0}


def test_priority(spark):
    day = S.DAY_MS
    assert one(spark, S.priority(F.lit(1.0), F.lit(0), 30 * day)) == 0.5
    assert one(spark, S.priority(F.lit(-1.0), F.lit(0), 30 * day)) == 0
    assert one(spark, S.priority(F.lit(0.4), F.lit(9 * day), day)) == 0.4


def test_reflection_alpha(spark):
    assert [one(spark, S.reflection_alpha(F.lit(x), F.lit(a))) for x, a in (("PIVOTAL", 0.1), ("RELATED", 0.0), ("IRRELEVANT", 1.0), ("", 0.0), ("", 0.3), ("else", 2.0))] == [1.0, 0.5, 0.0, 0.5, 0.3, 1.0]


def test_status_machines(spark):
    assert one(spark, S.policy_status(F.lit("active"), F.lit(3), F.lit(-0.3))) == "archived"
    assert one(spark, S.policy_status(F.lit("candidate"), F.lit(2), F.lit(0.2))) == "active"
    assert one(spark, S.policy_status(F.lit("archived"), F.lit(9), F.lit(0.9))) == "archived"
    assert one(spark, S.status_after_drift(F.lit("active"), F.lit(0.1))) == "archived"
    assert one(spark, S.reward_axes(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 1.0
    assert one(spark, S.world_confidence(F.lit(0.8), F.lit("loose"), F.lit(0.5))) == pytest.approx(0.64)
    assert one(spark, S.eta_after_drift(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.65)


def test_terms():
    assert T.terms("a, b  a|c") == ["a", "b", "a", "c"]
    assert T.needles(" Foo b foo ") == ["foo b foo", "foo"]
    assert T.fts_terms("科幻小说 ok specialterm, a") == ["科幻小说", "specialterm"]
    assert T.pattern_terms("科幻小 ts go!") == ["ts", "go", "科幻小", "科幻", "幻小"]
    assert T.like_escaped("a%b_c\\") == "a\\%b\\_c\\\\"
    assert T.agent_key_of(" A--b c") == "a_b_c"
    assert R.needs_keyword("find trace_abcdefgh_1234") and not R.needs_keyword("find the internationalisation")


def test_redaction(spark):
    cases = {"Authorization: Bearer abc.def": "Authorization: Bearer [redacted]", 'token = "zz"': "token=[redacted]", "password=hunter, x": "password=[redacted], x", "see ?key=1&b=2": "see ?key=[redacted]&b=2", '{"secret": "q"}': '{"secret":"[redacted]"}'}
    for raw, want in cases.items():
        assert one(spark, T.redacted(F.lit(raw))) == want


def test_djb2(spark):
    h = 5381
    for c in "docker|_|":
        h = (h * 33 + ord(c)) % (1 << 32)
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    assert one(spark, T.djb2_base36(F.lit("docker|_|"))) == out


def test_error_signatures(spark):
    text = "TypeError: cannot read x\nexit code: 127 now\nENV_NOT_SET and ENV_NOT_SET"
    got = T.error_signatures_of(text)
    assert got[0].startswith("TypeError") and "ENV_NOT_SET" in got and len(got) <= 4
    assert one(spark, T.error_code(F.lit("failed: exit code: 7"))) == "EXIT_7"


def test_rules(spark):
    f = lambda t: one(spark, R.turn_feedback(F.lit(t))["polarity"])
    assert [f("Perfect!"), f("that is wrong"), f("not correct"), f("next time use x"), f("hm"), f("")] == ["positive", "negative", "positive", "negative", "neutral", "neutral"]
    r = lambda t, p, g: one(spark, R.turn_relation(F.lit(t), F.lit(p), F.lit(g))["relation"])
    assert [r("wrong, redo", "x", 0), r("and also this", "x", 0), r("new topic please", "x", 0), r("hi", "", 0), r("hi", "x", 3 * 3_600_000), r("", "x", 0)] == ["revision", "follow_up", "new_task", "new_task", "new_task", "unknown"]


def test_turns(spark):
    rows = [(1, i, r, "t") for i, r in enumerate(["system", "user", "assistant", "user", "user", "assistant"])]
    df = C.split_turns(spark.createDataFrame(rows, "c long, o long, role string, text string"), "c", "o", "role")
    assert [r["turn_no"] for r in df.orderBy("o").collect()] == [0, 1, 1, 2, 3, 3]
    assert [r["complete"] for r in C.complete_turns(df, "c", "o", "role", "text").orderBy("turn_no").collect()] == [False, True, False, True]


def test_reflection_windows(spark):
    df = spark.createDataFrame([("a", 6), ("b", 7), ("c", 0), ("d", 12)], "g string, n int")
    got = sorted((r["g"], r["start"], r["end"]) for r in C.reflection_windows(df, "g", "n").collect())
    assert got == [("a", 0, 6), ("b", 0, 6), ("b", 5, 7), ("d", 0, 6), ("d", 5, 11), ("d", 10, 12)]


def test_upsert_and_import(spark):
    fields = "k string, id string, user_id string, tags array<string>, version int, v string"
    old = spark.createDataFrame([("x", "a1", "u1", ["p"], 1, "old")], fields)
    new = spark.createDataFrame([("x", "b1", "u2", ["q", "p"], 1, "new"), ("y", "b2", "u2", ["r"], 1, "n")], fields)
    got = {r["k"]: (r["id"], r["user_id"], list(r["tags"]), r["version"], r["v"]) for r in Q.upsert(old, new, ["k"], "tags", "version").collect()}
    assert got == {"x": ("a1", "u1", ["p", "q"], 2, "new"), "y": ("b2", "u2", ["r"], 1, "n")}
    assert Q.imported(old, new, "k", "skip").filter("k = 'x'").first()["v"] == "old"
    assert Q.imported(old, new, "k", "replace").filter("k = 'x'").first()["v"] == "new"
    with pytest.raises(ValueError):
        Q.imported(old, new, "k", "error")


def test_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2, "decomposes"), (1, 2, 3, "continues"), (1, 3, 1, "continues"), (1, 2, 4, "side_branch"), (1, 4, 5, "continues")], "graph long, source long, target long, type string")
    nodes = spark.createDataFrame([(1, 1, "task", "active", 1, 1), (1, 2, "step", "done", 1, 1), (1, 3, "step", "active", 1, 1), (1, 4, "step", "active", 9, 1), (1, 5, "step", "blocked", 9, 1)], "graph long, id long, kind string, status string, importance long, updated_at long")
    start = spark.createDataFrame([(1, 1)], "graph long, root long")
    assert {r["node"] for r in G.reachable(start, edges).collect()} == {1, 2, 3, 4, 5}
    assert G.makes_cycle(spark.createDataFrame([(1, 5, 1), (1, 1, 5)], "graph long, source long, target long"), edges).orderBy("source").select("cycle").collect() == [(False,), (True,)]
    assert {r["node"] for r in G.side_branches(nodes, edges).collect()} == {4, 5}
    assert G.active_paths(nodes, edges).first()["path"] == [1, 2, 3]
    assert G.root_task(nodes).first()["id"] == 1


def test_mmr_prefers_what_is_new(spark):
    rows = [(1, "a", "tier2", 0.0, 1.0, [1.0, 0.0]), (1, "b", "tier2", 0.0, 0.95, [1.0, 0.0]), (1, "c", "tier2", 0.0, 0.9, [0.0, 1.0]), (1, "d", "tier1", 0.0, 0.1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, id string, tier string, rrf double, relevance double, vector array<double>")
    got = [r["id"] for r in X.mmr(df, limit=3).orderBy("place").collect()]
    assert got[0] == "a" and set(got) == {"a", "c", "b"} and got.index("c") < got.index("b")


def test_vectors_travel(spark):
    df = spark.createDataFrame([([1.5, -2.0],)], "v array<float>")
    assert list(df.select(L.unpacked_vector(L.packed_vector(F.col("v"))).alias("v")).first()["v"]) == [1.5, -2.0]


def test_readers(spark, tmp_path):
    lines = ['{"type":"session","id":"s1","cwd":"/w"}', '{"call_id":"c1","name":"grep","role":"user","text":"hi","at":"2024-01-01T00:00:00Z"}', "broken", "", "[1]", '{"call_id":"c1","role":"robot","text":"ok"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = D.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 3
    assert {r["session_id"] for r in D.with_carried_session(rows).collect()} == {"s1"}
    assert [r["tool_name"] for r in D.with_tool_names(rows.filter("json like '%call_id%'")).collect()] == ["grep", "grep"]
    got = D.recipe(rows, "src", {"role": "$.role", "text": "$.text", "at": "$.at"}, {"user": "user"}).collect()
    assert [(r["role"], r["text"], len(r["id"])) for r in got] == [("user", "hi", 24)]
    (tmp_path / "b.json").write_text(json.dumps({"data": {"items": [{"x": 1}, {"x": 2}]}}))
    assert D.json_records(spark, str(tmp_path / "b.json"), "$.data.items").count() == 2
    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("create table m(id integer, t text)")
    db.executemany("insert into m values (?, ?)", [(1, "a"), (2, "b")])
    db.commit()
    db.close()
    assert D.sqlite_rows(spark, str(tmp_path / "c.db"), "select id, t from m", "id long, t string").count() == 2
    with pytest.raises(ValueError):
        D.sqlite_rows(spark, "x", "select 1; drop table m", "x long")
    assert [r["line_no"] for r in D.grep(spark, str(tmp_path), "brok.n", glob="*.jsonl").collect()] == [3]
    assert D.find_files(spark, str(tmp_path), "*.db").count() == 1
    assert set(D.with_columns(rows, {"file": "string", "none": "long"}).columns) == {"file", "none"}


def test_zstd(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "a.zst").write_bytes(zstandard.compress(b"one\ntwo") + zstandard.compress(b"\nthree"))
    (tmp_path / "b.zst").write_bytes(b"plain")
    assert sorted(r["text"] for r in D.zstd_lines(spark, str(tmp_path)).collect()) == ["one\ntwo\nthree", "plain"]


def test_streams(spark, tmp_path):
    rows = [(i, f"k{i % 3}", "t", i % 4 != 0, f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "step long, key string, tool string, failed boolean, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = Z.event_stream(spark, str(tmp_path / "in"), "step long, key string, tool string, failed boolean, at timestamp")
    assert Z.run_to_end(Z.deduped(s, "key", "at"), "dedup_out", str(tmp_path / "c1")).count() == 3
    got = sorted((r["step"], r["failures"]) for r in Z.run_to_end(Z.failure_bursts(s.select("tool", "step", "failed"), 3, 3), "burst_out", str(tmp_path / "c2")).collect())
    assert got == [(r["step"], r["failures"]) for r in C.failure_bursts(df, "tool", "step", "failed", 3, 3).orderBy("step").collect()]


def test_diversity_against_the_definition(spark):
    """Greedy choice by relevance less redundancy, spelled out."""
    import random

    rng = random.Random(2)
    rows = [(1, f"m{i:02d}", f"tier{i % 3 + 1}", rng.random(), round(rng.random(), 3), None if i % 9 == 8 else [rng.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, id string, tier string, rrf double, relevance double, vector array<double>")
    got = {r["id"]: r["score"] for r in X.mmr(df, 8).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    chosen: dict[str, float] = {}
    by = {r[1]: r for r in rows}

    def score(r):
        near = [cos(r[5], by[c][5]) for c in chosen if by[c][5] is not None] if r[5] is not None else []
        if not any(by[c][5] is not None for c in chosen):
            return r[4]
        return X.LAMBDA * r[4] - (1 - X.LAMBDA) * (max(near) if near else 0.0)

    def best(pool):
        r = max(sorted(pool, key=lambda r: (-r[4], r[1])), key=score)
        chosen[r[1]] = score(r)

    top = max(r[4] for r in rows)
    for tier in ("tier1", "tier2", "tier3"):
        own = [r for r in rows if r[2] == tier and r[4] >= top * X.SEED_RATIO and r[1] not in chosen]
        if own:
            best(own)
    while len(chosen) < 8:
        best([r for r in rows if r[1] not in chosen])
    assert set(got) == set(chosen) and all(abs(got[c] - chosen[c]) < 1e-9 for c in chosen)


def test_zones_and_schedules():
    from datetime import datetime, timezone

    ms = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)
    summer, winter = datetime(2024, 7, 1, tzinfo=timezone.utc), datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert [M.zone_offset(z, summer) for z in (None, "UTC+5:30", "-08", "GMT+2", "Europe/Berlin")] == [0, 330, -480, 120, 120]
    assert M.zone_offset("Europe/Berlin", winter) == 60
    base = ms(2024, 1, 31, 10, 7)
    assert M.next_run("cron", base, cron="*/15 * * * *") == ms(2024, 1, 31, 10, 15)
    assert M.next_run("cron", base, cron="0 9 1 * *") == ms(2024, 2, 1, 9, 0)
    assert M.next_run("cron", base, cron="30 8 29 2 *") == ms(2024, 2, 29, 8, 30)
    assert M.next_run("cron", base, cron="0 0 13 * 5") == ms(2024, 2, 2, 0, 0)  # a Friday comes first
    assert M.next_run("cron", base, cron="0 9 * * 1-5", zone="America/New_York") == ms(2024, 1, 31, 14, 0)
    assert M.next_run("cron", base, cron="0 0 30 2 *") is None
    assert [M.next_run("at", 5, at_ms=9), M.next_run("at", 9, at_ms=9), M.next_run("every", 5, every_ms=10), M.next_run("every", 5)] == [9, None, 15, None]


def test_stable_hashes_agree(spark):
    assert one(spark, M.stable_hash_of(b=F.lit("ü\"x"), a=F.lit(3))) == M.stable_hash({"a": 3, "b": "ü\"x"})
    for t in ("see job_2024:retry-17 now", "short_id1", "abcdefghijklmnopqrst"):
        assert one(spark, R.holds_identifier(F.lit(t))) == R.needs_keyword(t)


def test_all_files_are_found(spark, tmp_path):
    import __spark_entry__ as entry

    for i in range(1, 131):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    assert D.find_files(spark, str(tmp_path), "*.txt").count() == 100
    found = D.find_files(spark, str(tmp_path), "*.txt", limit=None)
    assert sorted(r["length"] for r in found.collect()) == list(range(1, 131))
    plan = entry.queries()["found_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
