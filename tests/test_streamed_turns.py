"""Turns of a shuffled stream against the batch's."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import sessions as C
from mnemolake.streaming import pipelines as Z
from mnemolake.streaming.turns import assembled_turns

SCHEMA = "conv string, no long, role string, text string, at timestamp"


def messages(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(6):
        at = 1_700_000_000 + c * 7
        for no in range(rng.randint(1, 25)):
            at += rng.randint(5, 60)
            role = rng.choice(["user", "assistant", "assistant", "tool", "system" if no == 0 else "user"])
            rows.append((f"c{c}", no, role, rng.choice(["hi", "there", " ", None]), at))
    return rows


def fed(spark, tmp_path, batches, name, **options):
    """Each batch is a file, read in order; a far later message of another conversation ends the stream."""
    end = max(r[4] for b in batches for r in b) + 10 * 86400
    for i, rows in enumerate([*batches, [("end", 0, "user", "x", end)], [("end", 1, "user", "x", end + 1)]]):
        df = spark.createDataFrame(rows, "conv string, no long, role string, text string, at long").withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{i:03}")
    import os
    import time

    os.makedirs(f"{tmp_path}/all", exist_ok=True)
    for i in range(len(batches) + 2):
        for f in sorted(os.listdir(f"{tmp_path}/in-{i:03}")):
            if f.endswith(".parquet"):
                os.replace(f"{tmp_path}/in-{i:03}/{f}", f"{tmp_path}/all/{i:03}-{f}")
                os.utime(f"{tmp_path}/all/{i:03}-{f}", (time.time() - 1000 + i, time.time() - 1000 + i))
    stream = Z.event_stream(spark, f"{tmp_path}/all", SCHEMA)
    got = Z.run_to_end(assembled_turns(stream, "conv", "no", "role", "text", "at", **options), name, f"{tmp_path}/out")
    return sorted(tuple(r) for r in got.filter("conversation <> 'end'").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_batch(spark, tmp_path, seed):
    """Messages come up to five minutes late, and some twice."""
    rng = random.Random(seed)
    rows = messages(seed)
    late = sorted(rows + rng.sample(rows, len(rows) // 3), key=lambda r: r[4] + rng.uniform(0, 300))
    size = len(late) // 5 + 1
    got = fed(spark, tmp_path, [late[i : i + size] for i in range(0, len(late), size)], f"turns{seed}")
    df = spark.createDataFrame(rows, "conv string, no long, role string, text string, at long")
    t = C.split_turns(df, "conv", "no", "role")
    last = t.groupBy("conv", "turn_no").agg(F.max("no").alias("last_no"))
    want = C.complete_turns(t, "conv", "no", "role", "text").join(last, ["conv", "turn_no"]).select("conv", "turn_no", "n", "first_at", "last_no", "complete")
    assert [r[:6] for r in got] == sorted(tuple(r) for r in want.collect())
    newest = {}
    for r in got:
        newest[r[0]] = r
    assert all((r[6] == "idle") == (newest[r[0]] == r) for r in got)


def test_idle_turns_and_messages_that_are_too_late(spark, tmp_path):
    t = 1_700_000_000
    first = [("a", 0, "user", "q", t), ("a", 1, "assistant", "r", t + 10), ("b", 0, "assistant", "alone", t)]
    second = [("a", 2, "assistant", "more", t + 9000), ("a", 3, "user", "q2", t + 9010), ("a", 4, "assistant", "r2", t + 9020)]
    third = [("z", 0, "user", "x", t + 20000)]
    fourth = [("a", 5, "assistant", "far too late", t + 9025), ("a", 4, "assistant", "r2", t + 20001)]
    got = fed(spark, tmp_path, [first, second, third, third, fourth], "idle", gap="1 hour", delay="1 minute")
    assert [r for r in got if r[0] == "a"] == [("a", 0, 2, 0, 1, True, "idle"), ("a", 1, 1, 2, 2, False, "user"), ("a", 2, 2, 3, 4, True, "idle")]
    assert [r for r in got if r[0] == "b"] == [("b", 0, 1, 0, 0, False, "idle")]


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_that_share_calls_are_told_as_if_alone(spark, tmp_path, seed):
    """Late messages and repeats; all conversations together, two groups, and each by itself."""
    rng = random.Random(seed)
    rows = messages(seed)
    late = sorted(rows + rng.sample(rows, len(rows) // 3), key=lambda r: r[4] + rng.uniform(0, 300))
    size = len(late) // 3 + 1
    batches = [late[i : i + size] for i in range(0, len(late), size)]
    alone, two, one = (fed(spark, tmp_path / n, batches, f"{n}{seed}", together=g) for n, g in (("alone", None), ("two", F.crc32("conv") % 2), ("one", F.lit(0))))
    assert len(alone) > 20 and alone == two == one


def test_the_query_calls_and_keeps_state_by_groups_of_conversations(spark, tmp_path, monkeypatch):
    """640 neighbours and three ids that no double tells apart, in some ten groups, not one each."""
    from mnemolake.plans import range_queries as R

    ids = spark.range(640).union(spark.range(2**53, 2**53 + 3))
    c = ids.selectExpr("id as conv_id", "explode(sequence(0L, id % 3)) as turn").selectExpr("*", "if(turn % 2 = 0, 'user', 'assistant') as role", "if(conv_id % 5 = 0, ' ', 'hi') as text")
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(R, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = R.streamed_turns(spark, str(tmp_path)).collect()
    t = C.complete_turns(C.split_turns(c, "conv_id", "turn", "role"), "conv_id", "turn", "role", "text")
    want = t.selectExpr("conv_id", "turn_no", "n", "first_at", "first_at + n - 1", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r[0] for r in got} == {r[0] for r in ids.collect()}
    state = spark.read.format("statestore").load(f"{tmp_path}/turns-out/turns-checkpoint")
    assert 11 <= state.count() <= 12


def test_micro_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    """What deals the messages may make far more files than asked for; they take no more rounds."""
    import os

    from mnemolake.plans import range_queries as R

    c = spark.range(30).selectExpr("id as conv_id", "explode(sequence(0L, 3L)) as turn").selectExpr("*", "if(turn % 2 = 0, 'user', 'assistant') as role", "'hi' as text")
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(R, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    dealt = type(c).repartition
    monkeypatch.setattr(type(c), "repartition", lambda df, n, *by: dealt(df, 24 if n == 5 else n, *by))
    got = R.streamed_turns(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, k, 2, 2 * k, 2 * k + 1, True) for i in range(30) for k in range(2))
    assert len([f for f in os.listdir(f"{tmp_path}/turns") if f.endswith(".parquet")]) > 12
    assert len([f for f in os.listdir(f"{tmp_path}/turns-out/turns-checkpoint/commits") if f.isdigit()]) <= 5
