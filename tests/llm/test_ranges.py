"""Branches that only large inputs take, with their bounds lowered: results stay the same."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from mnemolake.llm import common, mixing, sharding, simhash, simhash_similar, substring_dedup

WORDS = [f"w{i}" for i in range(50)]


def docs(spark, n: int = 300):
    rng = random.Random(1)
    rows = [(i % 70 if i % 7 else None, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))), f"s{i % 3}" if i % 5 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target long")


def test_many_ranges_of_a_source(spark, monkeypatch):
    """Shared and null ids, a carried column with a clashing name."""
    df = docs(spark)
    take = lambda: sorted(map(tuple, mixing.mix(df, "doc_id", "text", "source", "mix").collect()), key=str)
    one = take()
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    assert take() == one
    carried = mixing.mix(df.withColumnRenamed("target", "key"), "doc_id", "text", "source", "mix", "key")
    assert carried.count() == 300 and carried.select("key").distinct().count() == 300


def test_null_ids_spread_over_ranges(spark, monkeypatch):
    rows = [(None, f"{i} text", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(df).agg(F.sum("taken")).first()[0] == 600


def test_numbers_over_many_parts(spark):
    df = docs(spark).withColumn("h", F.xxhash64("target"))
    got = common.numbered(df, "source", F.col("h"), "slot", rows_per_part=4).filter("source is not null").select("source", "slot").collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["source"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(df.drop("h")).count() == 300


def test_fingerprints_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) for _ in range(4000)).encode()
    whole, found = simhash.fingerprint(text), simhash_similar.shingles(text.split())
    wide, bands = simhash_similar.fingerprint(found), simhash_similar.buckets(found)
    monkeypatch.setattr(simhash, "PIECE", 97)
    monkeypatch.setattr(simhash_similar, "PIECE", 97)
    assert simhash.fingerprint(text) == whole
    assert (simhash_similar.fingerprint(found) == wide).all() and (simhash_similar.buckets(found) == bands).all()


def test_wide_fingerprints_follow_the_estimate():
    """Of two sets at 0.8 some 39 of 256 bits differ, and hardly ever more than RADIUS."""
    rng = np.random.default_rng(4)
    apart = []
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 900, np.int64).view(np.uint64)
        b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, np.int64).view(np.uint64)])
        x, y = simhash_similar.fingerprint(np.sort(a)), simhash_similar.fingerprint(np.sort(b))
        apart.append(int(np.bitwise_count(x ^ y).sum()))
    assert 36 < np.mean(apart) < 42 and max(apart) < simhash_similar.RADIUS


def test_repeats_in_small_pieces(spark, monkeypatch):
    rng = random.Random(5)
    body = " ".join(rng.choice(WORDS) for _ in range(120))
    rows = [(i, t) for i, t in enumerate([body, "x " + body + " y", "a b", body[:300], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, substring_dedup.substring_dedup(df).collect()))
    for name, value in (("SEGMENT", 40), ("PIECE", 200)):
        monkeypatch.setattr(substring_dedup, name, value)
        batch = df.withColumn("rid", F.xxhash64("doc_id", "text")).select("rid", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()
        small = {lead for b in substring_dedup._groups(batch) for lead in b.column("lead").to_pylist()}
        monkeypatch.undo()
        assert small == {lead for b in substring_dedup._groups(batch) for lead in b.column("lead").to_pylist()}
    assert [r[2] for r in whole] == [120, 120, 0, whole[3][2], 0]
