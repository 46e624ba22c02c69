"""Many small files: what is written grows with bytes, not with the number of files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mnemolake.plans import source_queries as S
from mnemolake.sources import histories as H
from mnemolake.sources import readers as D


def files_of(folder, end=""):
    return [os.path.join(at, f) for at, _, found in os.walk(folder) for f in found if not f.startswith((".", "_")) and f.endswith(end)]


def test_packs_hold_the_files_lines(spark, tmp_path):
    """600 files of up to 7 lines, some of them malformed, blank, or with tabs."""
    kinds = F.element_at(F.array(*map(F.lit, ['{"a":1}', '{"b":"x\ty"}', '{"a": "x\\ty"}', "{oops", " ", "[1]", ' {"c":2}'])), (F.col("n") + 1).cast("int"))
    rows = spark.range(600).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("id") % 7))).withColumn("line", kinds)
    D.pack(rows, F.concat(F.lit("f="), "id"), ["n"], f"{tmp_path}/packs")
    rows.repartition(4, "id").sortWithinPartitions("id", "n").select("id", "line").write.partitionBy("id").text(f"{tmp_path}/files")
    got = H.numbered_lines(D.packed_json_lines(spark, f"{tmp_path}/packs")).select(F.split_part("file", F.lit("="), F.lit(2)).cast("long").alias("id"), "line_no", "json")
    want = H.numbered_lines(D.json_lines(spark, f"{tmp_path}/files")).select(F.regexp_extract("file", "id=([0-9]+)", 1).cast("long").alias("id"), "line_no", "json")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 1000


def test_histories_write_few_files(spark, tmp_path, monkeypatch):
    c = spark.range(400).selectExpr("id as conv_id", "explode(sequence(0L, 2L)) as turn").selectExpr("*", "if(turn = 0, 'user', 'assistant') as role", "concat('text ', turn) as text")
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(S, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    for name in ("transcripts", "rollouts", "carried_sessions", "envelopes", "loose_messages", "framed_sessions"):
        got = getattr(S, f"history_{name}")(spark, str(tmp_path))
        assert got.count() == 1200
    for name in ("transcripts", "rollouts", "carried", "envelopes", "loose", "framed"):
        assert 0 < len(files_of(f"{tmp_path}/{name}")) < 40


def test_a_file_a_conversation_without_folders_of_their_own(spark, tmp_path):
    c = spark.range(300).selectExpr("id as conv_id", "explode(sequence(0L, id % 4)) as turn").selectExpr("*", "concat('line ', turn, ' ä') as line")
    S._files(c, f"file://{tmp_path}/files")
    found = files_of(f"{tmp_path}/files")
    assert len(found) == 300 and len({os.path.dirname(f) for f in found}) <= 64
    for f in found:
        k = int(f.rsplit("=", 1)[1].removesuffix(".txt"))
        with open(f, encoding="utf-8") as text:
            assert text.read() == "".join(f"line {i} ä\n" for i in range(k % 4 + 1))


def test_keywords_are_told_by_their_literals():
    from mnemolake.functions import rules as R

    assert R.needed(r"\bsql\b|\bselect\s|\binsert\s") == ("sql", "select", "insert")
    assert R.needed(r"\bauth(entication|orization)?\b|\btoken\b|\boauth\b") == ("auth", "token", "oauth")
    assert R.needed(r"\bx?\b") == ()
    assert all(R.needed(p) for p, _ in R.KEYWORD_TAGS)
