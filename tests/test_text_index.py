"""The index after batches of changes against one built anew."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mnemolake.operators import retrieval as X
from mnemolake.operators.text_index import TextIndex

WORDS = "red green blue cyan rot grün 数据 x1 the the the".split()


def test_equal_to_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    index, now, seq = TextIndex(spark, f"file://{tmp_path}/index"), {}, 0
    assert index.segments() == [] and index.totals() == (0, 0) and index.postings().collect() == [] and index.bm25(["red"]).collect() == []
    for batch in range(6):
        rows = []
        for _ in range([40, 30, 5, 1, 0, 30][batch]):
            seq += 1
            i, deleted = rng.choice([None, *range(25)]), rng.random() < 0.25
            text = rng.choice([None, "", "!?", " ".join(rng.choice(WORDS).upper() if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randint(1, 12)))])
            rows.append((seq, i, text, deleted))
            now[i] = None if deleted else (text,)
        rng.shuffle(rows)
        index.apply(spark.createDataFrame(rows, "seq long, id long, text string, deleted boolean"))
        if batch == 3:
            index.compact()
            assert len(index.segments()) == 1
        live = spark.createDataFrame([(i, t[0]) for i, t in now.items() if t], "id long, text string")
        # null texts have no words
        want = X.postings(live.na.fill("", ["text"]), "id", "text")
        assert sorted(map(tuple, index.postings().select("id", "term", "tf").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert sorted(map(tuple, index.frequencies().collect())) == sorted(map(tuple, want.groupBy("term").count().collect()))
        assert index.totals() == (live.count(), sum(r["tf"] for r in want.collect()))
        near = lambda df: sorted((repr(r["id"]), r["hits"], round(r["bm25"], 9)) for r in df.collect())
        assert near(index.bm25(["red", "Grün", "the", "absent"], 2)) == near(X.bm25(live.na.fill("", ["text"]), "id", "text", ["red", "grün", "the", "absent"], 2))


def test_failed_batches_and_old_files(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    rows = lambda *r: spark.createDataFrame(list(r), "seq long, id long, text string, deleted boolean")
    index.apply(rows((1, 1, "one two", False)))
    monkeypatch.setattr(TextIndex, "_publish", lambda *_: 1 / 0)
    try:
        index.apply(rows((2, 1, "three", False)))
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert sorted(r["term"] for r in index.postings().collect()) == ["one", "two"]
    index.apply(rows((2, 1, "three", False)))
    old = index.postings()
    index.compact()
    assert [r["term"] for r in index.postings().collect()] == [r["term"] for r in old.collect()] == ["three"]
    index.sweep()
    assert len(list((tmp_path / "index" / "postings").iterdir())) == 1 == len(list((tmp_path / "index" / "manifest").iterdir()))
    assert [r["term"] for r in TextIndex(spark, f"file://{tmp_path}/index").postings().collect()] == ["three"]
    plan = index.postings(["three"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,three)]" in plan or "term" in plan.split("PushedFilters: [")[1][:60]


def test_terms_of_documents_dealt_by_id_need_no_shuffle(spark):
    from mnemolake.operators.queues import last_write
    from mnemolake.operators.text_index import with_terms

    rows = [(1, 1, "a b a", False), (2, None, "b", False), (3, 2, None, False), (4, 3, "c c", True), (5, 1, "b b", False)]
    docs = last_write(spark.createDataFrame(rows, "seq long, id long, text string, deleted boolean"), ["id"], [F.desc("seq")])
    told = with_terms(docs)
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["id"]: (r["deleted"], r["len"], sorted(map(tuple, r["terms"]))) for r in told.collect()}
    assert got == {1: (False, 2, [("b", 2)]), None: (False, 1, [("b", 1)]), 2: (False, 0, []), 3: (True, 0, [])}


def test_what_did_not_change_is_not_shuffled(spark, tmp_path):
    """Of 2,000 documents 20 change: neither a batch nor a compaction shuffles the others' terms."""
    from mnemolake.operators import text_index as I

    docs = spark.range(2000).selectExpr("id", "id as seg")
    same, maybe = I.parted(docs, spark.createDataFrame([(i * 100,) for i in range(20)], "id long"))
    assert maybe.count() < 30 and {r["id"] for r in maybe.collect()} >= {i * 100 for i in range(20)}
    assert same.count() + maybe.count() == 2000
    none = docs.selectExpr("if(id < 5, null, id) as id", "seg")
    assert I.parted(none, spark.createDataFrame([(None,)], "id long"))[1].count() >= 5

    index = TextIndex(spark, f"file://{tmp_path}/index")
    rows = spark.range(2000).selectExpr("id as seq", "id", "concat('w', id, ' all') as text", "false as deleted")
    index.apply(rows)
    index.apply(rows.filter("id % 100 = 0").selectExpr("seq + 5000 as seq", "id", "'new all' as text", "deleted"))
    plan = index.postings()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "_bits" in plan
    index.compact()
    assert index.postings().filter("term = 'new'").count() == 20 and index.postings().count() == 4000 == index.totals()[1]
