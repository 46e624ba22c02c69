"""Registered queries over orders that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import ranges as R
from mnemolake.operators.text_index import TextIndex
from mnemolake.plans.queries import Col, query, words
from mnemolake.plans.source_queries import _folder, _json
from mnemolake.plans.views import table
from mnemolake.sources import readers as I
from mnemolake.streaming.pipelines import run_to_end
from mnemolake.streaming.turns import assembled_turns


@query("SELECT event_id, f::BIGINT AS failures FROM (SELECT *, sum((event_id % 4 <> 0)::INT) OVER w AS f, sum((event_id % 4 = 0)::INT) OVER w AS g FROM events WINDOW w AS (ORDER BY event_id RANGE BETWEEN 8 PRECEDING AND CURRENT ROW)) WHERE event_id % 4 <> 0 AND f >= 3 AND g = 0 OR event_id % 4 <> 0 AND f >= 6")
def bursts_of_one_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as steps of one tool, dealt to tasks by ranges of steps; a success in four."""
    e = table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("tool"), (Col("event_id") % 4 != 0).alias("failed"))
    own = R.dealt(e, "tool", "event_id", 4000, reach=8)
    w = W.partitionBy("tool", "range").orderBy("event_id").rangeBetween(-8, 0)
    told = own.withColumns({"failures": F.sum(Col("failed").cast("int")).over(w), "good": F.sum((~Col("failed")).cast("int")).over(w)})
    return told.filter("not _halo and failed and (failures >= 3 and good = 0 or failures >= 6)").select("event_id", "failures")


@query("WITH o AS (SELECT *, row_number() OVER w - 1 AS n, sum(value) OVER w AS total, lag(event_type) OVER w AS before, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS last_purchase FROM events WINDOW w AS (ORDER BY event_id)) SELECT event_id, n, round(total, 3) AS total, before, last_purchase FROM o")
def one_long_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, running sums, carried and previous values over all events as one order."""
    e = R.dealt(table(spark, sf_dir, "events").withColumn("key", F.lit(None).cast("string")), "key", "event_id", 4000)
    out = R.numbered(e, ["key"], ["event_id"], "n")
    out = R.summed(out, ["key"], ["event_id"], Col("value"), "total")
    out = R.carried(out, ["key"], ["event_id"], {"last_purchase": F.when(Col("event_type") == "purchase", Col("event_id"))})
    out = R.previous(out, ["key"], ["event_id"], {"before": Col("event_type")})
    return out.select("event_id", Col("n").cast("long").alias("n"), F.round("total", 3).alias("total"), "before", "last_purchase")


@query("WITH e AS (SELECT *, user_id % 4 AS g FROM events), o AS (SELECT *, row_number() OVER w - 1 AS line_no, max(CASE WHEN event_id % 7 = 0 THEN event_id END) OVER w AS s FROM e WINDOW w AS (PARTITION BY g ORDER BY event_id)) SELECT event_id, g AS file, line_no, s AS session FROM o WHERE event_id % 7 <> 0")
def large_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the lines of four files, which are read in byte ranges: each line bears its
    number in its file and the session that was opened last."""
    path = _folder(spark, "large")
    head = _json(type=F.lit("session"), id=Col("event_id").cast("string"), cwd=F.lit("/w"))
    line = F.when(Col("event_id") % 7 == 0, head).otherwise(_json(type=F.lit("message"), event_id=Col("event_id"), props=Col("props")))
    e = table(spark, sf_dir, "events").select((Col("user_id") % 4).alias("g"), "event_id", line.alias("line"))
    e.repartition(4, "g").sortWithinPartitions("g", "event_id").select("g", "line").write.partitionBy("g").text(path)
    rows = I.with_carried_session(I.json_lines(spark, path))
    return rows.select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), F.regexp_extract("file", "g=([0-9]+)", 1).cast("long").alias("file"), "line_no", Col("session_id").cast("long").alias("session"))


@query(words("{turns,} t AS (SELECT conv_id, turn_no, count(*) AS n, min(turn) AS first_no, max(turn) AS last_no, arg_min(role, turn) = 'user' AND arg_min(trim(coalesce(text, '')), turn) <> '' AND arg_max(role, turn) = 'assistant' AND arg_max(trim(coalesce(text, '')), turn) <> '' AS complete FROM turns GROUP BY ALL) SELECT conv_id AS conversation, turn_no, n, first_no, last_no, complete FROM t"))
def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of files, dealt by a hash and thus out of order; a last file, a
    month later, lets the watermark pass all messages."""
    path = _folder(spark, "turns")
    at = F.timestamp_seconds(F.lit(1704067200) + Col("turn") * 60).alias("at")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", at)
    c.repartition(5, F.xxhash64("conv_id", "turn")).write.parquet(path)
    files = len(spark.read.schema(c.schema).parquet(path).inputFiles())  # as many as Spark dealt: a third a micro-batch
    end = c.limit(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"), F.timestamp_seconds(F.lit(1704067200 + 30 * 86400)).alias("at"))
    end.write.mode("append").parquet(path)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(path)
    # 64 neighbouring ids share calls and a state
    turns = assembled_turns(stream, "conv_id", "turn", "role", "text", "at", delay="7 days", together=F.shiftright("conv_id", 6))
    told = run_to_end(turns, "turns", _folder(spark, "turns-out"))
    return told.filter("conversation >= 0").select("conversation", "turn_no", "n", "first_no", "last_no", "complete")


#: What the changes leave: every fifth text has a word more, every seventh is gone, but for every fourteenth.
_LIVE = "live AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN coalesce(text, '') || ' updated twice' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)"


def _followed(spark: SparkSession, sf_dir: str) -> TextIndex:
    """An index that follows four batches of changes, with a compaction between them."""
    d = table(spark, sf_dir, "documents").select(Col("doc_id").alias("id"), "text")
    index = TextIndex(spark, _folder(spark, "index"), d.schema["id"].dataType)
    change = lambda rows, seq, text, deleted=False: rows.select((Col("id") + seq).alias("seq"), "id", text.alias("text"), F.lit(deleted).alias("deleted"))
    index.apply(change(d, 0, Col("text")))
    index.apply(change(d.filter("id % 5 = 0"), 10**9, F.concat(F.coalesce("text", F.lit("")), F.lit(" updated twice"))))
    index.compact()
    index.sweep()
    index.apply(change(d.filter("id % 7 = 0"), 2 * 10**9, Col("text"), True))
    index.apply(change(d.filter("id % 14 = 0"), 3 * 10**9, Col("text")))
    return index


@query(r"WITH " + _LIVE + r", t AS (SELECT id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM live) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM t WHERE term <> '' GROUP BY term")
def followed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies kept by sums of changes, beside the words of the live postings."""
    index = _followed(spark, sf_dir)
    tf = index.postings().groupBy("term").agg(F.sum("tf").alias("tf"))
    return index.frequencies().join(tf, "term", "full").select("term", "df", "tf")


@query(
    r"WITH " + _LIVE + r", t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM live) WHERE term <> '' GROUP BY ALL),"
    " l AS (SELECT id, sum(tf) AS len FROM t GROUP BY id), w AS (SELECT count(*) AS docs, (SELECT sum(len) FROM l) / count(*) AS avg_len FROM live), f AS (SELECT term, count(*) AS df FROM t GROUP BY term)"
    " SELECT id, count(*) AS hits, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 5) AS bm25 FROM t JOIN f USING (term) JOIN l USING (id), w WHERE term IN ('license', 'version', 'updated', 'public') GROUP BY id"
)
def followed_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir).bm25(["License", "version", "updated", "public"]).select("id", "hits", F.round("bm25", 5).alias("bm25"))
