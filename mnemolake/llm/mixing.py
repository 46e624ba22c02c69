"""Mixing sources to target weights, in DataFrame functions only.

Rows get hash-random keys; within a source they are dealt to ranges of the key, so
a range is sorted by one task and no task sorts a source. Prefix sums of sizes are
then the range's running sum plus what the earlier ranges hold. A source's budget is
cut where the prefix sum reaches it; budgets over a source's size repeat it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm.common import WORD_CLASS, stage

#: Fixed values of the contract: weights by place, in turn; the share; the most epochs.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2
ROWS_PER_RANGE = 4096


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) gains target. One row per source, so one task may rank
    them. What sources cannot take is shared again by weight until none is above its
    limit: with sources ordered by limit / weight, the level at which those up to k are
    full is (total - their limits) / (the others' weights); the largest level holds."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * epochs)
    by_limit = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything) * percent / 100) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything)).withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))).drop("weight", "most", "level")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", *carry: str) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    taken is how many words the mix takes of the row: its size once for each whole
    epoch, and in the last epoch its words up to the budget's cut (the row at the cut
    is taken in part), so a source's taken words are its target, rounded down. Null
    texts have size 0; a null source is a source, the last; texts count whole, however long.
    Rows are ordered by md5 of doc_id, seed and the text's md5, then size; rows that tie
    repeat each other, and which of them the cut falls on makes no difference. carry names
    columns of docs to hand on; others, whatever their names, are ignored. Empty tables
    give empty results.
    """
    # the text counts too: rows that share an id, or have none, spread over the ranges
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed + ":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    # carried columns go in one struct, so their names clash with none
    packed = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None)
    slim = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), packed.alias("carried"), words_in(F.col(text_col)).alias("size"), key.alias("key")), "sizes")
    per = budgets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))).join(slim.groupBy(F.col("source").alias("other")).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_RANGE).alias("ranges")), F.col("source").eqNullSafe(F.col("other"))).drop("other")
    per = stage(per.select(F.col("source").alias("name"), "source_size", "target", "ranges"), "budgets")
    # the key's first 48 bits as a fraction of one: range numbers follow the key's order
    ranged = slim.join(per, F.col("source").eqNullSafe(F.col("name"))).withColumn("range", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48)) * F.col("ranges")))
    held = ranged.groupBy("name", "range").agg(F.sum("size").alias("held"))
    starts = held.select(F.col("name").alias("n2"), F.col("range").alias("r2"), (F.sum("held").over(W.partitionBy("name").orderBy("range")) - F.col("held")).alias("start"))
    inside = F.sum("size").over(W.partitionBy("name", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = ranged.withColumn("inside", inside).join(starts, F.col("name").eqNullSafe(F.col("n2")) & (F.col("range") == F.col("r2")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size") - (F.col("start") + F.col("inside"))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)], "size", "source_size", "target", taken.cast("long").alias("taken"))


#: DuckDB: the same order (md5), sums and level, over whole tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 150 / 100 - coalesce(sum(2 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM e
"""
