"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes what its predecessor kept and, but for the last, returns the
columns of documents, whatever else there is beside the five it knows. ORACLE_SQL is
None: language ID and near dedup are beyond SQL; tests/llm holds the pipeline against a
brute-force version.
"""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm import bpe, exact_dedup, language_id, mixing, queries, simhash_similar
from mnemolake.llm.common import WORD_CLASS, release, scope, stage

#: A document goes if its language is in doubt: no letters, or a posterior below this.
MIN_SCORE = 0.5
ORACLE_SQL = None
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_runs = itertools.count()
#: The run that this thread is in; runs of other threads have their own.
_run: ContextVar[str] = ContextVar("run", default="")
#: Stages called apart, by folder: (place, time of the call, scope), earliest first.
_apart: dict[str, list[tuple[int, float, str]]] = {}


def _stage(place: int, keeps: bool = True) -> Callable[[Step], Step]:
    """A stage sees the columns it knows under their names, and others under names that
    clash with none; those get their own back. What a stage sets aside is deleted when a
    later stage of the same run begins, as its result is stored by then. Of stages called
    apart from a run, that holds only if the later one reads files written since."""

    def wrap(step: Step) -> Step:
        @functools.wraps(step)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = _run.get()
            if own:
                for earlier in range(place):
                    release(spark, f"{own}:{earlier}")
            else:
                own = f"apart-{next(_runs)}"
                known, written = _apart.setdefault(sf_dir, []), _written(spark, docs)
                for earlier in [x for x in known if x[0] < place and x[1] < written]:
                    release(spark, earlier[2])
                    known.remove(earlier)
                known.append((place, time.time(), f"{own}:{place}"))
            plain = docs.toDF(*[c if c in KNOWN else f"extra_{i}" for i, c in enumerate(docs.columns)])
            with scope(f"{own}:{place}"):
                out = step(spark, plain, sf_dir)
            return out.select(*plain.columns).toDF(*docs.columns) if keeps else out

        return run

    return wrap


def _written(spark: SparkSession, docs: DataFrame) -> float:
    """When the first of the files that docs is read from was written; 0 if there is none."""
    for name in docs.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1000
    return 0.0


def _rowed(docs: DataFrame) -> DataFrame:
    """docs with __th: (doc_id, __th) tells rows apart that share a doc_id."""
    return docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _same(docs: DataFrame, keys: DataFrame) -> Column:
    """Rows of docs and of keys (id, th)."""
    return docs["doc_id"].eqNullSafe(keys["id"]) & (docs["__th"] == keys["th"])


@_stage(0)
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay, as they are; texts that are null or have
    no letter go. Rows are judged one by one, repeats alike."""
    model = language_id.fit(docs.filter(~queries.held_out()).select("doc_id", "text", "lang"))
    told = language_id.identify(docs, model, "doc_id", "text", *[c for c in docs.columns if c != "doc_id"])
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))


@_stage(1)
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays; of rows that repeat whole, one. Null and
    empty texts form one group. Null doc_ids are ids like any other."""
    rows = exact_dedup.exact_dedup(docs).groupBy(F.col("doc_id").alias("id"), "th").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "rows")
    own = _rowed(docs)
    gone, twice = rows.filter("not stays"), rows.filter("stays and n > 1")
    left = own.join(gone, _same(own, gone), "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, _same(left, twice), "left_anti").unionByName(left.join(twice, _same(left, twice), "left_semi").dropDuplicates(["doc_id", "__th"]))
    return left


@_stage(2)
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash with verified links: texts whose five-word shingles have a Jaccard similarity
    of 0.8 or more are linked. Of each component the row with the smallest doc_id stays (null last), then with the
    smallest hash of its text; rows that repeat whole stay or go together."""
    found = stage(simhash_similar.near_texts(docs).select(F.col("doc_id").alias("id"), "th", "root"), "near")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th"))
    best = found.groupBy("root").agg(first.alias("b")).select(F.col("root").alias("r"), F.col("b.id").alias("bid"), F.col("b.th").alias("bth"))
    gone = found.join(best, F.col("root") == F.col("r")).filter(~(F.col("id").eqNullSafe(F.col("bid")) & (F.col("th") == F.col("bth")))).select("id", "th").distinct()
    own = _rowed(docs)
    return own.join(gone, _same(own, gone), "left_anti")


@_stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut ends after as
    many words as the budget has left. Rows without words are taken zero times. Rows that
    repeat whole are taken each; what the cut takes of them is shared out as one row's."""
    own = _rowed(docs)
    plan = mixing.mix(own, "doc_id", "text", "source", "mix", "__th").filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("__th").alias("th"), "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
    copies = F.row_number().over(W.partitionBy("doc_id", "__th").orderBy("size"))
    rows = own.join(plan, _same(own, plan))
    if not plan.filter("n > 1").isEmpty():
        rows = rows.withColumn("__copy", copies).filter("__copy = 1").drop("__copy")
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__epoch") - 1) * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words == F.col("size"), F.col("text")).otherwise(cut)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


@_stage(4, keeps=False)
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and digests; a document taken twice has two rows."""
    return bpe.encode_decode(docs, queries.vocabulary())


STAGES = [("language_id", languages), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Of what this run sets aside, only what its
    result is read from stays; other results of the session keep theirs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = f"run-{next(_runs)}"
    token = _run.set(own)
    try:
        for place, (name, step) in enumerate(STAGES[:-1]):
            with scope(f"{own}:stored:{place}"):
                docs = stage(step(spark, docs, sf_dir), name)
            release(spark, f"{own}:{place}")
            release(spark, f"{own}:stored:{place - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _run.reset(token)
