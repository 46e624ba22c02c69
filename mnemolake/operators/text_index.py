"""A full-text index that follows a change feed.

A batch of changes becomes a segment: the changed documents with their terms, their
postings sorted by term, and how each term's document frequency changed. A document's
newest segment counts, older postings of it are dead; no file is written again until a
compaction merges all live postings into one segment. Frequencies are sums of changes, so a
batch costs what it changes, not what the index holds.

    {root}/{table}/{segment}      docs (id, len, terms), postings (term, id, tf, len), deltas (term, n)
    {root}/manifest/{version}     which segments count, and the documents and words of each

A manifest is written last; the newest complete one is the index, so a batch that fails
half-way leaves it as it was and is simply applied again. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.operators.queues import last_write

_WORD = r"[^\p{L}\p{N}]+"
_MANIFEST = "no long, name string, docs long, words long"


def with_terms(docs: DataFrame) -> DataFrame:
    """(id, deleted, len, terms) of (id, deleted, text); ids are distinct. Rows that are dealt by id
    are not dealt again."""
    words = F.filter(F.split(F.lower(F.col("text")), _WORD), lambda t: t != "")
    each = docs.select("id", "deleted", F.explode_outer(F.when(~F.col("deleted"), words)).alias("term"))
    counted = each.groupBy("id", "deleted", "term").agg(F.count("term").alias("tf"))
    held = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return counted.groupBy("id", "deleted").agg(F.sum("tf").alias("len"), held.alias("terms"))


#: Words of 64 bits that tell apart rows whose id cannot be among given ones.
WORDS = 1 << 17


def parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id (a column of both) is not among the ids for sure, and the others, of which it
    may be. Bits of a hash stand for the ids: as many rows as WORDS are broadcast at most, so that
    a join of few changed documents needs no shuffle of all that the index holds."""
    h = F.xxhash64("id")
    word, bit = F.pmod(h, F.lit(WORDS)), F.shiftrightunsigned(h, 58).cast("int")
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    told = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return told.filter(~maybe).select(*rows.columns), told.filter(maybe).select(*rows.columns)


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: T.DataType | None = None) -> None:
        """root: a folder that the driver and all executors share."""
        self.spark, self.root = spark, root.rstrip("/")
        self.id_type = id_type or T.LongType()

    # --- files -----------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and done(s.getPath()))

    def segments(self) -> list[tuple[int, str, int, int]]:
        """(number, name, documents added, words added), oldest first."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/{versions[-1]}").collect()  # a row a segment
        return sorted((r["no"], r["name"], r["docs"], r["words"]) for r in rows)

    def _publish(self, segments: Sequence[tuple[int, str, int, int]]) -> None:
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        self.spark.createDataFrame(list(segments), _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{new}")

    def _table(self, table: str, schema: T.StructType, segments: Sequence[tuple[int, str, int, int]]) -> DataFrame:
        """A table's rows of the given segments, with the segment's number."""
        out = None
        for no, name, *_ in segments:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{name}").withColumn("seg", F.lit(no).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("seg", T.LongType())]))

    def _docs(self, segments: Sequence[tuple[int, str, int, int]]) -> DataFrame:
        term = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
        return self._table("docs", T.StructType([T.StructField("id", self.id_type), T.StructField("deleted", T.BooleanType()), T.StructField("len", T.LongType()), T.StructField("terms", T.ArrayType(term))]), segments)

    # --- writing ---------------------------------------------------------------------------
    def apply(self, changes: DataFrame) -> None:
        """changes: (seq, id, text, deleted). Of a batch's changes of a document the last counts;
        a null text has no words; deleting what is not there does nothing."""
        before = self.segments()
        no, name = (before[-1][0] + 1 if before else 0), uuid.uuid4().hex[:12]
        last = last_write(changes, ["id"], [F.desc("seq")]).select("id", "deleted", "text")
        with_terms(last).write.parquet(f"{self.root}/docs/{name}")
        new = self._docs([(no, name, 0, 0)])
        self._post(new, name)
        # what the changed documents held until now
        ids = new.select(F.col("id").alias("_id"))
        old = parted(self._docs(before), new.select("id"))[1].join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        old = old.groupBy("id").agg(F.max_by(F.struct("deleted", "len", "terms"), "seg").alias("d")).select("id", "d.*")
        each = lambda d, n: d.filter("not deleted").select(F.explode("terms.term").alias("term"), F.lit(n).cast("long").alias("n"))
        deltas = each(new, 1).unionByName(each(old, -1)).groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0")
        deltas.sortWithinPartitions("term").write.parquet(f"{self.root}/deltas/{name}")
        live = lambda d: d.filter("not deleted").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        (docs, words), (gone, gone_words) = live(new), live(old)
        self._publish([*before, (no, name, docs - gone, words - gone_words)])

    def _post(self, docs: DataFrame, name: str) -> None:
        """A segment's postings, of its documents as they are dealt."""
        posted = docs.select(F.explode("terms").alias("t"), "id", "len").select("t.term", "id", "t.tf", "len")
        posted.sortWithinPartitions("term", "id").write.parquet(f"{self.root}/postings/{name}")

    def compact(self) -> None:
        """One segment of all that is live. The old segments' files stay for readers that hold
        them; ``sweep`` deletes them."""
        before = self.segments()
        if len(before) < 2:
            return
        no, name = before[-1][0] + 1, uuid.uuid4().hex[:12]
        same, changed = parted(self._docs(before), self._docs(before[1:]).select("id"))
        newest = changed.groupBy("id").agg(F.max_by(F.struct("deleted", "len", "terms"), "seg").alias("d")).select("id", "d.*")
        same.select(*newest.columns).unionByName(newest).filter("not deleted").write.parquet(f"{self.root}/docs/{name}")
        self._post(self._docs([(no, name, 0, 0)]), name)
        self.frequencies().withColumnRenamed("df", "n").sortWithinPartitions("term").write.parquet(f"{self.root}/deltas/{name}")
        docs, words = self.totals()
        self._publish([(no, name, docs, words)])

    def sweep(self) -> None:
        """Deletes what no longer counts: earlier manifests and their segments."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        kept = {name for _, name, *_ in self.segments()}
        for table in ("docs", "postings", "deltas", "manifest"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            fs = path.getFileSystem(conf)
            newest = {str(v) for v in self._versions()[-1:]}
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in (newest if table == "manifest" else kept):
                    fs.delete(s.getPath(), True)

    # --- reading ---------------------------------------------------------------------------
    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(id, term, tf, len) of live documents. Asked terms reach the scan, whose files are
        sorted by term; dead postings are told by the documents changed since the oldest
        segment, not by the index."""
        segments = self.segments()
        schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", self.id_type), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
        found = self._table("postings", schema, segments)
        if terms is not None:
            found = found.filter(F.col("term").isin([t.lower() for t in terms]))
        if len(segments) < 2:
            return found.select("id", "term", "tf", "len")
        same, found = parted(found, self._docs(segments[1:]).select("id"))
        changed = self._docs(segments[1:]).groupBy(F.col("id").alias("_id")).agg(F.max("seg").alias("_seg"))
        live = found.join(changed, F.col("id").eqNullSafe(F.col("_id")), "left").filter(F.col("_seg").isNull() | (F.col("_seg") <= F.col("seg")))
        return same.unionByName(live.select(*same.columns)).select("id", "term", "tf", "len")

    def frequencies(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, df): sums of the segments' changes."""
        found = self._table("deltas", T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]), self.segments())
        if terms is not None:
            found = found.filter(F.col("term").isin([t.lower() for t in terms]))
        return found.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def totals(self) -> tuple[int, int]:
        """Live documents, and their words."""
        s = self.segments()
        return sum(x[2] for x in s), sum(x[3] for x in s)

    def bm25(self, asked: Sequence[str], at_least: int = 1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, hits, bm25) of documents with at least so many of the asked terms."""
        terms = list(dict.fromkeys(t.lower() for t in asked))
        docs, words = self.totals()
        idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(words / docs if docs else 1.0)))
        joined = self.postings(terms).join(F.broadcast(self.frequencies(terms)), "term")  # a row an asked term
        return joined.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.sum(part).alias("bm25")).filter(F.col("hits") >= at_least)
