"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its normalised bytes, modulo two primes
under 2**31. Fingerprints of neighbouring pieces compose:
``H(AB) = H(A) * r**len(B) + H(B)``; so a huge document is cut into chunks that
other tasks hash, and their hashes are put together by length-shifted sums.
Equal fingerprints only nominate: the texts are then compared chunk by chunk as
they stream past, and unlike ones part ways.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import SPACE_CLASS, SPACES, keyed, stage, tune, utf8

#: The two moduli and the two bases.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 694847539)
CHUNK = 1 << 16


@lru_cache(2)
def _powers(which: int) -> np.ndarray:
    """r**(CHUNK-1), ..., r**1, r**0 modulo the prime."""
    p, r = PRIMES[which], BASES[which]
    out = np.ones(1, np.uint64)
    step = r
    while len(out) < CHUNK:
        out = np.concatenate([out * np.uint64(step) % np.uint64(p), out])
        step = step * step % p
    return out


def piece_hash(data: np.ndarray, which: int) -> int:
    """Of at most CHUNK bytes: products stay under 2**40, their sum under 2**56."""
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), _powers(which)[CHUNK - len(data) :])) % PRIMES[which]


def compose(left: int, right: int, right_length: int, which: int) -> int:
    """The hash of the concatenation."""
    return (left * pow(BASES[which], right_length, PRIMES[which]) + right) % PRIMES[which]


def polynomial(data: bytes) -> tuple[int, int]:
    """Both hashes of the whole, piece after piece."""
    flat, out = np.frombuffer(data, np.uint8), []
    for which in range(2):
        total = 0
        for at in range(0, len(flat), CHUNK):
            piece = flat[at : at + CHUNK]
            total = compose(total, piece_hash(piece, which), len(piece), which)
        out.append(total)
    return out[0], out[1]


def _texts(column: pa.Array) -> Iterator[bytes]:
    at, raw = utf8(column)
    view = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield view[a:b]


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, size, sha = [], [], []
        for text in _texts(batch.column("text")):
            norm = text.translate(None, SPACES)
            a, b = polynomial(norm)
            fp.append(a << 31 | b)
            size.append(len(norm))
            sha.append(hashlib.sha256(norm).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("ncp"), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "ncp", "fp", "nb", "sha"])


def _chunk_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list[int]] = [[], [], [], [], []]
        for text in _texts(batch.column("chunk")):
            norm = text.translate(None, SPACES)
            a, b = polynomial(norm)
            for c, v in zip(cols, (a, b, pow(BASES[0], len(norm), PRIMES[0]), pow(BASES[1], len(norm), PRIMES[1]), len(norm)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "th", "ncp", "no", "sha")] + [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "ncp", "no", "sha", "h1", "h2", "s1", "s2", "nb"])


def fingerprints(rows: DataFrame, huge_chars: int) -> DataFrame:
    """(doc_id, th, ncp, fp, nb, sha) of keyed rows."""
    spark, rows = rows.sparkSession, rows.withColumn("ncp", F.length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    small = rows.filter(F.col("ncp") <= huge_chars).mapInArrow(_fingerprints, f"doc_id {kind}, th long, ncp long, fp long, nb long, sha string")
    # each row of a huge document is told apart by a number, as rows may repeat
    pieces = (
        rows.filter(F.col("ncp") > huge_chars)
        .withColumn("sha", F.sha2(F.regexp_replace("text", SPACE_CLASS, ""), 256))
        .withColumn("row", F.monotonically_increasing_id())
        # cut in one pass over the text
        .select("doc_id", "th", "ncp", F.struct("sha", "row").alias("sha"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{huge_chars}}}"), F.lit(0))).alias("no", "chunk"))
        .select("doc_id", "th", "ncp", "no", F.to_json("sha").alias("sha"), "chunk")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "no")
    )
    hashed = pieces.mapInArrow(_chunk_hashes, f"doc_id {kind}, th long, ncp long, no int, sha string, h1 long, h2 long, s1 long, s2 long, nb long")
    # length-shifted sums over a document's chunks, in order
    join = "aggregate(parts, named_struct('a', 0L, 'b', 0L), (t, x) -> named_struct('a', (t.a * x.s1 + x.h1) % {0}L, 'b', (t.b * x.s2 + x.h2) % {1}L))".format(*PRIMES)
    huge = (
        hashed.groupBy("doc_id", "th", "ncp", "sha")
        .agg(F.array_sort(F.collect_list(F.struct("no", "h1", "h2", "s1", "s2"))).alias("parts"), F.sum("nb").alias("nb"))
        .withColumn("t", F.expr(join))
        .select("doc_id", "th", "ncp", (F.col("t.a") * (1 << 31) + F.col("t.b")).alias("fp"), "nb", F.get_json_object("sha", "$.sha").alias("sha"))
    )
    return small.unionByName(huge)


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that ends at the first chunk that differs."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (fp, nb, salt); a class is a number within that group.

    Memory: the distinct texts of the group at hand, one but for collisions.
    """
    group, seen = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("fp", "nb", "salt", "salts")), strict=True))
        number, first = [], []
        for key, text in zip(keys, _texts(batch.column("text")), strict=True):
            norm = text.translate(None, SPACES)
            if key[:3] != group:
                group, seen = key[:3], []
            cls = next((k for k, x in enumerate(seen) if same(x, norm)), len(seen))
            first.append(norm if cls == len(seen) and key[3] > 1 else None)
            if cls == len(seen):
                seen.append(norm)
            number.append(cls)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "th", "ncp", "m", "row1", "fp", "nb", "salt")] + [pa.array(number, pa.int32()), pa.array(first, pa.binary())], names=["doc_id", "th", "ncp", "m", "row1", "fp", "nb", "salt", "cls", "rep"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Across salts: the first texts of each salt's classes, sorted by (fp, nb)."""
    group, seen = None, []
    for batch in batches:
        number = []
        for fp, nb, text in zip(*(batch.column(c).to_pylist() for c in ("fp", "nb", "rep")), strict=True):
            if (fp, nb) != group:
                group, seen = (fp, nb), []
            cls = next((k for k, x in enumerate(seen) if same(x, text)), len(seen))
            if cls == len(seen):
                seen.append(text)
            number.append(cls)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fp", "nb", "salt", "cls")] + [pa.array(number, pa.int32())], names=["fp", "nb", "salt", "cls", "gcls"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = 1 << 18, salt_rows: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, th (a
    hash of the text as it is).

    Null texts count as empty, and all empty texts form one group. Of equal texts
    the one with the most code points stays, then the smallest doc_id (null ids
    first); of rows that repeat whole, one. Documents of over huge_chars are hashed
    in chunks by many tasks. Groups of over salt_rows copies are compared in salted
    parts, whose first texts are then compared with each other. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs, id_col, text_col)
    # rows that repeat whole are told apart by a number, stored with them
    slim = stage(fingerprints(rows, huge_chars).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    hot = slim.groupBy("fp", "nb").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp", "nb", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    hot = stage(hot, "repeated")  # stored, so that the join below deals both sides and can split a hot key
    # counted before the join, which is then free to split a hot fingerprint
    members = slim.groupBy("doc_id", "th", "fp", "nb", "ncp").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("row1")).join(hot, ["fp", "nb"])
    members = members.withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, th), salts) as int)"))
    # a copy of a (doc_id, text) row adds nothing to compare
    texts = rows.join(members.withColumnRenamed("doc_id", "mid"), F.col("mid").eqNullSafe(F.col("doc_id")) & (members["th"] == rows["th"])).select("mid", members["th"], "ncp", "m", "row1", "fp", "nb", "salt", "salts", "text").withColumnRenamed("mid", "doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    dealt = texts.repartition(n, "fp", "nb", "salt").sortWithinPartitions("fp", "nb", "salt")
    classes = stage(dealt.mapInArrow(_classes, f"doc_id {kind}, th long, ncp long, m long, row1 long, fp long, nb long, salt int, cls int, rep binary"), "classes")
    across = classes.filter("rep is not null").select("fp", "nb", "salt", "cls", "rep").repartition(n, "fp", "nb").sortWithinPartitions("fp", "nb")
    across = across.mapInArrow(_merged, "fp long, nb long, salt int, cls int, gcls int")
    part = ["fp", "nb", "salt", "cls"]
    one = classes.dropDuplicates(["doc_id", "th", *part]).groupBy(part).agg(F.min(F.struct((-F.col("ncp")).alias("less"), "doc_id", "th")).alias("best"), F.sum("m").alias("size"))
    one = one.join(across, part, "left").withColumn("gcls", F.coalesce("gcls", "cls"))
    whole = one.groupBy("fp", "nb", "gcls").agg(F.min("best").alias("top"), F.sum("size").alias("group_size"))
    known = one.select(*part, "gcls").join(whole, ["fp", "nb", "gcls"]).select(*part, "top", "group_size")
    found = classes.select("doc_id", "th", "row1", *part).distinct().join(known, part).select(F.col("doc_id").alias("mid"), F.col("th").alias("mth"), "row1", "top", "group_size")
    out = slim.join(found, F.col("mid").eqNullSafe(F.col("doc_id")) & (F.col("mth") == F.col("th")), "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("row") == F.col("row1")) & F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.th") == F.col("th")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "th",
    )


#: DuckDB; white space is deleted before texts are held against each other.
ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS ncp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY ncp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
