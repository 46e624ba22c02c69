"""What the corpus operators share: staged tables, Arrow views, flat-array tools.

Staged tables are Parquet under ``spark.checkpoint.dir``, the one folder that the
driver and all executors share; reading them back cuts lineage, so a lost
executor costs the re-run of a few tasks and never of an earlier Python pass.
"""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.session import shared_dir, ship

#: The contract's white space: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_serial = itertools.count()
_staged: list[tuple[SparkSession, str, str]] = []
_scope: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """What is staged inside belongs to name, and goes with release(spark, name)."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns what a scan of it gives. The files
    go when their scope is released, or the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemolake/{name}-{next(_serial)}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _staged.append((spark, path, _scope.get()))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Deletes one staged table, which nothing reads any more."""
    path = df._staged_at  # type: ignore[attr-defined]
    _staged[:] = [x for x in _staged if x[1] != path]
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, name: str) -> None:
    """Deletes the tables staged in a scope. Call only when their results are stored."""
    gone = [p for s, p, own in _staged if s is spark and own == name]
    _staged[:] = [x for x in _staged if x[1] not in gone]
    for p in gone:
        _delete(spark, p)


@atexit.register
def _release_all() -> None:
    for spark, name in {(id(x[0]), x[2]): (x[0], x[2]) for x in _staged}.values():
        try:
            release(spark, name)
        except Exception:  # the JVM may be gone by now
            return


def tune(spark: SparkSession) -> None:
    """Ships the code, and bounds what one Arrow batch holds, so long texts cannot
    fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text, th): only the columns in use, so others may have any name.

    th is a hash of the text; (doc_id, th) stands for a row in joins, which keeps
    rows apart that share a doc_id but not the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *more)


def with_fields(rows: DataFrame, drop: tuple[str, ...], more: str) -> T.StructType:
    """The schema of rows without the columns of drop, and with the fields of more (DDL), none of
    which may be there already."""
    kept = [f for f in rows.schema.fields if f.name not in drop]
    added = T.StructType.fromDDL(more).fields
    if clash := sorted({f.name.lower() for f in kept} & {f.name.lower() for f in added}):
        raise ValueError(f"carried columns may not be named as those that are added: {', '.join(clash)}")
    return T.StructType([*kept, *added])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given runs, run after run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (two multiply-xorshift rounds), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def numbered(df: DataFrame, group: str, key: Column, name: str, rows_per_part: int = 4096) -> DataFrame:
    """Adds a gapless number from 0 within each group, in an order that key fixes.

    key is a long that spreads evenly (a hash); ties get any order. Rows are dealt
    to (group, part), parts being ranges of key, so no task sorts a whole group;
    offsets come from the parts' counts.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_parts"))
    dealt = df.join(sizes, group)
    dealt = dealt.withColumn("_key", key).withColumn("_part", F.floor((F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53))) * F.col("_parts")))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(group, "_part", (F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = W.partitionBy(group, "_part").orderBy("_key")
    return dealt.withColumn("_at", F.row_number().over(within) - 1).join(offsets, [group, "_part"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_parts", "_key", "_part", "_at", "_before")
