"""Filters and lookups over memory rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import text as T


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deleted"))


def all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    """Every wanted tag is there, whatever its case; blank ones ask nothing."""
    out = F.lit(True)
    for t in wanted:
        if t.strip():
            out = out & F.array_contains(F.transform(tags, F.lower), t.strip().lower())
    return out


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    asked = [t.strip().lower() for t in wanted if t.strip()]
    return F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, asked))) if asked else F.lit(True)


def agent(column: Column, equal: str | None = None, excluded: Sequence[str] = ()) -> Column:
    """Equality, or a list to leave out, which null and blank agents pass."""
    if equal and equal.strip():
        return T.agent_key(column) == T.agent_key_of(equal)
    out = [k for k in dict.fromkeys(map(T.agent_key_of, excluded)) if k]
    return (F.coalesce(F.trim(column), F.lit("")) == "") | ~T.agent_key(column).isin(out) if out else F.lit(True)


def memory_filter(df: DataFrame, equal: dict[str, str] | None = None, within: dict[str, Sequence[str]] | None = None, since: str | None = None, until: str | None = None, tags: Sequence[str] = (), **agents: object) -> DataFrame:
    """All conditions at once; an empty list asks nothing; times are half open."""
    df = live(df)
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    for c, vs in (within or {}).items():
        if vs:
            df = df.filter(F.col(c).isin(*vs))
    if since:
        df = df.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    return df.filter(all_tags(F.col("tags"), tags) & agent(F.col("agent_id"), **agents))  # type: ignore[arg-type]


def substring_search(df: DataFrame, query: str, tags: bool = True) -> DataFrame:
    """Rows that hold the whole query or one of its terms in id, key, value or tags."""
    columns = [F.col("id"), F.coalesce(F.col("memory_key"), F.lit("")), F.col("value")] + ([F.array_join("tags", ",")] if tags else [])
    found = T.needles(query)
    return df.filter(T.contains_any(found, columns)) if found else df


def get_many(df: DataFrame, ids: Sequence[str], spark: SparkSession) -> DataFrame:
    """In the order of the list, repeats included. The list is the caller's, and small."""
    asked = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos int")
    return live(df).join(F.broadcast(asked), "id")


def newest_by_key(df: DataFrame, *keys: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    return live(df).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit)


def without(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_r")).distinct(), F.col(left) == F.col("_r"), "left_anti")


def having(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_r")), F.col(left) == F.col("_r"), "left_semi")
