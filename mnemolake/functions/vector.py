"""Vector expressions over array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for unequal lengths."""
    na, nb = dot(a, a), dot(b, b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / F.sqrt(na * nb)).otherwise(0.0)


def normalized(v: Column) -> Column:
    """The unit vector; a zero vector as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def centroids(df: DataFrame, group: str, vector: str, order: str) -> DataFrame:
    """(group, centroid): the normalised mean. The group's first vector by order fixes
    the length; others of another length add nothing but count in the divisor."""
    present = df.filter(F.size(vector) > 0)
    dims = present.groupBy(group).agg(F.min_by(F.size(vector), order).alias("dim"), F.count(F.lit(1)).alias("n"))
    parts = present.join(F.broadcast(dims), group).filter(F.size(vector) == F.col("dim")).select(group, "n", F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg((F.sum(F.col("x").cast("double")) / F.first("n")).alias("m"))
    whole = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select(group, normalized(F.col("mean")).alias("centroid"))
