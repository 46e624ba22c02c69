"""Ordered windows over groups of any size: a group's order is cut into ranges, windows run
within a range, and what a range must know of those before it comes as one row a range
(counts, sums, last values) or as copies of the rows near its start (a halo).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about.
ROWS = 1_000_000


def beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with small's other columns, by keys of which any may be null."""
    other = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(other[f"_k_{k}"])
    return df.join(other, on, "left").drop(*[f"_k_{k}" for k in keys])


def _reached(bounds: Column, value: Column, most: int) -> Column:
    """How many of the ascending bounds, at most ``most``, are at most value, by halving; 0 for a null
    of either."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.when(bounds.isNull() | value.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) <= value, n + step).otherwise(n)))


def dealt(df: DataFrame, key: str, order: str, rows: int = ROWS, reach: float = 0, range_col: str = "range") -> DataFrame:
    """df with range_col, from 0 in order within each key, and _halo: true for copies of rows
    that lie within ``reach`` (in the unit of order, a number) before a range of which they
    are no part.

    Keys of up to ``rows`` rows are one range. The bounds of larger ones are percentiles, one for
    ``rows`` rows, fetched by the driver once, so that ranges are the same whenever a task
    is run; rows of equal order share a range.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        return df.withColumns({range_col: F.lit(0), "_halo": F.lit(False)})
    parts = -(-most // rows)
    cuts = F.percentile_approx(F.col(order), [i / parts for i in range(1, parts)] or [0.5], 100 * parts)
    large = hot.select(F.col(key).alias("_k"))
    bounds = df.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("_k"))).groupBy(key).agg(F.array_distinct(cuts).alias("_bounds")).collect()  # a number for ``rows`` rows
    kind = T.StructType([T.StructField("_k", df.schema[key].dataType), T.StructField("_bounds", T.ArrayType(df.schema[order].dataType))])
    known = F.broadcast(df.sparkSession.createDataFrame([(r[key], r["_bounds"]) for r in bounds], kind))
    out = df.join(known, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_own", _reached(F.col("_bounds"), F.col(order), parts))
    later = F.filter(F.sequence(F.col("_own") + 1, F.size("_bounds")), lambda r: F.get("_bounds", r - 1) - reach <= F.col(order))
    near = F.col("_bounds").isNotNull() & (F.col("_own") < F.size("_bounds")) & (F.get("_bounds", F.col("_own")) - reach <= F.col(order))
    copies = F.when(near & F.lit(reach > 0), F.concat(F.array("_own"), later)).otherwise(F.array("_own"))
    return out.withColumn(range_col, F.explode(copies)).withColumn("_halo", F.col(range_col) != F.col("_own")).drop("_k", "_bounds", "_own")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, range_col: str = "range") -> DataFrame:
    """name: the row's number from 0 within keys, by a total order; ranges are in order."""
    sizes = df.groupBy(*keys, range_col).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(range_col)) - F.col("_n")
    at = F.row_number().over(W.partitionBy(*keys, range_col).orderBy(*order)) - 1
    return beside(df.withColumn(name, at), sizes.select(*keys, range_col, before.alias("_before")), [*keys, range_col]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def summed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, range_col: str = "range") -> DataFrame:
    """name: the running sum of value, the row included."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*keys, range_col).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*keys).orderBy(range_col)) - F.col("_s")
    own = F.sum("_v").over(W.partitionBy(*keys, range_col).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return beside(df.withColumn(name, F.coalesce(own, F.lit(0))), sums.select(*keys, range_col, before.alias("_before")), [*keys, range_col]).withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_v")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], range_col: str = "range") -> DataFrame:
    """Each named value as it was last not null, at the row or before it."""
    df = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    place = F.struct(*order)
    ends = df.groupBy(*keys, range_col).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values])
    earlier = W.partitionBy(*keys).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, range_col, *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    own = W.partitionBy(*keys, range_col).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = beside(df.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(own) for n in values}), ends, [*keys, range_col])
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values}).drop(*[f"_{p}_{n}" for n in values for p in "vc"])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], range_col: str = "range") -> DataFrame:
    """Each named value as the row before has it, null included; null at a group's first row."""
    place, whole = F.struct(*order), F.struct(*[c.alias(n) for n, c in values.items()])
    df = df.withColumn("_row", whole)
    ends = df.groupBy(*keys, range_col).agg(F.max_by("_row", place).alias("_end"))
    ends = ends.select(*keys, range_col, F.lag("_end").over(W.partitionBy(*keys).orderBy(range_col)).alias("_end"))
    own = W.partitionBy(*keys, range_col).orderBy(*order)
    out = beside(df.withColumns({"_first": F.row_number().over(own) == 1, "_lag": F.lag("_row").over(own)}), ends, [*keys, range_col])
    was = F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_lag"))
    return out.withColumn("_then", was).withColumns({n: F.col("_then")[n] for n in values}).drop("_row", "_first", "_lag", "_end", "_then")
