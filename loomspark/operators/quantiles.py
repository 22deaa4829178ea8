"""Exact quantiles of groups of any size: values are counted, the counts summed over ranges of values.

An exact percentile aggregate keeps every distinct value of a group in one buffer. Here each task sums
a range of (group, value), and only the sums of ranges are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.catalog import written


def counted(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The written counts of every value of every group, by ranges: (groups, _v, _n, _p); null values are left out."""
    per = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return written(per.repartitionByRange(*groups, "_v").withColumn("_p", F.spark_partition_id()), "counts")


def running(counts: DataFrame, groups: list[str]) -> DataFrame:
    """``counted`` values with the places they take in their group: from ``_b`` up to before ``_e``, of ``_t``."""
    sums = counts.groupBy("_p", *groups).agg(F.sum("_n").alias("_s"))
    of = Window.partitionBy(*groups)
    before = of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sums.withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_t", F.sum("_s").over(of)).drop("_s")
    offsets = offsets.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)}).withColumnRenamed("_p", "_q")
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    end = F.sum("_n").over(Window.partitionBy("_p", *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_e", end).join(offsets, same).withColumn("_e", F.col("_e") + F.col("_o")).select(*groups, "_v", (F.col("_e") - F.col("_n")).alias("_b"), "_e", "_t")


def quantile_of(counts: DataFrame, groups: list[str], q: float = 0.5, name: str = "median") -> DataFrame:
    """``(groups, name)`` of ``counted`` values: the quantile, interpolated between neighbours; a null group is one."""
    holds = lambda k: (F.col("_b") <= k) & (k < F.col("_e"))
    both = running(counts, groups).withColumn("_k", (F.col("_t") - 1) * q).filter(holds(F.floor("_k")) | holds(F.ceil("_k")))
    pick = lambda k: F.max(F.when(holds(k), F.col("_v")))
    part = F.max(F.col("_k") - F.floor("_k"))
    out = both.groupBy(*groups).agg((pick(F.floor("_k")) * (1 - part) + pick(F.ceil("_k")) * part).alias(name))
    return out.filter(F.col(name).isNotNull())  # no row of no values


def value_at(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(groups, q, value)``: the values at the index floor(q n) of each group in order; q below 1."""
    rows = running(counted(df, groups, value), groups).withColumn("q", F.explode(F.array(*[F.lit(x) for x in shares])))
    at = F.floor(F.col("q") * F.col("_t"))
    return rows.filter((F.col("_b") <= at) & (at < F.col("_e"))).select(*groups, "q", F.col("_v").alias("value"))


def quantile(df: DataFrame, groups: list[str], value: str, q: float = 0.5, name: str = "median") -> DataFrame:
    """``(groups, name)``: the exact quantile of the non-null values of every group that has any."""
    return quantile_of(counted(df, groups, value), groups, q, name)


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups, count, min, max, mean, median)`` of the non-null values, from one pass over the rows."""
    counts = counted(df, groups, value)
    stats = counts.groupBy(*groups).agg(F.sum("_n").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    mid = quantile_of(counts, groups).withColumnsRenamed({g: f"_m{i}" for i, g in enumerate(groups)})
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_m{i}"))
    return stats.join(mid, same).select(*groups, "count", "min", "max", "mean", "median")
