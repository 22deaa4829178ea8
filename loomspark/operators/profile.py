"""Profiles of datasets: completeness, kinds, shapes, distinct values, drift, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.catalog import written
from loomspark.expr.compiler import as_text, is_number
from loomspark.operators.quantiles import quantile
from loomspark.operators.stages import data_columns, ident, value_of

WEIGHTS = {"completeness": 0.3, "validity": 0.3, "uniqueness": 0.15, "consistency": 0.15, "freshness": 0.1}
_PLACEHOLDER = r"(?i)^\s*(n/?a|n\.a\.|none|null|nil|undefined|unknown|tb[acd]|todo|-{1,3}|–|—|\?+|\.{2,3}|…|\{\{.*\}\})\s*$"


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(field, value)`` rows of the data columns, in one projection."""
    cols = columns or data_columns(df)
    return df.select(*[as_text(value_of(df, c)).col.alias(c) for c in cols]).unpivot([], cols, "field", "value")


def shape(c: Column) -> Column:
    """Runs of digits as 9, of letters as a; long texts and URLs by name."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)\p{L}+", "a"), r"(?U)\d+", "9")
    return F.when(c.rlike(r"(?i)^https?://"), "url").when(F.char_length(c) > 60, "text").otherwise(s)


def kind(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d+$"), "int").when(c.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "float").when(c.rlike("(?i)^(true|false)$"), "bool").otherwise("str")


def profile_fields(df: DataFrame) -> DataFrame:
    """Per field: rows, present, empty, placeholders, damaged, distinct, completeness.

    ``distinct`` is exact: values are counted first (combined before the shuffle), then the fields.
    """
    v = F.col("value")
    empty = v.isNull() | (F.trim(v) == "")
    per = long_form(df).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("field").agg(F.sum("n").alias("rows"), F.sum(F.when(empty, 0).otherwise(F.col("n"))).alias("present"), F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("empty"), F.sum(F.when(v.rlike(_PLACEHOLDER), F.col("n")).otherwise(0)).alias("placeholders"), F.sum(F.when(v.contains("�"), F.col("n")).otherwise(0)).alias("damaged"), F.count(F.when(~empty, 1)).alias("distinct"))
    return out.withColumn("completeness", F.round(F.col("present") / F.col("rows"), 4))


def approximate_distinct(df: DataFrame) -> DataFrame:
    """Per field an HLL estimate of its distinct values (2^14 registers), in one pass."""
    return long_form(df).filter("value is not null").groupBy("field").agg(F.approx_count_distinct("value", 0.01).alias("distinct"))


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """``(field, rank, value, n)``: the most frequent values, by value among equals."""
    per = long_form(df).filter("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")  # Spark keeps k rows per task before the shuffle
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("field", "rank", "value", "n")


def profile_shapes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(field, shape, n)`` of all present values."""
    return long_form(df, columns).filter("value is not null").groupBy("field", shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def consistency(df: DataFrame) -> DataFrame:
    """Per field: share of its main kind times share of its main shape (if it has at most 20)."""
    v = long_form(df).filter("value is not null and trim(value) <> ''").groupBy("field", kind(F.col("value")).alias("kind"), shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    kinds = v.groupBy("field", "kind").agg(F.sum("n").alias("n")).groupBy("field").agg((F.max("n") / F.sum("n")).alias("k"))
    shapes = v.groupBy("field", "shape").agg(F.sum("n").alias("n")).groupBy("field").agg((F.max("n") / F.sum("n")).alias("s"), F.count(F.lit(1)).alias("shapes"))
    return kinds.join(shapes, "field").select("field", F.round(F.col("k") * F.when(F.col("shapes") <= 20, F.col("s")).otherwise(1.0), 4).alias("consistency"))


def numeric_profile(df: DataFrame) -> DataFrame:
    """Per numeric field: n, least, largest, mean, deviation, median and median absolute deviation."""
    cols = [c for c in data_columns(df) if is_number(value_of(df, c))]
    long = df.select(*[ident(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "field", "value").filter("value is not null")
    mid = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    medians = quantile(long, ["field"], "value")
    far = long.join(F.broadcast(medians), "field").select("field", F.abs(F.col("value") - F.col("median")).alias("far"))  # a row per field is broadcast
    mid, mad = mid.join(medians, "field"), quantile(far, ["field"], "far", name="mad")
    return mid.join(mad, "field").select("field", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "deviation", "median", "mad")])


def mad_outliers(df: DataFrame, key: str, column: str, limit: float = 8.0, least: int = 20) -> DataFrame:
    """Rows whose distance from the median is over ``limit`` scaled median absolute deviations."""
    v = df.select(ident(key).alias("key"), ident(column).cast("double").alias("value")).filter("value is not null")
    mid = quantile(v, [], "value").first()
    middle = mid[0] if mid else None
    far = F.abs(F.col("value") - F.lit(middle))
    spread = quantile(v.select(far.alias("far")), [], "far").first()
    mad = spread[0] if spread else None
    if not mad or v.count() < least:
        return v.limit(0).withColumn("z", F.lit(None).cast("double"))
    z = 0.6745 * far / F.lit(mad)
    return v.withColumn("z", F.round(z, 6)).filter(z > limit).select("key", "value", "z")


def score(df: DataFrame, key: list[str], errors: Column | None = None, updated: Column | None = None, now: str | None = None, fresh_days: float = 30.0) -> DataFrame:
    """One row: completeness, validity, uniqueness, consistency, freshness and the weighted score."""
    cols = data_columns(df)
    n = F.count(F.lit(1))
    filled = sum((F.count(F.when(as_text(value_of(df, c)).col.isNotNull() & (F.trim(as_text(value_of(df, c)).col) != ""), 1)) for c in cols), F.lit(0))
    parts = df.agg(n.alias("rows"), (filled / (n * len(cols))).alias("completeness"), (F.lit(1.0) if errors is None else 1 - F.count(F.when(errors, 1)) / n).alias("validity"), *([F.avg(F.when(F.datediff(F.lit(now).cast("date"), updated.cast("date")) <= fresh_days, 1.0).otherwise(0.0)).alias("freshness")] if updated is not None else []))
    distinct = df.select(*[ident(k) for k in key]).distinct().agg(n.alias("keys"))
    out = parts.join(F.broadcast(distinct)).withColumn("uniqueness", F.col("keys") / F.col("rows"))
    out = out.join(F.broadcast(consistency(df).agg(F.avg("consistency").alias("consistency"))))
    have = [m for m in WEIGHTS if m in out.columns]
    total = sum(WEIGHTS[m] for m in have)
    s = sum((F.col(m) * (WEIGHTS[m] / total) for m in have), F.lit(0.0))
    return out.select("rows", *[F.round(m, 4).alias(m) for m in have], F.round(s, 4).alias("score"))


def compare_profiles(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(field, finding)`` of two tables from ``profile_fields``: appeared, disappeared, collapsed, dropped."""
    a = new.select("field", F.col("completeness").alias("c1"), F.col("rows").alias("r1"))
    b = old.select("field", F.col("completeness").alias("c0"), F.col("rows").alias("r0"))
    j = a.join(b, "field", "full")
    f = F.when(F.col("c0").isNull(), "field-appeared").when(F.col("c1").isNull(), "field-disappeared").when((F.col("c0") >= 0.5) & (F.col("c1") <= 0.1 * F.col("c0")), "extraction-collapse").when(F.col("c0") - F.col("c1") >= 0.1, "completeness-drop").when(F.col("r1") < 0.5 * F.col("r0"), "volume-drop")
    return j.select("field", f.alias("finding")).filter("finding is not null")


def schema_drift(new: T.StructType, old: T.StructType) -> dict[str, list[str]]:
    a, b = {f.name: f.dataType for f in new}, {f.name: f.dataType for f in old}
    return {"added": sorted(a.keys() - b.keys()), "removed": sorted(b.keys() - a.keys()), "retyped": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov distance, and whether it shows a shift (alpha 0.001, 30 values).

    Values are counted first; the running sums go over ranges of values, each summed in parallel, and
    the ranges' totals are added on.
    """
    both = a.select(ident(column).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(ident(column).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))).filter("v is not null")
    per = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = per.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    parts = written(per.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("p").agg(F.sum("x").alias("px"), F.sum("y").alias("py"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sums.select("p", F.coalesce(F.sum("px").over(before), F.lit(0)).alias("ox"), F.coalesce(F.sum("py").over(before), F.lit(0)).alias("oy"))
    within = Window.partitionBy("p").orderBy("v")
    run = parts.withColumn("cx", F.sum("x").over(within)).withColumn("cy", F.sum("y").over(within)).join(F.broadcast(offsets), "p").join(F.broadcast(total))
    d = run.agg(F.max(F.abs((F.col("cx") + F.col("ox")) / F.col("nx") - (F.col("cy") + F.col("oy")) / F.col("ny"))).alias("d"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    critical = 1.94947 * F.sqrt((F.col("nx") + F.col("ny")) / (F.col("nx") * F.col("ny")))
    return d.select(F.round("d", 6).alias("d"), ((F.col("d") > critical) & (F.col("nx") >= 30) & (F.col("ny") >= 30)).alias("shifted"))


def reservoir(df: DataFrame, n: int = 512, seed: int = 0, key: str | None = None) -> DataFrame:
    """``n`` rows by a seeded hash of the key (or of all columns): the same rows in every run."""
    h = F.xxhash64(*([ident(key)] if key else [ident(c) for c in df.columns]), F.lit(seed))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")
