"""Change history of pages: as-of comparison, change rates, recrawl times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.quantiles import quantile


def compare_runs(pages: DataFrame, old: int, new: int, complete: bool = True) -> DataFrame:
    """``(url, change)``: every url as of ``old`` (its latest snapshot with run <= old) against run ``new``.

    ``pages`` has url, run, status, content. Gone pages (404, 410; absent from a complete run) are
    removed, absent ones of an incomplete run missing, other errors skipped.
    """
    before = pages.filter(F.col("run") <= old).groupBy("url").agg(F.max_by(F.struct("content", "status"), "run").alias("b"))
    after = pages.filter(F.col("run") == new).groupBy("url").agg(F.max_by(F.struct("content", "status"), "run").alias("a"))
    return before.join(after, "url", "full").select("url", _change(F.lit(complete)).alias("change")).filter("change is not null")


def _change(complete: Column) -> Column:
    """The kind of change from the snapshot ``b`` to the snapshot ``a`` (content, status); null where there is none."""
    gone = lambda s: F.coalesce(F.col(s).isin(404, 410), F.lit(False))
    there = F.col("b").isNotNull() & ~gone("b.status")
    return (
        F.when(F.col("a").isNull(), F.when(there, F.when(complete, "removed").otherwise("missing")))
        .when(gone("a.status"), F.when(there, "removed"))
        .when(F.col("a.status") >= 400, "skipped")
        .when(~there, "added")
        .when(F.col("a.content").eqNullSafe(F.col("b.content")), "unchanged")
        .otherwise("modified")
    )


def compare_all_runs(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """``(site, run, url, change)``: every run of a site but its first as ``compare_runs`` has it, against its
    site as of the run before. ``pages`` as there, ``runs`` has run, site, complete, a row for each run.
    """
    taken = pages.groupBy("run", "url").agg(F.max(F.struct("status", "content")).alias("s")).select("run", "url", F.struct("s.content", "s.status").alias("a")).join(runs.select("run", "site"), "run")
    known = taken.groupBy("site", "url").agg(F.min("run").alias("known"))
    starts = runs.groupBy("site").agg(F.min("run").alias("start"))
    grid = known.join(runs.join(starts, "site"), "site").filter("run >= known").join(taken, ["site", "url", "run"], "left")
    earlier = Window.partitionBy("site", "url").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    states = grid.withColumn("b", F.last("a", ignorenulls=True).over(earlier)).filter("run > start")
    return states.select("site", "run", "url", _change(F.col("complete")).alias("change")).filter("change is not null")


def observations(pages: DataFrame) -> DataFrame:
    """``(url, n, changes, first, last, interval)``: one observation per run; a change is a run's first
    content unlike the last of the run before. ``pages`` has url, run, fetched (seconds), content."""
    per = pages.groupBy("url", "run").agg(F.min("fetched").alias("t"), F.min_by("content", "fetched").alias("first_content"), F.max_by("content", "fetched").alias("last_content"))
    w = Window.partitionBy("url").orderBy("run")
    step = per.withColumn("before", F.lag("last_content").over(w)).withColumn("seen", F.lag("run").over(w).isNotNull())
    out = step.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("seen") & ~F.col("first_content").eqNullSafe(F.col("before")), 1)).alias("changes"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.withColumn("interval", F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1))


def freshness(pages: DataFrame, now: float, target: float = 0.5) -> DataFrame:
    """Per url: change rate per day (Cho and Garcia-Molina's estimator with half a change added),
    recrawl interval in seconds (one hour to thirty days), probability that the copy is fresh."""
    o = observations(pages)
    days = F.col("interval") / 86400
    rate = F.when((F.col("n") > 1) & (days > 0), -F.ln((F.col("n") - F.col("changes")) / (F.col("n") + 0.5)) / days)
    recrawl = F.when(F.col("rate") > 0, F.least(F.greatest(-F.ln(F.lit(1 - target)) / F.col("rate") * 86400, F.lit(3600.0)), F.lit(30 * 86400.0))).otherwise(30 * 86400.0)
    fresh = F.when(F.col("rate").isNull(), 1.0).otherwise(F.exp(-F.col("rate") * F.greatest(F.lit(0.0), F.lit(now) - F.col("last")) / 86400))
    return o.withColumn("rate", rate).select("url", "n", "changes", F.round("rate", 6).alias("rate_per_day"), F.round(recrawl, 1).alias("recrawl"), F.round(fresh, 4).alias("fresh"))


def change_frequency(pages: DataFrame, now: float) -> DataFrame:
    """One row: the median change rate per day, four decimals."""
    return quantile(freshness(pages, now), [], "rate_per_day", name="m").select(F.round("m", 4).alias("changes_per_day"))
