"""Analyses of search rankings: rows (query, position, url, domain, type, fetched)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(results: DataFrame) -> DataFrame:
    """The rows of each query's latest collection: the time is aggregated (combined), then joined."""
    last = results.groupBy("query").agg(F.max("fetched").alias("__t"))
    return results.join(last.withColumnRenamed("query", "__q"), F.col("query").eqNullSafe(F.col("__q")) & F.col("fetched").eqNullSafe(F.col("__t"))).drop("__q", "__t")


def _inverse(c: Column) -> Column:
    """1 / position as an exact decimal, so that sums don't depend on their order."""
    return (1 / c).cast("decimal(20,12)")


def best_positions(results: DataFrame) -> DataFrame:
    return results.filter("domain is not null and position is not null").groupBy("domain", "query").agg(F.min("position").alias("best"))


def competitors(results: DataFrame, top: int = 20) -> DataFrame:
    """Domains by visibility: the sum of 1 / best position over all queries."""
    now = latest(results)
    queries = now.agg(F.count_distinct("query").alias("queries"))
    per = best_positions(now).groupBy("domain").agg(F.count(F.lit(1)).alias("found"), F.sum(_inverse(F.col("best"))).alias("v"), F.avg("best").alias("a"), F.min("best").alias("best"))
    out = per.join(F.broadcast(queries)).select("domain", "found", "best", F.round("a", 2).alias("average"), F.round(F.col("v").cast("decimal(30,12)") / F.col("queries"), 4).cast("double").alias("visibility"))
    return out.orderBy(F.col("visibility").desc(), "average", "domain").limit(top)


def visibility(results: DataFrame, domain: str) -> DataFrame:
    now = latest(results)
    queries = now.agg(F.count_distinct("query").alias("queries"))
    mine = best_positions(now).filter(F.col("domain") == domain).agg(F.coalesce(F.sum(_inverse(F.col("best"))), F.lit(0)).cast("decimal(30,12)").alias("v"))
    return mine.join(F.broadcast(queries)).select(F.round(F.try_divide(F.col("v"), F.col("queries")), 4).cast("double").alias("visibility"))


def gaps(results: DataFrame, domain: str, rivals: list[str]) -> DataFrame:
    """Queries where a rival is found and the domain isn't: ``(query, rivals, best)``."""
    now = latest(results)
    best = best_positions(now)
    theirs = best.filter(F.col("domain").isin(*rivals)).groupBy("query").agg(F.count(F.lit(1)).alias("rivals"), F.min("best").alias("best"))
    return theirs.join(best.filter(F.col("domain") == domain), "query", "left_anti")


def ranking_changes(old: DataFrame, new: DataFrame, domain: str) -> DataFrame:
    """Per query of both collections: old and new best position, and what became of it."""
    side = lambda df, name: df.groupBy("query").agg(F.min(F.when(F.col("domain") == domain, F.col("position"))).alias(name))
    j = side(old, "before").join(side(new, "after"), "query").filter("before is not null or after is not null")
    a, b = F.col("before"), F.col("after")
    return j.withColumn("change", F.when(a.isNull(), "entered").when(b.isNull(), "left").when(b < a, "up").when(b > a, "down").otherwise("same"))


def ranking_history(results: DataFrame, domain: str) -> DataFrame:
    """Per query and collection: the best position and its change against the collection before."""
    per = results.groupBy("query", "fetched").agg(F.min(F.when(F.col("domain") == domain, F.col("position"))).alias("position"))
    w = Window.partitionBy("query").orderBy("fetched")
    return per.withColumn("change", F.lag("position").over(w) - F.col("position"))


def overlap(results: DataFrame, a: str, b: str, p: float = 0.9) -> DataFrame:
    """One row: Jaccard and rank-biased overlap (normalized) of the urls of two queries."""
    now = latest(results)
    rank = Window.partitionBy("query").orderBy("position", "url")
    top = now.filter(F.col("query").isin(a, b)).groupBy("query", "url").agg(F.min("position").alias("position")).withColumn("r", F.row_number().over(rank))
    x = top.filter(F.col("query") == a).select("url", F.col("r").alias("ra"))
    y = top.filter(F.col("query") == b).select("url", F.col("r").alias("rb"))
    j = x.join(y, "url", "full")
    depth = j.agg(F.greatest(F.max("ra"), F.max("rb")).alias("n"), F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).alias("both"), F.count(F.lit(1)).alias("all"))
    met = j.filter("ra is not null and rb is not null").select(F.greatest("ra", "rb").alias("d"))
    # agreement at depth k counts a meeting at every depth from d on
    per = met.join(F.broadcast(depth)).select("n", F.explode(F.sequence("d", "n")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("x"))
    s = per.agg(F.coalesce(F.sum(F.col("x") / F.col("k") * F.pow(F.lit(p), F.col("k") - 1)), F.lit(0.0)).alias("s"))
    out = s.join(F.broadcast(depth))
    return out.select(F.round(F.try_divide(F.col("both"), F.col("all")), 4).alias("jaccard"), F.round(F.col("s") * (1 - p) / (1 - F.pow(F.lit(p), F.col("n"))), 4).alias("rbo"))


def shared_urls(results: DataFrame, least: int = 3) -> DataFrame:
    """``(a, b, shared)``: pairs of queries with so many urls in common; urls of one query only drop out first."""
    now = latest(results).select("query", "url").distinct()
    several = now.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("url")
    k = now.join(several, "url")
    j = k.alias("x").join(k.alias("y"), (F.col("x.url") == F.col("y.url")) & (F.col("x.query") < F.col("y.query")))
    return j.groupBy(F.col("x.query").alias("a"), F.col("y.query").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def cluster_queries(results: DataFrame, least: int = 3) -> DataFrame:
    """``(query, leader)``: a query joins the first leader with which it shares ``least`` urls."""
    from loomspark.catalog import written

    pairs = written(shared_urls(results, least), "shared")
    queries = latest(results).select("query").distinct()
    links = pairs.select(F.col("b").alias("query"), F.col("a").alias("other"))
    # a query leads unless a smaller leader is linked to it: settled from the smallest on, round by round
    open_, done = written(queries, "queries"), None
    while True:
        blocked = links.join(open_, "query").join(open_.select(F.col("query").alias("other")), "other").select("query").distinct()
        lead = open_.join(blocked, "query", "left_anti")
        joined = links.join(lead.select(F.col("query").alias("other")), "other").groupBy("query").agg(F.min("other").alias("leader"))
        settled = lead.select("query", F.col("query").alias("leader")).unionByName(joined.join(open_, "query", "left_semi"))
        done = written(settled if done is None else done.unionByName(settled), "clusters")
        open_ = written(open_.join(done.select("query"), "query", "left_anti"), "queries")
        if open_.isEmpty():
            return done


def modules(results: DataFrame, top: int = 3) -> DataFrame:
    """Per type of result: queries, results, mean of the best position, most frequent domains."""
    now = latest(results)
    best = now.groupBy("type", "query").agg(F.min("position").alias("m"), F.count(F.lit(1)).alias("n"))
    per = best.groupBy("type").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("results"), F.round(F.avg("m"), 2).alias("average"))
    w = Window.partitionBy("type").orderBy(F.col("n").desc(), "domain")
    doms = now.groupBy("type", "domain").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    names = doms.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("r", "domain"))).alias("d")).select("type", F.array_join(F.col("d.domain"), ", ").alias("domains"))
    return per.join(names, "type", "left")
