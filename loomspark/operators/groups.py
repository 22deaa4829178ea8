"""Grouping with labels, shares and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import written
from loomspark.operators.crawl import numbered
from loomspark.operators.quantiles import summary
from loomspark.operators.stages import SEQ, ident, with_sequence


def rounded(c: Column) -> Column:
    return F.round(c, 2)


def group_records(df: DataFrame, by: str, values: list[str] | None = None, currency: str | None = None, top: int | None = None) -> DataFrame:
    """Groups of a field, texts case-folded: label (the most common spelling, the first seen of equal
    ones), count, share and rank (null last, larger first, then by label); of ``values`` count, least,
    largest, mean and median, per currency where ``currency`` names its field.

    Spellings are counted before the label is chosen, so a group of any size is combined first.
    """
    rows = with_sequence(df)
    key = F.lower(F.trim(ident(by).cast("string")))
    spelled = rows.select(key.alias("k"), ident(by).cast("string").alias("s"), SEQ).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("first"))
    per = spelled.groupBy("k").agg(F.sum("n").alias("count"), F.max_by("s", F.struct("n", -F.col("first"))).alias("label"))
    per = written(per, "groups")
    total = per.agg(F.sum("count")).first()[0]
    per = per.withColumn("share", F.round(F.col("count") / F.lit(total), 4))
    order = [F.col("k").isNull(), F.col("count").desc(), F.col("label"), F.col("k")]
    per = numbered(per if top is None else per.orderBy(*order).limit(top), *order, name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    for v in values or []:
        keys = [key.alias("k")] + ([ident(currency).alias("currency")] if currency else [])
        c = ident(v).cast("double")
        names = ["k", "currency"] if currency else ["k"]
        stats = summary(rows.select(*keys, c.alias("v")), names, "v")
        stats = stats.select(*names, F.col("count").alias(f"{v}_count"), *[rounded(F.col(x)).alias(f"{v}_{x}") for x in ("min", "max", "mean", "median")])
        per = per.join(stats.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k")), "left").drop("__k")
    return per.drop("k")
