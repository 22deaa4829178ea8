"""Differences of two datasets, and versions of one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.expr.compiler import Value, as_text, is_number, is_text
from loomspark.functions.columns import hash_key
from loomspark.operators.quantiles import quantile
from loomspark.operators.stages import SEQ, data_columns, ident, value_of, with_sequence


def same(a: Value, b: Value) -> Column:
    """Equal values: texts after squeezing white space, numbers within 1e-9 of their size or 1e-12; null equals null."""
    if is_text(a) and is_text(b):
        sq = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
        return sq(a.col).eqNullSafe(sq(b.col))
    if is_number(a) and is_number(b):
        x, y = a.col.cast("double"), b.col.cast("double")
        close = F.abs(x - y) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-12))
        return F.coalesce(close, x.isNull() & y.isNull())
    return as_text(a).col.eqNullSafe(as_text(b).col)


def _keyed(df: DataFrame, key: list[str], side: str, fields: list[str]) -> DataFrame:
    """One row per key, the last of equal ones."""
    rows = with_sequence(df)
    k = F.concat_ws("\u001f", *[hash_key(as_text(value_of(rows, c)).col) for c in key])
    full = F.lit(True)
    for c in key:
        full = full & ident(c).isNotNull()
    got = rows.filter(full).select(k.alias("__k"), SEQ, F.struct(*[ident(c) if c in df.columns else F.lit(None).alias(c) for c in [*key, *[f for f in fields if f not in key]]]).alias("r"))
    return got.groupBy("__k").agg(F.max_by("r", SEQ).alias(side))


def diff(old: DataFrame, new: DataFrame, key: list[str], ignore: list[str] | None = None) -> DataFrame:
    """``(key..., change, fields)``: change is added, removed, changed or unchanged; ``fields`` has
    (field, old, new, delta, ratio) of every differing field. Rows without a full key aren't here (``bag_difference``)."""
    skip = {*key, *(ignore or [])}
    fields = [c for c in dict.fromkeys([*data_columns(old), *data_columns(new)]) if c not in skip]
    o, n = _keyed(old, key, "o", fields), _keyed(new, key, "n", fields)
    j = o.join(n, "__k", "full")
    kinds_o, kinds_n = ({f.name: f.dataType for f in d.schema.fields} for d in (old, new))
    parts = []
    for f in fields:
        a = Value(F.col(f"o.{f}"), kinds_o.get(f, kinds_n.get(f)))
        b = Value(F.col(f"n.{f}"), kinds_n.get(f, kinds_o.get(f)))
        number = is_number(a) and is_number(b)
        x, y = (v.col.cast("double") if number else F.lit(None).cast("double") for v in (a, b))
        item = F.struct(F.lit(f).alias("field"), as_text(a).col.alias("old"), as_text(b).col.alias("new"), F.round(y - x, 10).alias("delta"), F.round(F.try_divide(y - x, x), 6).alias("ratio"))
        parts.append(F.when(~same(a, b), item))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    changed = F.when(both, F.array_compact(F.array(*parts))) if parts else F.when(both, F.array())
    keys = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key]
    out = j.select(*keys, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").alias("c"), changed.alias("fields"))
    return out.withColumn("change", F.coalesce("c", F.when(F.size("fields") > 0, "changed").otherwise("unchanged"))).select(*key, "change", F.coalesce("fields", F.array().cast(out.schema["fields"].dataType)).alias("fields"))


def flat(d: DataFrame, key: list[str]) -> DataFrame:
    """One row per added or removed record and per changed field."""
    return d.filter("change <> 'unchanged'").select(*key, "change", F.explode_outer("fields").alias("f")).select(*key, "change", "f.field", "f.old", "f.new", "f.delta", "f.ratio")


def field_stats(d: DataFrame) -> DataFrame:
    """Per changed field: records, ups, downs, median ratio, values appeared and disappeared."""
    f = d.filter("change = 'changed'").select(F.explode("fields").alias("f")).select("f.*")
    count = lambda c: F.count(F.when(c, 1))
    per = f.groupBy("field").agg(F.count(F.lit(1)).alias("records"), count(F.col("delta") > 0).alias("up"), count(F.col("delta") < 0).alias("down"), count(F.col("old").isNull()).alias("appeared"), count(F.col("new").isNull()).alias("disappeared"))
    return per.join(quantile(f, ["field"], "ratio", name="_m"), "field", "left").select("field", "records", "up", "down", F.round("_m", 6).alias("median_ratio"), "appeared", "disappeared")


def bag_difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) rows as multisets."""
    cols = [c for c in old.columns if c in new.columns]
    a, b = old.select(*cols), new.select(*cols)
    return b.exceptAll(a), a.exceptAll(b)


def digest(df: DataFrame) -> DataFrame:
    """One row ``(rows, digest)``: independent of order, sensitive to multiplicity, combined before its shuffle."""
    row = F.to_json(F.struct(*[ident(c) for c in sorted(data_columns(df))]))
    h = F.sha2(F.coalesce(row, F.lit("null")), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(",", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0)) for i in range(8)]), 256).alias("digest"))


class Versions:
    """Append-only versions of a dataset in a folder: one Parquet partition each and a manifest table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def list(self) -> list[dict]:
        try:
            rows = self.spark.read.json(f"{self.path}/manifest").orderBy("version").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return []
            raise
        return [r.asDict() for r in rows]

    def commit(self, df: DataFrame, message: str = "", force: bool = False) -> int:
        """Writes a version unless its digest equals the latest; gives its number."""
        have = self.list()
        d = digest(df).first()
        if have and have[-1]["digest"] == d["digest"] and not force:
            return have[-1]["version"]
        n = (have[-1]["version"] if have else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/data/version={n}")
        row = json.dumps({"version": n, "rows": d["rows"], "digest": d["digest"], "message": message})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")
        return n

    def resolve(self, ref: int | str = "latest") -> int:
        have = [v["version"] for v in self.list()]
        if not have:
            raise ValueError("there are no versions")
        if ref in ("latest", "previous"):
            if ref == "previous" and len(have) < 2:
                raise ValueError("there is no previous version")
            return have[-1 if ref == "latest" else -2]
        n = int(str(ref).removeprefix("v"))
        if n not in have:
            raise ValueError(f"there is no version {ref}")
        return n

    def load(self, ref: int | str = "latest") -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/version={self.resolve(ref)}")

    def diff(self, old: int | str, new: int | str, key: list[str], **options) -> DataFrame:
        return diff(self.load(old), self.load(new), key, **options)
