"""Knowledge graphs: nodes and typed edges with sources, counts and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.columns import hash_key


def node_id(kind: str, name) -> object:
    """``kind:slug`` of a name column."""
    return F.concat(F.lit(kind + ":"), F.regexp_replace(hash_key(name), r"(?U)[^\w]+", "-"))


def build_graph(records: DataFrame, subject: tuple[str, str], facts: list[tuple[str, str, str]], source: str = "url", confidence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). ``subject`` is (kind, field), each fact (relation, kind, field).

    Equal facts merge: count, distinct sources, greatest confidence. Combined before the shuffle.
    """
    kind, name = subject
    src = node_id(kind, F.col(name))
    c = F.col(confidence).cast("double") if confidence else F.lit(1.0)
    rows = F.array(*[F.struct(F.lit(rel).alias("relation"), F.lit(k).alias("kind"), F.col(f).cast("string").alias("name"), node_id(k, F.col(f).cast("string")).alias("dst")) for rel, k, f in facts])
    long = records.filter(F.col(name).isNotNull()).select(src.alias("src"), F.col(name).cast("string").alias("subject"), F.col(source).cast("string").alias("source"), c.alias("confidence"), F.explode(rows).alias("f")).filter("f.name is not null and trim(f.name) <> ''")
    edges = long.groupBy("src", F.col("f.relation").alias("relation"), F.col("f.dst").alias("dst")).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("source").alias("sources"), F.max("confidence").alias("confidence"))
    subjects = records.filter(F.col(name).isNotNull()).select(src.alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    objects = long.select(F.col("f.dst").alias("id"), F.col("f.kind").alias("kind"), F.col("f.name").alias("name"))
    spelled = subjects.unionByName(objects).groupBy("id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    nodes = spelled.groupBy("id", "kind").agg(F.max(F.struct("n", "name")).alias("b"), F.sum("n").alias("mentions")).select("id", "kind", F.col("b.name").alias("name"), "mentions")
    return nodes, edges


def degree(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` counting edges at both ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbors(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    out = e.filter(F.col("src") == node).select("relation", F.col("dst").alias("id"), F.lit("out").alias("direction"))
    return out.unionByName(e.filter(F.col("dst") == node).select("relation", F.col("src").alias("id"), F.lit("in").alias("direction")))


def find(nodes: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    n = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    return n.filter(hash_key(F.col("name")).contains(text.casefold()))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "csv") -> None:
    """Folders ``nodes`` and ``edges`` in a form that graph databases import (csv with their header names, json, parquet)."""
    if form == "csv":
        nodes.select(F.col("id").alias("id:ID"), F.col("kind").alias(":LABEL"), "name", "mentions").write.mode("overwrite").csv(f"{path}/nodes", header=True)
        edges.select(F.col("src").alias(":START_ID"), F.col("relation").alias(":TYPE"), F.col("dst").alias(":END_ID"), "count", "sources", "confidence").write.mode("overwrite").csv(f"{path}/edges", header=True)
    else:
        nodes.write.mode("overwrite").format(form).save(f"{path}/nodes")
        edges.write.mode("overwrite").format(form).save(f"{path}/edges")
