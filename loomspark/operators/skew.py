"""Per-key results without stragglers: fragment-replicate by estimated load.

1. The load of every key comes from one combined count. Only keys above the mean load of a task count as heavy; of T tasks there can be
   fewer than T such keys, so what reaches the driver is bounded by T.
2. Heavy keys are split into shards in proportion to their load. All other keys are hashed into
   V = 16 T virtual buckets, whose loads (V numbers) are summed in the cluster.
3. Shards and buckets are packed into T tasks, largest first, each into the least loaded task.
4. Rows go to the task of their shard or bucket. The matching side of a join is replicated to
   the shards of the heavy keys only; all its other rows go to one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import tasks_of, written

BUCKETS_PER_TASK = 16


@dataclass(frozen=True)
class LoadPlan:
    """Where keys go: ``heavy`` has (key, shards) and ``slots`` the slot of every shard or bucket.

    A slot is an integer whose Spark hash falls into the wanted task, so that
    ``repartition(tasks, slot)`` is the packing and a later ``groupBy`` with the slot among its
    keys needs no second shuffle.
    """

    tasks: int
    buckets: int
    heavy: tuple[tuple[object, int, int], ...]  # key, first index, number of shards
    slots: tuple[int, ...]  # by index: buckets first, then shards
    loads: tuple[int, ...]  # packed load of every task

    def frames(self, spark: SparkSession, key_type) -> tuple[DataFrame, DataFrame]:
        """(heavy keys, slot of each index): fewer than T rows, and at most 18 T rows."""
        from pyspark.sql import types as T

        keys = T.StructType([T.StructField("_hk", key_type), T.StructField("_first", T.IntegerType()), T.StructField("_shards", T.IntegerType())])
        slots = T.StructType([T.StructField("_index", T.IntegerType()), T.StructField("_slot", T.IntegerType())])
        return spark.createDataFrame(list(self.heavy), keys), spark.createDataFrame(list(enumerate(self.slots)), slots)


def _slot_values(spark: SparkSession, tasks: int) -> list[int]:
    """For each task an integer that hash partitioning sends there."""
    found: dict[int, int] = {}
    at, step = 0, 32 * tasks
    while len(found) < tasks:
        for i, t in spark.range(at, at + step).select(F.col("id").cast("int"), F.expr(f"pmod(hash(cast(id as int)), {tasks})")).collect():
            found.setdefault(t, i)
        at += step
    return [found[t] for t in range(tasks)]


def plan_load(loads: DataFrame, key: str, count: str, tasks: int | None = None) -> LoadPlan:
    """The packing for ``loads``, a table with one row per key and its number of rows.

    A null key is a key of its own. An empty table gives a plan without heavy keys.
    """
    spark = loads.sparkSession
    tasks = tasks or tasks_of(spark)
    buckets = BUCKETS_PER_TASK * tasks
    total = loads.agg(F.sum(count)).first()[0] or 0
    mean = max(1, total // tasks)
    top = [(k, n) for k, n in loads.filter(F.col(count) > mean).select(key, count).collect()]  # fewer than `tasks`
    light = dict(loads.filter(F.col(count) <= mean).groupBy(_bucket(F.col(key), buckets)).agg(F.sum(count)).collect())
    items = [(light.get(b, 0), b) for b in range(buckets)]
    heavy, at = [], buckets
    for k, n in sorted(top, key=lambda x: (-x[1], str(x[0]))):
        shards = min(tasks, -(-2 * n // mean))
        heavy.append((k, at, shards))
        items += [(n // shards, at + i) for i in range(shards)]
        at += shards
    heap, task_of = [(0, t) for t in range(tasks)], [0] * at
    for load, i in sorted(items, key=lambda x: (-x[0], x[1])):
        have, t = heapq.heappop(heap)
        task_of[i] = t
        heapq.heappush(heap, (have + load, t))
    value = _slot_values(spark, tasks)
    packed = [0] * tasks
    for load, t in heap:
        packed[t] = load
    return LoadPlan(tasks, buckets, tuple(heavy), tuple(value[t] for t in task_of), tuple(packed))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def fragment(df: DataFrame, key: str, spread: Column, plan: LoadPlan) -> DataFrame:
    """``df`` with ``_index`` and ``_slot``; rows of a heavy key are spread by ``spread`` (an integer)."""
    heavy, slots = plan.frames(df.sparkSession, df.schema[key].dataType)
    shard = F.pmod(spread, F.col("_shards")).cast("int")
    index = F.coalesce(F.col("_first") + shard, _bucket(F.col(key), plan.buckets))
    out = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_hk")), "left").withColumn("_index", index).drop("_hk", "_first", "_shards")
    return out.join(F.broadcast(slots), "_index")


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: rows of a heavy key once for each of its shards, all others once."""
    heavy, slots = plan.frames(df.sparkSession, df.schema[key].dataType)
    every = F.when(F.col("_first").isNull(), F.array(_bucket(F.col(key), plan.buckets))).otherwise(F.sequence(F.col("_first"), F.col("_first") + F.col("_shards") - 1))
    out = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_hk")), "left").withColumn("_index", F.explode(every)).drop("_hk", "_first", "_shards")
    return out.join(F.broadcast(slots), "_index")


def _distinct_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b])
        yield from t.group_by(t.column_names).aggregate([]).combine_chunks().to_batches()


def balanced_aggregate(df: DataFrame, key: str, aggs: dict[str, tuple[Column, Callable[[str], Column]]] | None = None, distinct: str | None = None, distinct_as: str | None = None, count: str = "rows", tasks: int | None = None) -> DataFrame:
    """Per ``key``: ``count`` rows, the algebraic ``aggs``, and the distinct values of one column.

    ``aggs`` has by name an aggregate and how its parts merge (as ``(F.count("x"), F.sum)``). Rows of
    a heavy key are spread over its shards, parts of shards combine before each shuffle and merge
    per key. Distinct values (of ``distinct``, if given) are spread by value, so shards hold disjoint
    ones and the sum over shards is exact; before their shuffle each batch drops its repeats. Null
    values aren't counted; a null key is a group; an empty table gives none.
    """
    aggs = {count: (F.count(F.lit(1)), F.sum), **(aggs or {})}
    plan = plan_load(written(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "loads"), key, "_n", tasks)
    # rows of one map task combine to one for each key, so the task tells the shard
    rows = fragment(df, key, F.spark_partition_id(), plan).groupBy("_slot", "_index", key).agg(*[a.alias(name) for name, (a, _) in aggs.items()])
    base = rows.groupBy(key).agg(*[merge(name).alias(name) for name, (_, merge) in aggs.items()])
    if distinct is None:
        return base
    values = df.select(F.col(key).alias("_k"), F.col(distinct).alias("_v")).filter(F.col("_v").isNotNull())
    values = values.mapInArrow(_distinct_batches, values.schema)
    parts = fragment(values, "_k", F.xxhash64("_v"), plan).repartition(plan.tasks, "_slot")
    found = parts.groupBy("_slot", "_index", "_k", "_v").agg(F.count(F.lit(1)).alias("_n")).groupBy("_slot", "_index", "_k").agg(F.count(F.lit(1)).alias("_n"))
    found = found.groupBy("_k").agg(F.sum("_n").alias("_n"))
    return base.join(found, base[key].eqNullSafe(found["_k"]), "left").select(*base.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias(distinct_as or f"distinct_{distinct}"))


def balanced_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; left rows of heavy keys spread over shards.

    ``how`` is ``inner`` or ``left``. Column names on both sides besides ``key`` must differ; a
    null key matches nothing, as in SQL.
    """
    if how not in ("inner", "left"):
        raise ValueError("balanced_join takes 'inner' or 'left'")
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {key.lower()}:
        raise ValueError(f"both sides have {sorted(clash)}; rename them first")
    # one slot column is enough to bring the sides together; without this Spark would hash anew
    left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    plan = plan_load(written(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "loads"), key, "_n", tasks)
    a = fragment(left, key, spread, plan).repartition(plan.tasks, "_slot")
    b = replicate(right.filter(F.col(key).isNotNull()), key, plan).repartition(plan.tasks, "_slot")
    return a.join(b, ["_slot", "_index", key], how).drop("_slot", "_index")
