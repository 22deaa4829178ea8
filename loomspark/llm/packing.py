"""Filling containers: minimum bin slack with bitset subset sums.

Documents are hashed into shards of bounded size (``SHARD_ROWS`` on average); every shard is
packed on its own for each capacity. A shard knows only how many items have each length. For one
bin the longest item left is set; a bitset holds which sums the other lengths can reach beside
it, and the highest one at most the capacity is the fullest combination. It is taken out as often
as the counts allow, then the next bin follows. An item over the capacity is cut into full parts
and a rest; no other item is cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import table

SHARD_ROWS = 10_000
#: Kinds of containers that are packed in one pass.
KINDS = 500


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths in ``counts`` with the largest sum that is at most ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def pack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths, how many such bins); ``counts`` has lengths of 1 to ``capacity``."""
    counts, bins = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        lengths = fullest({k: v for k, v in counts.items() if v and k <= capacity - top}, capacity - top) if capacity > top else {}
        counts[top] += 1
        lengths[top] = lengths.get(top, 0) + 1
        times = min(counts[k] // n for k, n in lengths.items())
        for k, n in lengths.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        bins.append((lengths, times))
    return bins


def _pack_shard(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
    container, capacity, shard = key[0], int(key[1]), int(key[2])
    docs = docs.sort_values("doc_id")
    by_length: dict[int, list[tuple[int, int]]] = {}
    empty = []
    for doc, size in zip(docs["doc_id"].tolist(), docs["size"].tolist()):
        part = 0
        while size > capacity:
            by_length.setdefault(capacity, []).append((doc, part))
            size, part = size - capacity, part + 1
        if size or part:
            if size:
                by_length.setdefault(size, []).append((doc, part))
        else:
            empty.append((doc, 0))
    rows, b = [(doc, part, 0, 0) for doc, part in empty], 0
    for lengths, times in pack({k: len(v) for k, v in by_length.items()}, capacity):
        for _ in range(times):
            for length, n in sorted(lengths.items()):
                rows += [(*by_length[length].pop(), length, b) for _ in range(n)]
            b += 1
    out = pd.DataFrame(rows, columns=["doc_id", "part", "tokens", "bin"])
    out.insert(0, "container", container)
    out.insert(1, "shard", shard)
    return out


def pack_documents(docs: DataFrame, containers: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(container, shard, bin, doc_id, part, tokens)``: every part of every document, once per container.

    ``docs`` has doc_id and n_tokens, ``containers`` container and capacity; a container without
    a positive capacity gets nothing. A document of no or unknown size (0, null, negative) takes
    no room and is put into the first bin of its shard.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    sized = docs.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    kinds = containers.filter("capacity > 0").select("container", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    parts = max(1, -(-kinds.count() // KINDS))
    out = None
    for part in range(parts):  # containers are few; very many go to the tasks in parts
        rows = kinds.filter(F.pmod(F.xxhash64("container", "capacity"), F.lit(parts)) == part).collect()
        each = F.array(*[F.struct(F.lit(r["container"]).cast("string").alias("container"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in rows])
        each = each if rows else F.array().cast("array<struct<container:string,capacity:bigint>>")
        one = sized.withColumn("c", F.explode(each)).select("doc_id", "size", "shard", "c.*").groupBy("container", "capacity", "shard").applyInPandas(_pack_shard, "container string, shard int, doc_id bigint, part int, tokens bigint, bin int")
        out = one if out is None else out.unionByName(one)
    return out.select("container", "shard", "bin", "doc_id", "part", "tokens")


def p8_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Per container: bins, parts, tokens and the share of their room that is unused."""
    per = p8_pack(spark, sf_dir).groupBy("container", "shard", "bin").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("parts"))
    per = per.join(F.broadcast(table(spark, sf_dir, "containers").distinct()), "container")
    out = per.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"))
    return out.withColumn("slack", F.round(1 - F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
