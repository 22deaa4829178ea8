"""Has this key been seen before? Filter, then verify.

1. Each batch of rows drops repeats of one key before any shuffle: all rows of a key but the
   earliest are answered there (both full keys are at hand). So a key that fills a third of the
   table is one row per batch from then on.
2. The rows go to tasks by key hash, in order of ``seq``. A task keeps only a scalable Bloom
   filter (10 bits a key, no keys). What it has not seen is new, at once.
3. All rows are written as the store of full keys. The possibly seen ones are looked up there by
   full key: seen when a row of smaller ``seq`` has it. A positive that the store disproves is
   logged; their share is the measured error of the filter. The filter has no false negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import table, tasks_of, written

NEW, MAYBE, DECIDED = 0, 1, 2
_ROW = "verdict int, request_id bigint, seq bigint, h bigint, crawl string, key binary"


class ScalableBloom:
    """Bloom filter over 64-bit hashes that grows by adding layers of twice the size."""

    def __init__(self, capacity: int = 1 << 14, bits_per_key: int = 10) -> None:
        self.bits_per_key, self.layers, self.room, self.capacity = bits_per_key, [], 0, capacity // 2
        self.k = max(1, round(bits_per_key * math.log(2)))

    def _at(self, h: np.ndarray, m: int) -> np.ndarray:
        h = h.view(np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + np.arange(self.k, dtype=np.uint64) * b[:, None]) % np.uint64(m)

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for bits in self.layers:
            at = self._at(h, len(bits) * 8)
            out |= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return out

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.room:
                self.capacity *= 2
                self.layers.append(np.zeros(self.capacity * self.bits_per_key // 8, np.uint8))
                self.room = self.capacity
            now, h = h[: self.room], h[self.room :]
            at = self._at(now, len(self.layers[-1]) * 8).ravel()
            np.bitwise_or.at(self.layers[-1], at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            self.room -= len(now)


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key in a batch the earliest row stays; later ones are decided, redeliveries dropped."""
    for b in batches:
        h, seq = b.column("h").to_numpy(zero_copy_only=False), b.column("seq").to_numpy(zero_copy_only=False)
        order = np.lexsort((seq, h))
        h, seq, b = h[order], seq[order], b.take(pa.array(order))
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        head = pa.array(start)
        same = pc.and_(pc.equal(b.column("crawl"), b.column("crawl").take(head)), pc.equal(b.column("key"), b.column("key").take(head))).to_numpy(zero_copy_only=False).astype(bool)
        later = ~first & same & (seq > seq[start])
        again = ~first & same & (seq == seq[start]) & pc.fill_null(pc.equal(b.column("request_id"), b.column("request_id").take(head)), True).to_numpy(zero_copy_only=False).astype(bool)
        keep = pa.array(~again)
        none = pa.array(later)
        verdict = pa.array(np.where(later, DECIDED, NEW).astype(np.int32))
        cols = [verdict, b.column("request_id"), b.column("seq"), b.column("h"), pc.if_else(none, None, b.column("crawl")), pc.if_else(none, None, b.column("key"))]
        yield pa.RecordBatch.from_arrays(cols, names=["verdict", "request_id", "seq", "h", "crawl", "key"]).filter(keep)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bloom = ScalableBloom()
    for b in batches:
        verdict = b.column("verdict").to_numpy(zero_copy_only=False).copy()
        open_ = np.flatnonzero(verdict != DECIDED)
        h = b.column("h").to_numpy(zero_copy_only=False)[open_]
        if len(h):
            maybe = np.ones(len(h), bool)
            maybe[np.unique(h, return_index=True)[1]] = False
            maybe |= bloom.test(h)
            bloom.add(h[~maybe])
            verdict[open_[maybe]] = MAYBE
        yield b.set_column(0, "verdict", pa.array(verdict, pa.int32()))


def full_key(fingerprint: Column) -> Column:
    """20 bytes of a hexadecimal fingerprint; any other spelling as itself in lower case."""
    return F.when(fingerprint.rlike("^[0-9a-fA-F]{40}$"), F.unhex(fingerprint)).otherwise(F.encode(F.concat(F.lit("other spelling: -----"), F.lower(fingerprint)), "utf-8"))


def route(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """The written store: every row with its verdict (0 new, 1 possibly seen, 2 seen in its batch).

    ``incoming`` has crawl, fingerprint, seq, request_id; ``earlier`` crawl and fingerprint. Rows
    with a null crawl or fingerprint have no key and are left out; a null seq comes last.
    """
    cols = [F.col("crawl"), full_key(F.col("fingerprint")).alias("key")]
    a = incoming.filter("crawl is not null and fingerprint is not null").select(*cols, F.coalesce("seq", F.lit((1 << 63) - 1)).alias("seq"), "request_id")
    b = earlier.filter("crawl is not null and fingerprint is not null").select(*cols, F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("request_id"))
    rows = a.unionByName(b).select(F.xxhash64("crawl", "key").alias("h"), "crawl", "key", "seq", "request_id").mapInArrow(_earliest, _ROW)
    tasks = tasks_of(incoming.sparkSession)
    at = F.when(F.col("verdict") == DECIDED, F.pmod(F.xxhash64("request_id"), F.lit(tasks))).otherwise(F.pmod(F.col("h"), F.lit(tasks))).cast("int")
    return written(rows.repartitionById(tasks, at).sortWithinPartitions("seq").mapInArrow(_route, _ROW), "keys")


def verify(store: DataFrame) -> DataFrame:
    """The possibly seen rows with the first ``seq`` of their full key and whether it was new then."""
    keys = store.filter(F.col("verdict") != DECIDED).groupBy("h", "crawl", "key").agg(F.min("seq").alias("first"), F.max((F.col("verdict") == NEW).cast("int")).alias("has_new"))
    return store.filter((F.col("verdict") == MAYBE) & F.col("request_id").isNotNull()).join(keys, ["h", "crawl", "key"])


def seen_before(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """``request_id`` of the incoming rows whose key occurred earlier; each id once."""
    store = route(incoming, earlier)
    known = store.filter(F.col("verdict") == DECIDED).select("request_id")
    return known.unionByName(verify(store).filter("first < seq").select("request_id")).distinct()


def filter_errors(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """Per crawl: keys tested by the filter, positives, and the positives that the store disproved."""
    store = route(incoming, earlier)
    tested = store.filter((F.col("verdict") != DECIDED) & F.col("request_id").isNotNull()).groupBy("crawl").agg(F.count(F.lit(1)).alias("tested"), F.count(F.when(F.col("verdict") == MAYBE, 1)).alias("positives"))
    wrong = verify(store).filter("first >= seq and has_new = 0").groupBy("crawl").agg(F.countDistinct("h").alias("disproved"))
    out = tested.join(wrong, "crawl", "left").withColumn("disproved", F.coalesce("disproved", F.lit(0)))
    return out.withColumn("error_rate", F.round(F.col("disproved") / F.col("tested"), 6))


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "requests").filter("op = 'push'"), table(spark, sf_dir, "frontier_seen")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return seen_before(*_tables(spark, sf_dir))


def p3_filter_errors(spark, sf_dir: str) -> DataFrame:
    return filter_errors(*_tables(spark, sf_dir))


P3_SQL = """WITH p AS (SELECT request_id, crawl, lower(fingerprint) AS f, seq FROM requests WHERE op = 'push' AND fingerprint IS NOT NULL AND crawl IS NOT NULL),
first AS (SELECT crawl, f, min(seq) AS s FROM p GROUP BY 1, 2), seen AS (SELECT DISTINCT crawl, lower(fingerprint) AS f FROM frontier_seen)
SELECT DISTINCT request_id FROM p JOIN first USING (crawl, f) LEFT JOIN seen USING (crawl, f) WHERE seen.f IS NOT NULL OR s < seq"""
