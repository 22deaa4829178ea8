"""What changed between full snapshots, by invertible Bloom lookup tables.

Every record becomes one element (key hash, value hash). For each pair of snapshots and each
hash bucket the elements of the later are added to and those of the earlier subtracted from a
small table of cells; equal elements cancel, mostly before the shuffle. The cells left over are
peeled to the differing elements. Buckets that can't be peeled are built again with four times
the cells; what still fails is compared row by row. Recovered elements are joined back to their
rows, whose full digests decide.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomspark.catalog import once, table, written

BUCKET_KEYS = 512
ROUNDS = 3
_PAGE_FIELDS = "text string, title string, description string, structured string, price double, currency string, availability string, items string"


def squeezed(c: Column) -> Column:
    """White space (space, tab, CR, LF) squeezed to one space and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def _element(k: int, v: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", v), xxhash.xxh64_intdigest(struct.pack("<q", k), 42))


def _position(h: int, j: int, m: int) -> int:
    # Spark's pmod takes the hash as signed; Python's % of the signed number is the same
    p = xxhash.xxh64_intdigest(struct.pack("<q", j), h)
    return j * m + (p - (1 << 64) if p >> 63 else p) % m


def peel(cells: list[dict], m: int) -> list[tuple[int, int, int]] | None:
    """The (sign, key hash, value hash) in the cells of one bucket, or None if it can't be peeled.

    ``cells`` has cell, n, xk, xv, xc (the XOR of the element hashes); cells of only zeros may be
    missing.
    """
    at = {c["cell"]: [c["n"], c["xk"], c["xv"], c["xc"]] for c in cells}
    todo, out = list(at), []
    while todo:
        c = at.get(todo.pop())
        if c is None or c[0] not in (1, -1):
            continue
        sign, k, v, x = c
        h = _element(k, v)
        if (h - (1 << 64) if h >> 63 else h) != x:
            continue
        out.append((sign, k, v))
        if len(out) > 3 * m:  # more elements than cells: the cells don't fit together
            return None
        for j in range(3):
            p = _position(h, j, m)
            e = at.setdefault(p, [0, 0, 0, 0])
            e[0] -= sign
            e[1] ^= k
            e[2] ^= v
            e[3] ^= x
            todo.append(p)
    return None if any(any(c) for c in at.values()) else out


def _peel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            got = peel(r["cells"], r["m"])
            if got is None:
                rows.append((r["pair"], r["bucket"], 0, 0, 0))
            else:
                rows += [(r["pair"], r["bucket"], *x) for x in got]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["pair", "bucket", "sign", "k", "v"])


def _round(elements: DataFrame, scale: int) -> DataFrame:
    """(pair, bucket, sign, k, v) of all buckets; sign 0 marks a bucket that failed."""
    h = F.xxhash64("k", "v")
    cells = elements.withColumn("m", F.col("m") * scale).withColumn("xc", h)
    places = F.array(*[F.lit(j) * F.col("m") + F.pmod(F.xxhash64("k", "v", F.lit(j).cast("bigint")), F.col("m")).cast("int") for j in range(3)])
    cells = cells.withColumn("cell", F.explode(places)).groupBy("pair", "bucket", "m", "cell")
    cells = cells.agg(F.sum("sign").alias("n"), F.bit_xor("k").alias("xk"), F.bit_xor("v").alias("xv"), F.bit_xor("xc").alias("xc"))
    cells = cells.filter("n <> 0 or xk <> 0 or xv <> 0 or xc <> 0")
    # a bucket has at most 3 m cells, whatever the input
    lists = cells.groupBy("pair", "bucket", "m").agg(F.collect_list(F.struct("cell", "n", "xk", "xv", "xc")).alias("cells"))
    return lists.mapInArrow(_peel_batches, "pair int, bucket int, sign int, k bigint, v bigint")


def snapshot_changes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(run, key, change)`` for every pair of snapshots.

    ``rows`` has ``run int, key string, digest string``, one row for each key of a snapshot;
    ``pairs`` has ``run int, before int``. ``change`` is ``added``, ``removed`` or ``changed``.
    Snapshots without rows are empty ones; a null key isn't compared; no pairs give no rows.
    """
    rows = rows.filter(F.col("key").isNotNull()).select("run", "key", F.coalesce("digest", F.lit("")).alias("digest"), F.xxhash64("key").alias("k"), F.xxhash64("digest").alias("v"))
    rows = written(rows, "snapshots")
    sizes = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select(F.col("run").alias("pair"), F.explode(F.array(F.struct("run", F.lit(1).alias("sign")), F.struct(F.col("before").alias("run"), F.lit(-1).alias("sign")))).alias("s")).select("pair", "s.*")
    keys = each.join(sizes, "run").groupBy("pair").agg(F.max("n").alias("n"))
    keys = keys.select("pair", F.ceil(F.col("n") / BUCKET_KEYS).cast("int").alias("buckets"), F.greatest(F.lit(16), F.ceil(F.least(F.col("n"), F.lit(BUCKET_KEYS)) / 4)).cast("int").alias("m"))
    sides = each.join(keys, "pair")
    elements = rows.join(sides, "run").select("pair", F.pmod(F.xxhash64("k", F.lit(7)), F.col("buckets")).cast("int").alias("bucket"), "m", "sign", "k", "v")
    found, scale, left = [], 1, elements
    for i in range(ROUNDS):
        got = written(_round(left, scale), "peeled")
        found.append(got.filter("sign <> 0").select("pair", "k", "v", "sign"))
        failed = got.filter("sign = 0").select("pair", "bucket")
        if failed.isEmpty():
            break
        left = elements.join(failed, ["pair", "bucket"], "left_semi")
        scale *= 4
    else:  # these buckets are compared element by element
        found.append(left.groupBy("pair", "k", "v").agg(F.sum("sign").alias("sign")).filter("sign <> 0").select("pair", "k", "v", F.col("sign").cast("int").alias("sign")))
    diff = found[0]
    for x in found[1:]:
        diff = diff.unionByName(x)
    diff = diff.join(each, ["pair", "sign"]).join(rows, ["run", "k", "v"])
    new, old = F.col("sign") > 0, F.col("sign") < 0
    both = diff.groupBy("pair", "key").agg(F.max(F.when(new, F.col("digest"))).alias("now"), F.max(F.when(old, F.col("digest"))).alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.select(F.col("pair").alias("run"), "key", change.alias("change")).filter(F.col("change").isNotNull())


def consecutive_runs(runs: DataFrame) -> DataFrame:
    """(run, before): each finished run of a site with the finished run before it."""
    w = Window.partitionBy("site").orderBy("run")
    done = runs.filter(F.col("status") == "finished").select("site", "run").distinct()
    return done.withColumn("before", F.lag("run").over(w)).filter(F.col("before").isNotNull()).select("run", "before")


def page_states(pages: DataFrame) -> DataFrame:
    """(run, key, digest): what each run saw of each url, the largest ``fetched`` deciding.

    Statuses 404 and 410 mean that the url isn't there. The digest covers the compared fields
    of the snapshot by value; a null or unreadable snapshot has no fields.
    """
    o = F.from_json("snapshot", _PAGE_FIELDS)
    parts = []
    for f in _PAGE_FIELDS.split(", "):
        name, kind = f.split(" ")
        c = o[name]
        parts.append(F.coalesce(F.concat(F.lit("="), squeezed(c) if kind == "string" else (c + F.lit(0.0)).cast("string")), F.lit("-")))
    seen = pages.select("run", "url", "page_id", "fetched", "status", F.md5(F.concat_ws("\u001f", *parts)).alias("digest"))
    last = seen.groupBy("run", "url").agg(F.max(F.struct(F.coalesce("fetched", F.lit(float("-inf"))).alias("f"), "page_id", "status", "digest")).alias("s"))
    return last.filter(~F.coalesce(F.col("s.status"), F.lit(0)).isin(404, 410)).select("run", F.col("url").alias("key"), F.col("s.digest").alias("digest"))


def page_changes(spark, sf_dir: str) -> DataFrame:
    """``(run, url, change)`` over the whole tables pages and runs."""
    out = snapshot_changes(page_states(table(spark, sf_dir, "pages")), consecutive_runs(table(spark, sf_dir, "runs")))
    return out.withColumnRenamed("key", "url")


def change_claims(spark, sf_dir: str) -> DataFrame:
    """Per url: changes derived from the snapshots beside those the crawler noted in urls."""
    got = page_changes(spark, sf_dir).groupBy("url").agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "changed")])
    noted = once(table(spark, sf_dir, "urls").select("url", "last_run", F.col("changes").alias("noted_changes")), "url").select("url", "noted_changes")
    return noted.join(got, "url", "full").select("url", "noted_changes", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("added", "removed", "changed")])
