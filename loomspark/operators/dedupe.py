"""Duplicates by key, by content, and near ones by SimHash or MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.catalog import written
from loomspark.expr.compiler import as_text, is_empty
from loomspark.functions import urls as U
from loomspark.functions.columns import normalize_for_hash
from loomspark.functions.columns import hash_key
from loomspark.operators.stages import SEQ, data_columns, value_of, with_sequence


def key_column(df: DataFrame, fields: list[str]) -> Column:
    """The key of a record: canonical URLs, else normalized texts; null where a part is missing."""
    parts, missing = [], F.lit(False)
    for f in fields:
        v = value_of(df, f)
        t = as_text(v).col
        parts.append(F.coalesce(U.normalize_url_col(t), hash_key(t)) if f.lower() in ("url", "link", "uri", "href") or f.lower().endswith("_url") else hash_key(t))
        missing = missing | is_empty(v)
    return F.when(~missing, F.concat_ws("\u001f", *parts))


def content_column(df: DataFrame, fields: list[str] | None = None) -> Column:
    """A digest of the normalized values; null and '' are equal."""
    names = sorted(fields or data_columns(df))
    return F.sha2(F.concat_ws("\u001e", *[F.concat(F.lit(n + "="), F.coalesce(hash_key(as_text(value_of(df, n)).col), F.lit(""))) for n in names]), 256)


def _firsts(df: DataFrame, key: Column, kind: str) -> DataFrame:
    """``df`` with the sequence number of the first row of each key, over rows not yet marked.

    The first row comes from a combined aggregate, not from a window, so a key of any size is one
    row per task; rows without a key stand for themselves.
    """
    live = df.withColumn("__k", F.when(F.col("_duplicate_of").isNull(), key))
    first = live.filter("__k is not null").groupBy("__k").agg(F.min(SEQ).alias("__first"))
    out = live.join(first, "__k", "left")
    dup = F.col("__first").isNotNull() & (F.col("__first") < F.col(SEQ))
    return out.withColumn("_duplicate_of", F.when(dup, F.col("__first")).otherwise(F.col("_duplicate_of"))).withColumn("_duplicate_kind", F.when(dup, F.lit(kind)).otherwise(F.col("_duplicate_kind"))).drop("__k", "__first")


def deduplicate(df: DataFrame, fields: list[str] | None = None, content: list[str] | bool = False, near: str | None = None, threshold: float = 0.8, mark: bool = False) -> DataFrame:
    """First occurrences by ``fields``, then by content among what is left, then near texts.

    ``mark`` keeps duplicates with ``_duplicate_of`` (the ``_seq`` of the first) and
    ``_duplicate_kind``. A record without a full key skips the key check.
    """
    had = SEQ in df.columns
    out = with_sequence(df).withColumn("_duplicate_of", F.lit(None).cast("bigint")).withColumn("_duplicate_kind", F.lit(None).cast("string"))
    if fields:
        out = _firsts(out, key_column(df, fields), "key")
    if content:
        out = _firsts(out, content_column(df, None if content is True else content), "content")
    if near:
        texts = out.filter("_duplicate_of is null").select(SEQ, as_text(value_of(df, near)).col.alias("text"))
        links = near_duplicates(texts, SEQ, "text", threshold).filter(f"class <> {SEQ}").select(SEQ, F.col("class").alias("__of"))
        out = out.join(links, SEQ, "left").withColumn("_duplicate_kind", F.when(F.col("__of").isNotNull(), F.lit("near")).otherwise(F.col("_duplicate_kind"))).withColumn("_duplicate_of", F.coalesce("__of", "_duplicate_of")).drop("__of")
    if not mark:
        out = out.filter("_duplicate_of is null").drop("_duplicate_of", "_duplicate_kind")
    return out if had or mark else out.drop(SEQ)


# ---------------------------------------------------------------- similarity
def shingles(text: str, k: int = 3) -> list[str]:
    """The distinct runs of ``k`` words of the normalized text; of five characters where there are few words."""
    t = normalize_for_hash(text)
    words = t.split()
    if len(words) < 2 * k:
        return sorted({t[i : i + 5] for i in range(max(1, len(t) - 4))}) if t else []
    return sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1.0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def simhash(text: str, bits: int = 64, k: int = 3) -> int:
    """Weighted majority of the bits of the shingles' hashes, as a signed 64-bit number."""
    counts: dict[str, int] = {}
    t = normalize_for_hash(text)
    words = t.split()
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= 2 * k else [t[i : i + 5] for i in range(max(1, len(t) - 4))] if t else []
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    if not counts:
        return 0
    h = np.array([xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) for g in counts], np.uint64)
    w = np.array(list(counts.values()))
    on = ((h[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    got = ((2 * on - 1) * w[:, None]).sum(axis=0) > 0
    value = int(sum(1 << i for i in np.flatnonzero(got).tolist()))
    return value - (1 << 64) if value >= 1 << 63 else value


def simhash_column(c: Column, bits: int = 64, k: int = 3) -> Column:
    from loomspark.functions.columns import mapped

    return mapped(lambda t: simhash(t, bits, k), "bigint")(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - hamming(a, b) / bits


_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 128, dtype=np.uint64)


def _hashes(s: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in s], np.uint64)


def _signature(h: np.ndarray, slots: int) -> list[int]:
    low = np.full(slots, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        low = np.minimum(low, (h[i : i + 4096][None, :] * _MUL[:slots, None] + _ADD[:slots, None]).min(axis=1))
    return (low >> np.uint64(1)).astype(np.int64).tolist()


def minhash(text: str, slots: int = 64, k: int = 3) -> list[int]:
    """The least of each of ``slots`` hashes over the shingles; nothing for no text."""
    h = _hashes(shingles(text, k))
    return _signature(h, slots) if len(h) else []


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


#: The share of pairs just at the threshold that may fail to meet in any band.
MISSED = 0.001


def bands_for(threshold: float, slots: int = 64) -> tuple[int, int]:
    """(bands, rows) with the most rows that miss ``MISSED`` of the pairs at ``threshold`` at most; else single rows."""
    options = [(b, slots // b) for b in range(1, slots + 1) if slots % b == 0]
    return min((o for o in options if false_negative_rate(threshold, *o) <= MISSED), default=(slots, 1))


def false_negative_rate(similarity: float, bands: int, rows: int) -> float:
    return (1 - similarity**rows) ** bands


def _signed(batches: Iterator[pa.RecordBatch], slots: int, k: int, bands: int, rows: int):
    for b in batches:
        ids, sets, keys = [], [], []
        for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            h = _hashes(shingles(t or "", k))
            if not len(h):
                continue
            a = np.array(_signature(h, slots), np.int64)
            ids.append(i), sets.append(np.unique(h).view(np.int64))
            keys.append([xxhash.xxh64_intdigest(a[j * rows : (j + 1) * rows].tobytes(), j) - (1 << 63) for j in range(bands)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["id", "shingles", "bands"])


def near_pairs(texts: DataFrame, key: str, text: str, threshold: float = 0.8, slots: int = 64, k: int = 5) -> DataFrame:
    """``(a, b, similarity)``, a < b, of the distinct texts whose min-hash bands meet and whose sets
    of shingles have a Jaccard similarity of ``threshold`` or more.

    Equal texts are one (their least key stands for them; see ``near_duplicates`` for membership),
    so copies make no pairs. Pairs that meet in a band are compared by the 64-bit hashes of all
    their shingles; of pairs just at the threshold ``false_negative_rate(threshold, *bands_for(threshold, slots))``
    never meet (0.02 % at 0.8).
    """
    reps = texts.filter(F.col(text).isNotNull()).groupBy(F.xxhash64(hash_key(F.col(text))).alias("h"), F.sha2(hash_key(F.col(text)), 256).alias("d")).agg(F.min(F.struct(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))).alias("r")).select("r.*")
    bands, rows = bands_for(threshold, slots)
    signed = written(reps.mapInArrow(lambda it: _signed(it, slots, k, bands, rows), "id bigint, shingles array<bigint>, bands array<bigint>"), "signatures")
    keys = signed.select("id", F.size("shingles").alias("n"), F.explode("bands").alias("band"))
    x, y = keys.alias("x"), keys.alias("y")
    # a similarity of the threshold needs that share of the larger set's size
    fits = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    s = signed.select("id", "shingles")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
    return both.withColumn("similarity", jaccard(F.col("sa"), F.col("sb"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """``(node, class)``: the least node of each component of ``edges (a, b)``.

    Alternating large-star and small-star rounds, each written to the shared folder; a round
    halves the depth at least, and a node of any degree is combined before its shuffle.
    """
    both = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        sym = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: every smaller neighbour goes to the least one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = written(small, "edges")
        changed = not new.exceptAll(both).isEmpty() or not both.exceptAll(new).isEmpty()
        both = new
        if not changed:
            break
    else:
        raise RuntimeError("components didn't settle")
    members = both.groupBy("b").agg(F.min("a").alias("class")).select(F.col("b").alias("node"), "class")
    if nodes is None:
        nodes = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
    return nodes.join(members, "node", "left").select("node", F.coalesce("class", "node").alias("class"))


def near_duplicates(texts: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """``(key, class)``: one row per record; the class is the least key of its group of near texts.

    Null and empty texts are classes of their own.
    """
    digest = F.sha2(hash_key(F.col(text)), 256)
    full = texts.select(F.col(key).cast("bigint").alias("id"), F.when(F.trim(text) != "", digest).alias("d"), F.col(text).alias("t"))
    rep = full.filter("d is not null").groupBy("d").agg(F.min("id").alias("rep"))
    classes = connected_components(near_pairs(texts.filter(F.trim(text) != ""), key, text, threshold, k=k).select("a", "b"))
    out = full.select("id", "d").join(rep, "d", "left").join(classes.withColumnsRenamed({"node": "rep"}), "rep", "left")
    return out.select(F.col("id").alias(key), F.coalesce("class", "rep", "id").alias("class"))


def simhash_pairs(texts: DataFrame, key: str, text: str, distance: int = 3) -> DataFrame:
    """``(a, b, distance)``, a < b, of records whose SimHashes differ in at most ``distance`` bits.

    Equal hashes are one node (the least key); the others meet in one of ``distance`` + 1 blocks.
    """
    marked = texts.filter(F.trim(text) != "").select(F.col(key).cast("bigint").alias("id"), simhash_column(F.col(text)).alias("h"))
    reps = written(marked.groupBy("h").agg(F.min("id").alias("id")), "simhash")
    n = distance + 1
    width = -(-64 // n)
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1).cast("bigint") if min(width, 64 - i * width) < 63 else F.lit(-1).cast("bigint")).alias("v")) for i in range(n)])
    keys = reps.select("id", "h", F.explode(blocks).alias("k")).select("id", "h", "k.i", "k.v")
    x, y = keys.alias("x"), keys.alias("y")
    pairs = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")))
    out = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), hamming(F.col("x.h"), F.col("y.h")).alias("distance"))
    return out.filter(F.col("distance") <= distance).distinct()
