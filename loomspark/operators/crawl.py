"""What a crawl keeps beside its records: page snapshots, caches, events, waiting times, samples of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.catalog import written
from loomspark.functions import urls as U
from loomspark.operators.stages import ident

_SNAPSHOT = "status int, text string, title string, description string, meta string, structured string, types array<string>, price double, currency string, availability string, layout bigint, images string, navigation string, items string"
#: Bits of two layout hashes that must differ for a change of layout.
LAYOUT_BITS = 8


def snapshot(column: Column) -> Column:
    """A stored snapshot (JSON) as a struct; fields it doesn't have are null."""
    return F.from_json(column, _SNAPSHOT)


def snapshot_kinds(old: Column, new: Column) -> Column:
    """The kinds of change between two snapshots of one URL, in fixed order; JVM-side.

    Null and missing are equal. A layout has changed when ``LAYOUT_BITS`` bits differ; items are
    compared only where both snapshots have them.
    """
    differ = lambda *names: ~F.struct(*[old[n] for n in names]).eqNullSafe(F.struct(*[new[n] for n in names]))
    kinds = [
        ("status", differ("status")), ("text", differ("text")), ("title", differ("title")), ("description", differ("description")), ("metadata", differ("meta")),
        ("structured-data", differ("structured")), ("schema", differ("types")), ("price", differ("price", "currency")), ("availability", differ("availability")),
        ("layout", F.bit_count(F.coalesce(old["layout"], F.lit(0)).bitwiseXOR(F.coalesce(new["layout"], F.lit(0)))) >= LAYOUT_BITS),
        ("images", differ("images")), ("navigation", differ("navigation")), ("items", old["items"].isNotNull() & new["items"].isNotNull() & differ("items")),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in kinds]))


def snapshot_changes(pages: DataFrame) -> DataFrame:
    """``(url, run, kinds)`` of the snapshots that differ from the one before them of the same URL.

    ``pages`` has page_id, run, url, fetched and snapshot. Of several rows of one run and URL the
    last fetched counts; null snapshots and URLs are left out.
    """
    rows = pages.filter("url is not null and snapshot is not null")
    last = rows.groupBy("url", "run").agg(F.max_by("snapshot", F.struct("fetched", "page_id")).alias("s")).select("url", "run", snapshot(F.col("s")).alias("new"))
    both = last.withColumn("old", F.lag("new").over(Window.partitionBy("url").orderBy("run"))).filter("old is not null")
    return both.select("url", "run", snapshot_kinds(F.col("old"), F.col("new")).alias("kinds")).filter(F.size("kinds") > 0)


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with the place (from 0) of each row in an order that no two rows share.

    Ranges are numbered in parallel and their sizes added on, so no task sees all rows.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, (within + F.col("_o") - 1).cast("bigint")).drop("_p", "_o")


def even_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``n`` rows at equal distances in the given order; all rows of a smaller table, none for no ``n``."""
    total = df.count()
    step = max(1, total // n) if n > 0 else 1
    rows = numbered(df, *order, name="_at")
    return rows.filter((F.col("_at") % step == 0) & (F.col("_at") < step * max(n, 0))).drop("_at")


def page_of(df: DataFrame, order: list[str], offset: int = 0, limit: int = 100) -> tuple[DataFrame, int | None]:
    """One page of a table in a given order, and the offset of the next one; none after the last."""
    rows = df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))
    return rows, offset + limit if df.count() > offset + limit else None


def retry_after(header: Column, now: Column, cap: float = 3600.0) -> Column:
    """Seconds to wait by a Retry-After header: a number of seconds or an HTTP date; at most ``cap``, null for neither."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^\w{3}, (.*) (?:GMT|UTC)$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(text.try_cast("double"), (date.cast("double") - now.cast("timestamp").cast("double")))
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), F.greatest(F.lit(0.0), F.least(seconds, F.lit(float(cap)))))


def cached_answers(stored: DataFrame, now: str, ttl: float, key: str = "url", at: str = "stored_at") -> DataFrame:
    """The last stored row of each key that is no older than ``ttl`` seconds at ``now``; a null time is never fresh.

    Of rows of one time the largest counts. The row comes from a combined aggregate, so a key of any
    number of rows is one row per task.
    """
    rest = [c for c in stored.columns if c != key]
    fresh = (F.col(f"_r.{at}").cast("timestamp").cast("double") + ttl) > F.lit(now).cast("timestamp").cast("double")
    last = stored.filter(ident(key).isNotNull() & ident(at).isNotNull()).groupBy(key).agg(F.max(F.struct(ident(at), *[ident(c) for c in rest if c != at])).alias("_r"))
    return last.filter(fresh).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def strategy_shares(pages: DataFrame, pattern: Column, host: Column, enough: Column, least: int = 5) -> DataFrame:
    """``(host, pattern, pages, share, by)``: the share of pages whose plain answer wasn't enough.

    Patterns of fewer than ``least`` pages take the share of their host (``by`` tells which). Null
    ``enough`` counts as not enough.
    """
    short = F.count(F.when(~F.coalesce(enough, F.lit(False)), 1))
    per = pages.groupBy(host.alias("host"), pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("pages"), short.alias("short"))
    hosts = per.groupBy(F.col("host").alias("_h")).agg((F.sum("short") / F.sum("pages")).alias("h"))
    few = F.col("pages") < least
    return per.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).select("host", "pattern", "pages", F.round(F.when(few, F.col("h")).otherwise(F.col("short") / F.col("pages")), 4).alias("share"), F.when(few, "host").otherwise("pattern").alias("by"))


def event_counts(events: DataFrame, kind: str) -> DataFrame:
    """``(kind, n)``, null kinds included."""
    return events.groupBy(ident(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def failure_groups(failures: DataFrame, by: list[str], url: str = "url", samples: int = 3) -> DataFrame:
    """``(by, n, urls)``: failures grouped by their columns, largest groups' first URLs in order of spelling.

    The samples come from distinct URLs ranked within groups by a limited window, which drops all but
    the first ones in every task; no group is collected.
    """
    counts = failures.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = failures.select(*by, ident(url).alias("_u")).filter("_u is not null").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_u"))).filter(F.col("_r") <= samples)
    some = first.groupBy(*by).agg(F.array_sort(F.collect_list("_u")).alias("urls"))
    same = [counts[b].eqNullSafe(some[b]) for b in by]
    return counts.join(some, same, "left").select(*[counts[b] for b in by], "n", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def url_patterns(pages: DataFrame, group: str, url: str = "url") -> DataFrame:
    """``(group, pattern)``: the common pattern of the URLs of each group.

    Paths of the most frequent length count (of equally frequent ones the shorter); a segment that is
    the same in all of them stays, one of digits only is ``{id}``, any other ``{slug}``; ``/...``
    tells of other lengths. Values are counted before they are compared, so a large group is no
    more than its distinct segments' extremes per task.
    """
    parts = F.filter(F.split(U.path_col(ident(url)), "/"), lambda p: p != "")
    rows = pages.filter(ident(url).isNotNull()).select(ident(group).alias("g"), parts.alias("parts")).withColumn("size", F.size("parts"))
    lengths = rows.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n"))
    modal = lengths.groupBy("g").agg(F.max(F.struct("n", (-F.col("size")).alias("s"))).alias("m"), F.count(F.lit(1)).alias("lengths")).select("g", (-F.col("m.s")).alias("size"), "lengths")
    long = rows.join(modal, ["g", "size"]).select("g", F.posexplode("parts").alias("i", "part"))
    kinds = long.groupBy("g", "i").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min(F.col("part").rlike(r"^\d+$")).alias("digits"))
    one = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("digits"), "{id}").otherwise("{slug}")
    paths = kinds.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("p")))), lambda x: x["p"]), "/").alias("path"))  # a row per place in a path
    out = modal.join(paths, modal["g"].eqNullSafe(paths["g"]), "left")
    return out.select(modal["g"].alias(group), F.concat(F.lit("/"), F.coalesce("path", F.lit("")), F.when(F.col("lengths") > 1, "/...").otherwise("")).alias("pattern"))


def read_results(records: DataFrame) -> DataFrame:
    """Search results of tolerant records: ``(query, position, url, title, type)``; records without them are left out.

    ``query`` may be called keyword, ``position`` rank, ``url`` link; missing columns are null. A web
    result needs a URL, another one a URL or a title.
    """
    have = {c.lower() for c in records.columns}
    text = lambda *names: F.coalesce(*[F.when(F.trim(ident(n).cast("string")) != "", ident(n).cast("string")) for n in names if n in have], F.lit(None).cast("string"))
    kind = F.lower(F.coalesce(text("type"), F.lit("web")))
    rows = records.select(text("query", "keyword").alias("query"), text("position", "rank").try_cast("int").alias("position"), text("url", "link").alias("url"), F.trim(text("title")).alias("title"), kind.alias("type"))
    named = F.when(F.col("type") == "web", F.col("url").isNotNull()).otherwise(F.coalesce("url", "title").isNotNull())
    return rows.filter((F.col("position") >= 1) & F.col("query").isNotNull() & named)


def values_match(expected: Column, got: Column) -> Column:
    """Whether two values, as text, are the same: both empty, equal after squeezing white space, or equal numbers."""
    e, g = (F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")) for c in (expected, got))
    numbers = F.coalesce(e.try_cast("double") == g.try_cast("double"), F.lit(False))
    return F.when((e == "") | (g == ""), e == g).otherwise((e == g) | numbers)


def top_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """``(value, n)``: the most frequent values of a column, or of the arrays in it; ties in order of spelling."""
    c = ident(column)
    rows = df.select(F.explode(c).alias("value")) if df.schema[column].dataType.typeName() == "array" else df.select(c.alias("value"))
    return rows.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(n)
