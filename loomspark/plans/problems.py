"""Queries of the general training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import table, written
from loomspark.operators.skew import balanced_aggregate, balanced_join
from loomspark.operators.snapshots import change_claims, page_changes


def domain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain of requests: rows by op, distinct fingerprints, latest ts. Repeated rows count."""
    df = table(spark, sf_dir, "requests").select("domain", "op", F.lower("fingerprint").alias("fingerprint"), "ts")
    ops = {f"{op}_rows": (F.count(F.when(F.col("op") == op, 1)), F.sum) for op in ("push", "lease", "ack")}
    return balanced_aggregate(df, "domain", {**ops, "latest_ts": (F.max("ts"), F.max)}, "fingerprint", "fingerprints")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with at least 2 per cent of all rows of requests, counted by fragments."""
    per = written(balanced_aggregate(table(spark, sf_dir, "requests").select("domain"), "domain"), "domains")
    total = per.agg(F.sum("rows")).first()[0] or 0
    return per.filter(F.col("domain").isNotNull() & (F.col("rows") * 50 >= total)).select("domain")


def p1_domain_response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests matched with the responses of their domain by status, counted by domain, crawl and status."""
    left = table(spark, sf_dir, "requests").select("domain", "request_id", "crawl")
    right = table(spark, sf_dir, "responses").groupBy("domain", F.col("status").alias("response_status")).agg(F.countDistinct("response_id").alias("responses"))
    both = balanced_join(left, right, "domain", F.xxhash64("request_id"))
    return both.groupBy("domain", "crawl", "response_status").agg(F.count(F.lit(1)).alias("requests"), F.max("responses").alias("responses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_domain_results": domain_results,
    "p1_domain_response_join": p1_domain_response_join,
    "p4_found": page_changes,
    "p4_change_claims": change_claims,
}

_DOMAIN_SQL = """SELECT domain, count(*) AS "rows", count(*) FILTER (op = 'push') AS push_rows, count(*) FILTER (op = 'lease') AS lease_rows,
 count(*) FILTER (op = 'ack') AS ack_rows, max(ts) AS latest_ts, count(DISTINCT lower(fingerprint)) AS fingerprints FROM requests GROUP BY domain"""

_SQUEEZE = r"trim(regexp_replace(snapshot->>'$.{0}', '[ \t\r\n]+', ' ', 'g'))"
_FIELDS = ", ".join([_SQUEEZE.format(f) + f" AS {f}" for f in ("text", "title", "description", "structured", "currency", "availability", "items")] + ["CAST(snapshot->>'$.price' AS DOUBLE) AS price"])
_CHANGES = f"""WITH done AS (SELECT site, run, lag(run) OVER (PARTITION BY site ORDER BY run) AS before FROM (SELECT DISTINCT site, run FROM runs WHERE status = 'finished')),
pairs AS (SELECT run, before FROM done WHERE before IS NOT NULL),
seen AS (SELECT run, url, status, {_FIELDS} FROM pages QUALIFY row_number() OVER (PARTITION BY run, url ORDER BY fetched DESC NULLS LAST, page_id DESC) = 1),
alive AS (SELECT run, url, struct_pack(text, title, description, structured, currency, availability, items, price) AS s FROM seen WHERE coalesce(status, 0) NOT IN (404, 410)),
now AS (SELECT p.run, a.url, a.s FROM pairs p JOIN alive a ON a.run = p.run),
was AS (SELECT p.run, a.url, a.s FROM pairs p JOIN alive a ON a.run = p.before),
both_sides AS (SELECT coalesce(n.run, w.run) AS run, coalesce(n.url, w.url) AS url, CASE WHEN w.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' WHEN n.s IS DISTINCT FROM w.s THEN 'changed' END AS change
 FROM now n FULL JOIN was w ON n.run = w.run AND n.url = w.url),
changes AS (SELECT run, url, change FROM both_sides WHERE change IS NOT NULL)"""

SQL: dict[str, str] = {
    "p1_found": "SELECT domain FROM requests WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) * 50 >= (SELECT count(*) FROM requests)",
    "p1_domain_results": _DOMAIN_SQL,
    "p1_domain_response_join": """SELECT q.domain, q.crawl, r.response_status, count(*) AS requests, max(r.responses) AS responses FROM requests q
JOIN (SELECT domain, status AS response_status, count(DISTINCT response_id) AS responses FROM responses GROUP BY 1, 2) r ON q.domain = r.domain GROUP BY 1, 2, 3""",
    "p4_found": f"{_CHANGES} SELECT run, url, change FROM changes",
    "p4_change_claims": f"""{_CHANGES}, got AS (SELECT url, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM changes GROUP BY url),
noted AS (SELECT url, changes AS noted_changes FROM urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_run NULLS FIRST, changes NULLS FIRST) = 1)
SELECT coalesce(n.url, g.url) AS url, noted_changes, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed FROM noted n FULL JOIN got g ON n.url = g.url""",
}
