"""One query per operator over the driver's tables, with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.catalog import once, spread, table
from loomspark.expr.compiler import Expression
from loomspark.functions import urls as U
from loomspark.operators import crawl, dedupe, diff, entities, graph, groups, history, profile, quantiles, ranking, sites, stages
from loomspark.operators.schema import Field, Rule, Schema, infer_table, issue_column, issue_counts
from loomspark.operators.stages import Compute, ConvertCurrency, Deduplicate, Exclude, Filter, Lookup, Rename, Select, Transform, Validate
from loomspark.plans.pipeline import Pipeline
from loomspark.streaming import operators as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _run(name: str, tables: str, stages_: list, columns: str, sql: str) -> None:
    """A query of a few stages over one table."""
    QUERIES[name] = lambda s, d: Pipeline(stages_).run(table(s, d, tables).select(*columns.split()))
    SQL[name] = sql


# ---------------------------------------------------------------- flagship
_REVENUE = """SELECT o_orderpriority AS label, count(*) AS count, round(min(revenue), 2) AS revenue_min, round(max(revenue), 2) AS revenue_max,
 round(avg(revenue), 2) AS revenue_mean, round(median(revenue), 2) AS revenue_median
FROM (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'N') JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""


@query("revenue_by_priority", _REVENUE)
def revenue_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, Compute, Lookup's join and group statistics in one plan; columns are pruned at both scans."""
    items = Pipeline([Filter("l_quantity > 10 and l_returnflag != 'N'"), Compute({"revenue": "l_extendedprice * (1 - l_discount)"})]).run(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_extendedprice", "l_discount"))
    rows = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", "revenue")
    per = quantiles.summary(rows.withColumnRenamed("o_orderpriority", "label"), ["label"], "revenue")
    return per.select("label", "count", *[F.round(c, 2).alias(f"revenue_{c}") for c in ("min", "max", "mean", "median")])


# ---------------------------------------------------------------- filters and expressions
_LINE = "l_orderkey l_linenumber l_quantity l_returnflag"
_run("filter_expr", "lineitem", [Filter("l_quantity > 45 and l_returnflag != 'N'")], _LINE, "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
_run("filter_keep_false", "lineitem", [Filter("l_quantity > 2", keep=False)], _LINE, "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE NOT l_quantity > 2")
_run("filter_chained_compare", "lineitem", [Filter("10 < l_quantity <= 12")], _LINE, "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 12")
_run("filter_in_list", "orders", [Filter("o_orderstatus in ['F', 'P'] and not (o_totalprice < 100000)")], "o_orderkey o_orderstatus o_totalprice", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND NOT o_totalprice < 100000")
_run("filter_null_rules", "requests", [Filter("domain == None or retries > 2")], "request_id domain retries", "SELECT request_id, domain, retries FROM requests WHERE domain IS NULL OR coalesce(retries > 2, false)")

_FN = {
    "len": ("documents", "doc_id", "len(text)", "coalesce(length(text), 0)"),
    "lower": ("part", "p_partkey", "lower(p_name)", "lower(p_name)"),
    "upper": ("part", "p_partkey", "upper(p_brand)", "upper(p_brand)"),
    "strip": ("part", "p_partkey", "strip(' ' + p_name + ' ')", "p_name"),
    "contains": ("part", "p_partkey", "contains(p_type, 'a')", "contains(p_type, 'a')"),
    "icontains": ("part", "p_partkey", "icontains(p_type, 'STEEL')", "contains(lower(p_type), 'steel')"),
    "startswith": ("customer", "c_custkey", "startswith(c_mktsegment, 'B')", "starts_with(c_mktsegment, 'B')"),
    "endswith": ("customer", "c_custkey", "endswith(c_name, '7')", "ends_with(c_name, '7')"),
    "matches": ("customer", "c_custkey", "matches(c_name, '0{3}[1-4]')", "regexp_matches(c_name, '0{3}[1-4]')"),
    "extract": ("customer", "c_custkey", "extract(c_name, '([1-9]\\\\d*)$')", "nullif(regexp_extract(c_name, '([1-9]\\d*)$', 1), '')"),
    "replace": ("part", "p_partkey", "replace(p_brand, '#', '-')", "replace(p_brand, '#', '-')"),
    "sub": ("part", "p_partkey", "sub(p_brand, '[0-9]+', 'N')", "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"),
    "words": ("documents", "doc_id", "words(text)", "coalesce(len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')), 0)"),
    "join_split": ("part", "p_partkey", "join(split(p_type, ' '), '/')", "replace(p_type, ' ', '/')"),
    "first_split": ("part", "p_partkey", "first(split(p_type, ' '))", "split_part(p_type, ' ', 1)"),
    "coalesce": ("requests", "request_id", "coalesce(domain, 'none')", "coalesce(nullif(domain, ''), 'none')"),
    "min": ("lineitem", "l_orderkey l_linenumber", "min(l_quantity, 10)", "least(l_quantity, 10)"),
    "max": ("lineitem", "l_orderkey l_linenumber", "max(l_tax, l_discount)", "greatest(l_tax, l_discount)"),
    "abs": ("customer", "c_custkey", "abs(c_acctbal)", "abs(c_acctbal)"),
    "int": ("customer", "c_custkey", "int(c_acctbal)", "CAST(trunc(c_acctbal) AS BIGINT)"),
    "float": ("part", "p_partkey", "float(p_size) / 4", "p_size / 4.0"),
    "bool": ("requests", "request_id", "bool(retries)", "coalesce(retries <> 0, false)"),
    "host": ("requests", "request_id", "host(url)", "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]+)', 1)), '')"),
    "path": ("requests", "request_id", "path(url)", "CASE WHEN url IS NOT NULL THEN coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), ''), '/') END"),
    "arith": ("lineitem", "l_orderkey l_linenumber", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)", "NULL"),
    "div_zero": ("requests", "request_id", "priority / retries", "CASE WHEN retries <> 0 THEN priority / CAST(retries AS DOUBLE) END"),
    "floor_div": ("customer", "c_custkey", "(c_nationkey - 12) // 5", "CAST(floor((c_nationkey - 12) / 5.0) AS BIGINT)"),
    "floor_mod": ("customer", "c_custkey", "(c_nationkey - 12) % 5", "CAST((c_nationkey - 12) - 5 * floor((c_nationkey - 12) / 5.0) AS BIGINT)"),
    "power": ("part", "p_partkey", "p_size ** 2", "CAST(p_size * p_size AS BIGINT)"),
    "ifexp": ("customer", "c_custkey", "'debt' if c_acctbal < 0 else 'credit'", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END"),
    "or_value": ("requests", "request_id", "domain or crawl", "coalesce(nullif(domain, ''), crawl)"),
    "slice": ("customer", "c_custkey", "c_name[-3:]", "right(c_name, 3)"),
    "index": ("customer", "c_custkey", "c_name[0] + c_name[-1]", "c_name[1] || c_name[-1]"),
    "isnone": ("requests", "request_id", "fingerprint is None", "fingerprint IS NULL"),
    "in_text": ("part", "p_partkey", "'#1' in p_brand", "contains(p_brand, '#1')"),
}
for _n, (_t, _k, _e, _s) in _FN.items():
    QUERIES[f"fn_{_n}"] = lambda s, d, t=_t, k=_k, e=_e: (lambda df: df.select(*k.split(), Expression(e).column(df.schema).alias("v")))(table(s, d, t))
    if _s != "NULL":
        SQL[f"fn_{_n}"] = f"SELECT {', '.join(_k.split())}, {_s} AS v FROM {_t}"
SQL["fn_arith"] = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem"
for _n, _t, _k, _e in (("title", "part", "p_partkey", "title(p_name)"), ("clean", "documents", "doc_id", "clean(text)"), ("hash", "documents", "doc_id", "hash(text)"), ("domain", "requests", "request_id", "domain(url)"), ("param", "requests", "request_id", "param(url, 'id')"), ("number", "customer", "c_custkey", "number(c_name)"), ("money", "documents", "doc_id", "money(text)"), ("round_exact", "part", "p_partkey", "round_exact(p_retailprice, 1)"), ("distance_km", "customer", "c_custkey", "distance_km([c_acctbal / 200, c_nationkey], [52.5, 13.4])"), ("in_box", "customer", "c_custkey", "in_box([c_acctbal / 200, c_nationkey], 0, 5, 40, 20)")):
    QUERIES[f"fn_{_n}"] = lambda s, d, t=_t, k=_k, e=_e: (lambda df: df.select(k, Expression(e).column(df.schema).alias("v")))(table(s, d, t))
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
SQL["fn_title"] = f"SELECT p_partkey, {_TITLE} AS v FROM part"
SQL["fn_number"] = "SELECT c_custkey, CAST(nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS DOUBLE) AS v FROM customer"
SQL["fn_domain"] = "SELECT request_id, nullif(regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]+)', 1)), '([^.]+\\.[^.]+)$', 1), '') AS v FROM requests"
SQL["fn_in_box"] = "SELECT c_custkey, c_acctbal / 200 BETWEEN 0 AND 40 AND c_nationkey BETWEEN 5 AND 20 AS v FROM customer"
SQL["fn_param"] = "SELECT request_id, CASE WHEN regexp_matches(url, '[?&]id=') THEN url_decode(regexp_extract(url, '[?&]id=([^&#]*)', 1)) END AS v FROM requests"

_run("compute_ordered", "lineitem", [Compute({"net": "l_extendedprice * (1 - l_discount)", "half": "net / 2", "flag": "half > 10000"})], "l_orderkey l_linenumber l_extendedprice l_discount", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) / 2 AS half, l_extendedprice * (1 - l_discount) / 2 > 10000 AS flag FROM lineitem")

# ---------------------------------------------------------------- stages
_PART = "p_partkey p_name p_brand p_type p_size"
_run("rename_swap", "part", [Rename({"p_name": "p_brand", "p_brand": "p_name"})], _PART, "SELECT p_partkey, p_brand AS p_name, p_name AS p_brand, p_type, p_size FROM part")
QUERIES["rename_first_non_empty"] = lambda s, d: Rename({"domain": "site", "crawl": "site"}).apply(table(s, d, "requests").select("request_id", "domain", "crawl"))
SQL["rename_first_non_empty"] = "SELECT request_id, coalesce(nullif(domain, ''), crawl) AS site FROM requests"
_run("select_glob_fill", "part", [Select(["p_partkey", "p_t*", "missing"])], _PART, "SELECT p_partkey, p_type, CAST(NULL AS VARCHAR) AS missing FROM part")
_run("exclude_glob", "part", [Exclude(["p_b*", "p_size"])], _PART, "SELECT p_partkey, p_name, p_type FROM part")

_OPS = {
    "strip": ([{"prefix": "  "}, "strip"], "p_name", "p_name"), "lower": (["lower"], "p_name", "lower(p_name)"), "upper": (["upper"], "p_name", "upper(p_name)"),
    "prefix": ([{"prefix": "x-"}], "p_name", "'x-' || p_name"), "suffix": ([{"suffix": "!"}], "p_name", "p_name || '!'"), "truncate": ([{"truncate": 4}], "p_name", "left(p_name, 4)"),
    "replace": ([{"replace": ["#", ":"]}], "p_brand", "replace(p_brand, '#', ':')"), "sub": ([{"sub": ["[aeiou]", "_"]}], "p_name", "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    "regex": ([{"regex": "#(\\d)"}], "p_brand", "nullif(regexp_extract(p_brand, '#(\\d)', 1), '')"), "map": ([{"map": {"Brand#11": "eleven", "Brand#12": "twelve"}}], "p_brand", "CASE lower(trim(p_brand)) WHEN 'brand#11' THEN 'eleven' WHEN 'brand#12' THEN 'twelve' ELSE p_brand END"),
    "round": ([{"round": 1}], "p_retailprice", "round_even(p_retailprice, 1)"), "multiply": ([{"multiply": 1.5}], "p_size", "CAST(p_size AS DOUBLE) * 1.5"), "nullif": ([{"nullif": "brand#11 "}], "p_brand", "CASE WHEN lower(trim(p_brand)) <> 'brand#11' THEN p_brand END"),
    "split": ([{"split": " "}, {"join": "|"}], "p_type", "replace(p_type, ' ', '|')"), "first": ([{"split": " "}, "first"], "p_type", "split_part(p_type, ' ', 1)"), "last": ([{"split": " "}, "last"], "p_type", "split_part(p_type, ' ', -1)"),
    "length": (["length"], "p_name", "length(p_name)"), "default": ([{"nullif": "Brand#11"}, {"default": "none"}], "p_brand", "CASE WHEN lower(p_brand) = 'brand#11' THEN 'none' ELSE p_brand END"), "expr": ([{"expr": "value * 2 if value > 10 else value"}], "p_size", "CASE WHEN p_size > 10 THEN p_size * 2 ELSE p_size END"),
    "unique": ([{"split": " "}, "unique", "compact", {"join": " "}], "p_type", "(WITH w AS (SELECT unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i) SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM w WHERE w <> '' GROUP BY w))"), "title": (["title"], "p_name", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"), "clean": (["clean"], "p_name", "p_name"), "number": ([{"suffix": " kg"}, "number"], "p_brand", "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE)"), "integer": (["integer"], "p_brand", "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)"), "percent": ([{"suffix": "%"}, "percent"], "p_size", "p_size / 100.0"),
    "money": ([{"prefix": "$"}, "money"], "p_size", "CAST(p_size AS DOUBLE)"), "currency": ([{"prefix": "EUR "}, "currency"], "p_size", "'EUR'"), "unit": ([{"suffix": " cm"}, {"unit": "mm"}], "p_size", "CAST(p_size * 10 AS DOUBLE)"), "boolean": ([{"map": {"Brand#11": "yes"}}, "boolean"], "p_brand", "CASE WHEN p_brand = 'Brand#11' THEN true END"), "url": ([{"sub": ["#", ""]}, {"prefix": "HTTP://Shop.example:80/a/../"}, "url"], "p_brand", "'http://shop.example/' || replace(p_brand, '#', '')"), "fix_encoding": (["fix_encoding"], "p_name", "p_name"), "json": ([{"prefix": "["}, {"suffix": "]"}, "json", {"expr": "str(value)"}], "p_size", "'[' || p_size || ']'"), "date": ([{"prefix": "2024-01-0"}, {"truncate": 10}, "date"], "p_size", "'2024-01-0' || left(CAST(p_size AS VARCHAR), 1)"),
}
for _n, (_o, _c, _s) in _OPS.items():
    QUERIES[f"op_{_n}"] = lambda s, d, o=_o, c=_c: Transform([c], o, target="v").apply(table(s, d, "part").select("p_partkey", c)).select("p_partkey", "v")
    if _s:
        SQL[f"op_{_n}"] = f"SELECT p_partkey, {_s} AS v FROM part"


@query("lookup_left", "SELECT c_custkey, c_nationkey AS n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_left(s: SparkSession, d: str) -> DataFrame:
    return Lookup(table(s, d, "nation"), "n_nationkey").apply(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")))


@query("lookup_required", "SELECT c_custkey, c_nationkey AS n_nationkey, n_name AS nation_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10")
def lookup_required(s: SparkSession, d: str) -> DataFrame:
    return Lookup(table(s, d, "nation").filter("n_nationkey < 10"), "n_nationkey", columns=["n_name"], prefix="nation_", required=True).apply(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")))


@query("lookup_first_wins", "SELECT n_nationkey, n_regionkey, (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS first_nation FROM nation n")
def lookup_first_wins(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("first_nation"), F.col("n_nationkey").cast("bigint").alias("_seq"))
    return Lookup(ref, "n_regionkey", columns=["first_nation"]).apply(table(s, d, "nation").select("n_nationkey", "n_regionkey"))


@query("lookup_fill_only", "SELECT r.request_id, r.crawl, coalesce(r.domain, 'filled') AS domain FROM requests r")
def lookup_fill_only(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "requests").select("crawl").distinct().withColumn("domain", F.lit("filled"))
    return Lookup(ref, "crawl").apply(table(s, d, "requests").select("request_id", "crawl", "domain"))


@query("convert_currency", """SELECT o_orderkey, CASE WHEN code IN ('EUR', 'USD', 'JPY') THEN CAST(round_even(CAST(o_totalprice AS DECIMAL(28, 8)) * CASE code WHEN 'EUR' THEN 1 WHEN 'USD' THEN 0.9 ELSE 0.0061 END, 2) AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
 CASE WHEN code IN ('EUR', 'USD', 'JPY') THEN 'EUR' ELSE code END AS currency FROM (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' ELSE 'XXX' END AS code FROM orders)""")
def convert_currency(s: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 4 == 0, "EUR").when(F.col("o_orderkey") % 4 == 1, "USD").when(F.col("o_orderkey") % 4 == 2, "JPY").otherwise("XXX")
    return ConvertCurrency(["o_totalprice"], "EUR", {"USD": 0.9, "JPY": 0.0061}).apply(table(s, d, "orders").select("o_orderkey", "o_totalprice", code.alias("currency")))


# ---------------------------------------------------------------- groups
@query("group_stats", """SELECT c_mktsegment AS label, count(*) AS count, CAST(round(CAST(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS DECIMAL(30, 12)), 4) AS DOUBLE) AS share, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank,
 count(*) AS c_acctbal_count, round(min(c_acctbal), 2) AS c_acctbal_min, round(max(c_acctbal), 2) AS c_acctbal_max, round(avg(c_acctbal), 2) AS c_acctbal_mean, round(median(c_acctbal), 2) AS c_acctbal_median FROM customer GROUP BY 1""")
def group_stats(s: SparkSession, d: str) -> DataFrame:
    return groups.group_records(table(s, d, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment", ["c_acctbal"])


@query("group_null_last", """SELECT domain AS label, count(*) AS count, CAST(round(CAST(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS DECIMAL(30, 12)), 4) AS DOUBLE) AS share, row_number() OVER (ORDER BY domain IS NULL, count(*) DESC, domain) AS rank FROM requests GROUP BY domain""")
def group_null_last(s: SparkSession, d: str) -> DataFrame:
    return groups.group_records(table(s, d, "requests").select("domain"), "domain")


@query("group_label_mode", """WITH v AS (SELECT lower(trim(lang)) AS k, lang AS s, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)
SELECT (SELECT s FROM v x WHERE x.k IS NOT DISTINCT FROM p.k ORDER BY n DESC, f LIMIT 1) AS label, count FROM (SELECT k, sum(n)::BIGINT AS count FROM v GROUP BY k) p""")
def group_label_mode(s: SparkSession, d: str) -> DataFrame:
    return groups.group_records(table(s, d, "documents").select("lang", F.col("doc_id").alias("_seq")), "lang").select("label", "count")


# ---------------------------------------------------------------- schema
def _order_schema() -> Schema:
    return Schema("orders", [Field("o_orderkey", "integer", required=True), Field("o_orderstatus", "string", pattern="^[FO]$"), Field("o_totalprice", "number", minimum=1000, maximum=400000)], key=["o_orderkey"])


_ISSUES = """SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT regexp_matches(o_orderstatus, '^[FO]$') THEN 'o_orderstatus:pattern:error' END, CASE WHEN o_totalprice < 1000 THEN 'o_totalprice:range:error' END, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:range:error' END,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 5000 THEN 'cheap:rule:warning' END], lambda x: x IS NOT NULL)) AS i FROM orders"""


def _issued(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return df.withColumn("_issues", issue_column(df, _order_schema(), [Rule("cheap", "o_orderpriority != '1-URGENT' or o_totalprice >= 5000", severity="warning")]))


@query("validate_issues", f"SELECT o_orderkey, split_part(i, ':', 1) AS field, split_part(i, ':', 2) AS code, split_part(i, ':', 3) AS severity FROM ({_ISSUES})")
def validate_issues(s: SparkSession, d: str) -> DataFrame:
    return _issued(s, d).select("o_orderkey", F.explode("_issues").alias("i")).select("o_orderkey", "i.field", "i.code", "i.severity")


@query("validate_counts", f"SELECT split_part(i, ':', 1) AS field, split_part(i, ':', 2) AS code, split_part(i, ':', 3) AS severity, count(*) AS n FROM ({_ISSUES}) GROUP BY ALL")
def validate_counts(s: SparkSession, d: str) -> DataFrame:
    return issue_counts(_issued(s, d))


@query("validate_rejects", "SELECT o_orderkey FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[FO]$') OR o_totalprice < 1000 OR o_totalprice > 400000")
def validate_rejects(s: SparkSession, d: str) -> DataFrame:
    return Validate(_order_schema()).split(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))[1].select("o_orderkey")


@query("normalize_schema")
def normalize_schema(s: SparkSession, d: str) -> DataFrame:
    """Ten types over the texts of parts and their prices."""
    schema = Schema("parts", [Field("p_partkey", "integer", required=True), Field("name", "string", aliases=["p_name"]), Field("price", "money", aliases=["price_text"]), Field("currency", "currency", aliases=["no_currency"]), Field("size", "quantity", unit="mm", aliases=["size_text"]), Field("link", "url", aliases=["url_text"]), Field("made", "date", aliases=["date_text"])])
    df = spread(table(s, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")).select("p_partkey", "p_name", F.concat(F.lit("€"), F.col("p_retailprice")).alias("price_text"), F.concat("p_size", F.lit(" cm")).alias("size_text"), F.concat(F.lit("https://Shop.example/p/"), "p_partkey", F.lit("?utm_source=x")).alias("url_text"), F.lit("5 March 2024").alias("date_text"))
    return schema.normalize(df)


@query("infer_types")
def infer_types(s: SparkSession, d: str) -> DataFrame:
    return infer_table(table(s, d, "events").select("event_id", "event_type", "value", "props"))


@query("pipeline_normalize_validate_dedupe")
def pipeline_normalize_validate_dedupe(s: SparkSession, d: str) -> DataFrame:
    schema = Schema("requests", [Field("request_id", "integer", required=True), Field("url", "url", required=True), Field("domain", "string"), Field("priority", "integer", minimum=0)])
    steps = [stages.Normalize(schema), Validate(schema), Filter("priority >= 1"), Compute({"kind": "path(url)[1:4]"}), Deduplicate(fields=["url"])]
    return Pipeline(steps).run(spread(table(s, d, "requests").select("request_id", "url", "domain", "priority", F.col("seq").alias("_seq")))).drop("_seq")


# ---------------------------------------------------------------- duplicates
@query("dedupe_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedupe_key(s: SparkSession, d: str) -> DataFrame:
    return Deduplicate(fields=["o_custkey"]).apply(table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("_seq"))).select("o_custkey", "o_orderkey")


@query("dedupe_content", "SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) GROUP BY t")
def dedupe_content(s: SparkSession, d: str) -> DataFrame:
    return Deduplicate(content=["text"]).apply(table(s, d, "documents").select("doc_id", "text", F.col("doc_id").alias("_seq"))).select("doc_id")


@query("dedupe_mark", "SELECT o_orderkey, CASE WHEN first < o_orderkey THEN first END AS _duplicate_of, CASE WHEN first < o_orderkey THEN 'key' END AS _duplicate_kind FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)")
def dedupe_mark(s: SparkSession, d: str) -> DataFrame:
    return Deduplicate(fields=["o_custkey"], mark=True).apply(table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("_seq"))).select("o_orderkey", "_duplicate_of", "_duplicate_kind")


@query("near_dup_minhash")
def near_dup_minhash(s: SparkSession, d: str) -> DataFrame:
    """One row per document with the class of its near-duplicates."""
    return dedupe.near_duplicates(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", 0.8, k=5)


@query("near_dup_simhash")
def near_dup_simhash(s: SparkSession, d: str) -> DataFrame:
    """One row per document with the class of texts within three bits."""
    docs = spread(table(s, d, "documents").select("doc_id", "text"))
    marked = docs.filter("trim(text) <> ''").select("doc_id", dedupe.simhash_column(F.col("text")).alias("h"))
    reps = marked.groupBy("h").agg(F.min("doc_id").alias("node"))
    classes = dedupe.connected_components(dedupe.simhash_pairs(docs, "doc_id", "text", 3).select("a", "b"), reps.select("node"))
    return marked.join(reps, "h").join(classes, "node").select("doc_id", "class")


# ---------------------------------------------------------------- profiles
def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "requests").select("crawl", "op", "domain", "fingerprint", F.col("priority").cast("string").alias("priority"))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM requests" for c in ("crawl", "op", "domain", "fingerprint", "priority"))
_FILLED = "value IS NOT NULL AND trim(value) <> ''"


@query("profile_fields", f"SELECT field, count(*) AS rows, count(*) FILTER ({_FILLED}) AS present, count(*) FILTER (NOT coalesce({_FILLED}, false)) AS empty, count(*) FILTER (lower(value) IN ('n/a', 'none', 'null', 'unknown', '-')) AS placeholders, 0::BIGINT AS damaged, count(DISTINCT CASE WHEN {_FILLED} THEN value END) AS \"distinct\", round(count(*) FILTER ({_FILLED}) / CAST(count(*) AS DOUBLE), 4) AS completeness FROM ({_LONG}) GROUP BY field")
def profile_fields(s: SparkSession, d: str) -> DataFrame:
    return profile.profile_fields(_customers(s, d))


@query("profile_top", f"SELECT field, rank, value, n FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5")
def profile_top(s: SparkSession, d: str) -> DataFrame:
    return profile.top_values(_customers(s, d))


@query("profile_shapes", "SELECT 'p_brand' AS field, regexp_replace(regexp_replace(p_brand, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n FROM part GROUP BY 2")
def profile_shapes(s: SparkSession, d: str) -> DataFrame:
    return profile.profile_shapes(table(s, d, "part").select("p_brand"))


@query("profile_distinct_approx")
def profile_distinct_approx(s: SparkSession, d: str) -> DataFrame:
    return profile.approximate_distinct(_customers(s, d))


@query("profile_consistency")
def profile_consistency(s: SparkSession, d: str) -> DataFrame:
    return profile.consistency(_customers(s, d))


@query("profile_numeric", """WITH v AS (SELECT 'p_size' AS field, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part), m AS (SELECT field, median(value) AS med FROM v GROUP BY 1)
SELECT v.field, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(median(value), 6) AS median, round(median(abs(value - med)), 6) AS mad FROM v JOIN m USING (field) GROUP BY 1""")
def profile_numeric(s: SparkSession, d: str) -> DataFrame:
    return profile.numeric_profile(table(s, d, "part").select("p_size", "p_retailprice"))


@query("mad_outliers", """WITH m AS (SELECT median(n_chars) AS med FROM documents), a AS (SELECT med, median(abs(n_chars - med)) AS mad FROM documents, m GROUP BY med)
SELECT doc_id AS key, CAST(n_chars AS DOUBLE) AS value, round(0.6745 * abs(n_chars - med) / mad, 6) AS z FROM documents, a WHERE n_chars IS NOT NULL AND 0.6745 * abs(n_chars - med) / mad > 8""")
def mad_outliers(s: SparkSession, d: str) -> DataFrame:
    return profile.mad_outliers(table(s, d, "documents"), "doc_id", "n_chars")


@query("ks_shift", """WITH u AS (SELECT l_quantity AS v, 1 AS x, 0 AS y FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_quantity, 0, 1 FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT v, sum(x) AS x, sum(y) AS y FROM u GROUP BY v), c AS (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM p)
SELECT round(max(abs(cx / CAST(nx AS DOUBLE) - cy / CAST(ny AS DOUBLE))), 6) AS d, max(abs(cx / CAST(nx AS DOUBLE) - cy / CAST(ny AS DOUBLE))) > 1.94947 * sqrt((max(nx) + max(ny)) / (CAST(max(nx) AS DOUBLE) * max(ny))) AS shifted FROM c""")
def ks_shift(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").select("l_quantity", "l_returnflag")
    return profile.ks_statistic(items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'R'"), "l_quantity")


@query("profile_compare")
def profile_compare(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("balance"))
    return profile.compare_profiles(profile.profile_fields(a), profile.profile_fields(b))


@query("profile_score")
def profile_score(s: SparkSession, d: str) -> DataFrame:
    return profile.score(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])


# ---------------------------------------------------------------- differences and history
def _edited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, " X ").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"))))
    return old.filter("o_orderkey % 10 <> 4"), new


_EDIT = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 4), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 10 <> 3),
j AS (SELECT coalesce(n.k, o.k) AS o_orderkey, o.k IS NULL AS a, n.k IS NULL AS r, o.s AS os, n.s AS ns, o.p AS op, n.p AS np FROM o FULL JOIN n ON o.k = n.k)"""


@query("diff_changes", f"{_EDIT} SELECT o_orderkey, CASE WHEN a THEN 'added' WHEN r THEN 'removed' WHEN os <> ns OR op <> np THEN 'changed' ELSE 'unchanged' END AS change FROM j")
def diff_changes(s: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_edited(s, d), ["o_orderkey"]).select("o_orderkey", "change")


@query("diff_field_stats", f"{_EDIT}, f AS (SELECT 'o_totalprice' AS field, np - op AS delta, (np - op) / op AS ratio FROM j WHERE NOT a AND NOT r AND op <> np UNION ALL SELECT 'o_orderstatus', NULL, NULL FROM j WHERE NOT a AND NOT r AND os <> ns) SELECT field, count(*) AS records, count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down, round(median(round(ratio, 6)), 6) AS median_ratio, 0::BIGINT AS appeared, 0::BIGINT AS disappeared FROM f GROUP BY 1")
def diff_field_stats(s: SparkSession, d: str) -> DataFrame:
    return diff.field_stats(diff.diff(*_edited(s, d), ["o_orderkey"]))


@query("diff_flat")
def diff_flat(s: SparkSession, d: str) -> DataFrame:
    return diff.flat(diff.diff(*_edited(s, d), ["o_orderkey"]), ["o_orderkey"])


@query("bag_diff", "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity <= 25)")
def bag_diff(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return diff.bag_difference(items.filter("l_quantity <= 25").drop("l_quantity"), items.filter("l_quantity > 25").drop("l_quantity"))[0]


@query("version_digest")
def version_digest(s: SparkSession, d: str) -> DataFrame:
    return diff.digest(table(s, d, "orders"))


def _history(s: SparkSession, d: str) -> DataFrame:
    pages = once(table(s, d, "pages").select("page_id", "run", "url", "status", "fetched", F.get_json_object("snapshot", "$.text").alias("content")), "page_id")
    return pages


_PAGES = "SELECT DISTINCT page_id, run, url, status, fetched, snapshot->>'$.text' AS content FROM pages"


@query("asof_compare", f"""WITH p AS ({_PAGES}), b AS (SELECT url, arg_max(content, run) AS bc, arg_max(status, run) AS bs FROM (SELECT url, run, max_by(content, page_id) AS content, max_by(status, page_id) AS status FROM p WHERE run <= 4 GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT url, max_by(content, page_id) AS ac, max_by(status, page_id) AS st FROM p WHERE run = 5 GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN CASE WHEN bs NOT IN (404, 410) THEN 'removed' END WHEN st IN (404, 410) THEN CASE WHEN b.url IS NOT NULL AND bs NOT IN (404, 410) THEN 'removed' END WHEN st >= 400 THEN 'skipped' WHEN b.url IS NULL OR bs IN (404, 410) THEN 'added' WHEN ac IS NOT DISTINCT FROM bc THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.url = b.url) WHERE change IS NOT NULL""")
def asof_compare(s: SparkSession, d: str) -> DataFrame:
    """Every url as of run 4 against run 5; of several rows of a run the largest page_id counts."""
    p = _history(s, d).groupBy("url", "run").agg(F.max(F.struct("page_id", "content", "status")).alias("r")).select("url", "run", "r.content", "r.status")
    return history.compare_runs(p, 4, 5)


@query("asof_compare_all", f"""WITH p AS ({_PAGES}), r AS (SELECT DISTINCT run, site, coalesce(status = 'finished', false) AS complete FROM runs), v AS (SELECT site, url, run, arg_max(struct_pack(content := content, status := p.status), page_id) AS a FROM p JOIN r USING (run) GROUP BY 1, 2, 3),
u AS (SELECT site, url, min(run) AS known FROM v GROUP BY 1, 2), g AS (SELECT u.site, u.url, r.run, r.complete, v.a FROM u JOIN r ON r.site = u.site AND r.run >= u.known LEFT JOIN v ON v.site = u.site AND v.url = u.url AND v.run = r.run),
s AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY site, url ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g), t AS (SELECT site, run, url, complete, a IS NOT NULL AS now, b IS NOT NULL AND coalesce(b.status NOT IN (404, 410), true) AS there, a.status AS st, a.content AS ac, b.content AS bc FROM s WHERE run > (SELECT min(run) FROM r WHERE r.site = s.site))
SELECT * FROM (SELECT site, run, url, CASE WHEN NOT now THEN CASE WHEN there THEN CASE WHEN complete THEN 'removed' ELSE 'missing' END END WHEN st IN (404, 410) THEN CASE WHEN there THEN 'removed' END WHEN st >= 400 THEN 'skipped' WHEN NOT there THEN 'added' WHEN ac IS NOT DISTINCT FROM bc THEN 'unchanged' ELSE 'modified' END AS change FROM t) WHERE change IS NOT NULL""")
def asof_compare_all(s: SparkSession, d: str) -> DataFrame:
    """Every run of every site against its site as of the run before; urls absent from a run that was stopped are missing."""
    p = _history(s, d).groupBy("url", "run").agg(F.max(F.struct("page_id", "content", "status")).alias("r")).select("url", "run", "r.content", "r.status")
    runs = once(table(s, d, "runs").select("run", "site", F.coalesce(F.col("status") == "finished", F.lit(False)).alias("complete")), "run")
    return history.compare_all_runs(p, runs)


_OBSERVED = f"""WITH p AS ({_PAGES}), r AS (SELECT url, run, min(fetched) AS t, arg_min(content, fetched) AS fc, arg_max(content, fetched) AS lc FROM p GROUP BY 1, 2), l AS (SELECT *, lag(lc) OVER w AS before, lag(run) OVER w IS NOT NULL AS seen FROM r WINDOW w AS (PARTITION BY url ORDER BY run)),
o AS (SELECT url, count(*) AS n, count(*) FILTER (seen AND fc IS DISTINCT FROM before) AS changes, min(t) AS a, max(t) AS b FROM l GROUP BY 1), f AS (SELECT *, CASE WHEN n > 1 AND b > a THEN -ln((n - changes) / (n + 0.5)) / ((b - a) / (n - 1) / 86400) END AS rate FROM o)"""


@query("freshness", f"{_OBSERVED} SELECT url, n, changes, round(rate, 6) AS rate_per_day, round(CASE WHEN rate > 0 THEN least(greatest(-ln(0.5) / rate * 86400, 3600), 2592000) ELSE 2592000 END, 1) AS recrawl, round(CASE WHEN rate IS NULL THEN 1 ELSE exp(-rate * greatest(0, 1790000000 - b) / 86400) END, 4) AS fresh FROM f")
def freshness(s: SparkSession, d: str) -> DataFrame:
    return history.freshness(_history(s, d), 1790000000.0)


@query("change_frequency", f"{_OBSERVED} SELECT round(median(round(rate, 6)), 4) AS changes_per_day FROM f WHERE rate IS NOT NULL")
def change_frequency(s: SparkSession, d: str) -> DataFrame:
    return history.change_frequency(_history(s, d), 1790000000.0)


# ---------------------------------------------------------------- rankings
def _serp(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.concat(F.lit("q"), F.col("l_partkey") % 40).alias("query"), F.col("l_linenumber").alias("position"), F.concat(F.lit("d"), F.col("l_suppkey") % 60).alias("domain"), F.concat(F.lit("u"), F.col("l_suppkey") % 60, F.lit("/"), F.col("l_partkey") % 25).alias("url"), F.col("l_returnflag").alias("type"), F.date_trunc("year", "l_shipdate").alias("fetched"))


_SERP = """WITH r AS (SELECT 'q' || (l_partkey % 40) AS query, l_linenumber AS position, 'd' || (l_suppkey % 60) AS domain, 'u' || (l_suppkey % 60) || '/' || (l_partkey % 25) AS url, l_returnflag AS type, date_trunc('year', l_shipdate) AS fetched FROM lineitem),
now AS (SELECT * FROM r QUALIFY rank() OVER (PARTITION BY query ORDER BY fetched DESC) = 1), best AS (SELECT domain, query, min(position) AS best FROM now GROUP BY 1, 2)"""


@query("latest_per_key", f"{_SERP} SELECT query, position, domain, url, type FROM now")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return ranking.latest(_serp(s, d)).drop("fetched")


@query("rank_visibility", f"{_SERP} SELECT domain, count(*) AS found, min(best) AS best, round(avg(best), 2) AS average, CAST(round(CAST(sum(CAST(1 / CAST(best AS DOUBLE) AS DECIMAL(20, 12))) / (SELECT count(DISTINCT query) FROM now) AS DECIMAL(30, 16)), 4) AS DOUBLE) AS visibility FROM best GROUP BY 1 ORDER BY 5 DESC, 4, 1 LIMIT 20")
def rank_visibility(s: SparkSession, d: str) -> DataFrame:
    return ranking.competitors(_serp(s, d))


@query("rank_visibility_of", f"{_SERP} SELECT CAST(round(CAST(sum(CAST(1 / CAST(best AS DOUBLE) AS DECIMAL(20, 12))) / (SELECT count(DISTINCT query) FROM now) AS DECIMAL(30, 16)), 4) AS DOUBLE) AS visibility FROM best WHERE domain = 'd7'")
def rank_visibility_of(s: SparkSession, d: str) -> DataFrame:
    return ranking.visibility(_serp(s, d), "d7")


@query("rank_gaps", f"{_SERP} SELECT query, count(*) AS rivals, min(best) AS best FROM best WHERE domain IN ('d1', 'd2', 'd3') AND query NOT IN (SELECT query FROM best WHERE domain = 'd7') GROUP BY 1")
def rank_gaps(s: SparkSession, d: str) -> DataFrame:
    return ranking.gaps(_serp(s, d), "d7", ["d1", "d2", "d3"])


@query("rank_changes", f"{_SERP}, a AS (SELECT query, min(CASE WHEN domain = 'd7' THEN position END) AS before FROM r WHERE year(fetched) % 2 = 0 GROUP BY 1), b AS (SELECT query, min(CASE WHEN domain = 'd7' THEN position END) AS after FROM r WHERE year(fetched) % 2 = 1 GROUP BY 1) SELECT query, before, after, CASE WHEN before IS NULL THEN 'entered' WHEN after IS NULL THEN 'left' WHEN after < before THEN 'up' WHEN after > before THEN 'down' ELSE 'same' END AS change FROM a JOIN b USING (query) WHERE before IS NOT NULL OR after IS NOT NULL")
def rank_changes(s: SparkSession, d: str) -> DataFrame:
    r = _serp(s, d)
    return ranking.ranking_changes(r.filter(F.year("fetched") % 2 == 0), r.filter(F.year("fetched") % 2 == 1), "d7")


@query("rank_history", f"{_SERP}, h AS (SELECT query, year(fetched) AS year, min(CASE WHEN domain = 'd7' THEN position END) AS position FROM r GROUP BY 1, 2) SELECT query, CAST(year AS INT) AS year, position, lag(position) OVER (PARTITION BY query ORDER BY year) - position AS change FROM h")
def rank_history(s: SparkSession, d: str) -> DataFrame:
    return ranking.ranking_history(_serp(s, d), "d7").select("query", F.year("fetched").alias("year"), "position", "change")


@query("rank_overlap", f"""{_SERP}, t AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY min(position), url) AS r FROM now WHERE query IN ('q1', 'q2') GROUP BY query, url),
j AS (SELECT x.r AS ra, y.r AS rb FROM (SELECT url, r FROM t WHERE query = 'q1') x FULL JOIN (SELECT url, r FROM t WHERE query = 'q2') y ON x.url = y.url), n AS (SELECT greatest(max(ra), max(rb)) AS n FROM j),
k AS (SELECT unnest(generate_series(1, (SELECT n FROM n))) AS k), a AS (SELECT k, (SELECT count(*) FROM j WHERE ra <= k AND rb <= k) AS x FROM k)
SELECT (SELECT round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 4) FROM j) AS jaccard, round(sum(x / k * power(0.9, k - 1)) * 0.1 / (1 - power(0.9, max(k))), 4) AS rbo FROM a""")
def rank_overlap(s: SparkSession, d: str) -> DataFrame:
    return ranking.overlap(_serp(s, d), "q1", "q2")


@query("rank_shared_urls", f"{_SERP}, k AS (SELECT DISTINCT query, url FROM now) SELECT x.query AS a, y.query AS b, count(*) AS shared FROM k x JOIN k y ON x.url = y.url AND x.query < y.query GROUP BY 1, 2 HAVING count(*) >= 3")
def rank_shared_urls(s: SparkSession, d: str) -> DataFrame:
    return ranking.shared_urls(_serp(s, d))


@query("rank_clusters")
def rank_clusters(s: SparkSession, d: str) -> DataFrame:
    return ranking.cluster_queries(_serp(s, d))


@query("rank_modules", f"{_SERP}, b AS (SELECT type, query, min(position) AS m, count(*) AS n FROM now GROUP BY 1, 2), t AS (SELECT type, domain, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, domain) AS k FROM now GROUP BY 1, 2) SELECT type, count(*) AS queries, sum(n)::BIGINT AS results, round(avg(m), 2) AS average, (SELECT string_agg(domain, ', ' ORDER BY k) FROM t WHERE t.type = b.type AND k <= 3) AS domains FROM b GROUP BY type")
def rank_modules(s: SparkSession, d: str) -> DataFrame:
    return ranking.modules(_serp(s, d))


# ---------------------------------------------------------------- windows over events
@query("rolling_rate_30s", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_rate_30s(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return streams.rolling_count(e, ["event_type"], "t", 30_000_000).select("event_id", "n")


@query("last_n_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def last_n_mean(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(s, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("latency_percentile_index", "SELECT event_type, q, v AS value FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) JOIN (SELECT unnest([0.5, 0.9, 0.99]) AS q) ON i = CAST(floor(q * n) AS BIGINT)")
def latency_percentile_index(s: SparkSession, d: str) -> DataFrame:
    """The value at the index floor(q n)."""
    return quantiles.value_at(table(s, d, "events"), ["event_type"], "value", [0.5, 0.9, 0.99])


@query("queue_order", "SELECT crawl, request_id, place FROM (SELECT crawl, request_id, row_number() OVER (PARTITION BY crawl ORDER BY priority DESC, seq) AS place FROM (SELECT DISTINCT * FROM requests WHERE op = 'push')) WHERE place <= 10")
def queue_order(s: SparkSession, d: str) -> DataFrame:
    """The next ten requests of every crawl."""
    pushed = once(table(s, d, "requests").filter("op = 'push'").select("request_id", "crawl", "priority", "seq"), "request_id")
    return streams.queue_order(pushed, 10).select("crawl", "request_id", "place")


# ---------------------------------------------------------------- urls, sites and texts
@query("url_normalize")
def url_normalize(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "requests").select("request_id", "url")).select("request_id", U.normalize_url_col(F.col("url")).alias("url"))


@query("url_refusals")
def url_refusals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "requests").groupBy(U.refusal_col(F.col("url"), max_length=100, deny=r"/media/").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("url_routes")
def url_routes(s: SparkSession, d: str) -> DataFrame:
    return sites.routes(table(s, d, "urls"))


@query("path_rollup", "WITH u AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, string_split(trim(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/'), '/') AS s FROM urls WHERE url IS NOT NULL), x AS (SELECT host, list_filter(s, lambda p: p <> '') AS s FROM u), p AS (SELECT host, unnest(list_transform(range(0, least(len(s), 3) + 1), lambda i: '/' || array_to_string(s[1:i], '/'))) AS prefix FROM x) SELECT host, prefix, count(*) AS pages FROM p GROUP BY 1, 2")
def path_rollup(s: SparkSession, d: str) -> DataFrame:
    return sites.path_rollup(table(s, d, "urls"))


@query("classify_url")
def classify_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "urls").select("url", sites.classify_url(F.col("url")).alias("c")).select("url", "c.kind", "c.confidence").distinct()


@query("site_profile", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status BETWEEN 300 AND 399) AS redirects, count(*) FILTER (status >= 400) AS errors, round(count(*) FILTER (status >= 400) / CAST(count(*) AS DOUBLE), 4) AS error_rate, CASE WHEN count(*) > 1 THEN round((max(fetched) - min(fetched)) / (count(*) - 1), 3) END AS seconds_apart FROM (SELECT DISTINCT page_id, url, status, fetched FROM pages) GROUP BY 1")
def site_profile(s: SparkSession, d: str) -> DataFrame:
    return sites.site_profile(once(table(s, d, "pages").select("page_id", "url", "status", "fetched"), "page_id"))


@query("duplicate_routes", "SELECT snapshot->>'$.body' AS digest, count(DISTINCT url) AS urls, min(url) AS example FROM pages WHERE snapshot->>'$.body' IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) > 1")
def duplicate_routes(s: SparkSession, d: str) -> DataFrame:
    return sites.duplicate_routes(table(s, d, "pages").select("url", F.get_json_object("snapshot", "$.body").alias("body")), "body")


def _facts(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.html import page_facts

    return spread(table(s, d, "pages").filter("html is not null").select("page_id", "url", "html")).select("page_id", "url", page_facts(F.col("html"), F.col("url")).alias("f"))


@query("html_facts")
def html_facts(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).select("page_id", "f.title", "f.h1", "f.lang", "f.words", "f.tables", F.size("f.links").alias("links"))


@query("html_title")
def html_title(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).select("page_id", "f.title")


@query("html_links", "SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"/')) AS links FROM pages WHERE html IS NOT NULL")
def html_links(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).select("page_id", F.size("f.links").cast("bigint").alias("links"))


@query("html_markdown")
def html_markdown(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.html import html_markdown as f

    return spread(table(s, d, "pages").filter("html is not null").select("page_id", "html")).select("page_id", f(F.col("html")).alias("markdown"))


@query("html_main")
def html_main(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.html import html_main as f

    return spread(table(s, d, "pages").filter("html is not null").select("page_id", "html")).select("page_id", f(F.col("html")).alias("text"))


@query("html_tables")
def html_tables(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.html import html_tables as f

    rows = spread(table(s, d, "pages").filter("html is not null").select("page_id", "html")).select("page_id", F.posexplode(f(F.col("html"))).alias("n", "t"))
    return rows.select("page_id", "n", F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").alias("rows"))


@query("html_extract")
def html_extract(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.html import html_extract as f

    got = f(F.col("html"), {"heading": "h1", "points": {"selector": "ul > li", "many": True}})
    return spread(table(s, d, "pages").filter("html is not null").select("page_id", "html")).select("page_id", got.alias("x")).select("page_id", "x.heading", F.size("x.points").alias("points"))


@query("technologies")
def technologies(s: SparkSession, d: str) -> DataFrame:
    return sites.technologies(table(s, d, "pages").filter("html is not null").select("url", "html"))


@query("analyze_text")
def analyze_text(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.text import analyze

    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", analyze(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("word_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}'']+'), lambda w: w <> '')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 20")
def word_counts(s: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.text import word_counts as f

    return f(table(s, d, "documents"), "text", 20)


# ---------------------------------------------------------------- entities and graphs
@query("entities_resolve")
def entities_resolve(s: SparkSession, d: str) -> DataFrame:
    """Names of suppliers and of customers, spelled in two ways, with a website for some."""
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" Inc.")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://www.s"), "s_suppkey", F.lit(".example"))).alias("website"))
    b = table(s, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.upper("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("http://s"), "s_suppkey", F.lit(".example/x"))).alias("website"))
    return entities.resolve(a.unionByName(b), "company")[0]


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(table(s, d, "part").select("p_name", "p_brand", "p_type", F.col("p_partkey").alias("url")), ("type", "p_type"), [("made_by", "brand", "p_brand")])


_EDGES = "SELECT 'type:' || replace(lower(p_type), ' ', '-') AS src, 'made_by' AS relation, 'brand:' || replace(lower(p_brand), '#', '-') AS dst, count(*) AS count, count(DISTINCT p_partkey) AS sources, 1.0::DOUBLE AS confidence FROM part GROUP BY 1, 2, 3"


@query("graph_edges", _EDGES)
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)[1]


@query("graph_nodes")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)[0]


@query("graph_degree", f"SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM ({_EDGES})) GROUP BY 1")
def graph_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degree(_graph(s, d)[1])


# ---------------------------------------------------------------- streams (each equals its batch form)
def _events(s: SparkSession, d: str) -> DataFrame:
    """The events table as a stream over its one file."""
    kind = table(s, d, "events").schema
    return s.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s: SparkSession, d: str) -> DataFrame:
    return streams.replay(streams.drop_seen(_events(s, d).select("user_id", "event_type"), ["user_id", "event_type"]))


@query("stream_failures", "SELECT event_type, count(*) AS attempts FROM events GROUP BY 1")
def stream_failures(s: SparkSession, d: str) -> DataFrame:
    got = streams.failures(_events(s, d), ["event_type"], "user_id", "ts")
    return streams.last_of(streams.replay(got, mode="update"), ["event_type"]).select("event_type", "attempts")


@query("stream_rolling", "SELECT event_type, w AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def stream_rolling(s: SparkSession, d: str) -> DataFrame:
    """Counts over windows of two hours every hour."""
    got = streams.rolling_counts(_events(s, d), "ts", ["event_type"], "2 hours", "1 hour")
    out = streams.last_of(streams.replay(got, mode="update"), ["event_type", "start", "end"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("throttle_delays")
def throttle_delays(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "requests").select(F.col("domain").alias("key"), "seq", (F.col("retries") > 0).alias("error"))
    return streams.throttle_batch(rows)


# ---------------------------------------------------------------- extension: similar vectors
@query("ext_embedding_cosine_topk", """WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (q.n * c.n), 6) AS similarity FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5""")
def ext_embedding_cosine_topk(s: SparkSession, d: str) -> DataFrame:
    """The five vectors nearest to each whose id is divisible by 50, exactly: queries go to the vectors in blocks,
    products are matrices, and each batch keeps its best five before anything is shuffled."""
    from loomspark.operators.vectors import nearest

    return nearest(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5, 50)


# ---------------------------------------------------------------- what a crawl keeps
@query("snapshot_changes", """WITH last AS (SELECT url, run, snapshot AS s FROM pages WHERE url IS NOT NULL AND snapshot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, run ORDER BY fetched DESC NULLS LAST, page_id DESC) = 1),
v AS (SELECT url, run, CAST(s->>'$.status' AS INT) AS status, s->>'$.text' AS text, s->>'$.title' AS title, s->>'$.description' AS description, s->>'$.structured' AS structured, CAST(s->>'$.price' AS DOUBLE) AS price, s->>'$.currency' AS currency, s->>'$.availability' AS availability, coalesce(CAST(s->>'$.layout' AS BIGINT), 0) AS layout, s->>'$.navigation' AS navigation, s->>'$.items' AS items FROM last),
o AS (SELECT url, run, v, lag(v) OVER (PARTITION BY url ORDER BY run) AS w FROM (SELECT url, run, v FROM v)),
k AS (SELECT url, run, concat_ws(',', CASE WHEN v.status IS DISTINCT FROM w.status THEN 'status' END, CASE WHEN v.text IS DISTINCT FROM w.text THEN 'text' END, CASE WHEN v.title IS DISTINCT FROM w.title THEN 'title' END, CASE WHEN v.description IS DISTINCT FROM w.description THEN 'description' END, CASE WHEN v.structured IS DISTINCT FROM w.structured THEN 'structured-data' END,
 CASE WHEN v.price IS DISTINCT FROM w.price OR v.currency IS DISTINCT FROM w.currency THEN 'price' END, CASE WHEN v.availability IS DISTINCT FROM w.availability THEN 'availability' END, CASE WHEN bit_count(xor(v.layout, w.layout)) >= 8 THEN 'layout' END, CASE WHEN v.navigation IS DISTINCT FROM w.navigation THEN 'navigation' END, CASE WHEN v.items IS NOT NULL AND w.items IS NOT NULL AND v.items <> w.items THEN 'items' END) AS kinds FROM o WHERE w IS NOT NULL)
SELECT url, run, kinds FROM k WHERE kinds <> ''""")
def snapshot_changes(s: SparkSession, d: str) -> DataFrame:
    return crawl.snapshot_changes(table(s, d, "pages")).withColumn("kinds", F.array_join("kinds", ","))


@query("even_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () // 40 AS step FROM customer) WHERE i % greatest(step, 1) = 0 AND i < 40 * greatest(step, 1)")
def even_sample(s: SparkSession, d: str) -> DataFrame:
    return crawl.even_sample(table(s, d, "customer").select("c_custkey"), 40, "c_custkey")


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(s: SparkSession, d: str) -> DataFrame:
    return crawl.page_of(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 50)[0]


@query("cached_answers", "SELECT url, arg_max(status, (stored_at, coalesce(status, -1))) AS status FROM (SELECT DISTINCT url, status, stored_at FROM responses WHERE url IS NOT NULL AND stored_at IS NOT NULL) GROUP BY url HAVING max(stored_at) + INTERVAL 20 DAY > (SELECT max(stored_at) FROM responses)")
def cached_answers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "responses").select("url", "status", "stored_at")
    now = rows.agg(F.max("stored_at").cast("string")).first()[0]
    return crawl.cached_answers(rows, now or "1970-01-01", 20 * 86400.0).select("url", "status")


@query("strategy_shares", """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?]*)', 1) AS pattern, html IS NOT NULL AS ok FROM pages),
g AS (SELECT host, pattern, count(*) AS pages, count(*) FILTER (NOT ok) AS short FROM p GROUP BY 1, 2), h AS (SELECT host, sum(short) / sum(pages) AS h FROM g GROUP BY 1)
SELECT host, pattern, pages, round(CASE WHEN pages < 5 THEN h ELSE short / pages END, 4) AS share, CASE WHEN pages < 5 THEN 'host' ELSE 'pattern' END AS "by" FROM g JOIN h USING (host)""")
def strategy_shares(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select("url", F.col("html").isNotNull().alias("ok"))
    return crawl.strategy_shares(pages, F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?]*)", 1), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.col("ok"))


@query("event_counts", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def event_counts(s: SparkSession, d: str) -> DataFrame:
    return crawl.event_counts(table(s, d, "events"), "event_type")


@query("failure_groups", "SELECT status, count(*) AS n, array_to_string(list_sort(list_distinct(list(url)))[1:3], ' ') AS urls FROM pages WHERE status >= 400 GROUP BY 1")
def failure_groups(s: SparkSession, d: str) -> DataFrame:
    return crawl.failure_groups(table(s, d, "pages").filter("status >= 400"), ["status"]).withColumn("urls", F.array_join("urls", " "))


@query("url_patterns", """WITH u AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM urls WHERE url IS NOT NULL),
l AS (SELECT host, len(parts) AS size, count(*) AS n FROM u GROUP BY 1, 2), m AS (SELECT host, arg_max(size, (n, -size)) AS size, count(*) AS lengths FROM l GROUP BY 1),
x AS (SELECT u.host, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM u JOIN m ON u.host = m.host AND len(u.parts) = m.size),
k AS (SELECT host, i, CASE WHEN min(part) = max(part) THEN min(part) WHEN bool_and(regexp_matches(part, '^\\d+$')) THEN '{id}' ELSE '{slug}' END AS p FROM x GROUP BY 1, 2)
SELECT m.host, '/' || coalesce(p, '') || CASE WHEN lengths > 1 THEN '/...' ELSE '' END AS pattern FROM m LEFT JOIN (SELECT host, string_agg(p, '/' ORDER BY i) AS p FROM k GROUP BY 1) y ON m.host = y.host""")
def url_patterns(s: SparkSession, d: str) -> DataFrame:
    return crawl.url_patterns(table(s, d, "urls").select("url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")), "host")


@query("read_results", "SELECT crawl AS query, CAST(priority AS INT) AS position, url, CAST(NULL AS VARCHAR) AS title, 'web' AS type FROM requests WHERE priority >= 1 AND nullif(trim(url), '') IS NOT NULL AND nullif(trim(crawl), '') IS NOT NULL")
def read_results(s: SparkSession, d: str) -> DataFrame:
    return crawl.read_results(table(s, d, "requests").select(F.col("crawl").alias("keyword"), F.col("priority").cast("string").alias("rank"), F.col("url").alias("link")))


@query("values_match", "SELECT p_partkey, p_size = 10 AS v FROM part")
def values_match(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", crawl.values_match(F.lit(" 10.0 "), F.col("p_size")).alias("v"))


@query("top_languages", "SELECT language AS value, count(*) AS n FROM text_analysis WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_languages(s: SparkSession, d: str) -> DataFrame:
    return crawl.top_counts(table(s, d, "text_analysis"), "language", 10)
