import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomspark.functions import columns as C
from loomspark.functions import documents as D
from loomspark.functions import values as V
from loomspark.operators import crawl as G
from loomspark.sources import io


def test_snapshot_changes(spark):
    a = {"status": 200, "text": "t", "title": "A", "price": 1.0, "layout": 0}
    b = {"status": 404, "text": "t", "title": "B", "price": 1.00, "layout": 255, "items": "i"}
    c = {**b, "layout": 254, "items": "j", "price": 2, "types": ["Product"]}
    rows = [(1, 1, "u", 1.0, json.dumps(a)), (2, 2, "u", 2.0, json.dumps(a)), (3, 2, "u", 3.0, json.dumps(b)), (4, 3, "u", 4.0, json.dumps(c)), (5, 3, "v", 4.0, None), (6, 3, None, 4.0, "{}"), (7, 4, "u", None, json.dumps(c)), (7, 4, "u", None, json.dumps(c))]
    got = {(r[0], r[1]): r[2] for r in G.snapshot_changes(spark.createDataFrame(rows, "page_id int, run int, url string, fetched double, snapshot string")).collect()}
    assert got == {("u", 2): ["status", "title", "layout"], ("u", 3): ["schema", "price", "items"]}
    assert G.snapshot_changes(spark.createDataFrame([], "page_id int, run int, url string, fetched double, snapshot string")).count() == 0


def test_samples_and_pages(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k")
    assert sorted(r[0] for r in G.even_sample(df, 4, "k").collect()) == [0, 250, 500, 750]
    assert G.even_sample(df, 0, "k").count() == 0 and G.even_sample(df.limit(3), 10, "k").count() == 3 and G.even_sample(df.limit(0), 3, "k").count() == 0
    assert [r["number"] for r in G.numbered(df, "k").orderBy("k").collect()] == list(range(1000))
    rows, after = G.page_of(df, ["k"], 990, 20)
    assert [r[0] for r in rows.collect()] == list(range(990, 1000)) and after is None and G.page_of(df, ["k"], 0, 10)[1] == 10


@pytest.mark.parametrize("text,want", [("120", 120.0), (" 7.5 ", 7.5), ("-3", 0.0), ("99999", 3600.0), ("Thu, 01 Jan 2026 00:01:00 GMT", 60.0), ("Thu, 01 Jan 2015 00:01:00 GMT", 0.0), ("soon", None), ("", None), (None, None)])
def test_retry_after(spark, text, want):
    assert spark.createDataFrame([(text,)], "h string").select(G.retry_after(F.col("h"), F.lit("2026-01-01 00:00:00"))).first()[0] == want


def test_cache_and_strategy(spark):
    rows = [("a", "2026-01-01 00:00:00", 200), ("a", "2026-01-02 00:00:00", 404), ("b", "2025-01-01 00:00:00", 200), ("c", None, 200), (None, "2026-01-02 00:00:00", 200)]
    df = spark.createDataFrame(rows, "url string, stored_at string, status int").withColumn("stored_at", F.col("stored_at").cast("timestamp"))
    assert [(r["url"], r["status"]) for r in G.cached_answers(df, "2026-01-02 12:00:00", 86400).collect()] == [("a", 404)]
    pages = spark.createDataFrame([("h", "p", i < 3) for i in range(6)] + [("h", "q", False), (None, "p", None)], "host string, pattern string, ok boolean")
    got = {(r[0], r[1]): tuple(r[2:]) for r in G.strategy_shares(pages, F.col("pattern"), F.col("host"), F.col("ok")).collect()}
    assert got == {("h", "p"): (6, 0.5, "pattern"), ("h", "q"): (1, 0.5714, "host"), (None, "p"): (1, 1.0, "host")}


def test_events_patterns_results(spark):
    f = spark.createDataFrame([("x", None, "u1"), ("x", None, "u2"), ("x", None, "u2"), ("y", 500, None)], "kind string, status int, url string")
    assert {(r[0], r[1], r["n"], tuple(r["urls"])) for r in G.failure_groups(f, ["kind", "status"], samples=1).collect()} == {("x", None, 3, ("u1",)), ("y", 500, 1, ())}
    assert {tuple(r) for r in G.event_counts(f, "kind").collect()} == {("x", 3), ("y", 1)}
    p = spark.createDataFrame([("g", "https://a.x/product/1"), ("g", "https://a.x/product/22"), ("g", "https://a.x/product/3/more"), ("h", "https://a.x/"), ("k", "https://a.x/n/ab"), ("k", "https://a.x/n/7"), ("k", None)], "g string, url string")
    assert {tuple(r) for r in G.url_patterns(p, "g").collect()} == {("g", "/product/{id}/..."), ("h", "/"), ("k", "/n/{slug}")}
    r = spark.createDataFrame([("q", "1", "u", None), ("q", "x", "u", None), ("q", "0", "u", None), (" ", "1", "u", None), ("q", "2", None, "T")], "keyword string, rank string, link string, title string")
    assert [tuple(x) for x in G.read_results(r).collect()] == [("q", 1, "u", None, "web")]
    v = spark.createDataFrame([("a  b", " a b"), ("1.0", "1"), ("", None), ("a", None), ("a", "b"), (None, None)], "e string, g string")
    assert [x[0] for x in v.select(G.values_match(F.col("e"), F.col("g"))).collect()] == [True, True, True, False, False, True]
    t = spark.createDataFrame([(["b", "a"],), (["a"],), (None,)], "w array<string>")
    assert [tuple(x) for x in G.top_counts(t, "w", 5).collect()] == [("a", 2), ("b", 1)]


def test_documents(spark):
    doc = json.dumps({"data": {"edges": [{"node": {"id": 1, "v": [{"s": 1}, {"s": 2}]}}, {"node": {"id": 2}}]}, "id": [3], "tags": ["a", "b"]})
    assert D.find_values(doc, "id") == ["1", "2", "[3]"] and D.find_values("{", "id") == [] and D.find_values(None, "id") == []
    assert [(c["path"], c["records"]) for c in D.json_collections(doc)] == [("data.edges[].node", 2), ("data.edges[].node.v[]", 2)]
    assert D.json_collections("[1, 2]") == [] and D.json_collections(None) == []
    html = """<script type="application/json" id="__NEXT_DATA__">{"a": 1}</script><script>window.__STATE__ = {"b": [2]}; x</script><script type="application/json">{bad</script>"""
    assert [(e["name"], json.loads(e["data"])) for e in D.embedded_json(html)] == [("__NEXT_DATA__", {"a": 1}), ("__STATE__", {"b": [2]})] and D.embedded_json(None) == []
    assert D.next_page('<link rel="next" href="/p/2">', "https://x.example/p/1") == "https://x.example/p/2"
    assert D.next_page("<a href='/3'> Next </a>", "https://x.example/") == "https://x.example/3" and D.next_page("<a href='/'>Home</a>", "https://x.example/") is None
    df = spark.createDataFrame([(doc,), (None,), ("",)], "j string")
    got = df.select(D.find_values_col(F.col("j"), "id").alias("v"), D.collections_col(F.col("j")).alias("c")).collect()
    assert list(got[0]["v"]) == ["1", "2", "[3]"] and got[0]["c"][0]["path"] == "data.edges[].node" and got[1]["v"] is None


def test_ranges_and_dimensions(spark):
    assert V.parse_money_range("$10 - $20") == ((Decimal(10), "USD"), (Decimal(20), "USD")) and V.parse_money_range("10 bis 20 EUR")[0] == (Decimal(10), "EUR")
    assert V.parse_money_range("10 EUR") is None and V.parse_money_range(None) is None
    assert V.parse_dimensions("10 x 20 x 30 cm") == [(Decimal(10), "cm"), (Decimal(20), "cm"), (Decimal(30), "cm")] and V.parse_dimensions("10 x 20") == [] and V.parse_dimensions(None) == []
    row = spark.createDataFrame([("5-7 EUR", "2 x 3 m")], "a string, b string").select(C.money_range(F.col("a")).alias("r"), C.dimensions(F.col("b")).alias("d")).first()
    assert tuple(row["r"]) == (5.0, 7.0, "EUR") and list(row["d"]) == ["2 m", "3 m"]


def test_json_array_sink(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 1 else f"n{i}") for i in range(5)], "id bigint, name string").repartition(3)
    io.write_records(df, str(tmp_path / "out.json"))
    assert sorted(tuple(r) for r in io.read_records(spark, str(tmp_path / "out.json")).select("id", "name").collect()) == [(0, "n0"), (1, None), (2, "n2"), (3, "n3"), (4, "n4")]
    for f in (tmp_path / "out.json").glob("part-*"):
        assert isinstance(json.loads(f.read_text()), list)
