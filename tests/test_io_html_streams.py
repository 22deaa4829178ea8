import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomspark.functions import html as H
from loomspark.functions.text import analyze, detect_language, keywords
from loomspark.sources import io
from loomspark.streaming import operators as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a,b\nc", ["x"], True), (2, None, None, None, None)], "i bigint, d double, s string, l array<string>, b boolean")
    for name in ("x.jsonl", "x.parquet"):
        io.write_records(df, str(tmp_path / name))
        assert rows(io.read_records(spark, str(tmp_path / name)).select(*df.columns)) == rows(df)
    io.write_records(df, str(tmp_path / "x.csv"))
    back = io.read_records(spark, str(tmp_path / "x.csv"))
    assert {f.dataType.simpleString() for f in back.schema.fields} == {"string"} and back.filter("i = '1'").first()["s"] == "a,b\nc"
    io.write_sqlite(df, str(tmp_path / "x.sqlite"), key=["i"])
    io.write_sqlite(spark.createDataFrame([(1, None, "new", None, None)], df.schema), str(tmp_path / "x.sqlite"), key=["i"])
    got = io.read_records(spark, str(tmp_path / "x.sqlite"))
    assert rows(got.select("i", "d", "s", "b")) == [(1, 2.5, "new", True), (2, None, None, None)]
    with pytest.raises(ValueError):
        io.read_records(spark, "x.zzz")


def test_json_wrappers(spark, tmp_path):
    p = tmp_path / "w.json"
    for content in ([{"a": 1}, {"a": 2}], {"results": [{"a": 1}, {"a": 2}]}):
        p.write_text(json.dumps(content))
        assert rows(io.read_records(spark, str(p))) == [(1,), (2,)]
    assert io.read_records(spark, str(p), limit=1).count() == 1


def test_duckdb_source(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "x.duckdb")
    with duckdb.connect(path) as con:
        con.execute("create table items as select i, 'n' || i as s from range(5) t(i)")
    assert io.read_records(spark, path).count() == 5


def test_upsert_find_names(spark):
    df = spark.createDataFrame([(0, "a", 1, None), (1, "b", 2, "x"), (2, "a", None, "y"), (3, None, 9, "z")], "_seq bigint, k string, v int, w string")
    assert rows(io.upsert(df, ["k"]).select("_seq", "k", "v", "w")) == [(0, "a", 1, "y"), (1, "b", 2, "x"), (3, None, 9, "z")]
    assert io.find_records(df, k="a").count() == 2
    assert io.column_names(["A b", "a-b", "1x", ""]) == {"A b": "a_b", "a-b": "a_b_2", "1x": "_1x", "": "field"}


def test_sitemap(spark, tmp_path):
    p = tmp_path / "sitemap.xml"
    p.write_text("<urlset><url><loc> https://a.example/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.example/2</loc><lastmod>2020-01-01</lastmod></url></urlset>")
    assert io.read_sitemap(spark, str(p)).count() == 2 and rows(io.read_sitemap(spark, str(p), "2023-01-01").select("loc")) == [("https://a.example/1",)]


PAGE = """<html lang=en><head><title>A &amp; B</title><meta property="og:description" content="d"><link rel=canonical href=/c>
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "x"}]}</script></head><body><nav><a href="/n">Nav</a></nav><main><h1>Head</h1>
<p>Some <b>bold</b> text with a <a href="https://x.example/y#f">link</a> that is long enough to be the main content.</p><ul><li>one<li>two</ul>
<table><tr><th colspan=2>Top</th></tr><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table></main>
<div itemscope itemtype="https://schema.org/Offer"><span itemprop=price content=5>5</span></div></body></html>"""


def test_html():
    r = H.parse(PAGE)
    assert H.title_of(r) == "A & B" and H.metadata(r)["canonical"] == "/c" and H.metadata(r)["lang"] == "en"
    assert [(x["href"], x["nav"]) for x in H.links(r, "https://s.example/p/")] == [("https://s.example/n", True), ("https://x.example/y", False)]
    t = H.tables(r)[0]
    assert t["headers"] == ["Top a", "Top b"] and t["rows"] == [["1", "2"], ["1", "3"]]
    assert H.json_ld(r)[0]["@type"] == "Product" and H.microdata(r) == [{"@type": "Offer", "price": "5"}]
    assert H.main_content(r).tag == "main"
    md = H.markdown(r)
    assert "# Head" in md and "**bold**" in md and "- one" in md and "[link](https://x.example/y#f)" in md and "| 1 | 2 |" in md
    assert H.extract(PAGE, {"h": "main > h1", "items": {"selector": "ul li", "many": True}, "price": {"selector": "[itemprop=price]", "attr": "content"}}) == {"h": "Head", "items": ["one", "two"], "price": "5"}
    assert H.parse("").text() == "" and H.parse("<p>a<div>b").text() == "a b"
    deep = H.parse("<div>" * 5000 + "x")
    assert deep.text() == "x"


def test_html_columns(spark):
    df = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    got = df.select(H.page_facts(F.col("html"), F.col("url")).alias("f")).collect()
    assert got[0]["f"]["h1"] == "Head" and got[0]["f"]["types"] == ["Product", "Offer"] and got[1]["f"] is None
    assert df.select(H.html_extract(F.col("html"), {"h": "h1"}).alias("x")).first()["x"]["h"] == "Head"


def test_text(spark):
    assert detect_language("The cat is on the table and it was not there before they came")[0] == "en"
    assert detect_language("Der Hund und die Katze sind nicht auf dem Tisch")[0] == "de"
    assert detect_language("この製品は多くのお客さまに喜ばれています")[0] == "ja" and detect_language("x")[0] is None and detect_language(None)[0] is None
    assert keywords("party art party") == ["party", "art"] and keywords(None) == [] and keywords(" ".join(f"word{'abcdefghijkl'[i % 12]}{'abcdef'[i // 12]}" for i in range(70))) == []
    assert keywords("Solar panel prices rise. Solar panel makers sell more solar panel units.")[0] == "solar panel"
    df = spark.createDataFrame([("One two three. Four five!",), (None,), ("",)], "t string")
    got = [r["a"] for r in df.select(analyze(F.col("t")).alias("a")).collect()]
    assert (got[0]["words"], got[0]["sentences"]) == (5, 2) and got[1]["words"] == 0


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 00:00:{i % 60:02d}", f"k{i % 3}", i, i % 4 == 0) for i in range(90)], "t string, key string, seq bigint, error boolean").withColumn("t", F.col("t").cast("timestamp"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    stream = lambda: S.read_stream(spark, path, df.schema)
    assert rows(S.replay(S.drop_seen(stream().select("key"), ["key"]))) == [("k0",), ("k1",), ("k2",)]
    live = S.last_of(S.replay(S.failures(stream(), ["key"], "seq", "t"), mode="update"), ["key"])
    assert rows(live.select("key", "attempts")) == [("k0", 30), ("k1", 30), ("k2", 30)]
    batch = {r["key"]: (r["delay"], r["n"]) for r in S.throttle_batch(df).collect()}
    delay = 1.0
    for i in range(0, 90, 3):
        delay = min(60.0, delay * 1.5) if i % 4 == 0 else max(0.1, delay * 0.9)
    assert batch["k0"] == (round(delay, 6), 30)


def test_stateful_throttle(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(10)], "key string, seq bigint, error boolean")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = S.last_of(S.replay(S.throttle(S.read_stream(spark, path, df.schema)), mode="update"), ["key"])
    assert rows(live.select("key", "delay", "n")) == rows(S.throttle_batch(df).select("key", "delay", "n"))
