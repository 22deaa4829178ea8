import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators.schema import Field, Rule, Schema, infer_schema, issue_column, issue_counts
from loomspark.operators.stages import Compute, ConvertCurrency, Deduplicate, Enrich, Exclude, Filter, Locate, Lookup, Normalize, Rename, Select, Transform, Validate
from loomspark.plans.pipeline import Pipeline


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rename(spark):
    df = spark.createDataFrame([("1", "", "x"), (None, "2", "y")], "cost string, amount string, c string")
    assert rows(Rename({"cost": "price", "amount": "price"}).apply(df)) == [("1", "x"), ("2", "y")]
    assert Rename({"cost": "c", "c": "cost"}).apply(df).columns == ["c", "amount", "cost"]
    assert rows(Rename({"amount": "c"}).apply(df)) == [("1", "x"), (None, "2")]


def test_select_and_exclude(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "price_eur int, price_usd int, html int, _issues int")
    assert Select(["price_*", "none"]).apply(df).columns == ["price_eur", "price_usd", "none", "_issues"]
    assert Exclude(["price_*"]).apply(df).columns == ["html", "_issues"]


def test_transform_policies(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "i int, v string")
    run = lambda p: rows(Transform(["v"], ["number"], on_error=p).apply(df))
    assert run("null") == [(1, 5.0), (2, None), (3, None)]
    assert run("drop") == [(1, 5.0), (3, None)]
    with pytest.raises(Exception, match="failed"):
        run("raise")
    lists = spark.createDataFrame([(["1", "x", "2"],)], "v array<string>")
    assert rows(Transform(["v"], ["number"]).apply(lists)) == [([1.0, 2.0],)]
    assert rows(Transform(["v"], ["last"], target="w").apply(lists))[0][1] == "2"


def test_lookup(spark):
    ref = spark.createDataFrame([("42", "first", 1), ("42.0", "second", 2), (None, "none", 3), ("us ", "country", 4)], "k string, label string, _seq bigint")
    df = spark.createDataFrame([(1, "42", None), (2, "US", "own"), (3, None, None), (4, "zz", None)], "i int, k string, label string")
    got = sorted(rows(Lookup(ref, "k", columns=["label"]).apply(df)))
    assert got == [(1, "42", "first"), (2, "US", "own"), (3, None, None), (4, "zz", None)]
    assert [r[0] for r in sorted(rows(Lookup(ref, "k", columns=["label"], required=True, overwrite=True).apply(df)))] == [1, 2]
    probe = spark.createDataFrame([(1, ["zz", "us", "42"])], "i int, k array<string>")
    assert rows(Lookup(ref, "k", columns=["label"]).apply(probe).select("label")) == [("country",)]


def test_convert_currency(spark):
    df = spark.createDataFrame([(10.0, 1.005, "USD"), (10.0, None, "EUR"), (5.0, 1.0, "XXX")], "a double, b double, currency string")
    got = rows(ConvertCurrency(["a", "b"], "EUR", {"USD": 0.5}).apply(df))
    assert got == [(5.0, 0.5, "EUR"), (10.0, None, "EUR"), (5.0, 1.0, "XXX")]
    assert len(rows(ConvertCurrency(["a"], "EUR", {"USD": 0.5}, on_error="drop").apply(df))) == 2


def test_compute_filter_enrich(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "i int, x double")
    assert rows(Compute({"y": "x * 2", "z": "y + 1"}).apply(df)) == [(1, 2.0, 4.0, 5.0), (2, None, None, None)]
    assert rows(Filter("x > 1").apply(df)) == [(1, 2.0)] and rows(Filter("x > 1", keep=False).apply(df)) == [(2, None)]

    def more(pdf):
        import pandas as pd

        return pd.DataFrame({"x": pdf["i"] * 10.0, "w": pdf["i"].astype(str)})

    assert rows(Enrich(more, "x double, w string", ["i"], overwrite=False).apply(df)) == [(1, 2.0, "1"), (2, 20.0, "2")]


def test_schema_normalize_and_validate(spark):
    schema = Schema("p", [Field("name", required=True), Field("price", "money", minimum=0, aliases=["cost"]), Field("currency", "currency"), Field("tags", "string[]"), Field("day", "date")], key=["name"])
    df = spark.createDataFrame([("  A  ", "$5.00", None, ["x", ""], "5 March 2024"), ("", "oops", None, None, None)], "name string, cost string, currency string, tags array<string>, day string")
    out = schema.normalize(df, notes=True)
    assert rows(out.select("name", "price", "currency", "tags", "day", "_unreadable")) == [("A", 5.0, "USD", ["x"], "2024-03-05", []), (None, None, None, None, None, ["price"])]
    valid, bad = Validate(schema, [Rule("cheap", "price > 1")]).split(out)
    assert valid.count() == 1
    assert sorted(i["code"] for i in bad.first()["_issues"]) == ["invalid", "missing"]
    assert rows(issue_counts(Validate(schema).issues(out)).select("field", "n").orderBy("field")) == [("name", 1), ("price", 1)]
    assert schema.json_schema()["required"] == ["name"]
    with pytest.raises(ValueError):
        Schema.from_config({"fieldz": []})


def test_rules_skip_missing(spark):
    df = spark.createDataFrame([(None,), (5,), (50,)], "x int")
    got = df.select(F.size(issue_column(df, None, [Rule("small", "x < 10")])).alias("n"))
    assert [r[0] for r in got.collect()] == [0, 0, 1]


def test_infer(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-{i + 1:02d}", "https://a.example", "x y") for i in range(20)], "a string, b string, c string, d string")
    assert [f.type for f in infer_schema(df).fields] == ["integer", "date", "url", "string"]


def test_dedupe_stages(spark):
    df = spark.createDataFrame([(1, "https://A.example/?utm_source=x", "t"), (2, "https://a.example/", "u"), (3, None, "T!"), (4, None, "t")], "_seq bigint, url string, text string")
    assert sorted(r["_seq"] for r in Deduplicate(fields=["url"]).apply(df).collect()) == [1, 3, 4]
    assert sorted(r["_seq"] for r in Deduplicate(fields=["url"], content=["text"]).apply(df).collect()) == [1]
    marked = {r["_seq"]: (r["_duplicate_of"], r["_duplicate_kind"]) for r in Deduplicate(fields=["url"], content=["text"], mark=True).apply(df).collect()}
    assert marked == {1: (None, None), 2: (1, "key"), 3: (1, "content"), 4: (1, "content")}


def test_locate(spark):
    df = spark.createDataFrame([("Hauptstr. 5, 10115 Berlin, Germany", "Bonn"), (None, "Bonn")], "address string, city string")
    assert [r["city"] for r in Locate().apply(df).collect()] == ["Berlin", "Bonn"]


def test_pipeline_round_trip_and_report(spark, tmp_path):
    p = Pipeline([Filter("x > 1"), Compute({"y": "x + 1"}), Filter("y < 10")])
    assert [n for n, _ in p.stages] == ["filter", "compute", "filter#2"]
    path = str(tmp_path / "p.json")
    p.save(path)
    q = Pipeline.load(path)
    df = spark.createDataFrame([(i,) for i in range(20)], "x int")
    assert rows(q.run(df)) == rows(p.run(df))
    p.run(df, count=True).collect()
    assert [(r["in"], r["out"]) for r in p.report()] == [(20, 18), (18, 18), (18, 7)]
    for bad in ({"format": "x"}, {"format": "loomspark/pipeline/v1", "stages": [{"nope": {}}]}, {"format": "loomspark/pipeline/v1", "stages": [{"filter": {"wher": "x"}}]}):
        with pytest.raises(ValueError):
            Pipeline.from_config(bad)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double, currency string")
    for s in (Rename({"k": "z"}), Filter("x > 1"), Compute({"y": "x / 2"}), Transform(["k"], ["strip"]), Lookup(df.select("k", "x"), "k"), ConvertCurrency(["x"], "EUR", {}), Deduplicate(fields=["k"])):
        assert s.apply(df).count() == 0
