import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import dedupe, diff, entities, graph, groups, history, profile, ranking, sites
from loomspark.operators.skew import balanced_aggregate, balanced_join, plan_load
from loomspark.operators.snapshots import _element, _position, consecutive_runs, page_states, peel, snapshot_changes
from loomspark.operators.vectors import nearest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------- p1
def requests(spark):
    rng = random.Random(1)
    data = []
    for i in range(6000):
        d = "hot.example" if i % 3 == 0 else None if i % 50 == 1 else f"d{rng.randrange(200)}.example"
        data.append((d, rng.choice(["push", "ack"]), None if i % 7 == 0 else "f1" if d == "hot.example" and i % 2 else f"f{rng.randrange(900)}", i, "x"))
    return spark.createDataFrame(data + data[:50], "domain string, op string, fingerprint string, id int, rows string").drop("rows")


def test_balanced_aggregate(spark):
    df = requests(spark)
    got = rows(balanced_aggregate(df, "domain", {"m": (F.max("id"), F.max)}, "fingerprint", "fps", tasks=6).select("domain", "rows", "m", "fps"))
    assert got == rows(df.groupBy("domain").agg(F.count("*"), F.max("id"), F.count_distinct("fingerprint")))


def test_load_is_packed_evenly(spark):
    loads = requests(spark).groupBy("domain").agg(F.count("*").alias("n"))
    plan = plan_load(loads, "domain", "n", 8)
    assert len(plan.heavy) == 1 and plan.heavy[0][0] == "hot.example"
    assert max(plan.loads) <= 1.3 * sum(plan.loads) / len(plan.loads)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join(spark, how):
    left = requests(spark).select("domain", "id")
    right = spark.createDataFrame([("hot.example", 1), ("hot.example", 2), ("d5.example", 3), (None, 4), ("zz", 5)], "domain string, v int")
    assert rows(balanced_join(left, right, "domain", F.xxhash64("id"), how, 6)) == rows(left.join(right, "domain", how))


def test_balanced_refuses_clashes(spark):
    a = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        balanced_join(a, a, "k", F.lit(0))


def test_balanced_empty(spark):
    e = spark.createDataFrame([], "domain string, fingerprint string")
    assert balanced_aggregate(e, "domain", {}, "fingerprint", "f").count() == 0
    assert balanced_join(e, e.withColumnRenamed("fingerprint", "g"), "domain", F.lit(1)).count() == 0


# ------------------------------------------------------------- p4
def test_peel_recovers_the_difference():
    rng = random.Random(2)
    m, cells = 40, {}
    want = [(rng.choice((1, -1)), rng.getrandbits(63) - (1 << 62), rng.getrandbits(63)) for _ in range(50)]
    for s, k, v in want:
        h = _element(k, v)
        for j in range(3):
            c = cells.setdefault(_position(h, j, m), [0, 0, 0, 0])
            c[0] += s
            c[1] ^= k
            c[2] ^= v
            c[3] ^= h - (1 << 64) if h >> 63 else h
    as_rows = [{"cell": p, "n": c[0], "xk": c[1], "xv": c[2], "xc": c[3]} for p, c in cells.items()]
    assert sorted(peel(as_rows, m)) == sorted(want)
    assert peel(as_rows[:-1], m) is None


def snapshot_brute(states, pairs):
    out = set()
    for run, before in pairs:
        a, b = states.get(run, {}), states.get(before, {})
        out |= {(run, k, "added") for k in a.keys() - b.keys()} | {(run, k, "removed") for k in b.keys() - a.keys()} | {(run, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_snapshot_changes_equal_brute_force(spark, share):
    rng = random.Random(3)
    states = {1: {f"u{i}": str(i) for i in range(1500)}, 5: {"a": "1"}, 6: {}}
    for r in (2, 3):
        s = dict(states[r - 1])
        for k in list(s):
            x = rng.random()
            if x < share / 3:
                del s[k]
            elif x < share:
                s[k] = f"{r}-{k}"
        s.update({f"n{r}-{i}": "x" for i in range(20)})
        states[r] = s
    pairs = [(2, 1), (3, 2), (6, 5)]
    df = spark.createDataFrame([(r, k, v) for r, s in states.items() for k, v in s.items()] + [(1, None, "x")], "run int, key string, digest string")
    got = {tuple(r) for r in snapshot_changes(df, spark.createDataFrame(pairs, "run int, before int")).collect()}
    assert got == snapshot_brute(states, pairs)


def test_page_states(spark):
    a = '{"title": " A  b", "price": 1.50, "text": "t", "items": null}'
    b = '{"price":15e-1,"title":"A b","text":"t"}'
    c = '{"title": "\\u0041 b", "price": 1.5, "text": "other"}'
    pages = spark.createDataFrame([(1, 1, "u", 200, 5.0, a), (2, 2, "u", 200, 5.0, b), (3, 3, "u", 200, 9.0, c), (4, 3, "u", 200, 1.0, a), (5, 3, "v", 404, 2.0, a), (6, 3, "v", 200, 1.0, a), (7, 3, "w", None, None, None)], "page_id bigint, run int, url string, status int, fetched double, snapshot string")
    got = {(r["run"], r["key"]): r["digest"] for r in page_states(pages).collect()}
    assert set(got) == {(1, "u"), (2, "u"), (3, "u"), (3, "w")}
    assert got[1, "u"] == got[2, "u"] != got[3, "u"]


def test_consecutive_runs(spark):
    runs = spark.createDataFrame([(1, "a", "finished"), (2, "a", "stopped"), (3, "a", "finished"), (4, "b", "finished"), (5, "a", "finished"), (5, "a", "finished")], "run int, site string, status string")
    assert rows(consecutive_runs(runs)) == [(3, 1), (5, 3)]


def test_snapshots_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], "run int, key string, digest string"), spark.createDataFrame([], "run int, before int")).count() == 0


# ------------------------------------------------------------- similarity
WORDS = [f"w{i}" for i in range(500)]


def near_texts():
    rng = random.Random(4)
    base = [" ".join(rng.choices(WORDS, k=80)) for _ in range(20)]
    out = []
    for i, t in enumerate(base):
        out.append((10 * i, t))
        out.append((10 * i + 1, t.upper() + "!"))
        w = t.split()
        w[40] = "changed"
        out.append((10 * i + 2, " ".join(w)))
    return out


def test_near_duplicates(spark):
    data = near_texts() + [(900, None), (901, "")]
    got = dict(tuple(r) for r in dedupe.near_duplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", 0.8).collect())
    assert got == {**{i: 10 * (i // 10) for i, _ in near_texts()}, 900: 900, 901: 901}


def test_near_pairs_are_those_of_all_shingles(spark):
    """Pairs from a similarity just above 0.8 on are found, those below are not."""
    base, data, want = [f"w{i}" for i in range(104)], [], set()
    for g in range(40):
        words = [f"{w}x{g}" for w in base]
        # 100 shingles each; one of n shingles more has 100 of n in common
        for j, more in enumerate((0, 24, 27)):
            data.append((10 * g + j, " ".join(words + [f"z{g}y{i}" for i in range(more)])))
        want |= {(10 * g, 10 * g + 1), (10 * g + 1, 10 * g + 2)}
    got = dedupe.near_pairs(spark.createDataFrame(data, "id bigint, text string"), "id", "text", 0.8)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert {round(r["similarity"], 4) for r in got.collect()} == {round(100 / 124, 4), round(124 / 127, 4)}
    assert dedupe.false_negative_rate(0.8, *dedupe.bands_for(0.8)) < 0.001
    kept = dedupe.deduplicate(spark.createDataFrame([(d[1],) for d in data], "text string"), near="text", threshold=0.8)
    assert kept.count() == 40


def test_many_copies_make_no_pairs(spark):
    df = spark.createDataFrame([(i, "the very same text of some words") for i in range(3000)] + [(5000, "quite another text of other things")], "id bigint, text string")
    assert dedupe.near_pairs(df, "id", "text").count() == 0
    assert rows(dedupe.near_duplicates(df, "id", "text").groupBy("class").count()) == [(0, 3000), (5000, 1)]


def test_simhash():
    a = " ".join(WORDS[:100])
    assert dedupe.simhash(a) == dedupe.simhash(a.upper())
    near = bin((dedupe.simhash(a) ^ dedupe.simhash(a.replace("w50 ", "other "))) & (2**64 - 1)).count("1")
    far = bin((dedupe.simhash(a) ^ dedupe.simhash(" ".join(WORDS[200:300]))) & (2**64 - 1)).count("1")
    assert near < 16 < far


def test_simhash_pairs_are_complete(spark):
    data = near_texts()
    got = {(r["a"], r["b"]) for r in dedupe.simhash_pairs(spark.createDataFrame(data, "id bigint, text string"), "id", "text", 8).collect()}
    reps = {}
    for i, t in data:
        reps.setdefault(dedupe.simhash(t), i)
    want = {(min(i, j), max(i, j)) for h, i in reps.items() for g, j in reps.items() if i < j and bin((h ^ g) & (2**64 - 1)).count("1") <= 8}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    got = dict(tuple(r) for r in dedupe.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[300 + i] for i in range(50)} == {300}


# ------------------------------------------------------------- others
def test_groups(spark):
    df = spark.createDataFrame([("US", 1.0, "USD"), ("us", 3.0, "USD"), ("us", None, "EUR"), ("DE", 2.0, "EUR"), (None, 5.0, "EUR")], "c string, v double, cur string")
    got = [(r["label"], r["count"], r["share"], r["rank"], r["v_median"]) for r in groups.group_records(df, "c", ["v"]).orderBy("rank").collect()]
    assert got == [("us", 3, 0.6, 1, 2.0), ("DE", 1, 0.2, 2, 2.0), (None, 1, 0.2, 3, 5.0)]
    per = groups.group_records(df, "c", ["v"], currency="cur").filter("label = 'DE'").first()
    assert per["currency"] == "EUR" and per["v_count"] == 1


def test_diff_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("a", "x  y", 10.0), ("b", "z", 5.0), ("c", "q", 1.0)], "k string, s string, v double")
    new = spark.createDataFrame([("a", "x y", 8.0), ("b", "z", 5.0 + 1e-13), ("d", "n", None)], "k string, s string, v double")
    d = diff.diff(old, new, ["k"])
    assert rows(d.select("k", "change")) == [("a", "changed"), ("b", "unchanged"), ("c", "removed"), ("d", "added")]
    f = d.filter("k = 'a'").first()["fields"]
    assert [(x["field"], x["delta"], x["ratio"]) for x in f] == [("v", -2.0, -0.2)]
    assert rows(diff.flat(d, ["k"]).select("k", "change", "field")) == [("a", "changed", "v"), ("c", "removed", None), ("d", "added", None)]
    assert diff.digest(old).first() == diff.digest(old.orderBy("k", ascending=False).repartition(3)).first() != diff.digest(old.union(old)).first()
    v = diff.Versions(spark, str(tmp_path / "v"))
    assert (v.commit(old), v.commit(old), v.commit(new), v.commit(new, force=True)) == (1, 1, 2, 3)
    assert v.resolve("previous") == 2 and v.load("v1").count() == 3 and v.diff(1, 2, ["k"]).count() == 4


def test_history(spark):
    seen = [("u", r, r * 86400.0, c, 200) for r, c in enumerate("aaabbbccccd")] + [("once", 1, 5.0, "x", 200)]
    pages = spark.createDataFrame(seen, "url string, run int, fetched double, content string, status int")
    o = {r["url"]: (r["n"], r["changes"]) for r in history.observations(pages).collect()}
    assert o == {"u": (11, 3), "once": (1, 0)}
    f = {r["url"]: r for r in history.freshness(pages, 10 * 86400.0).collect()}
    import math

    assert abs(f["u"]["rate_per_day"] + math.log((11 - 3) / 11.5)) < 1e-5 and f["u"]["fresh"] == 1.0 and f["once"]["rate_per_day"] is None
    c = spark.createDataFrame([("a", 1, "x", 200), ("b", 1, "y", 200), ("c", 1, "z", 200), ("a", 2, "x", 200), ("b", 2, "q", 200), ("d", 2, "n", 200)], "url string, run int, content string, status int")
    assert rows(history.compare_runs(c, 1, 2)) == [("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")]
    assert ("c", "missing") in rows(history.compare_runs(c, 1, 2, complete=False))


def test_every_run_meets_its_own_site(spark):
    pages = [(1, "a/x", "1", 200), (1, "a/y", "1", 200), (2, "a/x", "2", 200), (2, "a/z", "1", 200), (3, "a/x", "2", 200), (3, "a/z", None, 500), (4, "b/x", "1", 200), (4, "b/y", "1", 404), (5, "b/x", None, 404), (5, "b/y", "1", 200)]
    runs = [(1, "a", True), (2, "a", False), (3, "a", True), (4, "b", True), (5, "b", True)]
    got = history.compare_all_runs(spark.createDataFrame(pages, "run int, url string, content string, status int"), spark.createDataFrame(runs, "run int, site string, complete boolean"))
    assert rows(got.select("run", "url", "change")) == [(2, "a/x", "modified"), (2, "a/y", "missing"), (2, "a/z", "added"), (3, "a/x", "unchanged"), (3, "a/y", "removed"), (3, "a/z", "skipped"), (5, "b/x", "removed"), (5, "b/y", "added")]


def test_rankings(spark):
    r = spark.createDataFrame([("q1", 1, "u1", "a", "web", "2024-01-02"), ("q1", 2, "u2", "b", "web", "2024-01-02"), ("q2", 1, "u2", "b", "web", "2024-01-02"), ("q2", 3, "u3", "c", "news", "2024-01-02"), ("q1", 9, "u1", "a", "web", "2024-01-01")], "query string, position int, url string, domain string, type string, fetched string")
    top = ranking.competitors(r).collect()
    assert [(t["domain"], t["visibility"]) for t in top] == [("b", 0.75), ("a", 0.5), ("c", 0.1667)]
    assert rows(ranking.gaps(r, "a", ["b"]).select("query")) == [("q2",)]
    assert ranking.visibility(r, "a").first()[0] == 0.5
    assert [x["change"] for x in ranking.ranking_history(r, "a").filter("query = 'q1'").orderBy("fetched").collect()] == [None, 8]
    o = ranking.overlap(r, "q1", "q2").first()
    assert o["jaccard"] == 0.3333 and 0 < o["rbo"] < 1
    assert {x["query"]: x["leader"] for x in ranking.cluster_queries(r, 1).collect()} == {"q1": "q1", "q2": "q1"}


def test_profile(spark):
    df = spark.createDataFrame([("a", "1"), ("b", ""), ("N/A", None), ("a", "2")], "x string, y string")
    got = {r["field"]: (r["present"], r["distinct"], r["placeholders"]) for r in profile.profile_fields(df).collect()}
    assert got == {"x": (4, 3, 1), "y": (2, 2, 0)}
    n = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert profile.ks_statistic(n, n, "v").first()["d"] == 0.0 and profile.ks_statistic(n, n.select((F.col("v") + 200).alias("v")), "v").first() == (1.0, True)
    s = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(999, 900.0)], "k int, v double")
    assert [r["key"] for r in profile.mad_outliers(s, "k", "v").collect()] == [999]
    assert profile.schema_drift(df.schema, n.schema) == {"added": ["x", "y"], "removed": ["v"], "retyped": []}


def test_entities(spark):
    m = spark.createDataFrame([(1, "Apple Inc.", None), (2, "APPLE INC", None), (3, "Apple", "https://www.apple.example"), (4, "Banana Trading Ltd", None), (5, "Banana Trading", "http://banana.example/x"), (6, "Cherry Works", None), (7, None, None)], "id bigint, name string, website string")
    got = {r["id"]: r["entity"] for r in entities.resolve(m)[0].collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] and len({got[1], got[4], got[6]}) == 3 and 7 not in got
    assert entities.gtin14("0-306-40615-2") == "09780306406157" and entities.gtin14("123") is None


def test_script_of_a_long_text(spark):
    from loomspark.functions.text import analyze

    text = "An English preamble comes first. " * 250 + "これは日本語で書かれた長い文章です。" * 900
    got = spark.createDataFrame([(text,)], "t string").select(analyze(F.col("t")).alias("a")).select("a.*").first()
    assert (got["script"], got["language"], got["words"]) == ("Hiragana", "ja", None)


def test_entities_of_common_words(spark):
    """Each word is in more units than a block may have; the pairs of words are not."""
    names = [(1, "Blue Star Tools Works"), (2, "Blue Star Tools")] + [(100 + i, f"{w} Other{i}") for i, w in enumerate(["Blue", "Star", "Tools", "Works"] * 12)]
    m = spark.createDataFrame([(i, n, "https://bst.example" if i == 1 else None) for i, n in names], "id bigint, name string, website string")
    entity, review = entities.resolve(m, block=10)
    got = {r["id"]: r["entity"] for r in entity.collect()}
    assert got[1] == got[2] or (1, 2) in {(r["a"], r["b"]) for r in review.collect()}


def test_entities_of_a_hot_name(spark):
    m = spark.createDataFrame([(i, "Hot Name", f"+49 30 {1000 + i}") for i in range(40)], "id bigint, name string, phone string")
    assert {r["entity"] for r in entities.resolve(m, block=10)[0].collect()} == {0}


def test_graph(spark):
    df = spark.createDataFrame([("Lamp", "Acme", "u1", 0.5), ("lamp", "Acme", "u2", 0.9), ("Desk", "", "u3", 1.0)], "name string, brand string, url string, c double")
    nodes, edges = graph.build_graph(df, ("product", "name"), [("made_by", "brand", "brand")], confidence="c")
    assert rows(edges) == [("product:lamp", "made_by", "brand:acme", 2, 2, 0.9)]
    assert {r["id"] for r in nodes.collect()} == {"product:lamp", "product:desk", "brand:acme"}
    assert rows(graph.degree(edges)) == [("brand:acme", 1), ("product:lamp", 1)] and graph.neighbors(edges, "brand:acme").count() == 1


def test_sites(spark):
    df = spark.createDataFrame([("https://s.example/blog/a-post",), ("https://s.example/blog/b",), ("https://s.example/",), ("https://s.example/login",), (None,)], "url string")
    kinds = {r["url"]: r["c"]["kind"] for r in df.select("url", sites.classify_url(F.col("url")).alias("c")).collect()}
    assert kinds["https://s.example/blog/b"] == "article" and kinds["https://s.example/"] == "homepage" and kinds["https://s.example/login"] == "login"
    assert ("s.example", "/blog", 2) in rows(sites.path_rollup(df)) and ("s.example", "/", 4) in rows(sites.path_rollup(df))
    t = spark.createDataFrame([("u", "<script src=/wp-content/x.js></script><script>gtag('google')</script>")], "url string, html string")
    assert {r["technology"] for r in sites.technologies(t).collect()} == {"WordPress", "Google Analytics"}


def test_nearest_vectors(spark):
    rng = random.Random(5)
    vs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    got = nearest(spark.createDataFrame(vs + [(1000, None)], "id bigint, v array<double>"), "id", "v", 3, 50).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for q in (0, 50, 100, 150):
        want = sorted((-round(cos(vs[q][1], v), 6), i) for i, v in vs if i != q)[:3]
        assert sorted((-r["similarity"], r["vec_id"]) for r in got if r["query_id"] == q) == want
