from itertools import combinations_with_replacement

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm.packing import fullest, pack, pack_documents


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_equals_brute_force(counts, room):
    items = [k for k, v in counts.items() for _ in range(v)]
    best = max((sum(s) for m in range(1 << len(items)) if sum(s := [x for i, x in enumerate(items) if m >> i & 1]) <= room), default=0) if len(items) <= 12 else None
    got = fullest(dict(counts), room)
    total = sum(k * v for k, v in got.items())
    assert total <= room and all(v <= counts[k] for k, v in got.items())
    if best is not None:
        assert total == best


def test_pack_uses_every_item_once_and_fills_bins():
    counts = {7: 10, 5: 10, 3: 20, 2: 5}
    used, slack = {}, 0
    for lengths, times in pack(counts, 10):
        total = sum(k * n for k, n in lengths.items())
        assert total <= 10
        slack += (10 - total) * times
        for k, n in lengths.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts and slack <= 10


def test_documents(spark):
    docs = spark.createDataFrame([(i, (i * 37) % 300, "x") for i in range(500)] + [(1000, None, "x"), (1001, 0, "x"), (1002, 1250, "x"), (1003, -4, "x")], "doc_id bigint, n_tokens bigint, container string")
    kinds = spark.createDataFrame([("short", 256), ("wide", 512), ("bad", 0)], "container string, capacity bigint")
    rows = pack_documents(docs, kinds, 200).collect()
    bins, sizes = {}, {}
    for r in rows:
        bins[r["container"], r["shard"], r["bin"]] = bins.get((r["container"], r["shard"], r["bin"]), 0) + r["tokens"]
        sizes[r["container"], r["doc_id"]] = sizes.get((r["container"], r["doc_id"]), 0) + r["tokens"]
    assert {k[0] for k in bins} == {"short", "wide"}
    for (c, *_), v in bins.items():
        assert v <= {"short": 256, "wide": 512}[c]
    for c in ("short", "wide"):
        assert sizes[c, 1002] == 1250 and sizes[c, 1000] == 0 and sizes[c, 36] == 36 * 37 % 300
        assert len([1 for k in sizes if k[0] == c]) == 504
    parts = [r for r in rows if r["doc_id"] not in (1002,) and r["part"] > 0 and sizes[r["container"], r["doc_id"]] <= 256]
    assert not parts


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    c = spark.createDataFrame([], "container string, capacity bigint")
    assert pack_documents(d, c).count() == 0
    assert pack_documents(d, spark.createDataFrame([("a", 5)], "container string, capacity bigint")).count() == 0
