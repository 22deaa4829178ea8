import numpy as np
import pytest

from loomspark.llm.membership import ScalableBloom, filter_errors, route, seen_before

IN = "crawl string, fingerprint string, seq bigint, request_id bigint, url string"
OLD = "crawl string, fingerprint string, url string"


def brute(rows, old):
    known = {(c, f.lower()) for c, f, _ in old if c and f}
    first = {}
    for c, f, s, i, _ in rows:
        if c and f:
            k = (c, f.lower())
            first[k] = min(first.get(k, 1 << 62), s if s is not None else 1 << 61)
    return {i for c, f, s, i, _ in rows if c and f and ((c, f.lower()) in known or (s if s is not None else 1 << 61) > first[(c, f.lower())])}


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 62, 50_000), rng.integers(1 << 62, (1 << 63) - 1, 50_000)
    f = ScalableBloom()
    f.add(a)
    assert f.test(a).all()
    assert f.test(b).mean() < 0.05


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        f = "%040x" % rng.integers(0, 1500)
        rows.append((str(rng.choice(["a", "b", "c"])), f.upper() if i % 3 else f, int(i), i, "u"))
    rows += [rows[k] for k in range(0, 6000, 97)]  # delivered twice
    rows += [("a", None, 9, 10_001, None), (None, "%040x" % 5, 9, 10_002, None), ("a", "not hexadecimal", 1, 10_003, None), ("a", "NOT hexadecimal", 2, 10_004, None)]
    rows += [("hot", "f" * 40, 20_000 + i, 20_000 + i, "u") for i in range(4000)]  # one key with a third of the rows
    old = [("a", "%040X" % 7, "u"), ("a", "%040X" % 7, "u"), ("b", None, "u"), ("zz", "%040X" % 8, "u")]
    got = [r[0] for r in seen_before(spark.createDataFrame(rows, IN).repartition(5), spark.createDataFrame(old, OLD)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, old)


def test_error_rate_counts_disproved_positives(spark):
    rows = [("a", "%040x" % i, i, i, "u") for i in range(3000)]
    out = filter_errors(spark.createDataFrame(rows, IN), spark.createDataFrame([], OLD)).collect()
    assert len(out) == 1 and out[0]["tested"] == 3000
    assert out[0]["disproved"] == out[0]["positives"]  # no key came twice: every positive is an error
    assert out[0]["error_rate"] < 0.05


def test_empty_tables(spark):
    assert seen_before(spark.createDataFrame([], IN), spark.createDataFrame([], OLD)).count() == 0


def test_ties_of_seq_are_not_earlier(spark):
    rows = [("a", "%040x" % 1, 5, 1, "u"), ("a", "%040x" % 1, 5, 2, "u")]
    assert seen_before(spark.createDataFrame(rows, IN), spark.createDataFrame([], OLD)).count() == 0
