import random

from loomspark.llm import leaks as G


def brute(items, words):
    out = set()
    for item, ws in items.items():
        for i in range(len(words) - G.WINDOW + 1):
            for j in range(len(ws) - G.WINDOW + 1):
                if words[i : i + G.WINDOW] == ws[j : j + G.WINDOW]:
                    out.add((item, i, j))
    return out


def test_search_equals_brute_force():
    rng = random.Random(1)
    items = {k: [rng.choice("abcdefg") for _ in range(rng.randrange(2, 20))] for k in range(12)}
    s = G.WuManber(items)
    for _ in range(30):
        words = [rng.choice("abcdefghij") for _ in range(80)]
        got = {(k, i, j) for k, hs in s.hits(s.encode(words)).items() for i, j in hs}
        assert got == brute(items, words)


def test_words():
    assert G.words_of("Café <b>de</b>l <p>mar</p> &amp; so­l") == ["cafe", "del", "mar", "sol"]
    assert G.words_of("東京の") == ["東", "京", "の"] and G.words_of(None) == []


ITEM = "The keeper of the northern light wrote down every ship that passed the cape in the long winter and nobody ever asked for the book until the harbour master found it under the stairs"


def leaks(spark, *texts):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short one"), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return sorted((r[0], r[1]) for r in G.find_leaks(items, docs).collect())


def test_found(spark):
    w = ITEM.split()
    half = " ".join(w[8:27])
    changed = w[:]
    for i in range(3, len(w), 9):
        changed[i] = "something"
    quote = " ".join(w[:6])
    apart = " ".join(w[:9]) + " filler " * 40 + " ".join(w[20:26])
    got = leaks(spark, ITEM.upper(), "before it " + half + " and after", " ".join(changed), quote, apart, None, "", "unlike " * 5000, "x " * 20000 + ITEM)
    assert got == [(1, 100), (1, 101), (1, 102), (1, 108)]


def test_short_items_and_parts(spark, monkeypatch):
    """Items of fewer than WINDOW words are found whole; more than ITEMS items take several passes."""
    monkeypatch.setattr(G, "ITEMS", 2)
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (5, "never seen words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(101, "a Short, one!"), (102, "one short"), (103, "so " + ITEM), (104, None)], "doc_id bigint, text string")
    assert sorted((r[0], r[1]) for r in G.find_leaks(items, docs).collect()) == [(1, 103), (2, 101)]


def test_in_order_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))], [rng.randrange(0, 6) for _ in range(rng.randrange(0, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert G.in_order(masks, len(a), b) == t[-1][-1]


def test_empty(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert G.find_leaks(items, spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")).count() == 0
