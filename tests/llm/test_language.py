import random

import numpy as np

from loomspark.llm import language as G

WORDS = {
    "en": "the lamp stands beside our window and this small table keeps its shape when wet for most kitchens without much care",
    "de": "die Lampe steht neben unserem Fenster und dieser kleine Tisch bleibt auch bei Kälte zuverlässig ohne jeden Nachteil",
    "fr": "la lampe reste près de notre fenêtre et cette petite table tient plus longtemps que prévu sans aucun défaut gênant",
    "ja": "このランプは窓の近くにありますそして小さいテーブルは寒い日でも安心して使えます",
}


def sentence(lang, rng):
    if lang == "ja":
        a = rng.randrange(0, 12)
        return WORDS["ja"][a : a + rng.randrange(16, 26)] + "。"
    w = WORDS[lang].split()
    rng.shuffle(w)
    return " ".join(w[: rng.randrange(7, 12)]).capitalize() + "."


def model():
    rng = random.Random(3)
    texts, labels = [], []
    for lang in WORDS:
        for _ in range(80):
            texts.append(G.clean(sentence(lang, rng)))
            labels.append(lang if rng.random() > 0.05 else "en")
    return G.fit(texts, labels, landmarks=20)


def test_kernel_is_the_share_of_common_ngrams():
    a, b = " abc ", " abd "
    grams = lambda t: {(n, t[i : i + n]) for n in G.ORDERS for i in range(len(t) - n + 1)}
    r, c = G.presence([a, b])
    assert abs(len(c[r == 0]) - len(grams(a))) <= 1
    z = G._columns([b])
    k = float(G._products([a], z)[0, 0])
    want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    assert abs(k - want) < 0.05


def test_held_out_accuracy():
    m, rng = model(), random.Random(9)
    texts = [(lang, sentence(lang, rng)) for lang in WORDS for _ in range(50)]
    got = m.scores([G.clean(t) for _, t in texts]).argmax(axis=1)
    assert np.mean([m.languages[g] == lang for g, (lang, _) in zip(got, texts)]) > 0.97


def test_segments():
    m, rng = model(), random.Random(4)
    de, en = (" ".join(sentence(x, rng) for _ in range(3)) for x in ("de", "en"))
    segs = G.segments_of([f"{de} {en}", None, "   ", "AB-123; CD-456\n77.10", f"{en}\n— Team Paris\nwww.rue.example/maison", "x" * 10], m)
    assert [s[2] for s in segs[0]] == ["de", "en"] and all(0 <= s[3] <= 1 for s in segs[0])
    assert segs[1] == [] and segs[2] == [] and segs[3] == []
    assert {s[2] for s in segs[4] if s[4]} == {"en"}


def test_mislabelled(spark):
    m, rng = model(), random.Random(5)
    text = {i: " ".join(sentence(lang, rng) for _ in range(4)) for i, lang in enumerate(["en", "de", "fr", "ja", "de"])}
    text[5] = sentence("en", rng) + " " + sentence("de", rng)
    docs = spark.createDataFrame([(i, t) for i, t in text.items()] + [(6, None), (7, "")], "doc_id bigint, text string")
    said = spark.createDataFrame([(0, "English"), (0, "English"), (1, "fr"), (2, "fr-FR"), (3, "und"), (4, "ger"), (5, "en"), (6, None), (7, "")], "doc_id bigint, language string")
    got = sorted(tuple(r) for r in G.mislabelled(docs, said, m).collect())
    assert got == [(1, "de"), (3, "ja"), (5, "de"), (5, "en")]


def test_codes(spark):
    rows = spark.createDataFrame([("EN",), ("pt_BR",), ("German",), ("unknown",), ("",), (None,), ("zxx",)], "s string").select(G.code_of(__import__("pyspark").sql.functions.col("s"))).collect()
    assert [r[0] for r in rows] == ["en", "pt", "de", None, None, None, None]
