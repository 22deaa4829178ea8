import random

import numpy as np

from loomspark.llm import truncation as G

SUBJECTS = ["The small lamp", "Our old table", "The tall shelf", "A new chair", "The wide desk"]
VERBS = ["keeps its shape", "needs no tools", "ships in a box", "costs very little", "folds down quickly"]
ENDS = ["on request", "for most kitchens", "after a long winter", "in the first week", "with great care"]


def text(rng, n=6):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}." for _ in range(n))


def test_endings():
    full = ["It is done.", "Really?", "Done.\n• weight: 5 g", "Done.\nwww.shop.example/a", "Done.\n— The Team", "Done.\nSKU ABC-1234", "AB-123 CD-456", "Who? (in 1448)", "これで終わりです。", "", None, "   "]
    assert [G.ending(t)[0] for t in full] == [G.FULL] * len(full)
    assert [G.ending(t)[0] for t in ("The lamp… (continued)", "The lamp... [+163 chars]", "The lamp... Read more", "caf�")] == [G.CUT] * 4
    assert G.ending("We will see...") == (G.DOTS, "We will see")
    assert G.ending("The lamp keeps its")[0] == G.OPEN


def test_minhash_estimates_similarity():
    a = "".join(f"word{i} " for i in range(200))
    b = a.replace("word50 ", "other ").replace("word150 ", "more ")
    assert len(set(G.bands(a)) & set(G.bands(b))) > 0
    assert not set(G.bands(a)) & set(G.bands("".join(f"thing{i} " for i in range(200))))
    assert G.bands("") == [] and len(G.bands("x")) == G.BANDS


def test_alignment():
    whole = "".join(f"One sentence with word{i} in it. " for i in range(30)) + "The last sentence ends right here as planned."
    assert G.ends_early(whole[: whole.index("right")], whole) is True
    assert G.ends_early(whole[: whole.index("right") + 3], whole) is True
    assert G.ends_early(whole, whole + " And one more.") is False
    assert G.ends_early("quite another text with no words in common", whole) is None


def test_cut_texts(spark):
    rng = random.Random(2)
    docs = [(i, text(rng)) for i in range(400)]
    docs += [(1000, text(rng) + " The small lamp keeps its"), (1001, text(rng) + " Our old tab"), (1002, text(rng) + " The wide desk folds… (continued)"), (1003, text(rng)[:-1]), (1004, text(rng) + "\n— The Team"), (1005, text(rng) + " The tall shelf costs very "), (1006, None), (1007, "  "), (1008, "AB-123; CD-4567")]
    docs += [(1100 + i, (text(rng, 12) + " x")[:250].rstrip(".") + "lim"[: 3]) for i in range(8)]
    base = "".join(f"Line{i} has a word of its own{i}. " for i in range(60))
    docs += [(1200, base + "The tall shelf costs very little today. And so on."), (1201, base + "The tall shelf costs very little")]
    got = {r[0] for r in G.cut_texts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {1000, 1001, 1002, 1005, 1201} <= got
    assert not got & ({1003, 1004, 1006, 1007, 1008, 1200} | set(range(400)))


def test_longer_variants_hide_no_copy(spark):
    """Variants with appendices are the longest texts of every band; the whole copy is between."""
    base = "".join(f"Line{i} has a word of its own{i}. " for i in range(60))
    whole, cut = base + "The tall shelf costs very little today. And so on.", base + "The tall shelf costs very little"
    docs = [(1, whole), (2, cut), (3, cut)] + [(10 + i, cut + ". " + "".join(f"Appendix{i} adds{i} {j} something{i} else{j}. " for j in range(24))) for i in range(60)]
    assert all(len(np.intersect1d(G.shingles(cut), G.shingles(t))) < 0.8 * len(G.shingles(t)) for _, t in docs[3:])
    assert set(G.bands(cut)) & set(G.bands(whole)) <= {b for _, t in docs[3:] for b in G.bands(t)}
    assert sorted(r[0] for r in G.cut_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()) == [2, 3]


def test_empty(spark):
    assert G.cut_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
