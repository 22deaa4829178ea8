import hashlib

import pytest

from loomspark.llm import encoding as G

CLEAN = ["Der Kühlschrank überzeugt für den gleichen Betrag", "La señora compró un frigorífico pequeño", "Le modèle présenté coûte très cher", "Zażółć gęślą jaźń większości kupujących", "Проверка марки и большинство покупателей", "この製品の電池は寒い日でも安心して使えます。"]


@pytest.mark.parametrize("pair", [("windows-1252", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("windows-1252", "cp1251"), ("windows-1252", "cp932"), ("windows-1252", "cp1250")])
def test_undo_is_the_inverse_of_garble(pair):
    for text in CLEAN:
        g = G.garble(text, pair)
        if g is not None and g != text:
            assert G.undo(g, pair) == text


def test_places_with_the_pattern_of_utf8():
    assert G.undo_utf8("für und fÃ¼r, 5 â‚¬", "windows-1252") == "für und für, 5 €"
    assert G.undo_utf8(G.garble(G.garble("größer", G.UTF8_PAIRS[0]), G.UTF8_PAIRS[0]), "windows-1252") == "größer"
    assert G.restore_text("São João, naïve café")[1] is False


def test_twins_show_the_transformation():
    assert ("windows-1252", "utf-8") in G.twin_pairs("fÃ¼r", "für")
    assert ("windows-1252", "cp1250") in G.twin_pairs("wiêkszoœci", "większości")
    assert G.twin_pairs("fur", "für") == []


@pytest.mark.parametrize("text,lost", [("pre�o", True), ("pre?o bajo", True), ("Perch? scegliere", True), ("Really? yes, really.", False), ("What? Yes. Is it?", False), ("see https://a.example/x.php?id=4", False), ("Qui ? Lui.", False), ("????? ??", True), ("", False)])
def test_lost_characters(text, lost):
    assert G.lost_characters(text, frozenset(map(G.mask, ("perché", "Perché", "più")))) is lost


def test_a_likely_word_of_another_language_is_left():
    """One letter is no evidence: Italian \"è\" between blanks is the byte of a frequent Russian word."""
    known = {p: G.math.log(0.09) for p in (" è", "è ", " и", "и ")}
    r = G.Restorer([("windows-1252", "cp1251")], known)
    assert r.restore("la porta è aperta") == ("la porta è aperta", False)
    assert G.Restorer([("windows-1252", "utf-8")], known).restore("la porta Ã¨ aperta") == ("la porta è aperta", True)


def test_chance_twins_teach_nothing(spark):
    """Twins that a learned pair explains don't count for another; the rest needs ``OTHER_TWINS`` of its own."""
    rows = [(i, f"für schöne Grüße über Köln mähen {i}") for i in range(40)] + [(100 + i, G.garble("für schöne Grüße über Köln mähen", ("windows-1252", "utf-8"))) for i in range(3)]
    got = G.learn_pairs(spark.createDataFrame(rows, "response_id bigint, body string"))
    assert [p for p, _ in got] == [("windows-1252", "utf-8")] and got[0][1] == 6


def test_bodies(spark):
    rows, want, n = [], {}, 0
    for k in range(40):
        for t in CLEAN:
            rows.append((n, f"<p>{t} {k}</p>", "x"))
            n += 1
    for pair, t in ((("windows-1252", "utf-8"), CLEAN[0]), (("mac_roman", "utf-8"), CLEAN[1]), (("windows-1252", "cp1250"), CLEAN[3]), (("windows-1252", "cp1251"), CLEAN[4]), (("windows-1252", "cp932"), CLEAN[5])):
        for k in range(5):
            whole = f"<p>{t} {k}</p>"
            rows.append((n, G.garble(whole, pair), "x"))
            want[n] = hashlib.md5(whole.encode()).hexdigest()
            n += 1
    rows += [rows[-1], (n, "<p>El modelo m�s</p>", "x"), (n + 1, None, "x"), (n + 2, "", "x"), (n + 3, "plain ascii only", "x")]
    want[n] = ""
    got = {r[0]: r[1] for r in G.garbled_bodies(spark.createDataFrame(rows, "response_id bigint, body string, restored_md5 string")).collect()}
    assert got == want


def test_no_bodies(spark):
    assert G.garbled_bodies(spark.createDataFrame([], "response_id bigint, body string")).count() == 0
