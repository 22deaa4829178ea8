"""Texts: language by common words, sizes, keywords."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of languages.
COMMON = {
    "en": "the of and to in is that for it with as was on are by this be from or have an at not which but you all their has more were they we been will one can there when if would about who so no out up",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec aux d'un cette ou son mais comme on tout nous sa fait été aussi leur bien peut ces y",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy",
    "it": "di e il la che in a per un del è non le una sono con si da come al dei più anche i nel alla della lo ma ha gli questo se o dalla delle su ci stato essere tra nella",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre",
    "nl": "de en van het een in is dat op te zijn met die voor niet aan er om ook als bij maar dan nog uit of door naar heeft ze wordt over zich deze tot werd hij kan geen worden",
    "sv": "och i att det som en på är av för med den till har de inte om ett han men var jag sig från vi så kan man när år säger hon under också efter eller nu sin där vid mot ska",
    "pl": "w i na z się nie do to że jest o jak a po co od za przez ale dla tego są był ma już tak czy tym które może być jego oraz ich przy bardzo tylko także",
    "da": "og i at det er en til af på for med den der de som ikke et har var han men om fra kan så vi jeg sig havde ved blev skal være eller efter også",
    "no": "og i det er på som en til av for at med de har den ikke et om var han fra men så jeg vi kan ble seg skal etter eller også ved",
    "fi": "ja on ei että se hän oli mutta ovat myös kun niin tai joka mukaan ole jo vain kuin olla voi sen mitä tämä",
    "tr": "ve bir bu da de için ile çok daha olarak gibi olan kadar ne sonra ama en var ya ben o her",
}
_WEIGHTS: dict[str, dict[str, float]] = {}
for _lang, _words in COMMON.items():
    for _w in set(_words.split()):
        _WEIGHTS.setdefault(_w, {})[_lang] = 0.0
for _w, _langs in _WEIGHTS.items():
    for _lang in _langs:
        _langs[_lang] = 1.0 / len(_langs)

#: Scripts with their ranges of letters, and languages that have a script of their own.
_SCRIPTS = [("Latin", r"[A-Za-zÀ-ɏḀ-ỿ]"), ("Cyrillic", r"[Ѐ-ӿ]"), ("Greek", r"[Ͱ-Ͽ]"), ("Arabic", r"[؀-ۿ]"), ("Hebrew", r"[֐-׿]"), ("Hiragana", r"[぀-ゟ]"), ("Katakana", r"[゠-ヿ]"), ("Han", r"[一-鿿]"), ("Hangul", r"[가-힯]"), ("Thai", r"[฀-๿]"), ("Devanagari", r"[ऀ-ॿ]")]
_PATTERNS = [(n, re.compile(p)) for n, p in _SCRIPTS]
_OWN = {"Greek": "el", "Hebrew": "he", "Hangul": "ko", "Thai": "th", "Devanagari": "hi", "Arabic": "ar", "Cyrillic": "ru"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|[。！？]")
UNSPACED = frozenset(("Hiragana", "Katakana", "Han", "Thai"))


def main_script(text: str) -> str | None:
    """The script of most letters of the whole text; kana tell Japanese from Chinese."""
    letters = "".join(c for c in text if c.isalpha())
    counts = {n: len(p.findall(letters)) for n, p in _PATTERNS}
    if counts["Hiragana"] + counts["Katakana"] > 0.1 * max(1, counts["Han"]) and counts["Hiragana"] + counts["Katakana"] + counts["Han"] > counts["Latin"]:
        return "Hiragana"
    best = max(counts, key=lambda n: counts[n])
    return best if counts[best] else None


def detect_language(text: str | None) -> tuple[str | None, float, str | None]:
    """(language, confidence, runner-up) by weighted common words; by script where it tells."""
    if not text:
        return None, 0.0, None
    script = main_script(text)
    if script in ("Hiragana", "Katakana"):
        return "ja", 0.99, None
    if script == "Han":
        return "zh", 0.95, None
    if script == "Arabic":
        return ("ur" if re.search("[ٹڈڑںھہےۓ]", text) else "fa" if re.search("[پچژگ]", text) else "ar"), 0.9, None
    if script in _OWN:
        return ("uk" if script == "Cyrillic" and re.search("[іїєґ]", text, re.I) else _OWN[script]), 0.9, None
    words = [w.lower().replace("’", "'") for w in _WORD.findall(text)]
    if len(words) < 5:
        return None, 0.0, None
    score: dict[str, float] = {}
    hits: Counter = Counter()
    for w in words:
        for lang, x in _WEIGHTS.get(w, {}).items():
            score[lang] = score.get(lang, 0.0) + x
            hits[lang] += 1
    ranked = sorted(score, key=lambda k: (-score[k], k))
    if not ranked or hits[ranked[0]] < 3 or score[ranked[0]] / len(words) < 0.06:
        return None, 0.0, None
    second = score[ranked[1]] if len(ranked) > 1 else 0.0
    if second and score[ranked[0]] / second < 1.15:
        return None, 0.0, ranked[0]
    share = min(1.0, score[ranked[0]] / len(words) / 0.3)
    lead = 1 - second / score[ranked[0]]
    return ranked[0], round(min(0.99, 0.5 * share + 0.5 * lead), 3), ranked[1] if len(ranked) > 1 else None


def sizes(text: str | None) -> tuple[int | None, int, int, float | None]:
    """(words, sentences, characters, reading minutes); no words where they aren't spaced."""
    if not text or not text.strip():
        return 0, 0, 0, 0.0
    sentences = max(1, len(_SENTENCE.findall(text)))
    chars = len(re.sub(r"\s", "", text))
    if main_script(text) in UNSPACED:
        return None, sentences, chars, None
    n = len(_WORD.findall(text))
    return n, sentences, chars, round(n / 230, 1)


_COMMON_OF = {lang: frozenset(words.split()) for lang, words in COMMON.items()}
#: Words of a text from which a single word must occur twice to be a keyword.
LONG = 60


def keywords(text: str | None, top: int = 8, language: str | None = None) -> list[str]:
    """Words and phrases of two or three words between common words, by their weight.

    A phrase weighs its count times 1.5 for each word and must occur twice, a word its count (twice
    in texts of ``LONG`` words or more). Common words are English and those of ``language``. Whole
    words of a better keyword, and phrases around one, are left out.
    """
    common = _COMMON_OF["en"] | _COMMON_OF.get(language or "", frozenset())
    words = [w.casefold() for w in _WORD.findall(text or "")]
    least = 2 if len(words) >= LONG else 1
    counts: Counter = Counter()
    for kept, run in groupby(words, key=lambda w: len(w) > 2 and w not in common):
        r = list(run)
        counts.update(" ".join(r[i : i + n]) for n in (1, 2, 3) for i in range(len(r) - n + 1)) if kept else None
    weights = {k: (1.5 * n * c if n > 1 else float(c)) for k, c in counts.items() if (n := k.count(" ") + 1) and c >= (2 if n > 1 else least)}
    out: list[str] = []
    for k in sorted(weights, key=lambda k: (-weights[k], k)):
        bounded = f" {k} "
        if all(bounded not in f" {o} " and f" {o} " not in bounded for o in out):
            out.append(k)
            if len(out) == top:
                break
    return out


ANALYSIS = "struct<language:string,language_confidence:double,runner_up:string,script:string,words:bigint,sentences:bigint,characters:bigint,reading_minutes:double,keywords:array<string>>"


def analyze(c: Column) -> Column:
    """``ANALYSIS`` of a text column, in one pass over each text."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            lang, sure, second = detect_language(t)
            w, n, ch, m = sizes(t)
            rows.append((lang, sure, second, main_script(t) if t else None, w, n, ch, m, [] if w is None else keywords(t, language=lang)))
        out = pd.DataFrame(rows, columns=["language", "language_confidence", "runner_up", "script", "words", "sentences", "characters", "reading_minutes", "keywords"])
        out["words"] = out["words"].astype("Int64")
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ANALYSIS)(c)


def word_counts(docs: DataFrame, text: str, least: int = 1) -> DataFrame:
    """``(word, n)`` over all texts, JVM-side."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}']+"), lambda w: w != "")
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
