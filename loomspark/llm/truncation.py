"""Texts cut off by field limits or in transfer.

1. Near-copies: min-hash signatures over shingles of five words, in bands. Equal texts are one; a
   text without an end meets every longer one of its bands whose number of shingles allows a
   similarity of 0.8. Pairs of that similarity or more are aligned: a copy whose alignment ends
   early, within a sentence of the other, was cut.
2. All others are scored by the terminality of their closing words: how often the last three (two,
   one) words end a sentence where they occur within the corpus. Texts that end with a sentence's
   end, a list, a code, an address, a signature or a bracket are whole; notes of omission are not.
3. Lengths at which far more texts stop without an end than at the lengths around are field limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import spread, table, written

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
#: Share of its places at which a word group must end a sentence to close a text; places needed by group size.
TERMINAL, PLACES = 0.5, {3: 4, 2: 6, 1: 6}
#: A limit stops this many texts at least, this share of all, and so many times those of the lengths around.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_TIMES, AROUND = 5, 0.0002, 5, 10

_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?…。！？]+|[\r\n]+|[^\w\s]")
_STOP = re.compile(r"[.!?…。！？]+$")
_CLOSERS = "\"'”’»」』)]"
_DOTS = re.compile(r"\s*(?:…|\.{2,})$")
#: Notes put in place of the rest of a text.
_NOTE = re.compile(
    r"(?:…|\.{2,})\s*(?:\[\+?\d+ [^\]]*\]|\((?:continued|more|cont\.?|fortsetzung folgt|suite|sigue|continua|vervolg|fortsätter|cd\.|продолжение)[^()]*\)|read more|more|show more|see more|continue reading|weiterlesen|mehr lesen|mehr|lire la suite|leer más|seguir leyendo|leggi tutto|continua a leggere|ler mais|leia mais|lees meer|lees verder|läs mer|czytaj dalej|więcej|читать далее|далее|続きを読む)\s*[.»›>→]*$|\[(?:…|\.{2,})\]$|\[\+\d+ chars\]$",
    re.I,
)
_LINE = re.compile(r"^(?:[—–•*·▪-]\s*\S.*|(?:https?://|www\.)\S+|\S+@\S+\.\S+|[^|]+(?: \| [^|]+)+|(?:\w+:? )?[A-Z]{2,4}-?\d{3,}[A-Z\d-]*)$")
_CODES = re.compile(r"^[\sA-Z\d.,;:/|#-]*$")

FULL, CUT, OPEN, DOTS = "full", "cut", "open", "dots"


def _normal(token: str) -> str:
    return "\n" if token[0] in "\r\n" else re.sub(r"\d", "0", token) if token[0].isdigit() else token.lower()


def tokens(text: str) -> list[str]:
    """Words, numbers with their digits masked, sentence ends and line ends; spaceless scripts by character."""
    return [_normal(w) for w in _TOKEN.findall(text)]


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


class Codes(dict):
    """Numbers of spellings, in order of appearance, with their hashes and whether they are words.

    ``masked`` are hashes with digits masked, ``plain`` those of the spelling in small letters.
    """

    #: Spellings remembered from batch to batch.
    REMEMBERED = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.masked: list[int] = []
        self.plain: list[int] = []
        self.word: list[bool] = []

    def __missing__(self, token: str) -> int:
        norm = _normal(token)
        self.masked.append(_hash(norm))
        self.plain.append(_hash(token.lower()))
        self.word.append(norm != "\n" and not _STOP.match(norm))
        self[token] = n = len(self.word) - 1
        return n

    def of(self, text: str) -> list[int]:
        return [self[w] for w in _TOKEN.findall(text)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.masked, np.uint64), np.array(self.plain, np.uint64), np.array(self.word, bool)

    def renew(self) -> Codes:
        return Codes() if len(self) > self.REMEMBERED else self


def ending(text: str | None) -> tuple[str, str]:
    """How a text ends, and what of it the closing words are taken from.

    ``full`` and ``cut`` are decided by the form alone; ``open`` and ``dots`` (an end in dots) are not.
    """
    s = (text or "").rstrip()
    if not s or _CODES.match(s):
        return FULL, ""
    if s.endswith("�"):
        return CUT, ""
    if ("…" in s or ".." in s or "[+" in s) and _NOTE.search(s):
        return CUT, ""
    if s.endswith(("…", "..")) and (m := _DOTS.search(s)):
        return DOTS, s[: m.start()]
    if s.rstrip(_CLOSERS)[-1:] in tuple(".!?。！？") or s[-1] in ")]":
        return FULL, ""
    line = s[max(s.rfind("\n"), s.rfind("\r")) + 1 :].strip()
    if len(line) < 100 and line != s.strip() and _LINE.match(line):
        return FULL, ""
    return OPEN, s


_FOLD, _64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _fold(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = h * np.uint64(_FOLD) + more
    return h ^ (h >> np.uint64(31))


def gram(words: list[str]) -> int:
    """The number of a group of words, even, as a signed 64-bit integer; the same that ``_grams`` gives."""
    h = 0
    for w in words:
        h = (h * _FOLD + _hash(w)) & _64
        h ^= h >> 31
    h &= _64 - 1
    return h - (1 << 64) if h >> 63 else h


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the groups of ``n`` words, by the place of their last one."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = _fold(out, h[k : k + len(out)])
    return out & np.uint64(_64 - 1)


def closing(text: str) -> list[int]:
    """Numbers of the last three, two and one words."""
    size = 200
    while len(w := tokens(text[-size:])) < 6 and size < len(text):  # the first ones may be cut
        size *= 2
    return [gram(w[-n:]) if len(w) >= n else 0 for n in (3, 2, 1)]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all word groups of a batch and of those that end a sentence; the end of a text is no place."""
    codes = Codes()
    for b in batches:
        codes = codes.renew()
        texts = [codes.of(t.rstrip()) for t in b.column("text").to_pylist() if t]
        masked, _, word = codes.arrays()
        at = np.array([i for t in texts for i in t], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        h, is_word = masked[at], word[at]
        place = np.zeros(len(at), bool)  # a word with something behind it
        place[:-1] = is_word[:-1] & (text[1:] == text[:-1])
        ends = np.zeros(len(at), np.uint64)
        ends[:-1] = ~is_word[1:]
        keys = []
        for n in PLACES:
            use = np.flatnonzero(place[n - 1 :] & (text[n - 1 :] == text[: len(text) - n + 1])) if len(at) >= n else np.zeros(0, np.int64)
            keys.append(_grams(h, n)[use] | ends[use + n - 1])
        k = np.sort(np.concatenate(keys))
        group = k & np.uint64(_64 - 1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(k) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(k)])
        ended = np.add.reduceat((k & np.uint64(1)).astype(np.int64), first) if len(k) else count
        yield pa.RecordBatch.from_arrays([pa.array(group[first].view(np.int64)), pa.array(count.astype(np.int64)), pa.array(ended)], ["gram", "n", "ends"])


_FORM = "doc_id bigint, form string, size int, length int, three bigint, two bigint, one bigint"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            form, rest = ending(text)
            rows.append((doc, form, len(text or ""), len((text or "").encode("utf-8", "surrogatepass")), *(closing(rest) if rest else (0, 0, 0))))
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "form", "size", "length", "three", "two", "one"])


_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _shingles(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _fold(out, h[k : k + len(out)])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct shingles of five words, sorted; of all words together where there are fewer."""
    w = [t.lower() for t in _TOKEN.findall(text)]
    return _shingles(np.array([_hash(t) for t in w if t[0] not in "\r\n" and not _STOP.match(t)], np.uint64))


def bands(text: str) -> list[int]:
    """The band keys of a text's min-hash signature."""
    return _bands(shingles(text))


def _bands(s: np.ndarray) -> list[int]:
    if not len(s):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        low = np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _fold(key, low[:, r])
    return key.view(np.int64).tolist()


_BANDED = "doc_id bigint, digest binary, size int, shingles int, open boolean, bands array<bigint>"


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for b in batches:
        codes, rows = codes.renew(), []
        docs = [(doc, text, np.array(codes.of(text), np.int64)) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if text]
        _, plain, word = codes.arrays()
        for doc, text, at in docs:
            s = _shingles(plain[at[word[at]]])
            if len(s):
                rows.append((doc, xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass")), len(text), len(s), ending(text)[0] in (OPEN, DOTS), _bands(s)))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "digest", "size", "shingles", "open", "bands"])


def ends_early(text: str, other: str) -> bool | None:
    """Whether ``text`` stops within a sentence of its near-copy ``other``; None if they aren't near-copies.

    The copies are aligned at the last five whole words of ``text``, at their last occurrence.
    """
    a, b = shingles(text), shingles(other)
    if not len(a) or not len(b):
        return None
    both = len(np.intersect1d(a, b))
    if both < SIMILAR * (len(a) + len(b) - both):
        return None
    stem = _DOTS.sub("", text.rstrip())
    w, o = [t for t in tokens(stem) if t != "\n"], [t for t in tokens(other) if t != "\n"]
    if not w or _STOP.match(w[-1]):
        return False
    for drop in (0, 1):  # the last word may be half a word
        tail = w[len(w) - drop - 5 : len(w) - drop]
        if len(tail) < 5:
            return None
        for i in range(len(o) - 5, -1, -1):
            if o[i : i + 5] == tail:
                after = o[i + 5 : i + 6]
                if drop and not (after and after[0].startswith(w[-1]) and after[0] != w[-1]):
                    continue
                return bool(after) and not _STOP.match(after[0])
    return None


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [doc for doc, text, other in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "other_text"))) if ends_early(text, other)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])


def cut_copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that end early beside a longer near-copy.

    Two sets of shingles can be similar by ``SIMILAR`` only where the smaller one has that share
    of the larger one's number, so other pairs of a band are left out; none else is.
    """
    signed = written(docs.filter("text is not null").mapInArrow(_banded, _BANDED), "bands")
    reps = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "shingles", "open", "bands")).alias("r"))
    keys = reps.select("r.doc_id", "r.size", "r.shingles", "r.open", F.explode("r.bands").alias("band"))
    x, y = keys.filter("open").drop("open").alias("x"), keys.drop("open").alias("y")
    near = F.least("x.shingles", "y.shingles") >= SIMILAR * F.greatest("x.shingles", "y.shingles")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("y.size") > F.col("x.size")) & near).select(F.col("x.doc_id").alias("doc_id"), F.col("y.doc_id").alias("other")).distinct()
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("other"), F.col("text").alias("other_text")), "other")
    found = both.mapInArrow(_aligned, "doc_id bigint").distinct()
    # what holds of a text holds of all that are equal to it
    of = signed.select("doc_id", "digest")
    return of.join(of.join(found, "doc_id").select("digest").distinct(), "digest").select("doc_id").distinct()


def field_limits(forms: DataFrame, column: str) -> list[int]:
    """Lengths at which texts without an end pile up; at most one in (1 / ``LIMIT_SHARE``)."""
    counts = forms.filter("form = 'open'").groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    near = counts.select(F.explode(F.sequence(F.col(column) - AROUND, F.col(column) + AROUND)).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("around"))
    total = forms.count()
    found = counts.join(near, counts[column] == near["at"]).filter((F.col("n") >= max(LIMIT_TEXTS, LIMIT_SHARE * total)) & (F.col("n") * 2 * AROUND >= LIMIT_TIMES * (F.col("around") - F.col("n"))))
    return sorted(r[0] for r in found.select(column).collect())


def cut_texts(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose text was cut off. Null and blank texts and codes are whole."""
    docs = spread(documents.select("doc_id", "text"))
    forms = written(docs.mapInArrow(_forms, _FORM), "ends")
    chars, octets = field_limits(forms, "size"), field_limits(forms, "length")
    places = docs.filter("text is not null").mapInArrow(_places, "gram bigint, n bigint, ends bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    unsure = forms.filter(F.col("form").isin(OPEN, DOTS))
    tails = unsure.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("words"), F.col(c).alias("gram")) for n, c in ((3, "three"), (2, "two"), (1, "one"))])).alias("t")).select("doc_id", "t.*").filter("gram <> 0")
    enough = F.expr("case words " + " ".join(f"when {k} then n >= {v}" for k, v in PLACES.items()) + " end")
    # the longest group with enough places decides; without one the words close nothing
    best = tails.join(places, "gram").filter(enough).groupBy("doc_id").agg(F.max_by(F.col("ends") / F.col("n"), "words").alias("terminal"))
    early = cut_copies(docs).withColumn("early", F.lit(True))
    at_limit = F.lit(False)
    if chars:
        at_limit = at_limit | F.col("size").isin(chars)
    if octets:
        at_limit = at_limit | F.col("length").isin(octets)
    scored = unsure.join(best, "doc_id", "left").join(early, "doc_id", "left")
    low = F.coalesce("terminal", F.lit(0.0)) < TERMINAL
    found = scored.filter(low | F.coalesce("early", F.lit(False)) | ((F.col("form") == OPEN) & at_limit))
    return forms.filter(F.col("form") == CUT).select("doc_id").unionByName(found.select("doc_id"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"))


def p10_source_rates(spark, sf_dir: str) -> DataFrame:
    """Per source: documents with a text, those cut off, and their share."""
    docs = table(spark, sf_dir, "documents")
    found = cut_texts(docs).withColumn("cut", F.lit(1))
    out = docs.filter("text is not null").select("doc_id", "source").join(found, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("cut").alias("cut"))
    return out.withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
