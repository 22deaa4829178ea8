"""Languages of documents and of the stretches in them, by string kernels.

Kernel: blended spectrum of presence, the number of n-grams of one to four characters that two
texts share, over the geometric mean of theirs. Nyström: a bounded set of landmark sentences spans
the feature space. One-versus-rest kernel ridge regression on a bounded sample of sentences, whose
labels are those on which the page and the earlier analysis agree; sentences that the first fit
contradicts leave the sample, and the fit is made again. Sentences are scored in batches by one
product of their presence matrix with the matrix (n-grams x languages) into which landmarks and
regression fold. A sentence differs from its document's language only by a clear margin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import once, spread, table

#: Bounds of the fit: documents and sentences of each language, landmarks of each, ridge.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, LANDMARKS, RIDGE = 300, 500, 40, 0.05
#: N-grams are hashed into so many columns.
COLUMNS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Letters a sentence needs, and by how much another language must score higher than the document's.
LEAST_WORDS, LEAST_LETTERS, MARGIN = 4, 12, 0.35

#: Spellings of languages besides their two-letter codes (ISO 639-2 and names).
SPELLINGS = {
    "en": "eng english anglais englisch inglés ingles",
    "de": "ger deu german deutsch allemand alemán",
    "fr": "fre fra french français francais französisch",
    "es": "spa spanish español espanol castellano spanisch",
    "it": "ita italian italiano italienisch",
    "pt": "por portuguese português portugues portugiesisch",
    "nl": "dut nld dutch nederlands niederländisch",
    "pl": "pol polish polski polnisch",
    "sv": "swe swedish svenska schwedisch",
    "ru": "rus russian русский russisch",
    "ja": "jpn japanese 日本語 japanisch",
}
UNKNOWN = "und unknown unk none null undefined undetermined other n/a na mul mis zxx xx ? -".split()
_CODES = {w: k for k, v in SPELLINGS.items() for w in v.split()}

_CUT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』]*\s*|[\r\n]+")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»」』)\]]*\s*$")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_OTHER = re.compile(r"[\W\d_]+")


def code_of(spelling: Column) -> Column:
    """The two-letter code of a spelling; null for none or a word for unknown."""
    s = F.lower(F.trim(spelling))
    head = F.split(s, "[-_]")[0]
    names = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.when(s.isin(*UNKNOWN) | (F.length(s) == 0), None).otherwise(F.coalesce(F.try_element_at(names, s), F.try_element_at(names, head), F.when(head.rlike("^[a-z]{2}$"), head), s))


def _without_addresses(text: str) -> str:
    return _ADDRESS.sub(" ", text) if "@" in text or "://" in text or "www." in text else text


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the stretches of a text; whole ones are sentences with their end."""
    out, at = [], 0
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        s = text[at:end]
        if s.strip():
            whole = False
            if _ENDED.search(s):
                body = _without_addresses(s)
                words = [w for w in _LETTERS.findall(body) if len(w) > 1 or w.islower()]
                whole = (len(words) >= LEAST_WORDS and sum(map(len, words)) >= LEAST_LETTERS) or (not body.isascii() and len(_CJK.findall(body)) >= 8)
            out.append((at, end, whole))
        at = m.end() if m else len(text)
    return out


def clean(sentence: str) -> str:
    """Lower case letters with single spaces, addresses, digits and marks left out."""
    return " " + _OTHER.sub(" ", _without_addresses(sentence)).strip().lower() + " "


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the hashed n-grams in each text, each once, sorted by row."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), lengths)
    keys, h = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)) if n > 1 else codes * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        h ^= h >> np.uint64(29)
        inside = row[:m] == row[n - 1 :]
        keys.append(row[:m][inside] * COLUMNS + (h[inside] >> np.uint64(17)).astype(np.int64) % COLUMNS)
    k = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
    return k // COLUMNS, k % COLUMNS


@dataclass
class Model:
    """``weights``: n-gram columns by languages; a text scores the mean of its rows times their root."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        out, at = [np.zeros((0, len(self.languages)), np.float32)], 0
        while at < len(texts):  # batches of bounded size
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 200_000):
                size += len(texts[to])
                to += 1
            out.append(_products(texts[at:to], self.weights))
            at = to
        return np.concatenate(out)


def _products(texts: list[str], right: np.ndarray) -> np.ndarray:
    """The presence matrix of ``texts``, rows of length one, times ``right``, in parts of bounded size."""
    out = np.zeros((len(texts), right.shape[1]), np.float32)
    step = max(1, min(64, 12_000_000 // (400 * right.shape[1])))  # sorted within the cache
    for a in range(0, len(texts), step):
        r, c = presence(texts[a : a + step])
        if len(r):
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[a + r[first]] = np.add.reduceat(right[c], first, axis=0) / np.sqrt(np.diff(np.r_[first, len(r)]))[:, None]
    return out


def _columns(texts: list[str]) -> np.ndarray:
    """N-gram columns by texts: the transposed presence matrix with columns of length one."""
    x = np.zeros((COLUMNS, len(texts)), np.float32)
    r, c = presence(texts)
    x[c, r] = 1
    return x / np.sqrt(np.maximum(1, x.sum(axis=0)))


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of labelled sentences; the order of the sentences decides the landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((COLUMNS, 0), np.float32))
    keep = list(range(len(texts)))
    for last in (False, True):
        y = [labels[i] for i in keep]
        size = Counter(y)
        chosen = [i for lang in languages for i in [k for k in keep if labels[k] == lang][:landmarks]]
        z = _columns([texts[i] for i in chosen])
        vals, vecs = np.linalg.eigh(_products([texts[i] for i in chosen], z).astype(np.float64))
        good = vals > 1e-6 * vals.max()
        root = (vecs[:, good] / np.sqrt(vals[good])).astype(np.float64)
        gram, target = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
        for a in range(0, len(keep), 500):
            phi = _products([texts[i] for i in keep[a : a + 500]], z).astype(np.float64) @ root
            t = np.array([[1.0 if lab == lang else -1.0 for lang in languages] for lab in y[a : a + 500]])
            # languages count alike however many sentences they have
            w = np.array([1 / size[lab] for lab in y[a : a + 500]]) * len(y) / len(languages)
            gram += (phi * w[:, None]).T @ phi
            target += (phi * w[:, None]).T @ t
        solved = np.linalg.solve(gram + ridge * len(keep) * np.eye(len(gram)) / len(languages), target)
        model = Model(languages, z @ (root @ solved).astype(np.float32))
        if last:
            return model
        best = model.scores([texts[i] for i in keep]).argmax(axis=1)
        keep = [i for i, b in zip(keep, best) if languages[b] == labels[i]] or keep
    return model


def train(documents: DataFrame, analysis: DataFrame) -> Model:
    """Fits on at most ``SAMPLE_DOCUMENTS`` x 2 documents of each two-letter language both sides agree on."""
    known = once(analysis.select("doc_id", "language"), "doc_id").select("doc_id", code_of(F.col("language")).alias("a"))
    agreed = documents.filter("text is not null").select("doc_id", code_of(F.col("lang")).alias("label")).join(known, "doc_id").filter("label = a and length(label) = 2").select("doc_id", "label")
    counts = agreed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    chosen = agreed.join(F.broadcast(counts), "label").filter(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / SAMPLE_DOCUMENTS)) == 0).select("doc_id", "label")
    rows = documents.join(chosen, "doc_id").select("doc_id", "label", "text").collect()  # bounded by the sample
    by: dict[str, list[tuple[int, str]]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"])):  # so that landmarks come from all over
        spans = [r["text"][a:b] for a, b, whole in sentences(r["text"]) if whole]
        by.setdefault(r["label"], []).extend((r["doc_id"], clean(s)) for s in spans[:: max(1, len(spans) // 4)][:4])
    texts, labels = [], []
    for lang in sorted(by):
        step = max(1, len(by[lang]) // SAMPLE_SENTENCES)
        got = [s for _, s in by[lang][::step][:SAMPLE_SENTENCES]]
        texts += got
        labels += [lang] * len(got)
    return fit(texts, labels)


def _has_words(text: str) -> bool:
    """Whether a text without a whole sentence still has words, not only codes and numbers."""
    body = _ADDRESS.sub(" ", text)
    return len(_CJK.findall(body)) >= 4 or sum(len(w) > 2 or not w.isupper() for w in _LETTERS.findall(body)) >= 3


def segments_of(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its stretches as (start, end, language, confidence, whole), neighbours of one language joined."""
    if not model.languages:
        return [[] for _ in texts]
    spans = [sentences(t) if t else [] for t in texts]
    flat = [clean(t[a:b]) for t, ss in zip(texts, spans) for a, b, _ in ss]
    scores = model.scores(flat)
    size = np.array([len(x) - 2 for x in flat], np.float64).clip(0)
    whole = np.array([w for ss in spans for _, _, w in ss], bool) & (size > 0)
    best = scores.argmax(axis=1) if len(flat) else np.zeros(0, np.int64)
    ranked = np.partition(scores, -2, axis=1)[:, -2:] if scores.shape[1] > 1 else np.c_[np.full(len(flat), -1.0), scores]
    out, at = [], 0
    for t, ss in zip(texts, spans):
        here = slice(at, at + len(ss))
        at += len(ss)
        own, n, full = scores[here], size[here], whole[here]
        usable = n > 0
        any_whole = bool(full.any())
        if not usable.any() or not (any_whole or _has_words(t)):
            out.append([])
            continue
        base = full if any_whole else usable
        main = int((own[base] * n[base][:, None]).sum(axis=0).argmax())
        # a whole sentence differs from its document's language only by a clear margin
        lang = np.where(full & (ranked[here, 1] - own[:, main] >= MARGIN), best[here], main)
        score = own[np.arange(len(ss)), lang]
        rival = np.where(score > ranked[here, 0], ranked[here, 0], ranked[here, 1])
        sure = np.where(usable, np.clip(0.5 + (score - rival) / 4, 0.0, 1.0), 0.0)
        rows: list[list] = []
        for (a, b, _), g, c, w, k in zip(ss, lang.tolist(), sure.tolist(), full.tolist(), n.tolist()):
            if rows and rows[-1][2] == g:
                r = rows[-1]
                r[3] = (r[3] * r[5] + c * k) / (r[5] + k) if r[5] + k else 0.0
                r[1], r[4], r[5] = b, r[4] or w, r[5] + k
            else:
                rows.append([a, b, g, c, w, k])
        out.append([(a, b, model.languages[g], round(c, 4), w or not any_whole) for a, b, g, c, w, _ in rows])
    return out


def text_segments(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, segment, start, length, language, confidence, whole)`` of every document with a language.

    ``whole`` tells whether the segment has a whole sentence (or the document has none at all). Null,
    blank and code-only texts have no segments. Nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                c = b.slice(at, 200)
                found = segments_of(c.column("text").to_pylist(), shared.value)
                rows = [(doc, k, a, e - a, lang, sure, w) for doc, segs in zip(c.column("doc_id").to_pylist(), found) for k, (a, e, lang, sure, w) in enumerate(segs)]
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()))], ["doc_id", "segment", "start", "length", "language", "confidence", "whole"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, segment int, start int, length int, language string, confidence double, whole boolean")


def document_languages(segments: DataFrame) -> DataFrame:
    """``(doc_id, language, confidence, share, languages)``: a row per language of a document with a whole sentence."""
    per = segments.filter("whole").groupBy("doc_id", "language").agg(F.sum("length").alias("chars"), F.sum(F.col("confidence") * F.col("length")).alias("c"))
    each = per.groupBy("doc_id").agg(F.sum("chars").alias("all"), F.count(F.lit(1)).alias("languages"), F.collect_list(F.struct("language", "chars", "c")).alias("l"))
    row = each.select("doc_id", "all", "languages", F.explode("l").alias("r"))
    return row.select("doc_id", "r.language", F.round(F.col("r.c") / F.col("r.chars"), 4).alias("confidence"), F.round(F.col("r.chars") / F.col("all"), 4).alias("share"), "languages")


def _all(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, Model]:
    docs, analysis = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "text_analysis")
    return docs, analysis, train(docs, analysis)


def mislabelled(documents: DataFrame, analysis: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, language)`` of documents whose label is missing or wrong, or with several languages."""
    found = document_languages(text_segments(documents, model))
    noted = once(analysis.select("doc_id", "language"), "doc_id").select("doc_id", code_of(F.col("language")).alias("noted"))
    return found.join(noted, "doc_id", "left").filter("languages > 1 or noted is null or noted <> language").select("doc_id", "language")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return mislabelled(*_all(spark, sf_dir))


def p2_document_languages(spark, sf_dir: str) -> DataFrame:
    docs, _, model = _all(spark, sf_dir)
    return document_languages(text_segments(docs, model))


def p2_segments(spark, sf_dir: str) -> DataFrame:
    docs, _, model = _all(spark, sf_dir)
    return text_segments(docs, model)
