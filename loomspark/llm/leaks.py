"""Evaluation texts in the corpus: Wu-Manber search for many patterns, confirmed by alignment.

Texts are sequences of words (letter case, accents, punctuation, markup and white space aside).
The patterns are all windows of ``WINDOW`` words of the items. The search moves over a document
with a table of shifts for blocks of ``BLOCK`` words: a block that no pattern has skips as far as
the window allows; a block that ends patterns selects those by its bucket, and direct comparison
confirms. With at most one word in eight changed, half an item holds five unchanged words in
a row somewhere, so no case is skipped. Where the words that the item and the passage around its
hits have in common, in their order (a bit-parallel count), are enough for a case, both are aligned
word by word, which decides. Items of fewer than ``WINDOW`` words are cases where they stand whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import once, spread, table

WINDOW, BLOCK = 4, 2
#: A passage holds this share of the item's words in their order, of which one in eight may be changed.
SHARE, CHANGED = 0.5, 1 / 8
#: Items that go to the tasks at once; more of them are searched in several passes.
ITEMS = 200_000

_INLINE_TAG = re.compile(r"</?(?:a|abbr|b|code|em|i|mark|small|span|strong|sub|sup|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_SPACELESS = re.compile(r"([぀-ヿ㐀-䶿一-鿿가-힯])")


def words_of(text: str | None) -> list[str]:
    """The words of a text as compared; characters of scripts without spaces are words of their own."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = _SPACELESS.sub(r" \1 ", text)
    return _WORD.findall(text.casefold())


class WuManber:
    """Search for all windows of the given word sequences."""

    def __init__(self, items: dict[int, list[str]]) -> None:
        self.ids: dict[str, int] = {}
        self.items = {k: [self.ids.setdefault(w, len(self.ids) + 1) for w in ws] for k, ws in items.items()}
        self.far = WINDOW - BLOCK + 1
        self.shift: dict[tuple[int, int], int] = {}
        self.bucket: dict[tuple[int, int], dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        self.short: dict[tuple[int, ...], list[int]] = {}
        self._masks: dict[int, dict[int, int]] = {}
        for item, ws in self.items.items():
            if 0 < len(ws) < WINDOW:
                self.short.setdefault(tuple(ws), []).append(item)
            for at in range(len(ws) - WINDOW + 1):
                p = tuple(ws[at : at + WINDOW])
                for j in range(WINDOW - BLOCK + 1):
                    b = p[j : j + BLOCK]
                    self.shift[b] = min(self.shift.get(b, self.far), WINDOW - BLOCK - j)
                self.bucket.setdefault(p[-BLOCK:], {}).setdefault(p[:-BLOCK], []).append((item, at))

    def encode(self, words: list[str]) -> list[int]:
        get = self.ids.get
        return [get(w, 0) for w in words]

    def whole(self, text: list[int]) -> set[int]:
        """The items of fewer than ``WINDOW`` words that stand in a text as they are."""
        out: set[int] = set()
        for n in {len(ws) for ws in self.short}:
            for at in range(len(text) - n + 1):
                out.update(self.short.get(tuple(text[at : at + n]), ()))
        return out

    def masks(self, item: int) -> dict[int, int]:
        """For each word of an item the bits of its places."""
        found = self._masks.get(item)
        if found is None:
            found = self._masks[item] = {}
            for i, w in enumerate(self.items[item]):
                found[w] = found.get(w, 0) | 1 << i
        return found

    def hits(self, text: list[int]) -> dict[int, list[tuple[int, int]]]:
        """For each item the (position in the text, position in the item) of its windows."""
        out: dict[int, list[tuple[int, int]]] = {}
        shift, far, i, n = self.shift.get, self.far, WINDOW - 1, len(text)
        while i < n:
            b = (text[i - 1], text[i])
            s = shift(b, far)
            if s:
                i += s
                continue
            found = self.bucket[b].get(tuple(text[i - WINDOW + 1 : i - BLOCK + 1]))
            for item, at in found or ():
                out.setdefault(item, []).append((i - WINDOW + 1, at))
            i += 1
        return out


def align(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Of the best local alignment: words of the item spanned, words equal, words inserted.

    An equal word counts 1, a replaced or omitted one -2, an inserted one -1.
    """
    best, row = (0, 0, 0, 0), [(0, 0, 0, 0)] * (len(text) + 1)  # score, spanned, equal, inserted
    zero = (0, 0, 0, 0)
    for w in item:
        new = [zero]
        left = zero
        for j, t in enumerate(text):
            s, a, e, x = row[j]
            c = (s + 1, a + 1, e + 1, x) if w == t else (s - 2, a + 1, e, x)
            s, a, e, x = row[j + 1]
            if s - 2 > c[0]:
                c = (s - 2, a + 1, e, x)
            s, a, e, x = left
            if s - 1 > c[0]:
                c = (s - 1, a, e, x + 1)
            if c[0] <= 0:
                c = zero
            elif c > best:
                best = c
            left = c
            new.append(c)
        row = new
    return best[1:]


def in_order(masks: dict[int, int], n: int, text: list[int]) -> int:
    """The most words of an item of ``n`` words that a text has in their order (longest common subsequence)."""
    full = (1 << n) - 1
    v, get = full, masks.get
    for t in text:
        if m := get(t):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def leaked(search: WuManber, text: list[int]) -> list[tuple[int, int, int, int]]:
    """(item, words spanned, words equal, words of the item) of the items that the text holds."""
    out = [(item, n, n, n) for item in sorted(search.whole(text)) if (n := len(search.items[item]))] if search.short else []
    for item, hits in search.hits(text).items():
        ws = search.items[item]
        n = len(ws)
        # a case spans SHARE of the item, all but CHANGED of it (and one word) unchanged
        least = SHARE * n * (1 - CHANGED) - 1
        if len({at + k for _, at in hits for k in range(WINDOW)}) < 0.15 * n:
            continue
        # passages: hits whose start of the item would lie close together
        starts = sorted((pos - at, pos, at) for pos, at in hits)
        groups, last = [], None
        for s, pos, at in starts:
            if last is None or s - last > max(4, n // 4):
                groups.append([])
            groups[-1].append((pos, at))
            last = s
        best = (0, 0, 0)
        for g in groups:
            if len({at + k for _, at in g for k in range(WINDOW)}) < 0.15 * n:
                continue
            low = max(0, min(pos - at for pos, at in g) - n // 6 - 2)
            high = max(pos + n - at for pos, at in g) + n // 6 + 2
            if in_order(search.masks(item), n, text[low:high]) < least:
                continue
            best = max(best, align(ws, text[low:high]), key=lambda b: b[1])
        span, equal, inserted = best
        if span >= SHARE * n and span - equal <= CHANGED * span + 1:
            out.append((item, span, equal, n))
    return out


def find_leaks(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``(item_id, doc_id)`` of every document that holds an item.

    At most ``ITEMS`` items go to the tasks at once, and documents are read once for each such part,
    in parallel, never shuffled. Null and empty texts hold nothing and null and empty items are never found.
    """
    items = once(items.select("item_id", "text"), "item_id")
    parts = max(1, -(-items.count() // ITEMS))
    docs = spread(documents.filter("text is not null").select("doc_id", "text"))
    found = None
    for part in range(parts):
        # hashed parts differ little in size
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        one = docs.mapInArrow(_search({r["item_id"]: w for r in rows if (w := words_of(r["text"]))}, items.sparkSession), "item_id bigint, doc_id bigint")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _search(words: dict[int, list[str]], spark):
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = WuManber(shared.value)
        for b in batches:
            got = [(i, doc) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, *_ in leaked(search, search.encode(words_of(text)))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["item_id", "doc_id"])

    return run


def p9_found(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p9_leaked_items(spark, sf_dir: str) -> DataFrame:
    """Per item of the benchmarks: the number of documents that hold it."""
    items = once(table(spark, sf_dir, "eval_items").select("item_id", "benchmark"), "item_id")
    found = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(found, "item_id", "left").select("item_id", "benchmark", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))
