"""Garbled text from wrong decoding: transformations learned from near-twins, then applied.

1. Words are joined with their near-twins on what is left without non-ASCII characters. In each
   such group the most frequent spelling is the clean one; every other one is aligned with it,
   and the codec pairs (decoded as, written in) that turn the clean runs into the garbled ones
   are its explanations. Words without ASCII letters have nothing to join on: there a pair
   explains a word when what it restores is a more frequent word of the corpus.
2. Pairs are learned greedily: the one that explains most twins first, then only by twins that no
   learned pair explains. So chance twins, which grow with the corpus, teach nothing that another
   pair shows already.
3. They are applied to all records, stretch by stretch, where the restored text is likelier.
   Likelihood is the share of bodies with each pair of neighbouring characters, so the test is the
   same at every size. Text written in UTF-8 shows by its byte pattern as well; any other pair must
   make a stretch likelier by ``ODDS`` in all and by ``GAIN`` a pair of characters.
4. Characters that were lost (replacement characters, question marks within words) can't be had
   again; such records are found, without a text. Where a question mark could end a sentence, the
   word must be the twin of a clean one.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import spread, table, written

#: Distinct twins that only this transformation explains: one out of UTF-8 proves itself by its byte pattern.
UTF8_TWINS, OTHER_TWINS = 1, 3
#: The least share of all explained twins that a pair must explain alone (those out of UTF-8 need none).
TWIN_SHARE = 0.0005
#: Share of bodies from which a pair of characters counts as known (unknown ones count as half of it),
#: and the gain of likelihood that accepts a text: per pair of characters, and in all (odds of 100 to 1).
KNOWN, GAIN, ODDS = 0.0005, 0.7, math.log(100)
UNKNOWN = math.log(KNOWN / 2)
#: Stretches whose restoration a task remembers.
REMEMBERED = 50_000

DECODED_AS = ["windows-1252", "mac_roman", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp437", "cp850", "cp866", "iso8859_15", "cp1254"]
WRITTEN_IN = ["utf-8", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp932", "euc_jp", "windows-1252", "mac_roman"]
Pair = tuple[str, str]
PAIRS: list[Pair] = [(a, b) for a in DECODED_AS for b in WRITTEN_IN if a != b]
PAIR_NUMBER = {p: i for i, p in enumerate(PAIRS)}
SEVERAL_BYTES = ("cp932", "euc_jp")
UTF8_PAIRS: tuple[Pair, ...] = (("windows-1252", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"))

_WORD = re.compile(r"[^\s<>\"'(),;:!?./|=&{}\[\]]*[^\x00-\x7f][^\s<>\"'(),;:!?./|=&{}\[\]]*")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_STRETCH = re.compile(r"[^<>\"\r\n]+")
#: Four characters of codecs with several bytes, each byte read as a character: the first of each isn't ASCII, none is a blank.
_COULD_BE_RUN = re.compile(r"(?:[^\x00-\x7f][^ \t]?){4}")


@cache
def _table(codec: str) -> tuple[str, ...]:
    """The character of each byte of a one-byte codec; where it has none, the control character."""
    name = "cp1252" if codec == "windows-1252" else codec
    out = []
    for i in range(256):
        c = bytes([i]).decode(name, "replace")
        out.append(chr(i) if c == "�" else c)
    return tuple(out)


@cache
def _bytes(codec: str) -> dict[str, int]:
    out = {c: i for i, c in enumerate(_table(codec))}
    if codec == "windows-1252":  # texts decoded as ISO 8859-1 have the control characters themselves
        out |= {chr(i): i for i in range(0x80, 0xA0)}
    return out


@cache
def _map(codec: str) -> dict[int, int]:
    return {ord(c): i for c, i in _bytes(codec).items()}


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _map(codec))[0]
    except UnicodeError:
        return None


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode("cp1252" if codec == "windows-1252" else codec)
    except UnicodeError:
        return None


def undo(text: str, pair: Pair) -> str | None:
    """``text`` decoded anew, or None if it can't have come about by ``pair``."""
    raw = _encode(text, pair[0])
    return None if raw is None else _decode(raw, pair[1])


def garble(text: str, pair: Pair) -> str | None:
    """What ``text`` looks like when written and decoded by ``pair``."""
    try:
        raw = text.encode("cp1252" if pair[1] == "windows-1252" else pair[1])
    except UnicodeError:
        return None
    t = _table(pair[0])
    return "".join(t[b] for b in raw)


@cache
def _utf8_places(codec: str) -> re.Pattern:
    at = lambda a, b: "[" + "".join(re.escape(c) for c, i in _bytes(codec).items() if a <= i <= b) + "]"
    tail = at(0x80, 0xBF)
    return re.compile(f"(?:{at(0xC2, 0xDF)}{tail}|{at(0xE0, 0xEF)}{tail}{{2}}|{at(0xF0, 0xF4)}{tail}{{3}})+")


def undo_utf8(text: str, codec: str) -> str:
    """Every place with the byte pattern of UTF-8 decoded anew, until none is left (twice garbled text)."""
    for _ in range(4):
        new = _utf8_places(codec).sub(lambda m: undo(m[0], (codec, "utf-8")) or m[0], text)
        if new == text:
            break
        text = new
    return text


def twin_pairs(garbled: str, clean: str) -> list[Pair]:
    """The pairs that explain every differing run of two words that are equal without non-ASCII characters."""
    if _NON_ASCII.sub("\x00", garbled) != _NON_ASCII.sub("\x00", clean):
        return []
    runs = [(a, b) for a, b in zip(_NON_ASCII.findall(garbled), _NON_ASCII.findall(clean)) if a != b]
    return [p for p in PAIRS if runs and all(garble(b, p) == a or undo(a, p) == b for a, b in runs)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for body in b.column("body").to_pylist():
            if body and not body.isascii():
                out += sorted(set(_WORD.findall(body)))
        skeleton = ["".join(c for c in w if c.isascii() and c.isalpha()) for w in out]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(skeleton, pa.string())], ["word", "skeleton"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, PAIR_NUMBER[p]) for w, clean in zip(b.column("word").to_pylist(), b.column("clean").to_pylist()) for p in twin_pairs(w, clean)]
        yield _record([("word", pa.string()), ("pair", pa.int32())], rows)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for w in b.column("word").to_pylist():
            for codec in DECODED_AS:
                if (raw := _encode(w, codec)) is None:
                    continue
                for wrote in WRITTEN_IN:
                    if wrote != codec and (r := _decode(raw, wrote)) and r != w and not r.isascii() and r.isprintable():
                        rows.append((w, r, PAIR_NUMBER[codec, wrote]))
        yield _record([("word", pa.string()), ("restored", pa.string()), ("pair", pa.int32())], rows)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of four or more non-ASCII characters, as they stand and as several-byte codecs restore them."""
    for b in batches:
        rows, stretches = [], set()
        for body in b.column("body").to_pylist():
            if body and not body.isascii():
                stretches |= {m[0] for m in _STRETCH.finditer(body) if not m[0].isascii()}
        for s in stretches:
            if not _COULD_BE_RUN.search(s):
                continue
            rows += [(s, x, -1) for x in set(_NON_ASCII.findall(s)) if len(x) >= 4]
            for codec in DECODED_AS:
                if (raw := _encode(s, codec)) is None:
                    continue
                for wrote in SEVERAL_BYTES:
                    if (r := _decode(raw, wrote)) and r != s:
                        rows += [(s, x, PAIR_NUMBER[codec, wrote]) for x in set(_NON_ASCII.findall(r)) if len(x) >= 4]
        yield _record([("word", pa.string()), ("run", pa.string()), ("pair", pa.int32())], rows)


def _record(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _corpus_words(bodies: DataFrame) -> DataFrame:
    words = bodies.filter("body is not null").mapInArrow(_words, "word string, skeleton string").groupBy("word", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    return written(words, "words")


def explained_twins(bodies: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, pairs)``: garbled words or stretches with the numbers of all pairs that explain them."""
    joined = words.filter("length(skeleton) >= 3")
    best = joined.groupBy("skeleton").agg(F.max(F.struct("n", "word")).alias("b")).select("skeleton", F.col("b.word").alias("clean"), F.col("b.n").alias("clean_n"))
    near = joined.join(best, "skeleton").filter("word <> clean and n < clean_n").mapInArrow(_aligned, "word string, pair int")
    forms = spread(words.filter("length(skeleton) < 3").select("word")).mapInArrow(_restored, "word string, restored string, pair int")
    # twice the frequency tells the clean word from another garbled one
    other = forms.join(words.select(F.col("word").alias("restored"), F.col("n").alias("clean_n")), "restored").join(words.select("word", "n"), "word").filter("clean_n >= 2 * n").select("word", "pair")
    # texts without spaces have no words: there the twin is a run of characters
    runs = written(bodies.filter("body is not null").mapInArrow(_runs, "word string, run string, pair int"), "runs")
    clean = runs.filter("pair < 0").groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("run")
    spaceless = runs.filter("pair >= 0").join(clean, "run", "left_semi").select("word", "pair")
    return near.unionByName(other).unionByName(spaceless).groupBy("word").agg(F.collect_set("pair").alias("pairs"))


def learn_pairs(bodies: DataFrame, words: DataFrame | None = None) -> list[tuple[Pair, int]]:
    """The transformations that twins show, with the twins that each explains beyond those before it.

    A round of the greedy choice is one combined count over the written twins; there are at most
    ``len(PAIRS)`` rounds, and each brings ``len(PAIRS)`` numbers to the driver at most.
    """
    twins = written(explained_twins(bodies, words or _corpus_words(bodies)), "twins")
    total, chosen = twins.count(), []
    while True:
        left = twins.filter(~F.arrays_overlap("pairs", F.array(*[F.lit(PAIR_NUMBER[p]) for p, _ in chosen]).cast("array<int>"))) if chosen else twins
        counts = {PAIRS[r["pair"]]: r["n"] for r in left.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
        enough = [p for p, n in counts.items() if n >= (UTF8_TWINS if p[1] == "utf-8" else max(OTHER_TWINS, TWIN_SHARE * total))]
        if not enough:
            return chosen
        p = min(enough, key=lambda p: (-counts[p], PAIR_NUMBER[p]))
        chosen.append((p, counts[p]))


def _pairs_of(text: str) -> set[str]:
    return {text[i : i + 2] for m in _NON_ASCII.finditer(text) for i in range(max(0, m.start() - 1), min(len(text) - 1, m.end()))}


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [p for body in b.column("body").to_pylist() if body and not body.isascii() for p in _pairs_of(body)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["pair"])


def known_neighbours(bodies: DataFrame) -> dict[str, float]:
    """Logarithm of the share of bodies with each pair of characters that ``KNOWN`` of all have.

    At most (pairs in a body / ``KNOWN``) pairs pass, however many bodies there are.
    """
    total = bodies.count()
    found = bodies.filter("body is not null").mapInArrow(_neighbours, "pair string").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return {r["pair"]: math.log(r["n"] / total) for r in found.filter(F.col("n") >= max(2, KNOWN * total)).collect()}


def _likely(text: str, known: dict[str, float]) -> tuple[float, int]:
    """Sum of the logarithmic shares of the pairs around non-ASCII characters, and their number."""
    total, n, get = 0.0, 0, known.get
    for m in _NON_ASCII.finditer(text):
        for i in range(max(0, m.start() - 1), min(len(text) - 1, m.end())):
            total += get(text[i : i + 2], UNKNOWN)
            n += 1
    return total, n


class Restorer:
    """Undoes learned transformations; without ``known`` only those out of UTF-8, by their byte pattern."""

    def __init__(self, pairs: tuple[Pair, ...] | list[Pair] = UTF8_PAIRS, known: dict[str, float] | None = None) -> None:
        self.utf8 = list(dict.fromkeys(p[0] for p in pairs if p[1] == "utf-8"))
        self.rest: dict[str, list[str]] = {}
        for a, b in pairs:
            if b != "utf-8" and known is not None:
                self.rest.setdefault(a, []).append(b)
        self.known, self._seen = known, {}

    def options(self, s: str) -> list[tuple[Pair, str, float]]:
        """(pair, stretch decoded anew, gain) of the pairs that make a stretch likelier."""
        found = self._seen.get(s)
        if found is None:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            found = self._seen[s] = self._options(s)
        return found

    def _options(self, s: str) -> list[tuple[Pair, str, float]]:
        out, (before, n) = [], _likely(s, self.known)
        for codec in self.utf8:
            if (r := undo_utf8(s, codec)) != s and (gain := _likely(r, self.known)[0] - before) > 0:
                out.append(((codec, "utf-8"), r, gain))
        for codec, wrote in self.rest.items():
            if (raw := _encode(s, codec)) is None:
                continue
            for w in wrote:
                r = _decode(raw, w)
                if r is None or r == s or not r.replace("\xa0", " ").isprintable():
                    continue
                after, k = _likely(r, self.known)
                # per pair of characters, as some codecs make one character of two
                gain = after / max(1, k) - before / max(1, n)
                if gain >= GAIN and gain * max(k, 1) >= ODDS:
                    out.append(((codec, w), r, gain * max(k, 1)))
        return out

    def restore(self, text: str) -> tuple[str, bool]:
        """``text`` with every garbled place restored, and whether anything was."""
        if not text or text.isascii():
            return text, False
        if self.known is None:
            new = text
            for codec in self.utf8:
                new = undo_utf8(new, codec)
            return new, new != text
        parts = [(m.start(), m.end(), m[0]) for m in _STRETCH.finditer(text) if not m[0].isascii()]
        changed = False
        for _ in range(4):  # text garbled in two ways takes two turns
            total: dict[Pair, float] = {}
            found = [self.options(s) for _, _, s in parts]
            for options in found:
                for pair, _, gain in options:
                    total[pair] = total.get(pair, 0.0) + gain
            if not total:
                break
            best = max(total, key=total.get)
            parts = [(a, b, next((r for pair, r, _ in options if pair == best), s)) for (a, b, s), options in zip(parts, found)]
            changed = True
        if not changed:
            return text, False
        out, at = [], 0
        for a, b, s in parts:
            out += [text[at:a], s]
            at = b
        new = "".join(out) + text[at:]
        return new, new != text


_by_pattern = Restorer()


def restore_text(text: str, pairs: tuple[Pair, ...] | list[Pair] = UTF8_PAIRS, known: dict[str, float] | None = None) -> tuple[str, bool]:
    """``text`` with every garbled place restored, and whether anything was; see ``Restorer``."""
    return (_by_pattern if known is None and pairs is UTF8_PAIRS else Restorer(pairs, known)).restore(text)


_TOKEN = re.compile(r"[^\s<>\"]+")
_LOST = re.compile(r"(?<!\d)[^\W\d_]\?+[^\W\d_]|\?\?\?|^[(«„]?\?[^\W\d_]")
_LONE = re.compile(r"(?<![^\s>])([^\W\d_]*\?)(?= +[a-zß-ÿ])|>\s*(\?)(?= \w)|^(\?)(?= \w)")
_ATTRIBUTES = re.compile(r"<[^>]*>")


def mask(word: str) -> str:
    """A word as it looks where every non-ASCII character was lost."""
    return _NON_ASCII.sub(lambda m: "?" * len(m[0]), word)


def masks(words: DataFrame, bodies: int) -> frozenset[str]:
    """The masks of the words that ``KNOWN`` of all bodies have; at most (words of a body / ``KNOWN``)."""
    rows = words.filter(F.col("n") >= max(2, KNOWN * bodies)).select("word").collect()
    return frozenset(mask(r["word"]) for r in rows)


def lost_characters(text: str, masks: frozenset[str] = frozenset()) -> bool:
    """Whether characters were lost: replacement characters, or question marks where letters stood.

    A question mark after a word and before a small letter counts where ``masks`` has the word.
    """
    if "�" in text:
        return True
    if "?" not in text:
        return False
    plain = _ATTRIBUTES.sub("<>", text)
    if any((m[1] or m[2] or m[3]) in masks for m in _LONE.finditer(plain)):
        return True
    return any("?" in t and not re.search(r"[/=&@\\]|\.\w+\?", t) and _LOST.search(t) for t in _TOKEN.findall(plain))


def _found(pairs: list[Pair], known: dict[str, float], lost_words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(pairs, known)
        for b in batches:
            rows = []
            for i, body in zip(b.column("response_id").to_pylist(), b.column("body").to_pylist()):
                if not body:
                    continue
                if lost_characters(body, lost_words):
                    rows.append((i, ""))
                    continue
                text, changed = restorer.restore(body)
                if changed:
                    rows.append((i, hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()))
            yield _record([("response_id", pa.int64()), ("restored_md5", pa.string())], rows)

    return run


def garbled_bodies(responses: DataFrame) -> DataFrame:
    """``(response_id, restored_md5)`` of the garbled bodies; the empty string where characters are lost.

    ``responses`` has response_id and body. Null, empty and ASCII bodies are no cases; a record
    delivered twice comes out once.
    """
    bodies = spread(responses.filter("body is not null").select("response_id", "body"))
    words = _corpus_words(bodies)
    known, lost_words = known_neighbours(bodies), masks(words, bodies.count())
    pairs = [p for p, _ in learn_pairs(bodies, words)]
    return bodies.mapInArrow(_found(pairs, known, lost_words), "response_id bigint, restored_md5 string").groupBy("response_id").agg(F.min("restored_md5").alias("restored_md5"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return garbled_bodies(table(spark, sf_dir, "responses"))


def p6_pairs(spark, sf_dir: str) -> DataFrame:
    """The learned transformations, in the order of their evidence, with the twins that each alone explains."""
    pairs = learn_pairs(spread(table(spark, sf_dir, "responses").select("response_id", "body")))
    return spark.createDataFrame([(i + 1, *p, n) for i, (p, n) in enumerate(pairs)], "rank int, decoded_as string, written_in string, twins bigint")
