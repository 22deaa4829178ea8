"""Main bodies of pages, and pages whose main body is residue.

Pages are parsed once, as a stream of events, into lines (blocks). Main bodies: what a line is made
of (only links, a path, sharing labels, navigation elements, a heading over links) and how it is
spread mark it as boilerplate: a line on ``COMMON`` of the pages of one language, or on
``SITE_COMMON`` of those of one site, is a fixed part of templates. The text-to-tag ratio of lines,
smoothed with a Gaussian and clustered in two per page, is ``ratio_bodies``; it can't tell notices from
sentences (README), so ``main_bodies`` follows the rule above.

Residue: the fixed parts align pages of one template; what lies between them are its slots. A
slot that holds variable names, filler or nothing is unfilled. Texts that fill slots of many
pages, and hardly ever stand there beside others that don't, are whole-page error templates; those
too rare to be learned are known by their wording. A page all of whose slots are such is residue.

Between the steps a line is 25 bytes: key, kind and digest; no text is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import once, spread, table, written
from loomspark.llm.encoding import restore_text
from loomspark.llm.html import Block, parse_page

#: Share of the pages of a language from which a line counts as part of templates, and least pages.
COMMON, COMMON_PAGES = 0.04, 3
#: The same for the pages of one site.
SITE_COMMON, SITE_PAGES = 0.5, 5
#: Share of all pages from which a slot's text can be an error template, and least pages.
FREQUENT, FREQUENT_PAGES = 0.0001, 5
#: Share of a text's pages on which only such texts stand, from which it is an error template.
ALONE = 0.75
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CELLS = frozenset(("td", "th", "h1", "h2"))
_CHROME = frozenset(("nav", "aside", "footer"))
_CRUMB = re.compile(r" [>›»/→] ")
_LANG = re.compile(r"""<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2})""", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_NO_KEY = re.compile(r"[^0-9A-Za-z*]+")

#: Bits of a line's kind: never a template line, a heading, unfilled, worded as a message.
CELL, HEADING, UNFILLED, MESSAGE = 1, 2, 4, 8
_PARSED = "origin string, row_id bigint, lang string, site bigint, keys array<bigint>, kinds binary, sums binary"
_SLOTS = "origin string, row_id bigint, keys array<bigint>, kinds binary, sums binary"


def marks(blocks: list[Block]) -> list[bool]:
    """Whether each block is boilerplate by what it is made of."""
    out = []
    for b in blocks:
        squeezed = len("".join(b.text.split()))
        tags = set(b.path)
        linked = b.linked >= 0.95 * len(b.text)
        out.append("link" if linked else "chrome" if tags & _CHROME else "share" if b.spans >= 2 and b.spanned >= squeezed else "path" if b.linked and _CRUMB.search(b.text) else "")
    for i, b in enumerate(blocks):
        if not out[i] and b.path and b.path[-1] in HEADINGS and b.path[-1] != "h1":
            if i + 1 < len(blocks) and out[i + 1] == "link":
                out[i] = "heading of links"
    return [bool(x) for x in out]


def line_key(text: str, names: list[str]) -> str:
    """What two spellings of one template line have in common: digits, marks and names masked, garbling undone."""
    if not text.isascii():
        text = restore_text(text)[0]
    text = _DIGITS.sub("0", text)
    for n in names:
        text = text.replace(n, "*")
    letters = _WORD.findall(text)
    ascii_ = [x for x in letters if x.isascii()]
    if not text.isascii() and sum(map(len, ascii_)) < 0.5 * sum(map(len, letters)):
        return text
    return _NO_KEY.sub("", text)


def site_names(url: str | None, title: str) -> list[str]:
    """Names of the site, longest first: the end of the title, the host and its first label."""
    host = (url or "").split("//")[-1].split("/")[0]
    names = {title.rsplit("|")[-1].strip() if "|" in title else "", host, re.split(r"[-.]", host)[0].capitalize()}
    return sorted((n for n in names if len(n) > 2), key=lambda n: (-len(n), n))


#: Variables of template languages and what is printed for missing values.
_VARIABLE = re.compile(r"""\{\{.*?\}\}|\{%.*?%\}|\$\{[^}]*\}|\$[A-Za-z_]\w*|<%.*?%>|<\?.*?\?>|%[A-Z][A-Z_0-9]+%|%\([a-z_]+\)s|%%\w+%%|__[A-Z][A-Z_0-9]*__|\[\[.*?\]\]|\#[A-Z][A-Z_0-9]+\#|\#\{[^}]*\}|@@\w+@@|\{[A-Za-z_][\w.]*\}|\[[A-Z][A-Z _]+\]|\[[A-Za-z]+ ?(?:name|text|title|here|date|price|address|email|company|description)[^\]]*\]|\[(?:your|company|insert|product|enter|add)\b[^\]]*\]|\[object Object\]|\bundefined\b|\bNaN\b|\bnull\b|\bNone\b|\bTODO\b|\bTBD\b|\bx{4,}\b""", re.I | re.S)
#: The words of the common filler text.
_LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad
    minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
    fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum arcu viverra semper vitae
    porta justo lectus sapien mauris ligula turpis egestas nibh rutrum aliquet morbi felis tristique senectus netus malesuada fames ac integer bibendum
    pellentesque habitant suspendisse potenti vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae donec quam vel pharetra fermentum massa
    tincidunt ornare praesent sagittis nunc maecenas volutpat blandit cras dapibus libero hendrerit gravida risus feugiat pretium nam odio eros auctor neque
    convallis accumsan tellus mattis diam urna cursus euismod congue sodales nec leo vulputate ultricies purus imperdiet proin lacinia vehicula elementum
    facilisis condimentum dui metus augue fringilla porttitor placerat laoreet mi lobortis scelerisque nullam eget at a tortor interdum varius phasellus dictum
    molestie iaculis erat dignissim rhoncus venenatis quisque aenean etiam""".split()
)
_DUMMY = frozenset("text sample dummy test blah foo bar baz placeholder copy content texto ejemplo prueba muestra beispiel beispieltext mustertext texte exemple testo esempio prova tekst voorbeeld przykład exempel пример текст テキスト サンプル ダミー".split())
#: Wordings of error, refusal, script and default-text messages, for messages too rare to be learned.
_NEEDS = r"\b(?:enabl|activ|aktiv|ativ|attiv|requir|richied|kräv|wymag|требу|need|benötig|besoin|necesit|włącz|включит|abilit|habilit|schakel|inschakel|turn|switch|disabled|blocked)\w*\b"
#: Each wording with literals of which a text must hold one, in small letters, before the wording is looked for.
_MESSAGES = [
    ("script", _NEEDS + r".{0,40}javascript|javascript.{0,60}" + _NEEDS),
    ("script", r"scripts? (?:are|is) (?:blocked|disabled|off)"),
    ("not found|nicht gefunden|no encontrada|introuvable|non trovata|não encontrada|niet gevonden|hittades inte|не найдена", r"(?:page|seite|página|pagina|sidan?|strony|страница)\b.{0,30}(?:not found|nicht gefunden|no encontrada|introuvable|non trovata|não encontrada|niet gevonden|hittades inte|не найдена)"),
    ("nie znaleziono|ページが見つかりません", r"nie znaleziono strony|ページが見つかりません"),
    ("error |fehler |erreur |errore |erro |fel |fout |błąd |ошибка ", r"\b(?:error|fehler|erreur|errore|erro|fel|fout|błąd|ошибка) [45]\d\d\b"),
    ("gateway|server|requests|database|fatal|page not", r"\b(?:bad gateway|gateway time-?out|internal server error|interner serverfehler|too many requests|database connection|fatal error|page not found)\b"),
    ("denied|verweigert|refusé|denegado|negato|negado|geweigerd|nekad|odmowa|brak|доступ", r"access denied|zugriff verweigert|accès refusé|acceso denegado|accesso negato|acesso negado|toegang geweigerd|åtkomst nekad|odmowa dostępu|brak dostępu|доступ (?:запрещ|закрыт)"),
    ("temporarily|vorübergehend|momentanément|temporalmente|temporaneamente|temporariamente|tijdelijk|tillfälligt|chwilowo|tymczasowo|временно", r"(?:temporarily|vorübergehend|momentanément|temporalmente|temporaneamente|temporariamente|tijdelijk|tillfälligt|chwilowo|tymczasowo|временно) (?:\w+ )?(?:un|in|no |nicht |non |niet |not |o|n)\w*"),
    ("maintenance|wartungsarbeiten|mantenimiento|manutenzione|manutenção", r"planned maintenance|wartungsarbeiten|cours de maintenance|(?:en|por) mantenimiento|in manutenzione|em manutenção"),
    ("no longer|ya no|n'est plus|non è più|não está mais|niet meer|finns inte|już nie|nicht mehr", r"(?:no longer|ya no|n'est plus|non è più|não está mais|niet meer|finns inte|już nie|nicht mehr) (?:exist\w*|available|existe|disponible|disponibile|disponível|beschikbaar|längre|istnieje|verfügbar)"),
    ("n'existe plus|nicht mehr|больше не|больше нет|no longer", r"n'existe plus|gibt es leider nicht mehr|больше (?:нет|не существует)|moved or no longer exists"),
    ("session|went wrong|unusual|blocked", r"session has expired|something went wrong|unusual traffic|request was blocked"),
    ("checking|verify|are you|captcha|just a|please wait|loading", r"checking your browser|verify(?:ing)? (?:that )?you|are you (?:a )?(?:human|robot)|captcha|^just a moment|^please wait|^loading\b"),
    ("placeholder|your text|sample copy|replace|später|compléter|va el texto|texto de", r"\bplaceholder (?:for|text)|your text goes here|sample copy|replace (?:it|this) with your|steht später ihr text|texte à compléter|va el texto|texto de ejemplo"),
]
_MESSAGE = re.compile("|".join(pattern for _, pattern in _MESSAGES), re.I)
_TRIGGERS = ahocorasick.Automaton()
for _literals, _ in _MESSAGES:
    for _word in _literals.split("|"):
        _TRIGGERS.add_word(_word, _word)
_TRIGGERS.make_automaton()
_QUOTED = re.compile(r"[“„«\"][^”“»\"]*[”“»\"]")


#: Every variable has one of these marks or, in small letters, one of these words.
_MARKED = re.compile(r"[{}$<%_\[#@]")
_NAMED = ("undefined", "nan", "null", "none", "todo", "tbd", "xxxx")


def unfilled(text: str) -> bool:
    """Whether a slot keeps variable names (with a few words at most) or filler."""
    low = text.lower()
    if _MARKED.search(text) or any(w in low for w in _NAMED):
        rest, found = _VARIABLE.subn(" ", text)
        if found and len(_WORD.findall(rest)) <= 4:
            return True
    words = _WORD.findall(low)
    if not words:
        return not re.search(r"\w", text)
    known = set(words)
    if len(words) >= 2 and not known.isdisjoint(_LOREM) and sum(w in _LOREM for w in words) >= 0.8 * len(words):
        return True
    return not known.isdisjoint(_DUMMY) and sum(w in _DUMMY for w in words) >= 0.8 * len(words) and (len(words) >= 3 or "lorem" in words)


def message(text: str) -> bool:
    """Whether a text has the wording of an error message or a notice; what stands in quotes doesn't count."""
    return next(_TRIGGERS.iter(text.lower()), None) is not None and bool(_MESSAGE.search(_QUOTED.sub(" ", text)))


@lru_cache(maxsize=1 << 14)
def _traits(text: str, fillings: bool) -> tuple[bytes, int]:
    """Digest of a line, and whether it is unfilled or worded as a message."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), 0 if not fillings else (UNFILLED if unfilled(text) else 0) | (MESSAGE if message(text) else 0)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def open_lines(html: str | None, url: str | None, fillings: bool = True) -> tuple[list[int], bytes, bytes]:
    """(keys, kinds, digests) of the lines that nothing in the markup marks as boilerplate.

    Without ``fillings`` lines aren't tested for variables, filler and messages.
    """
    blocks, title = parse_page(html)
    names = site_names(url, title)
    keys, kinds, sums = [], bytearray(), bytearray()
    for x, marked in zip(blocks, marks(blocks)):
        if marked:
            continue
        tag = x.path[-1] if x.path else ""
        digest, kind = _traits(x.text, fillings)
        keys.append(_signed(xxhash.xxh64_intdigest(line_key(x.text, names).encode("utf-8", "surrogatepass"))))
        kinds.append(kind | (CELL if tag in _CELLS else 0) | (HEADING if tag in HEADINGS else 0))
        sums += digest
    return keys, bytes(kinds), bytes(sums)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, sites, keys, kinds, sums = [], [], [], [], []
        for origin, url, html in zip(b.column("origin").to_pylist(), b.column("url").to_pylist(), b.column("html")):
            html = html.as_py()  # one page at a time is a Python object
            lang = _LANG.search(html or "")
            langs.append(lang[1].lower() if lang else "")
            host = (url or "").split("//")[-1].split("/")[0].lower()
            sites.append(_signed(xxhash.xxh64_intdigest(host)))
            k, t, d = open_lines(html, url, origin == "pages")  # only pages can be residue
            keys.append(k), kinds.append(t), sums.append(d)
        cols = [b.column("origin"), b.column("row_id"), pa.array(langs, pa.string()), pa.array(sites, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kinds, pa.binary()), pa.array(sums, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["origin", "row_id", "lang", "site", "keys", "kinds", "sums"])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The written lines of every page, one row per (origin, row_id); ``pages`` has origin, row_id, url, html."""
    lines = spread(pages.filter("html is not null").select("origin", "row_id", "url", "html")).mapInArrow(_parse, _PARSED)
    best = lines.groupBy("origin", "row_id").agg(F.min(F.struct("lang", "site", "keys", "kinds", "sums")).alias("r"))
    return written(best.select("origin", "row_id", "r.*"), "lines")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, key, kind) of all lines of a batch."""
    lists = b.column("keys")
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    kinds = np.frombuffer(b"".join(b.column("kinds").to_pylist()), np.uint8)
    return np.repeat(np.arange(b.num_rows), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), kinds


def _counted(group: np.ndarray, page: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, pages): how many pages of each group have each key."""
    at = np.lexsort((page, key, group))
    group, key, page = group[at], key[at], page[at]
    new = np.ones(len(at), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    each = new.copy()
    each[1:] |= page[1:] != page[:-1]
    first = np.flatnonzero(new)
    return group[first], key[first], np.add.reduceat(each.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        page, key, kind = _flat(b)
        names, codes = np.unique(np.array(b.column("lang").to_pylist(), dtype=object), return_inverse=True) if b.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
        use = (kind & CELL) == 0
        g, k, n = _counted(codes[page][use], page[use], key[use])
        yield pa.RecordBatch.from_arrays([pa.array(names[g].tolist(), pa.string()), pa.array(k), pa.array(n)], ["lang", "key", "n"])


def common_lines(parsed: DataFrame) -> dict[str, np.ndarray]:
    """The keys of the template lines of each language; pages that name none are a group of their own.

    A page has few lines, and a line needs ``COMMON`` of a language's pages, so there are at most
    (lines of a page / COMMON) for each of at most 26² + 1 two-letter codes, however many pages.
    """
    pages = parsed.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    df = parsed.select("lang", "keys", "kinds").mapInArrow(_by_language, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    df = df.filter(f"n >= {COMMON_PAGES}").join(F.broadcast(pages), "lang").filter(F.col("n") >= COMMON * F.col("pages"))
    out: dict[str, list] = {}
    for lang, key in df.select("lang", "key").collect():
        out.setdefault(lang, []).append(key)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _not_common(b: pa.RecordBatch, page: np.ndarray, key: np.ndarray, kind: np.ndarray, common: dict[str, np.ndarray]) -> np.ndarray:
    """Which lines of a batch are no template lines of their language."""
    keep = np.ones(len(key), bool)
    langs = np.array(b.column("lang").to_pylist(), dtype=object)
    for lang in set(langs.tolist()) & common.keys():
        keep &= ~((langs == lang)[page] & ((kind & CELL) == 0) & np.isin(key, common[lang]))
    return keep


def site_lines(parsed: DataFrame, common: dict[str, np.ndarray]) -> DataFrame:
    """``(site, fixed)``: the keys on ``SITE_COMMON`` of a site's pages, sites of ``SITE_PAGES`` pages or more.

    Counts combine within batches before their shuffle, so a site with a third of all pages is a
    row per batch and line. A site has at most (lines of a page / ``SITE_COMMON``) such keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, key, kind = _flat(b)
            use = ((kind & CELL) == 0) & _not_common(b, page, key, kind, common)
            g, k, n = _counted(b.column("site").to_numpy()[page][use], page[use], key[use])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["site", "key", "n"])

    sizes = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).filter(f"pages >= {SITE_PAGES}")
    counts = parsed.select("lang", "site", "keys", "kinds").mapInArrow(run, "site bigint, key bigint, n bigint").groupBy("site", "key").agg(F.sum("n").alias("n")).filter(f"n >= {SITE_PAGES}")
    return counts.join(sizes, "site").filter(F.col("n") >= SITE_COMMON * F.col("pages")).groupBy("site").agg(F.collect_list("key").alias("fixed"))


def template_slots(pages: DataFrame) -> DataFrame:
    """``(origin, row_id, keys, kinds, sums)``: the written lines of every page between its fixed parts."""
    parsed = parsed_pages(pages)
    common = common_lines(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, key, kind = _flat(b)
            keep = _not_common(b, page, key, kind, common)
            fixed = b.column("fixed")
            for i in np.flatnonzero(~np.asarray(fixed.is_null())):
                keep &= ~((page == i) & ((kind & CELL) == 0) & np.isin(key, fixed[i].values.to_numpy()))
            n = np.bincount(page[keep], minlength=b.num_rows)
            offsets = np.r_[0, np.cumsum(n)]
            sums = np.frombuffer(b"".join(b.column("sums").to_pylist()), np.uint8).reshape(-1, 16)[keep].tobytes()
            kinds = kind[keep].tobytes()
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("row_id"), lists, pa.array([kinds[x:y] for x, y in spans], pa.binary()), pa.array([sums[16 * x : 16 * y] for x, y in spans], pa.binary())], ["origin", "row_id", "keys", "kinds", "sums"])

    return written(parsed.join(site_lines(parsed, common), "site", "left").mapInArrow(run, _SLOTS), "slots")


def _body(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(page, key) of the filled slots of each page; headings only where nothing else stands."""
    page, key, kind = _flat(b)
    other = np.bincount(page[(kind & HEADING) == 0], minlength=b.num_rows) > 0
    use = ((kind & UNFILLED) == 0) & (((kind & HEADING) == 0) | ~other[page])
    return page[use], key[use]


def error_templates(slots: DataFrame) -> np.ndarray:
    """Keys of slot texts on ``FREQUENT`` of all pages that stand among such texts only on ``ALONE`` of theirs.

    Keys are bounded by (lines of a page / FREQUENT), however many pages there are.
    """
    pages = slots.filter("origin = 'pages'").select("keys", "kinds")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, key = _body(b)
            _, k, n = _counted(np.zeros(len(key), np.int64), page, key)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    least = max(FREQUENT_PAGES, FREQUENT * pages.count())
    rows = pages.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
    frequent = np.array([r["key"] for r in rows], np.int64)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, key = _body(b)
            known = np.isin(key, frequent)
            strange = np.bincount(page[~known], minlength=b.num_rows) > 0
            use = known & ~strange[page]
            _, k, n = _counted(np.zeros(int(use.sum()), np.int64), page[use], key[use])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    among = {r["key"]: r["n"] for r in pages.mapInArrow(alone, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    return np.array([r["key"] for r in rows if among.get(r["key"], 0) >= ALONE * r["n"]], np.int64)


def _residue(b: pa.RecordBatch, errors: np.ndarray) -> np.ndarray:
    """Whether all slots of each page are unfilled, filler or messages; headings alone are no content."""
    page, key, kind = _flat(b)
    content = ((kind & (HEADING | UNFILLED | MESSAGE)) == 0) & ~np.isin(key, errors)
    return (np.bincount(page[content], minlength=b.num_rows) == 0) & np.array([o == "pages" for o in b.column("origin").to_pylist()], bool)


def _sources(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("row_id"), "url", "html")
    kind = F.lower(F.coalesce(F.regexp_extract("headers", r'"[Cc]ontent-[Tt]ype"\s*:\s*"([^"]*)"', 1), F.lit("")))
    html = kind.contains("html") | ((kind == "") & F.col("body").rlike(r"^\s*<"))
    return pages.unionByName(table(spark, sf_dir, "responses").filter(html).select(F.lit("responses").alias("origin"), F.col("response_id").alias("row_id"), "url", F.col("body").alias("html")))


_BLOCKS = "origin string, row_id bigint, block_md5 string"


def _rows(origins: list, ids: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["origin", "row_id", "block_md5"])


def main_bodies(pages: DataFrame) -> DataFrame:
    """``(origin, row_id, block_md5)``: the distinct blocks of the main body of every page.

    ``pages`` has origin, row_id, url and html. Null or empty pages and residue have no rows.
    """
    slots = template_slots(pages)
    errors = error_templates(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            origins, ids, out = [], [], []
            for drop, origin, row, sums in zip(_residue(b, errors).tolist(), *(b.column(c).to_pylist() for c in ("origin", "row_id", "sums"))):
                if not drop:
                    found = {sums[i : i + 16].hex() for i in range(0, len(sums), 16)}
                    origins += [origin] * len(found)
                    ids += [row] * len(found)
                    out += found
            yield _rows(origins, ids, out)

    return slots.mapInArrow(run, _BLOCKS)


def residue_pages(pages: DataFrame) -> DataFrame:
    """``page_id`` of the rows with origin ``pages`` that hold residue instead of content."""
    slots = template_slots(pages)
    errors = error_templates(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row_id").filter(pa.array(_residue(b, errors)))], ["page_id"])

    return slots.mapInArrow(run, "page_id bigint")


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios smoothed with a Gaussian of ``SIGMA`` lines; the ends count as zero beyond the page."""
    reach = math.ceil(3 * SIGMA)
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA * SIGMA))
    return np.convolve(ratios, w / w.sum())[reach : reach + len(ratios)]


def two_means(values: np.ndarray) -> float:
    """The threshold between the two clusters of a page's smoothed ratios; its only value where all are equal."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        mid = (low + high) / 2
        a, b = values[values < mid], values[values >= mid]
        if not len(a) or (float(a.mean()), float(b.mean())) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def ratio_bodies(pages: DataFrame) -> DataFrame:
    """``(origin, row_id, block_md5)``: the blocks that text-to-tag ratios alone take for the main body.

    A line's ratio is its characters outside links over the tags since the line before; ratios are
    smoothed and clustered in two for each page. One pass, nothing but its result is shuffled.
    Null and empty pages have no rows; a page of equal ratios is one cluster of content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            origins, ids, out = [], [], []
            for origin, row, html in zip(*(b.column(c) for c in ("origin", "row_id", "html"))):
                blocks = parse_page(html.as_py())[0]
                if not blocks:
                    continue
                s = smoothed(np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in blocks]))
                at = two_means(s)
                found = {hashlib.md5(x.text.encode("utf-8", "surrogatepass")).hexdigest() for x, v in zip(blocks, s) if v >= at}
                origins += [origin.as_py()] * len(found)
                ids += [row.as_py()] * len(found)
                out += found
            yield _rows(origins, ids, out)

    return spread(pages.filter("html is not null").select("origin", "row_id", "html")).mapInArrow(run, _BLOCKS).distinct()


def p5_method(spark, sf_dir: str) -> DataFrame:
    return ratio_bodies(_sources(spark, sf_dir))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return main_bodies(_sources(spark, sf_dir))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return residue_pages(_sources(spark, sf_dir).filter("origin = 'pages'"))


def p7_residue_by_status(spark, sf_dir: str) -> DataFrame:
    """Per status of pages: rows with html and those that hold residue."""
    pages = once(table(spark, sf_dir, "pages").filter("html is not null").select("page_id", "status"), "page_id")
    found = p7_found(spark, sf_dir).withColumn("residue", F.lit(1))
    return pages.join(found, "page_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.count("residue").alias("residue"))
