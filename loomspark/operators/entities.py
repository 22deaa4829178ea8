"""Entity resolution: mentions of companies, people and products become entities."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalog import written
from loomspark.functions import urls as U
from loomspark.operators.dedupe import connected_components

#: Legal forms, titles of persons, hosts of free mail.
LEGAL = frozenset("inc incorporated corp corporation co company ltd limited llc llp plc gmbh ag kg ohg se sa sas sarl srl spa bv nv ab as oy aps kk pty holding holdings group".split())
TITLES = frozenset("mr mrs ms dr prof sir herr frau".split())
FREE_MAIL = frozenset("gmail.com yahoo.com hotmail.com outlook.com gmx.de web.de mail.ru icloud.com aol.com".split())
#: Log-odds: start, equal key, equal core, shared words, initials, attributes.
PRIOR, EQUAL_KEY, EQUAL_CORE, PER_WORD, INITIALS, SAME_SITE, OTHER_SITE, SAME_PHONE, SAME_CODE, OTHER_CODE = -2.0, 4.0, 3.5, 1.2, 1.0, 3.0, -2.0, 2.5, 6.0, -6.0
MERGE, REVIEW, BLOCK = 0.8, 0.5, 300


def name_parts(name: str | None, kind: str = "company") -> dict:
    """key (all words), core (without legal forms or titles), words, initials."""
    s = unicodedata.normalize("NFKD", name or "")
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold().replace("&", " and ")
    if kind == "person" and s.count(",") == 1:
        last, first = s.split(",")
        s = f"{first} {last}"
    words = re.findall(r"[^\W_]+", re.sub(r"(?<=\b\w)\.(?=\w\b)", "", s))
    drop = LEGAL if kind == "company" else TITLES if kind == "person" else frozenset()
    core = [w for w in words if w not in drop] or words
    return {"key": " ".join(words), "core": " ".join(core), "words": core, "initials": "".join(w[0] for w in core) if len(core) > 1 else ""}


def gtin14(code: str | None) -> str | None:
    """GTIN-14 of a GTIN, UPC, EAN or ISBN with a right check digit."""
    d = re.sub(r"[^\dXx]", "", code or "")
    if len(d) == 10:
        if sum((10 - i) * (10 if c in "Xx" else int(c)) for i, c in enumerate(d)) % 11:
            return None
        d = "978" + d[:9]
        d += str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d)) % 10)
    if not d.isdigit() or len(d) not in (8, 12, 13, 14):
        return None
    d = d.zfill(14)
    return d if sum(int(c) * (1 if i % 2 else 3) for i, c in enumerate(d)) % 10 == 0 else None


def site_of(website: str | None) -> str | None:
    host = re.sub(r"^\w+://(?:[^/@]*@)?|[/:?#].*$", "", (website or "").strip().lower())
    d = U.registrable_domain(host.removeprefix("www."))
    return None if not d or d in FREE_MAIL else d


def pair_score(a: dict, b: dict) -> float:
    """Probability that two mentions (``name_parts`` with site, phone and code) are one entity."""
    s = PRIOR
    wa, wb = set(a["words"]), set(b["words"])
    if a["key"] == b["key"]:
        s += EQUAL_KEY
    elif a["core"] == b["core"]:
        s += EQUAL_CORE
    else:
        s += PER_WORD * len(wa & wb) - 0.8 * len(wa ^ wb)
        if a["initials"] and a["initials"] in (b["core"], b["initials"]) or b["initials"] and b["initials"] == a["core"]:
            s += INITIALS
    for name, plus, minus in (("site", SAME_SITE, OTHER_SITE), ("phone", SAME_PHONE, 0.0), ("code", SAME_CODE, OTHER_CODE)):
        if a.get(name) and b.get(name):
            s += plus if a[name] == b[name] else minus
    return round(1 / (1 + math.exp(-s)), 3)


def _mentions(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                p = name_parts(r["name"], kind)
                if p["key"]:
                    rows.append((r["id"], r["name"], p["key"], p["core"], p["words"], p["initials"], site_of(r["website"]), r["phone"], gtin14(r["code"])))
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "name", "key", "core", "words", "initials", "site", "phone", "code"])

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r["a"], r["b"], pair_score(r["x"], r["y"])) for r in b.to_pylist()]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "score"])


def units(mentions: DataFrame, kind: str = "company") -> DataFrame:
    """Identical mentions as one unit: (unit, key, core, words, initials, site, phone, code, n, name); ``mentions``
    has id, name, website, phone, code. Mentions without a name make no unit."""
    for c in ("website", "phone", "code"):
        if c not in mentions.columns:
            mentions = mentions.withColumn(c, F.lit(None).cast("string"))
    m = mentions.select(F.col("id").cast("bigint").alias("id"), "name", "website", "phone", "code").mapInArrow(_mentions(kind), "id bigint, name string, key string, core string, words array<string>, initials string, site string, phone string, code string")
    return written(m, "mentions")


def resolve(mentions: DataFrame, kind: str = "company", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(entities, review)``: entities has (id, entity, name); review the pairs of units between both thresholds.

    Units are compared within blocks (words, pairs of the first four words, initials, cores, sites,
    phones, codes). Words, pairs of words and initials of over ``block`` units are too common to
    suggest a match and are left out, as the semantics to match have it; equal cores, sites,
    phones and codes are compared whatever their number.
    """
    m = units(mentions, kind)
    sig = ["key", "core", "words", "initials", "site", "phone", "code"]
    u = written(m.groupBy(*sig).agg(F.min("id").alias("unit"), F.count(F.lit(1)).alias("n")), "units")
    first = F.array_sort(F.array_distinct(F.slice("words", 1, 4)))
    couples = F.flatten(F.transform(first, lambda p: F.transform(F.filter(first, lambda q: q > p), lambda q: F.concat(F.lit("w2:"), p, F.lit("|"), q))))
    keys = F.array_compact(F.concat(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), couples, F.array(F.concat(F.lit("k:"), F.col("core")), F.when(F.col("initials") != "", F.concat(F.lit("i:"), F.col("initials"))), F.when(F.col("words")[0] == F.col("core"), F.concat(F.lit("i:"), F.col("core"))), F.concat(F.lit("s:"), F.col("site")), F.concat(F.lit("p:"), F.col("phone")), F.concat(F.lit("c:"), F.col("code")))))
    blocks = u.select("unit", F.explode(F.array_distinct(keys)).alias("block"))
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter((F.col("size") > 1) & ((F.col("size") <= block) | F.col("block").rlike("^[kspc]:")))
    kept = blocks.join(sizes, "block").select("block", "unit")
    pairs = kept.alias("l").join(kept.alias("r"), (F.col("l.block") == F.col("r.block")) & (F.col("l.unit") < F.col("r.unit"))).select(F.col("l.unit").alias("a"), F.col("r.unit").alias("b")).distinct()
    s = u.select("unit", F.struct(*sig).alias("s"))
    both = pairs.join(s.withColumnsRenamed({"unit": "a", "s": "x"}), "a").join(s.withColumnsRenamed({"unit": "b", "s": "y"}), "b").select("a", "b", "x", "y")
    scored = written(both.mapInArrow(_scores, "a bigint, b bigint, score double"), "scores")
    groups = connected_components(scored.filter(F.col("score") >= MERGE).select("a", "b"), u.select(F.col("unit").alias("node")))
    of_unit = groups.select(F.col("node").alias("unit"), F.col("class").alias("entity"))
    of_sig = u.join(of_unit, "unit").select(F.struct(*sig).alias("s"), "entity")
    members = m.withColumn("s", F.struct(*sig)).join(of_sig, "s").select("id", "entity", F.col("name"))
    # the canonical name: the most frequent spelling, the longest of equally frequent ones
    spelled = members.groupBy("entity", "name").agg(F.count(F.lit(1)).alias("n"))
    best = spelled.groupBy("entity").agg(F.max(F.struct("n", F.char_length("name").alias("l"), "name")).alias("b")).select("entity", F.col("b.name").alias("name"))
    return members.select("id", "entity").join(best, "entity").select("id", "entity", "name"), scored.filter((F.col("score") >= REVIEW) & (F.col("score") < MERGE))
