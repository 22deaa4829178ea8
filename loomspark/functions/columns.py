"""The parsers of ``values`` and further scalar functions as columns, over Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import values as V


def mapped(f, kind: str, nulls: bool = False):
    """A column function that runs ``f`` over batches; nulls stay null unless ``nulls``."""

    if kind.startswith("struct<"):
        names = re.findall(r"(\w+):", kind)

        def run(s: pd.Series) -> pd.DataFrame:
            rows = [(f(x) if isinstance(x, str) else None) or {} for x in s]
            return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
    else:

        def run(s: pd.Series) -> pd.Series:
            return pd.Series([f(x) if nulls or not (x is None or x is pd.NA or x != x) else None for x in s], dtype=object)

    def call(c: Column) -> Column:
        return F.pandas_udf(run, kind)(c)

    call.scalar, call.kind = f, kind
    return call


def mapped_items(f, kind: str):
    """Like ``mapped`` over the items of a list."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if xs is None else [None if x is None else f(x) for x in xs] for xs in s], dtype=object)

    return lambda c: F.pandas_udf(run, f"array<{kind}>")(c)


title = mapped(str.title, "string")
clean = mapped(V.clean_text, "string")
clean_lines = mapped(lambda x: V.clean_text(x, True), "string")
fix_encoding = mapped(V.fix_garbled, "string")
garbled_share = mapped(V.garbled_share, "double")
is_placeholder = mapped(V.is_placeholder, "boolean")
number = mapped(V.parse_number, "double")
integer = mapped(V.parse_integer, "bigint")
percent = mapped(V.parse_percent, "double")
boolean = mapped(V.parse_boolean, "boolean")
currency = mapped(V.detect_currency, "string")
duration = mapped(V.parse_duration, "double")
email = mapped(V.normalize_email, "string")
country = mapped(V.normalize_country, "string")
region = mapped(V.normalize_region, "string")
language = mapped(V.normalize_language, "string")
availability = mapped(V.normalize_availability, "string")
coordinates = mapped(V.parse_coordinates, "array<double>")
address = mapped(V.parse_address, "struct<street:string,city:string,region:string,postal_code:string,country:string>")


def rating(c: Column, best: float = 5.0) -> Column:
    return mapped(lambda x: V.parse_rating(x, best), "double")(c)


def phone(c: Column, country_code: str | None = None) -> Column:
    return mapped(lambda x: V.normalize_phone(x, country_code), "string")(c)


def number_with(c: Column, decimal: str | None) -> Column:
    return mapped(lambda x: V.parse_number(x, decimal), "double")(c)


def money(c: Column, default: str | None = None, country_code: str | None = None) -> Column:
    def one(x):
        m = V.parse_money(x, default, country_code)
        return None if m is None else {"amount": float(m[0]), "currency": m[1]}

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [one(x) or {} if isinstance(x, str) else {} for x in s]
        return pd.DataFrame({"amount": [r.get("amount") for r in rows], "currency": [r.get("currency") for r in rows]})

    m = F.pandas_udf(run, "struct<amount:double,currency:string>")(c)
    return F.when(m["amount"].isNotNull(), m)


def money_range(c: Column, default: str | None = None, country_code: str | None = None) -> Column:
    """struct<low, high, currency> of a range of prices; fields are null for anything else."""

    def one(x):
        r = V.parse_money_range(x, default, country_code)
        return r and {"low": float(r[0][0]), "high": float(r[1][0]), "currency": r[0][1]}

    return mapped(one, "struct<low:double,high:double,currency:string>")(c)


def dimensions(c: Column) -> Column:
    """The quantities of ``10 x 20 cm`` as texts with their unit."""
    return mapped(lambda x: [f"{n.normalize():f} {u}" for n, u in V.parse_dimensions(x)], "array<string>")(c)


def quantity(c: Column, to: str | None = None) -> Column:
    """struct<value, unit>; converted to ``to``, null for another dimension."""

    def one(x):
        q = V.parse_quantity(x) if isinstance(x, str) else None
        if q is None:
            return (None, None)
        if to:
            v = V.convert(q[0], q[1], to)
            return (None, None) if v is None else (round(float(v), 9), to)
        return float(q[0]), q[1]

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=["value", "unit"])

    q = F.pandas_udf(run, "struct<value:double,unit:string>")(c)
    return F.when(q["value"].isNotNull(), q)


def date_text(c: Column, now: datetime, dayfirst: bool = False) -> Column:
    return mapped(lambda x: V.parse_date(x, now, dayfirst), "string")(c)


def datetime_text(c: Column, now: datetime, dayfirst: bool = False) -> Column:
    return mapped(lambda x: V.parse_datetime(x, now, dayfirst), "string")(c)


def distance_km(a: Column, b: Column) -> Column:
    """Great-circle distance of two [latitude, longitude] columns, JVM-side, to a tenth."""
    la, lb = F.radians(a[0]), F.radians(b[0])
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((F.radians(b[1]) - F.radians(a[1])) / 2), 2)
    return F.round(2 * 6371.0088 * F.asin(F.sqrt(h)), 1)


def in_box(p: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whether a point lies in a box; with west > east the box crosses the date line."""
    lon = F.when(west <= east, (p[1] >= west) & (p[1] <= east)).otherwise((p[1] >= west) | (p[1] <= east))
    return F.coalesce((p[0] >= south) & (p[0] <= north) & lon, F.lit(False))


def round_exact(c: Column, digits: int = 0) -> Column:
    """Half to even on the binary value, as Python rounds."""
    return mapped(lambda x: float(round(x, digits)), "double")(c.cast("double"))


def normalize_for_hash(text: str) -> str:
    """NFKC, case-folded, punctuation as spaces, white space squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text).casefold())).strip()


def content_digest(text: str | None) -> str:
    return hashlib.blake2b(normalize_for_hash(text or "").encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


content_hash = mapped(content_digest, "string", nulls=True)
fold = mapped(normalize_for_hash, "string")


def hash_key(c: Column) -> Column:
    """``normalize_for_hash`` JVM-side, without NFKC: for grouping where texts are NFC."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
