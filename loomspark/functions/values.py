"""Parsers of written values: numbers, money, dates, durations, quantities, texts, contacts, places.

Pure functions of one text each; ``columns.py`` runs them over Arrow batches. A value that can't be
read is null. Every parser takes what it can't know (the day's date, a country) as an argument.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation
from email.utils import parsedate_to_datetime

# ---------------------------------------------------------------- texts
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​-‏‪-‮⁠﻿­]")
#: Texts that stand for a missing value, as they are, and marks of which nothing else may be there.
PLACEHOLDERS = frozenset(["n/a", "na", "null", "none", "nil", "undefined", "nan", "tbd", "tba", "todo", "0000-00-00", "[object object]"])
_ONLY_MARKS = ("-", "?")
#: What encloses a variable of a template.
_ENCLOSED = (("{{", "}}"), ("${", "}"), ("<%", "%>"))


def clean_text(text: str | None, lines: bool = False) -> str | None:
    """References resolved, NFC, control and invisible characters dropped, white space squeezed; '' is null."""
    if text is None:
        return None
    s = unicodedata.normalize("NFC", html.unescape(text) if "&" in text else text)
    if lines:
        rows = [re.sub(r"\s+", " ", r).strip() for r in re.split(r"\r\n?|\n", s)]
        s = re.sub(r"\n{3,}", "\n\n", "\n".join(_CONTROL.sub("", r) for r in rows)).strip()
    else:
        s = re.sub(r"\s+", " ", _CONTROL.sub("", s)).strip()
    return s or None


def is_placeholder(text: str | None) -> bool:
    """Whether a text stands for a missing value: a word for none, dashes, filler, a template's variable."""
    s = (text or "").strip().casefold()
    if not s:
        return False
    if s in PLACEHOLDERS or s.startswith("lorem ipsum") or any(not s.strip(m) for m in _ONLY_MARKS):
        return True
    return any(len(s) >= len(a) + len(b) and s.startswith(a) and s.endswith(b) for a, b in _ENCLOSED) or bool(re.fullmatch(r"%[a-z_]+%", s))


_GARBLED = re.compile("[ÃÂâ][\x80-\xbf€‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|ï¿½|\ufffd")


def garbled_share(text: str | None) -> float:
    return len(_GARBLED.findall(text)) / len(text) if text else 0.0


def fix_garbled(text: str | None) -> str | None:
    """UTF-8 that was read as Windows-1252 or ISO 8859-1, read again as long as that lowers the garbling."""
    while text and _GARBLED.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                new = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if garbled_share(new) < garbled_share(text):
                text = new
                break
        else:
            break
    return text


#: Words for yes and no.
YES = frozenset("true yes y on 1 ja oui si sí sim tak да はい vrai verdadero wahr vero available in stock checked x ✓ ✔".split()) - {"in", "stock", "available"}
NO = frozenset("false no n off 0 nein non não nao nee nej nie нет いいえ faux falso falsch ✗ ✘".split())


def parse_boolean(text: str | None) -> bool | None:
    s = (text or "").strip().casefold()
    return True if s in YES else False if s in NO else None


#: Wordings of availability, negations first, as schema.org names.
AVAILABILITY = [
    ("Discontinued", r"discontinued|no longer (?:available|sold)|nicht mehr (?:lieferbar|verfügbar)|discontinu|descatalogad"),
    ("SoldOut", r"sold.?out|ausverkauft|agotado|esgotado|uitverkocht|slutsåld|épuisé|esaurit"),
    ("OutOfStock", r"out.?of.?stock|unavailable|not available|not in stock|no stock|nicht (?:verfügbar|lieferbar|vorrätig|auf lager)|rupture|indisponible|sin stock|no disponible|non disponibile|niedostępn|нет в наличии|在庫切れ"),
    ("BackOrder", r"back.?order|nachbestell|auf bestellung"),
    ("PreOrder", r"pre.?order|vorbestell|précommand|reserva|preordin"),
    ("PreSale", r"pre.?sale|vorverkauf"),
    ("MadeToOrder", r"made.?to.?order|auf anfrage|sur commande"),
    ("InStoreOnly", r"in.?store.?only|nur im (?:laden|geschäft)"),
    ("OnlineOnly", r"online.?only|nur online"),
    ("LimitedAvailability", r"limited|only \d+ left|last \d+|low stock|nur noch|wenige|dernier|últim|poche|laatste"),
    ("Reserved", r"reserved|reserviert"),
    ("InStock", r"in.?stock|available|auf lager|lieferbar|verfügbar|vorrätig|en stock|disponib|in voorraad|i lager|dostępn|в наличии|在庫あり"),
]


def normalize_availability(text: str | None) -> str | None:
    s = re.sub(r"^https?://schema\.org/", "", (text or "").strip())
    for name, _ in AVAILABILITY:
        if s.casefold() == name.casefold():
            return name
    for name, pattern in AVAILABILITY:
        if re.search(pattern, s, re.I):
            return name
    return None


# ---------------------------------------------------------------- numbers
#: Words and letters that multiply.
SCALES = {"k": 3, "thousand": 3, "tsd": 3, "mil": 3, "m": 6, "mn": 6, "mio": 6, "million": 6, "millions": 6, "millionen": 6, "b": 9, "bn": 9, "mrd": 9, "billion": 9, "billions": 9, "milliarden": 9, "t": 12, "tn": 12, "trillion": 12, "lakh": 5, "lakhs": 5, "lac": 5, "crore": 7, "crores": 7}
_NUMBER = re.compile(r"(?<![\w.,])(\()?\s*([-+−–]?)\s*((?:\d{1,3}(?:[  ' ’]\d{3})+|\d+)(?:[.,]\d+)*|\.\d+)(?:\s*(k|thousand|tsd|m(?:n|io|illion(?:s|en)?)?|b(?:n|illions?)?|mrd|milliarden|tn|trillion|lakhs?|lac|crores?)\b\.?)?(?:[eE]([+-]?\d{1,3})\b)?", re.I)


def _digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) if not c.isascii() and c.isdigit() and unicodedata.digit(c, None) is not None else c for c in text)


def _plain(raw: str, decimal: str | None, group_if_unclear: bool) -> tuple[str, bool]:
    """The digits with a point, and whether the separator was unclear."""
    raw = re.sub(r"[  ' ’]", "", raw)
    marks = [c for c in raw if c in ".,"]
    if not marks:
        return raw, False
    if decimal:
        other = "," if decimal == "." else "."
        return raw.replace(other, "").replace(decimal, "."), False
    if len(set(marks)) == 2:
        last = marks[-1]
        return raw.replace("," if last == "." else ".", "").replace(last, "."), False
    mark, parts = marks[0], raw.split(marks[0])
    if len(marks) > 1:
        return ("".join(parts), False) if all(len(p) in (2, 3) for p in parts[1:]) else (parts[0] + "." + "".join(parts[1:]), False)
    if len(parts[1]) == 3 and 1 <= len(parts[0]) <= 3 and parts[0] != "0":
        return ("".join(parts) if mark == "," or group_if_unclear else raw), True
    return raw.replace(",", "."), False


def iter_numbers(text: str | None, decimal: str | None = None, group_if_unclear: bool = False):
    """(value, start, end, unclear) of every number written in a text."""
    s = _digits(text or "")
    for m in _NUMBER.finditer(s):
        plain, unclear = _plain(m[3], decimal, group_if_unclear)
        try:
            v = Decimal(plain)
        except InvalidOperation:
            continue
        if m[4]:
            v = v.scaleb(SCALES[m[4].lower()])
        if m[5]:
            v = v.scaleb(int(m[5]))
        if m[2] in ("-", "−", "–") or (m[1] and s[m.end() :].lstrip().startswith(")")):
            v = -v
        yield v, m.start(), m.end(), unclear


def parse_number(text: str | None, decimal: str | None = None) -> float | None:
    v = next((v for v, *_ in iter_numbers(text, decimal)), None)
    return None if v is None else float(v)


def parse_integer(text: str | None) -> int | None:
    v = next((v for v, *_ in iter_numbers(text, None, True)), None)
    return None if v is None else int(v.to_integral_value(ROUND_HALF_EVEN))


def parse_percent(text: str | None) -> float | None:
    v = next((v for v, *_ in iter_numbers(text)), None)
    return None if v is None else float(v / 100)


#: Signs and words of currencies, and those whose minor unit isn't a hundredth.
CURRENCY_SIGNS = {"€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₺": "TRY", "₴": "UAH", "₪": "ILS", "₫": "VND", "฿": "THB", "zł": "PLN", "Kč": "CZK", "Ft": "HUF", "R$": "BRL", "US$": "USD", "C$": "CAD", "A$": "AUD", "CHF": "CHF", "Fr.": "CHF", "euro": "EUR", "euros": "EUR", "dollar": "USD", "dollars": "USD", "pound": "GBP", "pounds": "GBP", "yen": "JPY", "円": "JPY", "元": "CNY", "руб": "RUB", "kronor": "SEK", "złotych": "PLN", "$": "USD", "kr": "SEK"}
CURRENCY_CODES = frozenset("USD EUR GBP JPY CNY INR RUB KRW TRY UAH ILS VND THB PLN CZK HUF BRL CAD AUD CHF SEK NOK DKK NZD MXN ZAR SGD HKD TWD AED SAR EGP RON BGN ISK IDR MYR PHP CLP COP ARS PEN KWD BHD JOD TND OMR".split())
MINOR_UNITS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "ISK": 0, "KWD": 3, "BHD": 3, "JOD": 3, "TND": 3, "OMR": 3}
_SIGNS = "|".join(re.escape(s) for s in sorted(CURRENCY_SIGNS, key=lambda s: (-len(s), s)))
_CURRENCY = re.compile(rf"(?<![A-Za-z])(?:({_SIGNS})(?![A-Za-z])|({'|'.join(sorted(CURRENCY_CODES))})(?![A-Za-z]))", re.I)
_BY_FOLD = {k.casefold(): v for k, v in CURRENCY_SIGNS.items()}
#: What ambiguous signs mean in a country.
LOCAL_SIGNS = {"$": {"CA": "CAD", "AU": "AUD", "NZ": "NZD", "MX": "MXN", "SG": "SGD", "HK": "HKD"}, "kr": {"NO": "NOK", "DK": "DKK", "SE": "SEK", "IS": "ISK"}, "¥": {"CN": "CNY"}}


def minor_units(currency: str | None) -> int:
    return MINOR_UNITS.get(currency or "", 2)


def _currency_of(m: re.Match, country: str | None) -> str:
    if m[2]:
        return m[2].upper()
    sign = m[1].casefold()
    return LOCAL_SIGNS.get(sign, {}).get((country or "").upper(), _BY_FOLD[sign])


def detect_currency(text: str | None, country: str | None = None) -> str | None:
    m = _CURRENCY.search(text or "")
    return _currency_of(m, country) if m else None


def parse_money(text: str | None, currency: str | None = None, country: str | None = None) -> tuple[Decimal, str | None] | None:
    """(amount, currency): the first amount with a currency beside it, else the first that is no share."""
    if not text:
        return None
    s = _digits(text)
    s = re.sub(r"(\d)[.,]\s?[-–—](?=\s|$)", r"\1", s)
    marks = [(m.start(), m.end(), _currency_of(m, country)) for m in _CURRENCY.finditer(s)]
    first = None
    for v, a, b, unclear in iter_numbers(re.sub(rf"({_SIGNS})(?=\d)", lambda m: " " * len(m[0]), s)):
        if s[b:].lstrip().startswith("%"):
            continue
        near = next((c for x, y, c in marks if 0 <= a - y <= 2 and not s[y:a].strip(" - ") or 0 <= x - b <= 2 and not s[b:x].strip("  ")), None)
        code = near or (marks[0][2] if marks else currency)
        if unclear and minor_units(code) != 3 and v != v.to_integral_value():
            v = v * 1000  # three digits can't be a fraction of this currency
        if near:
            return v, near
        first = first or (v, code)
    if first is None and re.search(r"\b(?:free|gratis|kostenlos|gratuit|grátis|bezpłatn\w*|бесплатно)\b", s, re.I):
        return Decimal(0), detect_currency(s, country) or currency
    return first


_BETWEEN = re.compile(r"\s*(?:[-–—]|\b(?:to|bis|à|a)\b)\s*")


def parse_money_range(text: str | None, currency: str | None = None, country: str | None = None) -> tuple[tuple[Decimal, str | None], tuple[Decimal, str | None]] | None:
    """Both ends of ``$10 - $20`` or ``10 bis 20 EUR``, in one currency; null for anything that is no range."""
    for m in _BETWEEN.finditer(text or ""):
        if not re.match(r"[^\d\s]{0,4}\s*\d", text[m.end() :]):
            continue
        ends = [parse_money(part, currency, country) for part in (text[: m.start()], text[m.end() :])]
        if None in ends:
            return None
        code = ends[0][1] or ends[1][1]
        return (ends[0][0], code), (ends[1][0], code)
    return None


def parse_rating(text: str | None, best: float = 5.0) -> float | None:
    """A rating on 0..best, four decimals: x of y, per cent, stars, or a bare number whose scale is guessed."""
    s = (text or "").strip()
    if not s:
        return None
    if m := re.search(r"(\d+(?:[.,]\d+)?)\s*(?:/|out of|von|sur|de|su|of)\s*(\d+)", s, re.I):
        top = float(m[2])
        return round(float(m[1].replace(",", ".")) / top * best, 4) if top and float(m[1].replace(",", ".")) <= top else None
    if m := re.search(r"(\d+(?:[.,]\d+)?)\s*%", s):
        return round(min(float(m[1].replace(",", ".")), 100.0) / 100 * best, 4)
    if "★" in s or "⭐" in s:
        return round(min(s.count("★") + s.count("⭐"), 5) / 5 * best, 4)
    words = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
    if m := re.fullmatch(r"(one|two|three|four|five)(?: stars?)?", s, re.I):
        return round(words[m[1].lower()] / 5 * best, 4)
    v = parse_number(s)
    if v is None or v < 0:
        return None
    scale = 5 if v <= 5 else 10 if v <= 10 else 100 if v <= 100 else None
    return round(v / scale * best, 4) if scale else None


# ---------------------------------------------------------------- dates
#: Months in seven languages.
_MONTH_WORDS = """january jan januar janvier janv enero ene gennaio gen janeiro januari
february feb februar février fevrier févr febrero febbraio fevereiro fev februari
march mar märz maerz mrz mars marzo março maart mrt
april apr avril avr abril abr aprile
may mai mayo maggio mag maio mei
june jun juni juin junio giugno giu junho
july jul juli juillet juil julio luglio lug julho
august aug août aout agosto ago augustus augusti
september sep sept septembre septiembre settembre set setembro
october oct oktober okt octobre octubre ottobre ott outubro out
november nov novembre noviembre novembro
december dec dezember dez décembre decembre déc diciembre dic dicembre dezembro""".split("\n")
MONTHS = {w: i + 1 for i, row in enumerate(_MONTH_WORDS) for w in row.split()}
_M = "|".join(sorted(MONTHS, key=lambda w: (-len(w), w)))
_ISO = re.compile(r"\b(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\b", re.I)
_NUMERIC = re.compile(r"(?<!\d)(\d{1,4})([./-])(\d{1,2})\2(\d{2,4})(?!\d)")
_CJK_DATE = re.compile(r"(\d{4})\s*[年년]\s*(\d{1,2})\s*[月월]\s*(?:(\d{1,2})\s*[日일])?")
_DAY_MONTH = re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?\s*(?:of |de |di |d')?({_M})\b\.?,?\s*(?:de |del )?(\d{{4}}|'?\d{{2}}(?!\d|:))?", re.I)
_MONTH_DAY = re.compile(rf"\b({_M})\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b,?\s*(\d{{4}})?", re.I)
_MONTH_YEAR = re.compile(rf"\b({_M})\b\.?,?\s+(?:de |del )?(\d{{4}})\b", re.I)
_TIME = re.compile(r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?", re.I)
_AGO = re.compile(r"(?:(\d+|an?|one)\s+(second|minute|hour|day|week|month|year)s?\s+ago)|vor\s+(\d+|einem|einer)\s+(sekunde|minute|stunde|tag|woche|monat|jahr)\w*|hace\s+(\d+|una?)\s+(segundo|minuto|hora|día|semana|mes|año)\w*|il y a\s+(\d+|une?)\s+(seconde|minute|heure|jour|semaine|mois|an)\w*", re.I)
_AGO_DAYS = {"sec": 1 / 86400, "sek": 1 / 86400, "seg": 1 / 86400, "min": 1 / 1440, "hou": 1 / 24, "stu": 1 / 24, "hor": 1 / 24, "heu": 1 / 24, "day": 1, "tag": 1, "día": 1, "jou": 1, "wee": 7, "woc": 7, "sem": 7, "mon": 30, "mes": 30, "moi": 30, "yea": 365, "jah": 365, "año": 365, "an": 365}


def _year(text: str) -> int:
    n = int(text.lstrip("'"))
    return n if len(text.lstrip("'")) == 4 else 1900 + n if n >= 70 else 2000 + n


def _date(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _find_date(s: str, dayfirst: bool, now: datetime) -> tuple[date | None, str]:
    """The date in a text and what is left to hold a time."""
    if m := _CJK_DATE.search(s):
        return _date(int(m[1]), int(m[2]), int(m[3] or 1)), s[m.end() :]
    if m := _NUMERIC.search(s):
        a, sep, b, c = m[1], m[2], int(m[3]), m[4]
        if len(a) == 4:
            return _date(int(a), b, int(c)) if len(c) <= 2 else None, s[m.end() :]
        if len(c) in (2, 4) and len(a) <= 2:
            x, y = int(a), _year(c)
            first = dayfirst or sep == "."
            day, month = (x, b) if (first and b <= 12) or x > 12 else (b, x)
            return _date(y, month, day), s[m.end() :]
    if m := _DAY_MONTH.search(s):
        return _date(_year(m[3]) if m[3] else now.year, MONTHS[m[2].lower()], int(m[1])), s[m.end() :]
    if (m := _MONTH_DAY.search(s)) and not (m[3] is None and _MONTH_YEAR.search(s)):
        return _date(int(m[3]) if m[3] else now.year, MONTHS[m[1].lower()], int(m[2])), s[m.end() :]
    if m := _MONTH_YEAR.search(s):
        return _date(int(m[2]), MONTHS[m[1].lower()], 1), s[m.end() :]
    low = s.casefold()
    for days, words in ((0, "today heute hoy aujourd'hui oggi hoje vandaag"), (-1, "yesterday gestern ayer hier ieri ontem gisteren"), (1, "tomorrow morgen mañana demain domani amanhã")):
        if any(re.search(rf"\b{w}\b", low) for w in words.split()):
            return (now + timedelta(days=days)).date(), s
    return None, s


def parse_datetime(text: str | None, now: datetime, dayfirst: bool = False) -> str | None:
    """An ISO date-time; the offset stays as written. ``now`` dates what is relative or lacks a year."""
    s = (text or "").strip()
    if not s:
        return None
    if m := _ISO.search(s):
        y, mo, d, h, mi, se, fr, tz = m.groups()
        try:
            t = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(se or 0), int((fr or "0")[:6].ljust(6, "0")))
        except ValueError:
            return None
        zone = "" if not tz else "+00:00" if tz.upper() == "Z" else tz if ":" in tz else tz[:3] + ":" + tz[3:]
        return t.isoformat() + zone
    if re.fullmatch(r"\d{10}|\d{13}", s):
        return datetime.fromtimestamp(int(s[:10]), timezone.utc).isoformat()
    if re.match(r"[A-Za-z]{3},? \d{1,2} [A-Za-z]{3} \d{4} \d", s):
        try:
            return parsedate_to_datetime(s).isoformat()
        except (TypeError, ValueError):
            pass
    if m := _AGO.search(s):
        n, unit = next((m[i], m[i + 1]) for i in (1, 3, 5, 7) if m[i])
        days = (int(n) if n.isdigit() else 1) * next(v for k, v in _AGO_DAYS.items() if unit.lower().startswith(k))
        return (now - timedelta(days=days)).replace(microsecond=0).isoformat()
    found, rest = _find_date(s, dayfirst, now)
    if found is None:
        return None
    h = mi = se = 0
    if m := _TIME.search(rest):
        h, mi, se = int(m[1]), int(m[2]), int(m[3] or 0)
        if m[4]:
            h = h % 12 + 12 * (m[4][0].lower() == "p")
    return datetime(found.year, found.month, found.day, h, mi, se).isoformat() if h < 24 and mi < 60 and se < 60 else None


def parse_date(text: str | None, now: datetime, dayfirst: bool = False) -> str | None:
    t = parse_datetime(text, now, dayfirst)
    return t[:10] if t else None


_ISO_DURATION = re.compile(r"P(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.I)


def parse_duration(text: str | None) -> float | None:
    """Seconds of ISO 8601 durations, ``1h 30m``, ``h:mm:ss`` and ``m:ss``."""
    s = (text or "").strip()
    if (m := _ISO_DURATION.fullmatch(s)) and any(m.groups()):
        return float(sum(float(v or 0) * k for v, k in zip(m.groups(), (604800, 86400, 3600, 60, 1))))
    if m := re.fullmatch(r"(?:(\d+):)?(\d{1,3}):(\d{2})", s):
        return float(int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]))
    parts = re.findall(r"(\d+(?:[.,]\d+)?)\s*(weeks?|wochen?|w|days?|tage?|d|hours?|hrs?|stunden?|std|h|minutes?|mins?|minuten|m|seconds?|secs?|sekunden?|s)\b", s, re.I)
    if not parts:
        return None
    size = {"w": 604800, "d": 86400, "t": 86400, "h": 3600, "m": 60, "s": 1}
    return float(sum(float(n.replace(",", ".")) * (3600 if u.lower().startswith("st") else size[u[0].lower()]) for n, u in parts))


# ---------------------------------------------------------------- quantities
#: Units with dimension and factor to its base (temperatures have an offset as well).
UNITS = {
    **{u: ("length", Decimal(f)) for u, f in {"mm": "0.001", "cm": "0.01", "dm": "0.1", "m": "1", "km": "1000", "in": "0.0254", "ft": "0.3048", "yd": "0.9144", "mi": "1609.344"}.items()},
    **{u: ("mass", Decimal(f)) for u, f in {"mg": "0.000001", "g": "0.001", "kg": "1", "t": "1000", "oz": "0.028349523125", "lb": "0.45359237"}.items()},
    **{u: ("volume", Decimal(f)) for u, f in {"ml": "0.001", "cl": "0.01", "dl": "0.1", "l": "1", "gal": "3.785411784", "fl oz": "0.0295735295625", "pt": "0.473176473", "qt": "0.946352946"}.items()},
    **{u: ("area", Decimal(f)) for u, f in {"m2": "1", "km2": "1000000", "ha": "10000", "sqft": "0.09290304", "acre": "4046.8564224"}.items()},
    **{u: ("power", Decimal(f)) for u, f in {"w": "1", "kw": "1000", "mw": "1000000", "hp": "745.69987158227022"}.items()},
    **{u: ("energy", Decimal(f)) for u, f in {"j": "1", "kj": "1000", "kcal": "4184", "wh": "3600", "kwh": "3600000"}.items()},
    **{u: ("data", Decimal(f)) for u, f in {"b": "1", "kb": "1000", "mb": "1000000", "gb": "1000000000", "tb": "1000000000000", "kib": "1024", "mib": "1048576", "gib": "1073741824"}.items()},
    **{u: ("time", Decimal(f)) for u, f in {"ms": "0.001", "s": "1", "min": "60", "h": "3600", "d": "86400"}.items()},
    **{u: ("speed", Decimal(f)) for u, f in {"m/s": "1", "km/h": str(Decimal(1000) / Decimal(3600)), "mph": "0.44704"}.items()},
    **{u: ("frequency", Decimal(f)) for u, f in {"hz": "1", "khz": "1000", "mhz": "1000000", "ghz": "1000000000"}.items()},
    **{u: ("pressure", Decimal(f)) for u, f in {"pa": "1", "kpa": "1000", "bar": "100000", "psi": "6894.757293168"}.items()},
    **{u: ("voltage", Decimal(f)) for u, f in {"mv": "0.001", "v": "1", "kv": "1000"}.items()},
    **{u: ("charge", Decimal(f)) for u, f in {"mah": "0.001", "ah": "1"}.items()},
    **{u: ("temperature", Decimal(1)) for u in ("c", "f", "k")},
}
_SPELLED = {"millimetre": "mm", "millimeter": "mm", "centimetre": "cm", "centimeter": "cm", "metre": "m", "meter": "m", "kilometre": "km", "kilometer": "km", "inch": "in", "inches": "in", '"': "in", "″": "in", "'": "ft", "′": "ft", "foot": "ft", "feet": "ft", "yard": "yd", "mile": "mi", "gram": "g", "gramm": "g", "gramme": "g", "kilogram": "kg", "kilo": "kg", "tonne": "t", "ounce": "oz", "pound": "lb", "lbs": "lb", "litre": "l", "liter": "l", "millilitre": "ml", "milliliter": "ml", "gallon": "gal", "watt": "w", "kilowatt": "kw", "byte": "b", "second": "s", "sec": "s", "minute": "min", "hour": "h", "hr": "h", "day": "d", "°c": "c", "°f": "f", "celsius": "c", "fahrenheit": "f", "kelvin": "k", "m²": "m2", "km²": "km2", "sq ft": "sqft", "kmh": "km/h", "kph": "km/h", "hertz": "hz", "volt": "v"}


def unit_name(text: str | None) -> str | None:
    s = re.sub(r"\s+", " ", (text or "").strip().lower().rstrip("."))
    s = _SPELLED.get(s) or _SPELLED.get(s.removesuffix("s")) or s
    return s if s in UNITS else None


def convert(value: Decimal, unit: str, to: str) -> Decimal | None:
    """Exactly converted; null between dimensions."""
    if unit == to:
        return value
    if UNITS[unit][0] != UNITS[to][0]:
        return None
    if UNITS[unit][0] == "temperature":
        kelvin = value + Decimal("273.15") if unit == "c" else (value - 32) * 5 / 9 + Decimal("273.15") if unit == "f" else value
        return kelvin - Decimal("273.15") if to == "c" else (kelvin - Decimal("273.15")) * 9 / 5 + 32 if to == "f" else kelvin
    return value * UNITS[unit][1] / UNITS[to][1]


_QUANTITY_UNIT = re.compile(r"\s*(°?[A-Za-zµ²]+(?:/[a-z]+)?\d?|[\"″'′]|fl oz|sq ft)", re.I)


def parse_quantity(text: str | None) -> tuple[Decimal, str] | None:
    """The first number with a unit after it; feet and inches add up."""
    s = _digits(text or "")
    if m := re.search(r"(\d+(?:\.\d+)?)\s*(?:'|′|ft|feet)\s*(\d+(?:\.\d+)?)\s*(?:\"|″|in|inches)", s, re.I):
        return Decimal(m[1]) * 12 + Decimal(m[2]), "in"
    for m in re.finditer(r"[-−]?\d+(?:[.,]\d+)*", s):
        u = _QUANTITY_UNIT.match(s, m.end())
        name = unit_name(u[1]) if u else None
        if name and u[1].isalpha() and len(u[1]) <= 2 and re.match(r"\s+[a-z]{3,}", s[u.end() :]):
            continue  # "5 in stock"
        if name:
            return next(iter_numbers(m[0]))[0], name
    return None


def parse_dimensions(text: str | None) -> list[tuple[Decimal, str]]:
    """The quantities of ``10 x 20 x 30 cm``; a number without a unit takes the last one written. Nothing where one can't be read."""
    parts = [p for p in re.split(r"\s*[x×*]\s*", (text or "").strip())]
    found = [parse_quantity(p) for p in parts]
    units = [q[1] for q in found if q]
    if not units:
        return []
    full = [q or ((n, units[-1]) if (n := parse_number(p)) is not None else None) for p, q in zip(parts, found)]
    return [] if None in full else [(Decimal(str(n)), u) for n, u in full]


# ---------------------------------------------------------------- contacts and places
_EMAIL = re.compile(r"([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63})")


def normalize_email(text: str | None) -> str | None:
    s = re.sub(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+(?=\S+\s*(?:\.|dot|[\[(]dot))", "@", (text or "").strip(), flags=re.I)
    s = re.sub(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+", ".", s, flags=re.I)
    m = _EMAIL.search(re.sub(r"^mailto:", "", s, flags=re.I))
    if not m or ".." in m[1] or m[1][0] == "." or m[1][-1] == "." or len(m[0]) > 254:
        return None
    return f"{m[1]}@{m[2].lower()}"


#: Calling code, trunk prefix and lengths of national numbers.
PHONES = {"US": ("1", "1", 10, 10), "CA": ("1", "1", 10, 10), "GB": ("44", "0", 9, 10), "DE": ("49", "0", 6, 13), "FR": ("33", "0", 9, 9), "ES": ("34", "", 9, 9), "IT": ("39", "", 6, 11), "NL": ("31", "0", 9, 9), "BE": ("32", "0", 8, 9), "AT": ("43", "0", 6, 13), "CH": ("41", "0", 9, 9), "PL": ("48", "", 9, 9), "SE": ("46", "0", 7, 9), "NO": ("47", "", 8, 8), "DK": ("45", "", 8, 8), "PT": ("351", "", 9, 9), "BR": ("55", "0", 10, 11), "RU": ("7", "8", 10, 10), "JP": ("81", "0", 9, 10), "IN": ("91", "0", 10, 10), "AU": ("61", "0", 9, 9), "MX": ("52", "", 10, 10), "CN": ("86", "0", 10, 11)}
_KEYPAD = {c: str(d) for d, cs in zip((2, 3, 4, 5, 6, 7, 8, 9), ("ABC", "DEF", "GHI", "JKL", "MNO", "PQRS", "TUV", "WXYZ")) for c in cs}


def normalize_phone(text: str | None, country: str | None = None) -> str | None:
    """E.164; letters as on a keypad; a number without a country code needs ``country``."""
    s = re.sub(r"(?:ext|extension|x|durchwahl)\.?\s*\d+\s*$", "", re.sub(r"^tel:", "", (text or "").strip(), flags=re.I), flags=re.I)
    if len(re.findall(r"\d", s)) >= 3:
        s = "".join(_KEYPAD.get(c, c) for c in s.upper())
    s = s.replace("(0)", "")
    plus = bool(re.match(r"\s*(?:\+|00)", s))
    digits = re.sub(r"\D", "", _digits(s))
    if plus:
        digits = digits[2:] if not s.strip().startswith("+") else digits
        rule = next((r for r in sorted(PHONES.values(), key=lambda r: -len(r[0])) if digits.startswith(r[0])), None)
        if rule is None:
            return f"+{digits}" if 8 <= len(digits) <= 15 else None
        national = digits[len(rule[0]) :]
    else:
        rule = PHONES.get((country or "").upper())
        if rule is None:
            return None
        national = digits
        if rule[0] == "1" and len(national) == 11:
            national = national.removeprefix("1")
        elif rule[1] and national.startswith(rule[1]):
            national = national[len(rule[1]) :]
    if not rule[2] <= len(national) <= rule[3] or (rule[0] == "1" and not re.match(r"[2-9]\d\d[2-9]", national)):
        return None
    return f"+{rule[0]}{national}"


#: Countries by ISO 3166-1 code with the names they are written by.
COUNTRIES = {
    "US": "united states|usa|u.s.|u.s.a.|united states of america|vereinigte staaten|états-unis|estados unidos|america", "GB": "united kingdom|uk|great britain|england|scotland|wales|vereinigtes königreich|royaume-uni|reino unido",
    "DE": "germany|deutschland|allemagne|alemania|germania|alemanha|duitsland|niemcy|tyskland|германия|ドイツ", "FR": "france|frankreich|francia|frança|frankrijk|francja|франция|フランス", "ES": "spain|spanien|espagne|españa|spagna|espanha|spanje|hiszpania|испания",
    "IT": "italy|italien|italie|italia|itália|italië|włochy|италия", "NL": "netherlands|the netherlands|holland|niederlande|pays-bas|países bajos|nederland", "BE": "belgium|belgien|belgique|bélgica|belgië", "AT": "austria|österreich|autriche", "CH": "switzerland|schweiz|suisse|svizzera|suiza",
    "PL": "poland|polen|pologne|polonia|polska", "SE": "sweden|schweden|suède|suecia|sverige", "NO": "norway|norwegen|norge", "DK": "denmark|dänemark|danmark", "FI": "finland|finnland|suomi", "PT": "portugal", "IE": "ireland|irland|irlande", "BR": "brazil|brasilien|brasil|brésil",
    "RU": "russia|russland|russie|rusia|россия|russian federation", "JP": "japan|japon|japón|日本", "CN": "china|chine|中国", "IN": "india|indien|inde", "AU": "australia|australien", "NZ": "new zealand|neuseeland", "CA": "canada|kanada", "MX": "mexico|mexiko|méxico", "AR": "argentina", "CL": "chile", "CO": "colombia", "ZA": "south africa|südafrika", "KR": "south korea|korea|republic of korea", "TR": "turkey|türkei|türkiye", "UA": "ukraine", "CZ": "czechia|czech republic|tschechien", "HU": "hungary|ungarn", "RO": "romania|rumänien", "GR": "greece|griechenland", "IL": "israel", "AE": "united arab emirates|uae", "SG": "singapore|singapur", "HK": "hong kong", "TW": "taiwan",
}
_COUNTRY_NAMES = {n: c for c, names in COUNTRIES.items() for n in names.split("|")}
#: Subdivisions of the United States and Canada.
REGIONS = {("US", code): name for code, name in (x.split(":") for x in "AL:Alabama AK:Alaska AZ:Arizona AR:Arkansas CA:California CO:Colorado CT:Connecticut DE:Delaware FL:Florida GA:Georgia HI:Hawaii ID:Idaho IL:Illinois IN:Indiana IA:Iowa KS:Kansas KY:Kentucky LA:Louisiana ME:Maine MD:Maryland MA:Massachusetts MI:Michigan MN:Minnesota MS:Mississippi MO:Missouri MT:Montana NE:Nebraska NV:Nevada NH:New_Hampshire NJ:New_Jersey NM:New_Mexico NY:New_York NC:North_Carolina ND:North_Dakota OH:Ohio OK:Oklahoma OR:Oregon PA:Pennsylvania RI:Rhode_Island SC:South_Carolina SD:South_Dakota TN:Tennessee TX:Texas UT:Utah VT:Vermont VA:Virginia WA:Washington WV:West_Virginia WI:Wisconsin WY:Wyoming DC:District_of_Columbia".split())} | {("CA", code): name for code, name in (x.split(":") for x in "ON:Ontario QC:Quebec BC:British_Columbia AB:Alberta MB:Manitoba SK:Saskatchewan NS:Nova_Scotia NB:New_Brunswick NL:Newfoundland_and_Labrador PE:Prince_Edward_Island".split())}
_REGION_NAMES = {(c, n.replace("_", " ").casefold()): k for (c, k), n in REGIONS.items()}


def normalize_country(text: str | None) -> str | None:
    s = re.sub(r"\s+", " ", (text or "").strip())
    return s.upper() if s.upper() in COUNTRIES else _COUNTRY_NAMES.get(s.casefold()) or {"UK": "GB", "USA": "US", "DEU": "DE", "FRA": "FR", "GBR": "GB", "ESP": "ES", "ITA": "IT"}.get(s.upper())


def normalize_region(text: str | None, country: str | None = None) -> str | None:
    """ISO 3166-2 where it is known, else the cleaned text."""
    s = clean_text(text)
    if not s:
        return None
    for c in [country.upper()] if country else ["US", "CA"]:
        code = s.upper() if (c, s.upper()) in REGIONS else _REGION_NAMES.get((c, s.casefold()))
        if code:
            return f"{c}-{code}"
    return s


#: Languages by ISO 639-1 code with other codes and names.
LANGUAGES = {"en": "eng english englisch anglais inglés", "de": "deu ger german deutsch allemand alemán", "fr": "fra fre french französisch français francés", "es": "spa spanish spanisch espagnol español castellano", "it": "ita italian italienisch italien italiano", "pt": "por portuguese portugiesisch portugais português", "nl": "nld dut dutch niederländisch nederlands", "pl": "pol polish polnisch polski", "sv": "swe swedish schwedisch svenska", "ru": "rus russian russisch русский", "ja": "jpn japanese japanisch 日本語", "zh": "zho chi chinese chinesisch 中文", "ko": "kor korean 한국어", "ar": "ara arabic العربية", "da": "dan danish dansk", "no": "nor norwegian norsk", "fi": "fin finnish suomi", "tr": "tur turkish türkçe", "cs": "ces cze czech čeština", "el": "ell gre greek ελληνικά", "he": "heb hebrew עברית", "uk": "ukr ukrainian українська", "hu": "hun hungarian magyar"}
_LANGUAGE_NAMES = {n: c for c, names in LANGUAGES.items() for n in names.split()}


def normalize_language(text: str | None) -> str | None:
    """BCP 47: ``en_us`` -> ``en-US``, ``German`` -> ``de``."""
    s = (text or "").strip().replace("_", "-")
    head, _, rest = s.partition("-")
    code = head.lower() if head.lower() in LANGUAGES else _LANGUAGE_NAMES.get(s.casefold()) or _LANGUAGE_NAMES.get(head.casefold())
    if not code:
        return None
    return code + ("-" + (rest.upper() if len(rest) == 2 else rest.title() if len(rest) == 4 else rest) if rest and re.fullmatch(r"[A-Za-z]{2}|[A-Za-z]{4}|\d{3}", rest) else "")


_DMS = re.compile(r"(\d{1,3})\s*[°º]\s*(?:(\d{1,2})\s*['′’]\s*)?(?:(\d{1,2}(?:\.\d+)?)\s*(?:\"|″|'')\s*)?([NSEWO])", re.I)


def _point(lat: float, lon: float) -> list[float] | None:
    return [lat, lon] if -90 <= lat <= 90 and -180 <= lon <= 180 and (lat, lon) != (0, 0) else None


def parse_coordinates(text: str | None) -> list[float] | None:
    """[latitude, longitude] of decimal pairs, degrees with minutes, and links to maps; never [0, 0]."""
    s = text or ""
    for pattern in (r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)", r"@(-?\d+\.\d+),(-?\d+\.\d+)", r"[?&#](?:q|ll|center|query|daddr|sll|cp|mlat)=(?:loc:)?(-?\d+(?:\.\d+)?)(?:,|%2C|~|&mlon=)(-?\d+(?:\.\d+)?)", r"#map=\d+/(-?\d+\.\d+)/(-?\d+\.\d+)", r"^geo:(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)", r"lat\w*\W{1,4}(-?\d+(?:\.\d+)?)\D{1,12}?(?:lon|lng)\w*\W{1,4}(-?\d+(?:\.\d+)?)"):
        if m := re.search(pattern, s, re.I):
            return _point(float(m[1]), float(m[2]))
    found = _DMS.findall(s)
    if len(found) == 2:
        v = {}
        for d, m_, sec, h in found:
            x = int(d) + int(m_ or 0) / 60 + float(sec or 0) / 3600
            v["lat" if h.upper() in "NS" else "lon"] = -x if h.upper() in "SWO" else x
        return _point(round(v["lat"], 6), round(v["lon"], 6)) if len(v) == 2 else None
    m = re.fullmatch(r"\s*[(\[]?\s*(-?\d{1,3}(?:\.\d+)?)\s*[,;\s]\s*(-?\d{1,3}(?:\.\d+)?)\s*[)\]]?\s*", s)
    return _point(float(m[1]), float(m[2])) if m else None


_POSTAL = {"US": r"\d{5}(?:-\d{4})?", "DE": r"\d{5}", "FR": r"\d{5}", "ES": r"\d{5}", "IT": r"\d{5}", "GB": r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}", "NL": r"\d{4}\s?[A-Z]{2}", "CA": r"[A-Z]\d[A-Z]\s?\d[A-Z]\d", "CH": r"\d{4}", "AT": r"\d{4}", "BE": r"\d{4}", "PL": r"\d{2}-\d{3}", "SE": r"\d{3}\s?\d{2}", "JP": r"\d{3}-\d{4}", "AU": r"\d{4}", "BR": r"\d{5}-\d{3}", "PT": r"\d{4}-\d{3}"}


def parse_address(text: str | None, country: str | None = None) -> dict | None:
    """Parts of an address read from its end: country, region, postal code, city, street."""
    s = clean_text(text)
    if not s:
        return None
    parts = [p.strip() for p in re.split(r"[,\n;]", s) if p.strip()]
    out = {"street": None, "city": None, "region": None, "postal_code": None, "country": (country or "").upper() or None}
    if len(parts) > 1 and (c := normalize_country(parts[-1])) and not (len(parts[-1]) == 2 and ("US", parts[-1].upper()) in REGIONS and country in (None, "US")):
        out["country"] = c
        parts.pop()
    for c in [out["country"]] if out["country"] in _POSTAL else ["US", "GB", "CA", "NL", "PL", "DE"]:
        for i in range(len(parts) - 1, -1, -1):
            if m := re.search(rf"(?<![\w-])({_POSTAL[c]})(?![\w-])", parts[i]):
                rest = (parts[i][: m.start()] + " " + parts[i][m.end() :]).strip()
                if i == 0 and len(parts) > 1 and rest and c in ("US", "DE", "FR"):
                    continue
                out["postal_code"] = m[1]
                parts[i : i + 1] = [rest] if rest else []
                break
        if out["postal_code"]:
            break
    if parts:
        r = normalize_region(parts[-1], out["country"] if out["country"] in ("US", "CA") else None)
        if r and re.match(r"(?:US|CA)-", r) and (len(parts) > 1) and out["country"] in (None, "US", "CA"):
            out["region"], out["country"] = r, out["country"] or r[:2]
            parts.pop()
        elif (m := re.fullmatch(r"(.+?)\s+([A-Z]{2})", parts[-1])) and ((out["country"] or "US"), m[2]) in REGIONS:
            out["country"] = out["country"] or "US"
            out["region"] = f"{out['country']}-{m[2]}"
            parts[-1] = m[1]
    if parts:
        out["city"] = parts.pop() if len(parts) > 1 or not re.search(r"\d", parts[-1]) else None
    if parts:
        out["street"] = ", ".join(parts)
    return out if any(out.values()) else None


def distance_km(a: list[float] | None, b: list[float] | None) -> float | None:
    """Great-circle distance on a sphere of 6371.0088 km, to a tenth."""
    if not a or not b:
        return None
    (la, lo), (lb, lp) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return round(2 * 6371.0088 * math.asin(math.sqrt(h)), 1)
