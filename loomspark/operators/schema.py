"""Schemas: typed fields, normalization, validation, rules, inference."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.expr.compiler import Value, as_text, compile_expression, is_empty, is_list, is_number, is_text, java_regex, truthy
from loomspark.functions import columns as C
from loomspark.functions import urls as U
from loomspark.functions import values as V
from loomspark.operators.stages import data_columns, ident, value_of

ISSUE = "struct<field:string,code:string,message:string,severity:string,value:string>"
ALIASES = {"str": "string", "int": "integer", "float": "number", "decimal": "number", "bool": "boolean", "price": "money", "uri": "url", "link": "url", "timestamp": "datetime", "dict": "object", "telephone": "phone", "tel": "phone"}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


#: Type name -> function of (text column, field): its normalized column. ``register_type`` adds to it.
TYPES: dict[str, object] = {
    "string": lambda c, f: C.clean(c),
    "text": lambda c, f: C.clean_lines(c),
    "integer": lambda c, f: C.integer(c),
    "number": lambda c, f: C.number(c),
    "boolean": lambda c, f: C.boolean(c),
    "date": lambda c, f: C.date_text(c, f.now or _now(), f.dayfirst),
    "datetime": lambda c, f: C.datetime_text(c, f.now or _now(), f.dayfirst),
    "duration": lambda c, f: C.duration(c),
    "url": lambda c, f: U.normalize_url_col(c),
    "email": lambda c, f: C.email(c),
    "phone": lambda c, f: C.phone(c, f.country),
    "money": lambda c, f: C.money(c, f.currency, f.country)["amount"],
    "currency": lambda c, f: C.currency(c),
    "country": lambda c, f: C.country(c),
    "region": lambda c, f: C.region(c),
    "language": lambda c, f: C.language(c),
    "quantity": lambda c, f: C.quantity(c, f.unit)["value"],
    "rating": lambda c, f: C.rating(c, f.best),
    "availability": lambda c, f: C.availability(c),
    "address": lambda c, f: C.address(c),
    "coordinates": lambda c, f: C.coordinates(c),
    "object": lambda c, f: F.try_parse_json(c),
    "any": lambda c, f: c,
}


def register_type(name: str, build) -> None:
    TYPES[name] = build


@dataclass
class Field:
    """One field: its type, where it comes from (``aliases``), and its constraints."""

    name: str
    type: str = "string"
    required: bool = False
    many: bool = False
    aliases: list[str] = field(default_factory=list)
    default: object = None
    options: list[str] | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    unit: str | None = None
    best: float = 5.0
    currency: str | None = None
    currency_field: str | None = None
    country: str | None = None
    dayfirst: bool = False
    now: datetime | None = None

    def __post_init__(self) -> None:
        if self.type.endswith("[]"):
            self.type, self.many = self.type[:-2], True
        self.type = ALIASES.get(self.type, self.type)
        if self.type != "enum" and self.type not in TYPES:
            raise ValueError(f"{self.name}: there is no type {self.type!r}")

    def source(self, df: DataFrame) -> Value:
        """The first non-empty of the field and its aliases."""
        vs = [value_of(df, n) for n in [self.name, *self.aliases] if n in df.columns]
        if not vs:
            return Value(F.lit(None).cast("string"), T.StringType())
        if len(vs) == 1:
            return vs[0]
        same = all(type(v.type) is type(vs[0].type) for v in vs)
        vs = vs if same else [as_text(v) for v in vs]
        return Value(F.coalesce(*[F.when(~is_empty(v), v.col) for v in vs]), vs[0].type)

    def normalized(self, v: Value) -> Column:
        if is_list(v) and not self.many:
            inner = v.type.elementType
            v = Value(F.try_element_at(F.filter(v.col, lambda x: ~is_empty(Value(x, inner))), F.lit(1)), inner)
        if self.many:
            items = v.col if is_list(v) else F.array(v.col)
            texts = F.transform(items, lambda x: x.cast("string"))
            kept = F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != ""))
            return kept if self.type in ("string", "text", "any", "enum") else C.mapped_items(_PYTHON[self.type](self), _KIND[self.type])(kept) if self.type in _PYTHON else kept
        out = self._typed(v)
        if self.default is not None:
            out = F.coalesce(out, F.lit(self.default))
        return out

    def _typed(self, v: Value) -> Column:
        if self.type == "enum":
            t = F.trim(as_text(v).col)
            out = t
            for o in reversed(self.options or []):
                out = F.when(F.lower(t) == o.lower(), F.lit(o)).otherwise(out)
            return F.when(t != "", out)
        if is_number(v) and self.type in ("number", "money", "rating", "quantity", "duration"):
            return v.col.cast("double")
        if is_number(v) and self.type == "integer":
            return F.bround(v.col, 0).cast("bigint")
        if isinstance(v.type, T.BooleanType) and self.type == "boolean":
            return v.col
        if isinstance(v.type, (T.TimestampType, T.TimestampNTZType, T.DateType)) and self.type in ("date", "datetime"):
            return F.date_format(v.col, "yyyy-MM-dd" if self.type == "date" else "yyyy-MM-dd'T'HH:mm:ss")
        if is_list(v) and self.type == "coordinates":
            return v.col.cast("array<double>")
        return TYPES[self.type](as_text(v).col, self)


_PYTHON = {"integer": lambda f: V.parse_integer, "number": lambda f: V.parse_number, "boolean": lambda f: V.parse_boolean, "url": lambda f: U.normalize_url, "email": lambda f: V.normalize_email, "phone": lambda f: lambda x: V.normalize_phone(x, f.country), "country": lambda f: V.normalize_country, "language": lambda f: V.normalize_language, "date": lambda f: lambda x: V.parse_date(x, f.now or _now(), f.dayfirst)}
_KIND = {"integer": "bigint", "number": "double", "boolean": "boolean", "url": "string", "email": "string", "phone": "string", "country": "string", "language": "string", "date": "string"}


@dataclass
class Schema:
    """Named fields, a key, and what happens to other fields: ``keep``, ``drop`` or ``warn``."""

    name: str
    fields: list[Field]
    key: list[str] = field(default_factory=list)
    extra: str = "keep"
    version: int = 1

    @classmethod
    def from_config(cls, config: dict) -> Schema:
        known = {"name", "fields", "key", "extra", "version", "format"}
        if unknown := set(config) - known:
            raise ValueError(f"unknown options of a schema: {', '.join(sorted(unknown))}")
        fields = config.get("fields", {})
        rows = [Field(n, **({"type": o} if isinstance(o, str) else o)) for n, o in fields.items()] if isinstance(fields, dict) else [Field(**f) for f in fields]
        key = config.get("key", [])
        return cls(config.get("name", "schema"), rows, [key] if isinstance(key, str) else list(key), config.get("extra", "keep"), config.get("version", 1))

    def normalize(self, df: DataFrame, notes: bool = False) -> DataFrame:
        """Every field in its type; ``_unreadable`` lists fields whose value couldn't be read (with ``notes``)."""
        new, raw = {}, {}
        for f in self.fields:
            v = f.source(df)
            raw[f.name] = v
            new[f.name] = f.normalized(v)
        for f in self.fields:
            if f.type == "money" and not f.many and (to := f.currency_field or next((g.name for g in self.fields if g.type == "currency"), None)):
                v = raw[f.name]
                if is_text(v):
                    code = C.money(as_text(v).col, f.currency, f.country)["currency"]
                    new[to] = F.coalesce(new.get(to, value_of(df, to).col.cast("string")), code)
        aliases = {a for f in self.fields for a in f.aliases} - {f.name for f in self.fields}
        rest = [c for c in df.columns if c not in new and c not in aliases and (self.extra != "drop" or c.startswith("_"))]
        out = [c.alias(n) for n, c in new.items()]
        if notes:
            unread = [F.when(~is_empty(raw[f.name]) & new[f.name].isNull(), F.lit(f.name)) for f in self.fields]
            out.append(F.array_compact(F.array(*unread)).alias("_unreadable"))
        return df.select(*out, *[ident(c) for c in rest])

    def key_column(self, df: DataFrame) -> Column:
        """The key as text; null where a part is missing."""
        parts = [as_text(value_of(df, k)).col for k in self.key]
        return F.when(F.forall(F.array(*parts), lambda x: x.isNotNull() & (x != "")), F.concat_ws("\u001f", *parts)) if parts else F.lit(None).cast("string")

    def json_schema(self) -> dict:
        kinds = {"integer": "integer", "number": "number", "money": "number", "rating": "number", "quantity": "number", "duration": "number", "boolean": "boolean", "object": "object", "address": "object", "coordinates": "array"}
        props = {}
        for f in self.fields:
            p: dict = {"type": kinds.get(f.type, "string")}
            if f.many:
                p = {"type": "array", "items": p}
            if not f.required:
                p["type"] = [p["type"], "null"]
            for a, b in (("minimum", "minimum"), ("maximum", "maximum"), ("min_length", "minLength"), ("max_length", "maxLength"), ("pattern", "pattern"), ("options", "enum")):
                if getattr(f, a) is not None:
                    p[b] = getattr(f, a)
            props[f.name] = p
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": self.name, "type": "object", "properties": props, "required": [f.name for f in self.fields if f.required], "additionalProperties": self.extra != "drop"}

    def to_json(self) -> str:
        return json.dumps(self.json_schema(), indent=2)


@dataclass
class Rule:
    """A condition on whole records; skipped where a field that it reads is missing."""

    name: str
    where: str
    message: str = ""
    severity: str = "error"
    skip_missing: bool = True

    def issue(self, df: DataFrame) -> Column:
        e = compile_expression(self.where)
        bad = ~truthy(e.value(df.schema))
        if self.skip_missing:
            for n in sorted(e.names):
                bad = bad & ~is_empty(value_of(df, n))
        return F.when(bad, _issue(self.name, "rule", self.message or f"{self.where} is false", self.severity, F.lit(None)))


def _issue(name: str, code: str, message: str, severity: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(severity).alias("severity"), value.cast("string").alias("value"))


def field_issues(f: Field, v: Value) -> list[Column]:
    """The issues of one normalized field, each null where there is none."""
    shown, present = as_text(v).col, ~is_empty(v)
    out = []
    if f.required:
        out.append(F.when(~present, _issue(f.name, "missing", "a required value is missing", "error", F.lit(None))))
    if is_text(v):
        size = F.char_length(v.col)
        if f.min_length is not None:
            out.append(F.when(present & (size < f.min_length), _issue(f.name, "length", f"shorter than {f.min_length}", "error", shown)))
        if f.max_length is not None:
            out.append(F.when(present & (size > f.max_length), _issue(f.name, "length", f"longer than {f.max_length}", "error", shown)))
        if f.pattern:
            out.append(F.when(present & ~v.col.rlike(java_regex(f.pattern)), _issue(f.name, "pattern", f"doesn't match {f.pattern}", "error", shown)))
        if f.options:
            out.append(F.when(present & ~v.col.isin(*f.options), _issue(f.name, "enum", "not one of the options", "error", shown)))
        out.append(F.when(present & v.col.contains("�"), _issue(f.name, "encoding", "characters are lost", "warning", shown)))
        if f.type in ("date", "datetime"):
            year = F.substring(v.col, 1, 4).try_cast("int")
            limit = (f.now or _now()).year + 5
            out.append(F.when(present & ((year < 1800) | (year > limit)), _issue(f.name, "suspicious", "an unlikely date", "warning", shown)))
    if is_number(v):
        if f.minimum is not None:
            out.append(F.when(v.col < f.minimum, _issue(f.name, "range", f"less than {f.minimum:g}", "error", shown)))
        if f.maximum is not None:
            out.append(F.when(v.col > f.maximum, _issue(f.name, "range", f"more than {f.maximum:g}", "error", shown)))
        if f.type == "money" and f.minimum is None:
            out.append(F.when(v.col <= 0, _issue(f.name, "suspicious", "an amount that isn't positive", "warning", shown)))
    return out


def issue_column(df: DataFrame, schema: Schema | None = None, rules: list[Rule] | None = None) -> Column:
    """All issues of a record, in the order of fields and rules."""
    out: list[Column] = []
    for f in schema.fields if schema else []:
        out += field_issues(f, value_of(df, f.name))
        if "_unreadable" in df.columns:
            out.append(F.when(F.array_contains("_unreadable", f.name), _issue(f.name, "invalid", f"can't be read as {f.type}", "error" if f.required else "warning", F.lit(None))))
    if schema and schema.extra == "warn":
        known = {f.name for f in schema.fields}
        out += [F.when(~is_empty(value_of(df, c)), _issue(c, "unknown-field", "not in the schema", "warning", F.lit(None))) for c in data_columns(df) if c not in known]
    out += [r.issue(df) for r in rules or []]
    return F.array_compact(F.array(*out)).cast(f"array<{ISSUE}>") if out else F.array().cast(f"array<{ISSUE}>")


def issue_counts(df: DataFrame) -> DataFrame:
    """Issues by field, code and severity."""
    return df.select(F.explode("_issues").alias("i")).groupBy("i.field", "i.code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


#: Types in the order in which they are tried, with the form of their texts.
_FORMS = [
    ("boolean", r"(?i)^\s*(true|false|yes|no)\s*$"),
    ("integer", r"^\s*[+-]?\d{1,18}\s*$"),
    ("number", r"^\s*[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?\s*$"),
    ("datetime", r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?\s*$"),
    ("date", r"^\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})\s*$"),
    ("url", r"(?i)^\s*https?://\S+\s*$"),
    ("email", r"^\s*[^\s@]+@[^\s@]+\.[A-Za-z]{2,}\s*$"),
    ("money", r"^\s*([$€£¥]\s*\d[\d.,]*|\d[\d.,]*\s*([$€£¥]|EUR|USD|GBP|CHF|PLN|SEK))\s*$"),
    ("phone", r"^\s*\+\d[\d\s().-]{6,}\s*$"),
    ("object", r"^\s*[\[{].*[\]}]\s*$"),
]


def infer_table(df: DataFrame) -> DataFrame:
    """``(field, present, total, type, share)``: of each field the share of its values in each form, in one pass."""
    cols = data_columns(df)
    text = df.select(*[as_text(value_of(df, c)).col.alias(c) for c in cols])
    long = text.unpivot([], cols, "field", "value")
    full = F.col("value").isNotNull() & (F.trim("value") != "")
    got = long.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(full, 1)).alias("present"), *[F.count(F.when(full & F.col("value").rlike(p), 1)).alias(n) for n, p in _FORMS])
    return got.unpivot(["field", "total", "present"], [n for n, _ in _FORMS], "type", "n").withColumn("share", F.round(F.try_divide(F.col("n"), F.col("present")), 6)).drop("n")


def infer_schema(df: DataFrame, name: str = "inferred", threshold: float = 0.9) -> Schema:
    """The first form that ``threshold`` of a field's values have, else enum, text or string."""
    rows = infer_table(df).collect()  # a few rows per column
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for c in data_columns(df):
        mine = {r["type"]: r for r in rows if r["field"] == c}
        first = next(iter(mine.values()))
        kind = next((n for n, _ in _FORMS if (mine[n]["share"] or 0) >= threshold), "string")
        if kind == "boolean" and not isinstance(kinds[c], (T.BooleanType, T.StringType)):
            kind = "integer"
        fields.append(Field(c, kind, required=first["present"] == first["total"] and first["total"] > 0))
    return Schema(name, fields)
