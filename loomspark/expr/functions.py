"""The functions of the expression language. All take nulls."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.expr.compiler import ExpressionError, Value, as_text, const, function, is_empty, is_list, is_null, is_number, is_text, item, java_regex, truthy, unify
from loomspark.functions import columns as C
from loomspark.functions import urls as U

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _constant(v: Value, what: str):
    if not v.is_literal:
        raise ExpressionError(f"{what} must be a constant")
    return v.literal


def _texts(name: str, f):
    @function(name, 1)
    def run(v: Value) -> Value:
        return v if is_null(v) else Value(f(as_text(v).col), S)


_texts("lower", F.lower)
_texts("upper", F.upper)
_texts("title", C.title)
_texts("strip", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
_texts("clean", C.clean)
_texts("currency", C.currency)
_texts("host", U.host_col)
_texts("domain", U.domain_col)
_texts("path", U.path_col)
_texts("hash", C.content_hash)


@function("len", 1)
def _len(v: Value) -> Value:
    if is_null(v):
        return const(0)
    c = F.char_length(v.col) if is_text(v) else F.size(v.col) if is_list(v) or isinstance(v.type, T.MapType) else F.lit(len(v.type.names)) if isinstance(v.type, T.StructType) else None
    if c is None:
        raise ExpressionError(f"{v.type.simpleString()} has no length")
    return Value(F.when(v.col.isNull(), 0).otherwise(c).cast("bigint"), L)


def _find(a: Value, b: Value, fold: bool) -> Value:
    if is_null(a) or is_null(b):
        return const(False)
    low = F.lower if fold else (lambda c: c)
    if is_list(a):
        inner = a.type.elementType
        return Value(F.coalesce(F.exists(a.col, lambda x: low(as_text(Value(x, inner)).col) == low(as_text(b).col)), F.lit(False)), B)
    return Value(F.coalesce(low(as_text(a).col).contains(low(as_text(b).col)), F.lit(False)), B)


function("contains", 2)(lambda a, b: _find(a, b, False))
function("icontains", 2)(lambda a, b: _find(a, b, True))


def _edge(name: str, method: str):
    @function(name, 2)
    def run(a: Value, b: Value) -> Value:
        return const(False) if is_null(a) or is_null(b) else Value(F.coalesce(getattr(as_text(a).col, method)(as_text(b).col), F.lit(False)), B)


_edge("startswith", "startswith")
_edge("endswith", "endswith")


@function("matches", 2)
def _matches(v: Value, p: Value) -> Value:
    pattern = java_regex(_constant(p, "the pattern"))
    return const(False) if is_null(v) else Value(F.coalesce(as_text(v).col.rlike(pattern), F.lit(False)), B)


@function("extract", 2)
def _extract(v: Value, p: Value) -> Value:
    import re

    source = _constant(p, "the pattern")
    pattern, groups = java_regex(source), re.compile(source).groups
    return v if is_null(v) else Value(F.when(as_text(v).col.rlike(pattern), F.regexp_extract(as_text(v).col, pattern, 1 if groups else 0)), S)


@function("replace", 3)
def _replace(v: Value, a: Value, b: Value) -> Value:
    return v if is_null(v) else Value(F.replace(as_text(v).col, as_text(a).col, as_text(b).col), S)


@function("sub", 3)
def _sub(v: Value, p: Value, r: Value) -> Value:
    import re

    to = re.sub(r"\\(\d)", r"$\1", _constant(r, "the replacement").replace("$", "\\$"))
    return v if is_null(v) else Value(F.regexp_replace(as_text(v).col, java_regex(_constant(p, "the pattern")), to), S)


@function("split", 1, 2)
def _split(v: Value, sep: Value | None = None) -> Value:
    import re

    if is_null(v):
        return Value(F.array().cast("array<string>"), T.ArrayType(S))
    mark = r"(?U)\s+" if sep is None else re.escape(_constant(sep, "the separator"))
    parts = F.filter(F.transform(F.split(as_text(v).col, mark), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return Value(F.coalesce(parts, F.array().cast("array<string>")), T.ArrayType(S))


@function("join", 1, 2)
def _join(v: Value, sep: Value | None = None) -> Value:
    if is_null(v):
        return v
    if not is_list(v):
        return as_text(v)
    inner = v.type.elementType
    texts = F.transform(v.col, lambda x: as_text(Value(x, inner)).col)
    return Value(F.array_join(F.filter(texts, lambda x: x != ""), _constant(sep, "the separator") if sep else ", "), S)


@function("words", 1)
def _words(v: Value) -> Value:
    return const(0) if is_null(v) else Value(F.coalesce(F.size(F.filter(F.split(as_text(v).col, r"(?U)\s+"), lambda x: x != "")), F.lit(0)).cast("bigint"), L)


function("first", 1)(lambda v: item(v, const(0)) if is_list(v) else v)
function("last", 1)(lambda v: item(v, const(-1)) if is_list(v) else v)


@function("coalesce", 1, 100)
def _coalesce(*vs: Value) -> Value:
    cols, kind = unify(*vs)
    return Value(F.coalesce(*[F.when(~is_empty(v), c) for v, c in zip(vs, cols)]), kind)


def _pick(name: str, many, one):
    @function(name, 1, 100)
    def run(*vs: Value) -> Value:
        if len(vs) == 1 and is_list(vs[0]):
            return Value(many(vs[0].col), vs[0].type.elementType)
        known = [v for v in vs if not is_null(v)]
        if not known:
            return const(None)
        cols, kind = unify(*known)
        return Value(cols[0] if len(cols) == 1 else one(*cols), kind)


_pick("min", F.array_min, F.least)
_pick("max", F.array_max, F.greatest)


@function("sum", 1)
def _sum(v: Value) -> Value:
    if is_null(v):
        return v
    whole = isinstance(v.type.elementType, (T.IntegerType, T.LongType, T.ShortType))
    kind = L if whole else D
    zero = F.lit(0).cast(kind)
    return Value(F.aggregate(F.filter(v.col, lambda x: x.isNotNull()), zero, lambda a, x: a + x.cast(kind)), kind)


def _over(name: str, f):
    @function(name, 1)
    def run(v: Value) -> Value:
        if is_null(v):
            return const(False)
        if not is_list(v):
            return Value(truthy(v), B)
        inner = v.type.elementType
        return Value(F.coalesce(f(v.col, lambda x: truthy(Value(x, inner))), F.lit(False)), B)


_over("any", F.exists)
_over("all", F.forall)
function("abs", 1)(lambda v: v if is_null(v) else Value(F.abs(v.col), v.type))


@function("round", 1, 2)
def _round(v: Value, digits: Value | None = None) -> Value:
    """Half to even; on the decimal spelling of the number (``round_exact`` has the binary rule)."""
    if is_null(v):
        return v
    n = 0 if digits is None else _constant(digits, "the digits")
    out = F.bround(v.col, n)
    return Value(out.cast("bigint"), L) if digits is None else Value(out, v.type)


@function("round_exact", 1, 2)
def _round_exact(v: Value, digits: Value | None = None) -> Value:
    return v if is_null(v) else Value(C.round_exact(v.col, 0 if digits is None else _constant(digits, "the digits")), D)


@function("int", 1)
def _int(v: Value) -> Value:
    if is_null(v):
        return v
    c = F.try_to_number(v.col, F.lit("9")) if False else v.col.try_cast("double") if is_text(v) else v.col.cast("double") if is_number(v) else v.col.cast("int")
    return Value(F.when(c.cast("double") >= 0, F.floor(c.cast("double"))).otherwise(F.ceil(c.cast("double"))).try_cast("bigint"), L)


function("float", 1)(lambda v: v if is_null(v) else Value((v.col.cast("int") if isinstance(v.type, T.BooleanType) else v.col).try_cast("double"), D))
function("str", 1)(lambda v: v if is_null(v) else as_text(v))
function("bool", 1)(lambda v: Value(truthy(v), B))


def _parsed(name: str, f, kind):
    @function(name, 1)
    def run(v: Value) -> Value:
        return v if is_null(v) else Value(f(as_text(v).col), kind)


_parsed("number", C.number, D)
_parsed("integer", C.integer, L)
_parsed("boolean", C.boolean, B)
_parsed("money", lambda c: C.money(c)["amount"], D)
_parsed("coordinates", C.coordinates, T.ArrayType(D))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


_parsed("date", lambda c: C.date_text(c, _now()), S)
_parsed("datetime", lambda c: C.datetime_text(c, _now()), S)
function("now", 0)(lambda: Value(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), S))
function("today", 0)(lambda: Value(F.date_format(F.current_timestamp(), "yyyy-MM-dd"), S))


@function("param", 2)
def _param(v: Value, name: Value) -> Value:
    return v if is_null(v) else Value(U.param_col(as_text(v).col, _constant(name, "the name")), S)


def _place(v: Value):
    return v.col if is_list(v) else C.coordinates(as_text(v).col)


@function("distance_km", 2)
def _distance(a: Value, b: Value) -> Value:
    return const(None) if is_null(a) or is_null(b) else Value(C.distance_km(_place(a), _place(b)), D)


@function("in_box", 5)
def _in_box(p: Value, south: Value, west: Value, north: Value, east: Value) -> Value:
    return const(False) if is_null(p) else Value(C.in_box(_place(p), south.col, west.col, north.col, east.col), B)
