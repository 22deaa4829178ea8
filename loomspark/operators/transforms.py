"""The operations of the Transform stage: named, with flags, each a function on compiled values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.expr.compiler import Expression, ExpressionError, Value, as_text, const, is_empty, is_list, is_null, is_number, is_text, item, java_regex, unify
from loomspark.functions import columns as C
from loomspark.functions import urls as U
from loomspark.functions import values as V

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


@dataclass(frozen=True)
class Operation:
    """``strict``: a null result of a value is a failure. ``whole``: takes lists as one value.
    ``takes_null``: also runs on null. ``items``: the form over a list's items that needs Python."""

    name: str
    build: Callable
    strict: bool = False
    whole: bool = False
    takes_null: bool = False
    items: Callable | None = None


OPERATIONS: dict[str, Operation] = {}


def register_operation(name: str, build: Callable, **flags) -> None:
    """``build(value, argument, schema) -> Value`` becomes the operation ``name``."""
    OPERATIONS[name] = Operation(name, build, **flags)


def _text(name: str, f, **flags) -> None:
    register_operation(name, lambda v, a, s: Value(f(as_text(v).col, a), S), **flags)


_EDGES = r"(?U)^\s+|\s+$"
_text("strip", lambda c, a: F.regexp_replace(c, _EDGES, "") if not a else F.btrim(c, F.lit(a)))
_text("lower", lambda c, a: F.lower(c))
_text("upper", lambda c, a: F.upper(c))
_text("prefix", lambda c, a: F.concat(F.lit(str(a)), c))
_text("suffix", lambda c, a: F.concat(c, F.lit(str(a))))
_text("truncate", lambda c, a: F.left(c, F.lit(int(a))))
_text("replace", lambda c, a: F.replace(c, F.lit(a[0]), F.lit(a[1])))


def _sub(c, a):
    import re

    return F.regexp_replace(c, java_regex(a[0]), re.sub(r"\\(\d)", r"$\1", a[1].replace("$", "\\$")))


_text("sub", _sub)


def _regex(c, a):
    import re

    pattern, group = (a["pattern"], a.get("group")) if isinstance(a, dict) else (a, None)
    if group is None:
        group = 1 if re.compile(pattern).groups else 0
    elif isinstance(group, str):
        group = re.compile(pattern).groupindex[group]
    return F.when(c.rlike(java_regex(pattern)), F.regexp_extract(c, java_regex(pattern), group))


_text("regex", _regex, strict=True)


def _python(name: str, make, kind: str, spark_type, strict: bool) -> None:
    """An operation of a Python function ``make(argument) -> f``, over values and over items."""
    register_operation(name, lambda v, a, s: Value(C.mapped(make(a), kind)(as_text(v).col), spark_type), strict=strict, items=lambda v, a: Value(C.mapped_items(make(a), kind)(v.col), T.ArrayType(spark_type)))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _when(f):
    def make(a):
        a = a if isinstance(a, dict) else {"dayfirst": bool(a)}
        now = datetime.fromisoformat(a["now"]) if a.get("now") else _now()
        return lambda x: f(x, now, bool(a.get("dayfirst")))

    return make


def _money(a):
    def one(x):
        m = V.parse_money(x, a)
        return None if m is None else float(m[0])

    return one


def _unit(a):
    to, given = (a.get("to"), a.get("from")) if isinstance(a, dict) else (a, None)

    def one(x):
        q = V.parse_quantity(x)
        if q is None and given:
            n = next(iter(V.iter_numbers(x)), None)
            q = (n[0], V.unit_name(given)) if n else None
        if q is None:
            return None
        r = V.convert(q[0], q[1], V.unit_name(to)) if to else q[0]
        return None if r is None else round(float(r), 9)

    return one


_python("title", lambda a: str.title, "string", S, False)
_python("clean", lambda a: V.clean_text, "string", S, False)
_python("fix_encoding", lambda a: V.fix_garbled, "string", S, False)
_python("number", lambda a: lambda x: V.parse_number(x, a), "double", D, True)
_python("integer", lambda a: V.parse_integer, "bigint", L, True)
_python("percent", lambda a: V.parse_percent, "double", D, True)
_python("boolean", lambda a: V.parse_boolean, "boolean", B, True)
_python("date", _when(V.parse_date), "string", S, True)
_python("datetime", _when(V.parse_datetime), "string", S, True)
_python("money", _money, "double", D, True)
_python("currency", lambda a: lambda x: V.detect_currency(x, a), "string", S, True)
_python("unit", _unit, "double", D, True)
_python("url", lambda a: lambda x: U.normalize_url(x, a), "string", S, True)


def _map(v: Value, a: dict, s) -> Value:
    exact = {str(k): x for k, x in a.items()}
    folded = {str(k).strip().casefold(): x for k, x in a.items()}
    c = as_text(v).col
    fold = F.lower(F.regexp_replace(c, _EDGES, ""))
    kinds = {type(x) for x in a.values()}
    out = Value(c, S) if kinds <= {str} or not is_number(v) else v
    to = (lambda x: F.lit(x)) if kinds <= {str} else (lambda x: F.lit(None if x is None else str(x)))
    got = None
    for table, key in ((exact, c), (folded, fold)):
        for k, x in table.items():
            got = F.when(key == k, to(x)) if got is None else got.when(key == k, to(x))
    return Value(got.otherwise(as_text(out).col), S)


register_operation("map", _map, takes_null=True)
register_operation("round", lambda v, a, s: Value(F.bround(v.col.cast("double"), int(a or 0)), D))
register_operation("multiply", lambda v, a, s: Value((v.col.cast("decimal(38,12)") * F.lit(str(a)).cast("decimal(20,10)")).cast("double"), D))


def _nullif(v: Value, a, s) -> Value:
    options = a if isinstance(a, list) else [a]
    if is_text(v):
        return Value(F.when(~F.lower(F.regexp_replace(v.col, _EDGES, "")).isin(*[str(x).strip().casefold() for x in options]), v.col), v.type)
    return Value(F.when(~v.col.isin(*options), v.col), v.type)


register_operation("nullif", _nullif)
register_operation("json", lambda v, a, s: Value(F.try_parse_json(as_text(v).col), T.VariantType()), strict=True)


def _default(v: Value, a, s) -> Value:
    (x, y), kind = unify(v, const(a)) if not is_list(v) else ((v.col, F.array(*[F.lit(i) for i in (a if isinstance(a, list) else [a])])), v.type)
    return Value(F.when(is_empty(v), y).otherwise(x), kind)


register_operation("default", _default, whole=True, takes_null=True)


def _kept(v: Value):
    inner = v.type.elementType
    return F.filter(v.col, lambda x: ~is_empty(Value(x, inner)))


def _end(at: int):
    return lambda v, a, s: v if not is_list(v) else Value(F.try_element_at(_kept(v), F.lit(at)), v.type.elementType)


register_operation("first", _end(1), whole=True)
register_operation("last", _end(-1), whole=True)
register_operation("join", lambda v, a, s: as_text(v) if not is_list(v) else Value(F.array_join(F.transform(_kept(v), lambda x: as_text(Value(x, v.type.elementType)).col), ", " if a is None else a), S), whole=True)


def _split(v: Value, a, s) -> Value:
    import re

    mark = r"(?U)\s+" if a is None else re.escape(a)
    cut = lambda c: F.filter(F.transform(F.split(c, mark), lambda x: F.regexp_replace(x, _EDGES, "")), lambda x: x != "")
    return Value(F.flatten(F.transform(v.col, cut)) if is_list(v) else cut(as_text(v).col), T.ArrayType(S))


register_operation("split", _split, whole=True)
register_operation("unique", lambda v, a, s: Value(F.array_distinct(v.col), v.type) if is_list(v) else v, whole=True)
register_operation("compact", lambda v, a, s: Value(_kept(v), v.type) if is_list(v) else v, whole=True)


def _length(v: Value, a, s) -> Value:
    if is_null(v):
        return const(0)
    return Value(F.coalesce(F.size(v.col) if is_list(v) else F.char_length(as_text(v).col), F.lit(0)).cast("bigint"), L)


register_operation("length", _length, whole=True, takes_null=True)
register_operation("expr", lambda v, a, s: Expression(a).value(s, {"value": v}), whole=True, takes_null=True)


def apply_operation(v: Value, name: str, arg, schema: T.StructType) -> tuple[Value, object]:
    """The value after one operation, and the column of its failure (null-safe boolean)."""
    if name not in OPERATIONS:
        raise ExpressionError(f"there is no operation {name!r}")
    op = OPERATIONS[name]
    if is_null(v) and not op.takes_null:
        return v, F.lit(False)
    if is_list(v) and not op.whole:
        inner = v.type.elementType
        if op.items:
            out = op.items(Value(F.transform(v.col, lambda x: as_text(Value(x, inner)).col), T.ArrayType(S)), arg)
        else:
            probe = op.build(Value(F.lit(None).cast(inner), inner), arg, schema)
            out = Value(F.transform(v.col, lambda x: op.build(Value(x, inner), arg, schema).col), T.ArrayType(probe.type))
        failed = F.exists(F.arrays_zip(v.col.alias("a"), out.col.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNull()) if op.strict and not op.items else F.lit(False)
        return out, F.coalesce(failed, F.lit(False))
    out = op.build(v, arg, schema)
    if not op.takes_null:
        out = Value(F.when(v.col.isNotNull(), out.col), out.type)
    return out, (v.col.isNotNull() & out.col.isNull()) if op.strict else F.lit(False)
