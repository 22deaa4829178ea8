"""The expression language: Python expression syntax compiled to Spark columns.

Every node becomes a (column, type) pair. Types are known from the table's schema, so rules that
depend on them (truthiness, concatenation, null equality) are settled while compiling and what
runs is plain Catalyst. Comparisons are two-valued, division is true division and null on zero,
``//`` and ``%`` floor, ``and``/``or`` return an operand.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MAX_DEPTH, MAX_REPEAT, MAX_EXPONENT = 10_000, 100, 1_000_000, 1000


class ExpressionError(ValueError):
    """An expression that isn't allowed, or types that don't go together."""


@dataclass(frozen=True)
class Value:
    """A compiled node: its column, its type and, for literals, the constant."""

    col: Column
    type: T.DataType
    literal: object = None
    is_literal: bool = False


def const(x: object) -> Value:
    kinds = {type(None): T.NullType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    if type(x) not in kinds:
        raise ExpressionError(f"constants of type {type(x).__name__} aren't supported")
    kind = kinds[type(x)]
    return Value(F.lit(x) if x is None else F.lit(x).cast(kind), kind, x, True)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_null(v: Value) -> bool:
    return isinstance(v.type, T.NullType)


def is_number(v: Value) -> bool:
    return isinstance(v.type, _NUMERIC)


def is_whole(v: Value) -> bool:
    return isinstance(v.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_text(v: Value) -> bool:
    return isinstance(v.type, (T.StringType, T.CharType, T.VarcharType))


def is_list(v: Value) -> bool:
    return isinstance(v.type, T.ArrayType)


def is_bool(v: Value) -> bool:
    return isinstance(v.type, T.BooleanType)


def truthy(v: Value) -> Column:
    """Python truthiness, never null: null, false, 0, '' and empty lists and maps are false."""
    if is_null(v):
        return F.lit(False)
    if is_bool(v):
        c = v.col
    elif is_number(v):
        c = v.col != 0
    elif is_text(v):
        c = v.col != ""
    elif is_list(v) or isinstance(v.type, T.MapType):
        c = F.size(v.col) > 0
    else:
        c = v.col.isNotNull()
    return F.coalesce(c, F.lit(False))


def is_empty(v: Value) -> Column:
    """Null, '' and empty lists or maps."""
    if is_null(v):
        return F.lit(True)
    if is_text(v):
        return v.col.isNull() | (v.col == "")
    if is_list(v) or isinstance(v.type, T.MapType):
        return v.col.isNull() | (F.size(v.col) == 0)
    return v.col.isNull()


def unify(*vs: Value) -> tuple[list[Column], T.DataType]:
    """The values as columns of one type."""
    kinds = [v.type for v in vs if not is_null(v)]
    if not kinds:
        return [v.col for v in vs], T.NullType()
    known = [v for v in vs if not is_null(v)]
    if all(k == kinds[0] for k in kinds):
        kind = kinds[0]
    elif all(is_whole(v) for v in known):
        kind = T.LongType()
    elif all(is_number(v) for v in known):
        kind = T.DoubleType()
    elif all(is_number(v) or is_bool(v) for v in known):
        kind = T.DoubleType()
    else:
        kind = T.StringType()
    if isinstance(kind, T.StringType):
        return [as_text(v).col for v in vs], kind
    return [v.col.cast(kind) for v in vs], kind


def as_text(v: Value) -> Value:
    if is_text(v):
        return v
    if is_list(v) or isinstance(v.type, (T.StructType, T.MapType)):
        return Value(F.to_json(v.col), T.StringType())
    return Value(v.col.cast("string"), T.StringType())


def java_regex(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, named groups, end of text."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ExpressionError(f"invalid regular expression {pattern!r}: {e}") from e
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern).replace(r"\Z", r"\z")


_BUILTIN: dict[str, tuple[int, int, Callable[..., Value]]] = {}


def function(name: str, least: int, most: int | None = None):
    """Registers a function of the language: ``f(*values) -> Value``."""

    def add(f):
        _BUILTIN[name] = (least, least if most is None else most, f)
        return f

    return add


class Expression:
    """A compiled source; ``names`` are the fields it reads."""

    def __init__(self, source: str) -> None:
        if not source or not source.strip():
            raise ExpressionError("the expression is empty")
        if len(source) > MAX_CHARS:
            raise ExpressionError(f"the expression has more than {MAX_CHARS} characters")
        try:
            self.tree = ast.parse(source.strip(), mode="eval").body
        except (SyntaxError, ValueError, RecursionError) as e:
            raise ExpressionError(f"can't read {source!r}: {e}") from e
        self.source = source
        self.names = frozenset(self._fields(self.tree))

    def _fields(self, tree: ast.AST):
        called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and id(n) not in called:
                yield n.id
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "get" and n.args and isinstance(n.args[0], ast.Constant):
                yield str(n.args[0].value).split(".")[0]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Expression) and other.source == self.source

    def __hash__(self) -> int:
        return hash(self.source)

    def __repr__(self) -> str:
        return f"Expression({self.source!r})"

    def value(self, schema: T.StructType, bindings: dict[str, Value] | None = None) -> Value:
        """Compiled against a schema; ``bindings`` are further names."""
        return _Compiler(schema, bindings or {}).node(self.tree, 0)

    def column(self, schema: T.StructType, bindings: dict[str, Value] | None = None) -> Column:
        return self.value(schema, bindings).col

    def condition(self, schema: T.StructType) -> Column:
        """The truthiness of the expression, never null."""
        return truthy(self.value(schema))


class _Compiler:
    def __init__(self, schema: T.StructType, bindings: dict[str, Value]) -> None:
        self.fields = {f.name: f.dataType for f in schema.fields}
        self.bindings = bindings

    def node(self, n: ast.AST, depth: int) -> Value:
        if depth > MAX_DEPTH:
            raise ExpressionError("the expression is nested too deeply")
        f = getattr(self, "on_" + type(n).__name__.lower(), None)
        if f is None:
            raise ExpressionError(f"{type(n).__name__} isn't allowed in an expression")
        return f(n, depth + 1)

    def on_constant(self, n: ast.Constant, d: int) -> Value:
        return const(n.value)

    def on_name(self, n: ast.Name, d: int) -> Value:
        if n.id in self.bindings:
            return self.bindings[n.id]
        if n.id in self.fields:
            return Value(F.col("`" + n.id.replace("`", "``") + "`"), self.fields[n.id])
        return const(None)

    def on_list(self, n: ast.List, d: int) -> Value:
        cols, kind = unify(*[self.node(x, d) for x in n.elts])
        return Value(F.array(*cols), T.ArrayType(kind))

    on_tuple = on_set = on_list

    def on_dict(self, n: ast.Dict, d: int) -> Value:
        if not all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in n.keys):
            raise ExpressionError("keys of a dict must be texts")
        vals = [(k.value, self.node(v, d)) for k, v in zip(n.keys, n.values)]
        return Value(F.struct(*[v.col.alias(k) for k, v in vals]), T.StructType([T.StructField(k, v.type) for k, v in vals]))

    def on_unaryop(self, n: ast.UnaryOp, d: int) -> Value:
        v = self.node(n.operand, d)
        if isinstance(n.op, ast.Not):
            return Value(~truthy(v), T.BooleanType())
        if is_null(v):
            return v
        if not (is_number(v) or is_bool(v)) or isinstance(n.op, ast.Invert):
            raise ExpressionError("a sign needs a number")
        if v.is_literal:
            return const(-v.literal if isinstance(n.op, ast.USub) else +v.literal)
        return Value(-v.col if isinstance(n.op, ast.USub) else v.col, v.type)

    def on_binop(self, n: ast.BinOp, d: int) -> Value:
        a, b, op = self.node(n.left, d), self.node(n.right, d), type(n.op).__name__
        if is_null(a) or is_null(b):
            return const(None)
        if op == "Add" and is_text(a) and is_text(b):
            return Value(F.concat(a.col, b.col), T.StringType())
        if op == "Add" and is_list(a) and is_list(b):
            return Value(F.concat(a.col, b.col), a.type)
        if op == "Mult" and (is_text(a) or is_list(a)) and is_whole(b) or op == "Mult" and is_whole(a) and (is_text(b) or is_list(b)):
            s, k = (a, b) if is_whole(b) else (b, a)
            if k.is_literal and isinstance(k.literal, int) and k.literal > MAX_REPEAT:
                raise ExpressionError("the repetition is too long")
            n_ = F.greatest(k.col, F.lit(0)).cast("int")
            return Value(F.repeat(s.col, n_), s.type) if is_text(s) else Value(F.flatten(F.array_repeat(s.col, n_)), s.type)
        a, b = (Value(x.col.cast("bigint"), T.LongType()) if is_bool(x) else x for x in (a, b))
        if not (is_number(a) and is_number(b)):
            raise ExpressionError(f"{op} doesn't go with {a.type.simpleString()} and {b.type.simpleString()}")
        whole = is_whole(a) and is_whole(b)
        kind = T.LongType() if whole else T.DoubleType()
        x, y = (v.col.cast(kind) for v in (a, b))
        if op == "Add":
            return Value(F.try_add(x, y), kind)
        if op == "Sub":
            return Value(F.try_subtract(x, y), kind)
        if op == "Mult":
            return Value(F.try_multiply(x, y), kind)
        if op == "Div":
            return Value(F.try_divide(x.cast("double"), y.cast("double")), T.DoubleType())
        if op in ("FloorDiv", "Mod"):
            safe = F.when(y != 0, y)
            if whole:  # exact: Spark truncates, so one less where the signs differ and something is left
                left = x % safe
                over = (left != 0) & ((left < 0) != (safe < 0))
                r = F.when(over, left + safe).otherwise(left)
                return Value(r, kind) if op == "Mod" else Value(((x - r) / safe).cast("bigint"), kind)
            q = F.floor(x / safe)
            return Value(q.cast("double") if op == "FloorDiv" else x - safe * q, kind)
        if op == "Pow":
            big = F.abs(y) > MAX_EXPONENT
            p = F.when((x == 0) & (y < 0), None).when(big, None).otherwise(F.pow(x.cast("double"), y.cast("double")))
            exact = whole and b.is_literal and isinstance(b.literal, int) and b.literal >= 0
            return Value(p.cast("bigint") if exact else p, T.LongType() if exact else T.DoubleType())
        raise ExpressionError(f"{op} isn't allowed in an expression")

    def on_boolop(self, n: ast.BoolOp, d: int) -> Value:
        vs = [self.node(x, d) for x in n.values]
        conj = isinstance(n.op, ast.And)
        if all(is_bool(v) for v in vs):
            out = truthy(vs[0])
            for v in vs[1:]:
                out = out & truthy(v) if conj else out | truthy(v)
            return Value(out, T.BooleanType())
        out = vs[-1]
        for v in reversed(vs[:-1]):
            (x, y), kind = unify(v, out)
            out = Value(F.when(truthy(v), y if conj else x).otherwise(x if conj else y), kind)
        return out

    def on_ifexp(self, n: ast.IfExp, d: int) -> Value:
        t, a, b = self.node(n.test, d), self.node(n.body, d), self.node(n.orelse, d)
        (x, y), kind = unify(a, b)
        return Value(F.when(truthy(t), x).otherwise(y), kind)

    def on_compare(self, n: ast.Compare, d: int) -> Value:
        left, out = self.node(n.left, d), None
        for op, r in zip(n.ops, n.comparators):
            right = self.node(r, d)
            c = self._compare(type(op).__name__, left, right)
            out, left = c if out is None else out & c, right
        return Value(out, T.BooleanType())

    def _compare(self, op: str, a: Value, b: Value) -> Column:
        if op in ("Is", "IsNot"):
            if not b.is_literal or b.literal not in (None, True, False) or isinstance(b.literal, int) and not isinstance(b.literal, bool):
                raise ExpressionError("'is' compares with None, True or False only")
            if b.literal is None:
                same = a.col.isNull()
            else:
                same = a.col.eqNullSafe(F.lit(b.literal)) if is_bool(a) else F.lit(False)
            return same if op == "Is" else ~same
        if op in ("In", "NotIn"):
            c = self._contained(a, b)
            return c if op == "In" else ~c
        if op in ("Eq", "NotEq"):
            c = self._equal(a, b)
            return c if op == "Eq" else ~c
        if is_null(a) or is_null(b):
            return F.lit(False)
        kinds = [is_number(v) or is_bool(v) for v in (a, b)]
        if kinds[0] != kinds[1] or (not kinds[0] and type(a.type) is not type(b.type) and not self._dates(a, b)):
            raise ExpressionError(f"can't order {a.type.simpleString()} and {b.type.simpleString()}")
        x, y = (v.col.cast("int") if is_bool(v) else v.col for v in (a, b))
        return F.coalesce({"Lt": x < y, "LtE": x <= y, "Gt": x > y, "GtE": x >= y}[op], F.lit(False))

    @staticmethod
    def _dates(a: Value, b: Value) -> bool:
        return all(isinstance(v.type, (T.DateType, T.TimestampType, T.TimestampNTZType)) or is_text(v) for v in (a, b))

    @staticmethod
    def _equal(a: Value, b: Value) -> Column:
        if is_null(a) or is_null(b):
            return a.col.isNull() & b.col.isNull()
        if (is_number(a) or is_bool(a)) and (is_number(b) or is_bool(b)):
            x, y = (v.col.cast("int") if is_bool(v) else v.col for v in (a, b))
            return x.eqNullSafe(y)
        if type(a.type) is type(b.type):
            return a.col.eqNullSafe(b.col)
        return a.col.isNull() & b.col.isNull()  # values of unlike kinds are never equal

    def _contained(self, a: Value, b: Value) -> Column:
        if is_null(b):
            return F.lit(False)
        if is_text(b):
            if is_null(a):
                return F.lit(False)
            if not is_text(a):
                raise ExpressionError("'in' a text needs a text")
            return F.coalesce(b.col.contains(a.col), F.lit(False))
        if is_list(b):
            item = b.type.elementType
            if is_null(a):
                return F.coalesce(F.exists(b.col, lambda x: x.isNull()), F.lit(False))
            return F.coalesce(F.exists(b.col, lambda x: self._equal(a, Value(x, item))), F.lit(False))
        if isinstance(b.type, T.MapType):
            return F.coalesce(F.map_contains_key(b.col, a.col), F.lit(False))
        if isinstance(b.type, T.StructType) and a.is_literal:
            return F.lit(a.literal in b.type.names)
        raise ExpressionError(f"'in' doesn't go with {b.type.simpleString()}")

    def on_subscript(self, n: ast.Subscript, d: int) -> Value:
        v = self.node(n.value, d)
        if isinstance(n.slice, ast.Slice):
            return self._slice(v, n.slice, d)
        return item(v, self.node(n.slice, d))

    def _slice(self, v: Value, s: ast.Slice, d: int) -> Value:
        if is_null(v):
            return v
        if not (is_text(v) or is_list(v)):
            raise ExpressionError("only texts and lists can be sliced")
        size = F.char_length(v.col) if is_text(v) else F.size(v.col)
        step = self.node(s.step, d) if s.step else const(1)
        if not step.is_literal or step.literal not in (1, -1) and not (isinstance(step.literal, int) and step.literal > 0):
            raise ExpressionError("the step of a slice must be a positive constant, or -1")

        def bound(x: ast.AST | None, default: Column) -> Column:
            if x is None:
                return default
            c = self.node(x, d).col.cast("int")
            return F.least(F.greatest(F.when(c < 0, size + c).otherwise(c), F.lit(0)), size)

        if step.literal == -1:
            if s.lower or s.upper:
                raise ExpressionError("a slice with the step -1 has no bounds")
            return Value(F.reverse(v.col), v.type)
        low, high = bound(s.lower, F.lit(0)), bound(s.upper, size)
        n_ = F.greatest(high - low, F.lit(0))
        out = F.substring(v.col, low + 1, n_) if is_text(v) else F.slice(v.col, low + 1, n_)
        if step.literal > 1:
            if is_text(v):
                return Value(F.array_join(F.filter(F.split(out, ""), lambda x, i: i % step.literal == 0), ""), v.type)
            out = F.filter(out, lambda x, i: i % step.literal == 0)
        return Value(out, v.type)

    def on_call(self, n: ast.Call, d: int) -> Value:
        if not isinstance(n.func, ast.Name):
            raise ExpressionError("only the language's own functions can be called")
        if n.keywords or any(isinstance(a, ast.Starred) for a in n.args):
            raise ExpressionError("functions take plain arguments only")
        name = n.func.id
        if name == "get":
            return self._get(n, d)
        if name not in _BUILTIN:
            import loomspark.expr.functions  # noqa: F401  registers the functions

            if name not in _BUILTIN:
                raise ExpressionError(f"there is no function {name!r}")
        least, most, f = _BUILTIN[name]
        if not least <= len(n.args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments")
        return f(*[self.node(a, d) for a in n.args])

    def _get(self, n: ast.Call, d: int) -> Value:
        if not 1 <= len(n.args) <= 2 or not isinstance(n.args[0], ast.Constant):
            raise ExpressionError("get takes a constant path and a default")
        path, default = str(n.args[0].value), self.node(n.args[1], d) if len(n.args) > 1 else const(None)
        v = self.on_name(ast.Name(path), d)
        if is_null(v) and path not in self.fields:
            first, *rest = path.split(".")
            v = self.on_name(ast.Name(first), d)
            for part in rest:
                v = item(v, const(int(part)) if re.fullmatch(r"-?\d+", part) and is_list(v) else const(part))
        (x, y), kind = unify(v, default)
        return Value(F.coalesce(x, y), kind)


def item(v: Value, key: Value) -> Value:
    """``v[key]``; out of range or a missing key is null."""
    if is_null(v) or is_null(key):
        return const(None)
    if is_list(v):
        k = key.col.cast("int")
        return Value(F.try_element_at(v.col, F.when(k < 0, k).otherwise(k + 1)), v.type.elementType)
    if is_text(v):
        k = key.col.cast("int")
        n = F.char_length(v.col)
        at = F.when(k < 0, n + k).otherwise(k)
        return Value(F.when((at >= 0) & (at < n), F.substring(v.col, at + 1, F.lit(1))), T.StringType())
    if isinstance(v.type, T.StructType) and key.is_literal:
        return Value(v.col.getField(key.literal), v.type[key.literal].dataType) if key.literal in v.type.names else const(None)
    if isinstance(v.type, T.MapType):
        return Value(F.try_element_at(v.col, key.col), v.type.valueType)
    raise ExpressionError(f"{v.type.simpleString()} has no items")


def compile_expression(source: str | Expression) -> Expression:
    return source if isinstance(source, Expression) else Expression(source)
