"""Pipeline stages: each takes a DataFrame and gives a DataFrame. Nothing runs before the sink.

Rows carry ``_seq``, their place in the input, where order matters. A stage that drops rows says so
by leaving them out; failures follow the stage's ``on_error``: ``null``, ``keep``, ``drop`` or
``raise``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.expr.compiler import Expression, Value, as_text, compile_expression, is_empty, is_list, is_text, truthy
from loomspark.functions.values import minor_units
from loomspark.operators.transforms import apply_operation

SEQ = "_seq"


def ident(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_sequence(df: DataFrame) -> DataFrame:
    """``df`` with ``_seq``, increasing within and over its partitions."""
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


def value_of(df: DataFrame, name: str) -> Value:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return Value(ident(name), kinds[name]) if name in kinds else Value(F.lit(None), T.NullType())


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def expand(patterns: list[str], columns: list[str]) -> list[str]:
    """Names and glob patterns against the columns; a plain name stays even where it is missing."""
    out: list[str] = []
    for p in patterns:
        found = [c for c in columns if fnmatch.fnmatchcase(c, p)] if any(x in p for x in "*?[") else [p]
        out += [c for c in found if c not in out]
    return out


class Stage:
    """One step; ``kind`` is its name in configurations."""

    kind = ""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def config(self) -> dict:
        return {self.kind: {k: v for k, v in vars(self).items() if not k.startswith("_") and v is not None}}


@dataclass
class Rename(Stage):
    """``{old: new}``, all at once (swaps work). Of several olds for one new the first non-empty value
    wins, else the first that is present; an empty value never replaces a non-empty target."""

    fields: dict[str, str]
    kind = "rename"

    def apply(self, df: DataFrame) -> DataFrame:
        there = [o for o in self.fields if o in df.columns and self.fields[o] != o]
        target: dict[str, list[str]] = {}
        for o in there:
            target.setdefault(self.fields[o], []).append(o)
        out, done = [], set()
        for c in df.columns:
            new = self.fields[c] if c in there else c
            if new in done:
                continue
            if new in target:
                olds = target[new] + ([new] if new in df.columns and new not in there else [])
                vs = [value_of(df, o) for o in olds]
                out.append(F.coalesce(*[F.when(~is_empty(v), v.col) for v in vs], vs[0].col).alias(new))
            elif c not in there:
                out.append(ident(c))
            done.add(new)
        return df.select(*out)


@dataclass
class Select(Stage):
    """Ordered projection by name and glob; missing names are null; fields with ``_`` stay."""

    fields: list[str]
    fill_missing: bool = True
    keep_metadata: bool = True
    kind = "select"

    def apply(self, df: DataFrame) -> DataFrame:
        names = expand(self.fields, df.columns)
        if self.keep_metadata:
            names += [c for c in df.columns if c.startswith("_") and c not in names]
        return df.select(*[ident(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names if c in df.columns or self.fill_missing])


@dataclass
class Exclude(Stage):
    fields: list[str]
    kind = "exclude"

    def apply(self, df: DataFrame) -> DataFrame:
        gone = set(expand(self.fields, df.columns))
        return df.select(*[ident(c) for c in df.columns if c not in gone])


def _outcome(df: DataFrame, new: dict[str, Column], failed: Column, old: dict[str, Column], policy: str, what: str) -> DataFrame:
    """``df`` with ``new`` columns, rows where ``failed`` treated by ``policy``."""
    if policy == "drop":
        df = df.withColumn("__failed", failed).withColumns({k: v for k, v in new.items()})
        return df.filter(~F.col("__failed")).drop("__failed")
    if policy == "keep":
        new = {k: F.when(failed, old[k]).otherwise(v) if k in old else v for k, v in new.items()}
    elif policy == "raise":
        new = {k: F.when(failed, F.raise_error(F.lit(f"{what} failed"))).otherwise(v) for k, v in new.items()}
    elif policy != "null":
        raise ValueError(f"on_error is null, keep, drop or raise, not {policy!r}")
    return df.withColumns(new)


@dataclass
class Transform(Stage):
    """Operations on fields (names or globs), left to right; ``target`` writes elsewhere."""

    fields: list[str] | str
    ops: list
    target: str | None = None
    on_error: str = "null"
    kind = "transform"

    def apply(self, df: DataFrame) -> DataFrame:
        names = expand([self.fields] if isinstance(self.fields, str) else self.fields, df.columns)
        for name in names:
            v, failed = value_of(df, name), F.lit(False)
            if name not in df.columns and not any(self._op(o)[0] in ("default", "length", "expr", "map") for o in self.ops):
                continue
            start = v
            for o in self.ops:
                op, arg = self._op(o)
                v, bad = apply_operation(v, op, arg, df.schema)
                failed = failed | bad
                if is_list(v) and self.on_error == "null":
                    v = Value(F.filter(v.col, lambda x: x.isNotNull()), v.type)
            to = self.target or name
            kept = {to: start.col.cast(v.type) if type(start.type) is not type(v.type) and not is_text(v) else as_text(start).col if is_text(v) and not is_text(start) else start.col}
            df = _outcome(df, {to: v.col}, failed, kept, self.on_error, f"the transformation of {name}")
        return df

    @staticmethod
    def _op(o) -> tuple[str, object]:
        if isinstance(o, str):
            return o, None
        return next(iter(o.items())) if isinstance(o, dict) else (o[0], o[1])


@dataclass
class Compute(Stage):
    """Expressions in order; later ones see earlier results."""

    fields: dict[str, str]
    on_error: str = "null"
    kind = "compute"

    def apply(self, df: DataFrame) -> DataFrame:
        for name, source in self.fields.items():
            df = df.withColumn(name, compile_expression(source).column(df.schema))
        return df


@dataclass
class Filter(Stage):
    """Rows whose expression is true; ``keep=False`` turns it round."""

    where: str
    keep: bool = True
    kind = "filter"

    def apply(self, df: DataFrame) -> DataFrame:
        c = compile_expression(self.where).condition(df.schema)
        return df.filter(c if self.keep else ~c)


def match_key(v: Value) -> Column:
    """The form in which keys are compared: case-folded and squeezed texts, numbers without a zero
    fraction, true and false as words. Null and nested values match nothing."""
    if isinstance(v.type, (T.ArrayType, T.StructType, T.MapType, T.NullType)):
        return F.lit(None).cast("string")
    if isinstance(v.type, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = v.col.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    if not is_text(v):
        return v.col.cast("string")
    t = F.trim(F.regexp_replace(F.lower(v.col), r"(?U)\s+", " "))
    plain = F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1")
    return F.when(plain != "", plain)


@dataclass
class Lookup(Stage):
    """Joins a reference table on one key. The first row of a key counts; only empty fields are
    filled unless ``overwrite``; ``required`` drops rows without a match. A list probes with its
    items in order. The reference side is broadcast only if its measured size is small."""

    table: DataFrame = field(repr=False)
    key: str = ""
    on: str | None = None
    columns: list[str] | None = None
    prefix: str = ""
    required: bool = False
    overwrite: bool = False
    kind = "lookup"

    def apply(self, df: DataFrame) -> DataFrame:
        on = self.on or self.key
        ref = with_sequence(self.table)
        names = self.columns or [c for c in ref.columns if c not in (on, SEQ)]
        k = match_key(value_of(ref, on))
        build = ref.select(k.alias("__k"), SEQ, *[ident(c).alias(f"__r_{i}") for i, c in enumerate(names)]).filter("__k is not null")
        build = build.groupBy("__k").agg(F.min_by(F.struct(*[f"__r_{i}" for i in range(len(names))]), SEQ).alias("__r"))
        v = value_of(df, self.key)
        if is_list(v):
            df = with_sequence(df)
            inner = v.type.elementType
            probe = df.select(SEQ, F.posexplode(v.col).alias("__p", "__x")).withColumn("__k", match_key(Value(F.col("__x"), inner)))
            hit = probe.join(build, "__k").groupBy(SEQ).agg(F.min_by("__r", "__p").alias("__r"))
            out = df.join(hit, SEQ, "inner" if self.required else "left")
        else:
            out = df.withColumn("__k", match_key(v)).join(build, "__k", "inner" if self.required else "left").drop("__k")
        new = {}
        for i, c in enumerate(names):
            to, got = self.prefix + c, F.col(f"__r.__r_{i}")
            if to in df.columns:
                old = value_of(df, to)
                new[to] = F.when(F.col("__r").isNotNull() if self.overwrite else is_empty(old) & F.col("__r").isNotNull(), got).otherwise(old.col)
            else:
                new[to] = got
        return out.withColumns(new).drop("__r")


@dataclass
class ConvertCurrency(Stage):
    """Amounts times a rate, rounded half to even to the target's minor unit. ``rates`` are units of
    ``to`` for one unit. All fields of a row convert, or none; the currency field changes only
    where an amount did."""

    fields: list[str]
    to: str
    rates: dict[str, float]
    currency: str = "currency"
    on_error: str = "keep"
    kind = "convert_currency"

    def apply(self, df: DataFrame) -> DataFrame:
        code = F.upper(as_text(value_of(df, self.currency)).col)
        rate = F.lit(None).cast("decimal(20,10)")
        for k, r in {**self.rates, self.to: 1}.items():
            rate = F.when(code == k, F.lit(Decimal(str(r))).cast("decimal(20,10)")).otherwise(rate)
        present = F.lit(False)
        for f in self.fields:
            present = present | value_of(df, f).col.isNotNull()
        failed = present & rate.isNull()
        same = code == self.to
        new, old = {}, {}
        for f in self.fields:
            amount = ident(f)
            out = F.bround(amount.cast("decimal(28,8)") * rate, minor_units(self.to)).cast("double")
            new[f] = F.when(same, amount.cast("double")).otherwise(out)
            old[f] = amount.cast("double")
        new[self.currency] = F.when(present & rate.isNotNull(), F.lit(self.to)).otherwise(ident(self.currency))
        old[self.currency] = ident(self.currency)
        return _outcome(df, new, failed, old, self.on_error, "the conversion of currency")


@dataclass
class Enrich(Stage):
    """Merges the struct that ``function`` makes of each row's column(s): a vectorized function on
    pandas frames. Only empty fields are filled unless ``overwrite``."""

    function: Callable = field(repr=False)
    schema: str = ""
    inputs: list[str] = field(default_factory=list)
    overwrite: bool = True
    kind = "enrich"

    def apply(self, df: DataFrame) -> DataFrame:
        f = self.function

        def run(pdf):
            return f(pdf)

        import pandas as pd

        run.__annotations__ = {"pdf": pd.DataFrame, "return": pd.DataFrame}
        kind = T._parse_datatype_string(self.schema)
        out = df.withColumn("__e", F.pandas_udf(run, kind)(F.struct(*[ident(c) for c in self.inputs])))
        new = {}
        for n in kind.names:
            got = F.col(f"__e.{n}")
            new[n] = got if self.overwrite or n not in df.columns else F.when(is_empty(value_of(df, n)), got).otherwise(ident(n))
        return out.withColumns(new).drop("__e")


@dataclass
class FunctionStage(Stage):
    """Any function of a DataFrame, or of pandas batches where ``schema`` is given."""

    function: Callable = field(repr=False)
    schema: str | None = None
    kind = "function"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.mapInPandas(self.function, self.schema) if self.schema else df.transform(self.function)


@dataclass
class Deduplicate(Stage):
    """See ``operators.dedupe``."""

    fields: list[str] | None = None
    content: list[str] | bool = False
    near: str | None = None
    threshold: float = 0.8
    mark: bool = False
    kind = "dedupe"

    def apply(self, df: DataFrame) -> DataFrame:
        from loomspark.operators.dedupe import deduplicate

        return deduplicate(df, self.fields, self.content, self.near, self.threshold, self.mark)


@dataclass
class Normalize(Stage):
    """See ``operators.schema``."""

    schema: object = None
    notes: bool = False
    kind = "normalize"

    def apply(self, df: DataFrame) -> DataFrame:
        return self.schema.normalize(df, notes=self.notes)


@dataclass
class Validate(Stage):
    """Adds ``_issues``; rows with errors and rows with warnings only go by their policies."""

    schema: object = None
    rules: list = field(default_factory=list)
    on_error: str = "drop"
    on_warning: str = "keep"
    kind = "validate"

    def issues(self, df: DataFrame) -> DataFrame:
        from loomspark.operators.schema import issue_column

        return df.withColumn("_issues", issue_column(df, self.schema, self.rules))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid, rejects)."""
        out = self.issues(df)
        bad = F.exists("_issues", lambda i: i["severity"] == "error")
        return out.filter(~bad), out.filter(bad)

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.issues(df)
        bad = F.exists("_issues", lambda i: i["severity"] == "error")
        warned = F.exists("_issues", lambda i: i["severity"] == "warning") & ~bad
        if self.on_error == "raise":
            out = out.withColumn("_issues", F.when(bad, F.raise_error(F.lit("a record isn't valid"))).otherwise(F.col("_issues")))
        if self.on_error == "drop":
            out = out.filter(~bad)
        if self.on_warning == "drop":
            out = out.filter(~warned)
        flag = {p for p in (self.on_error, self.on_warning)} & {"flag"}
        return out if flag else out.drop("_issues")


@dataclass
class Analyze(Stage):
    """Language and size of a text field, see ``functions.text``."""

    text: str = "text"
    kind = "analyze"

    def apply(self, df: DataFrame) -> DataFrame:
        from loomspark.functions.text import analyze

        a = analyze(as_text(value_of(df, self.text)).col)
        return df.withColumn("__a", a).select("*", "__a.*").drop("__a")


@dataclass
class Locate(Stage):
    """Parts of the place in an address field; a value never becomes null."""

    address: str = "address"
    country: str | None = None
    kind = "locate"

    def apply(self, df: DataFrame) -> DataFrame:
        from loomspark.functions import columns as C
        from loomspark.functions import values as V

        c = self.country
        parts = C.mapped(lambda x: V.parse_address(x, c), "struct<street:string,city:string,region:string,postal_code:string,country:string>")(as_text(value_of(df, self.address)).col)
        df = df.withColumn("__p", parts)
        new = {n: F.coalesce(F.col(f"__p.{n}"), ident(n)) if n in df.columns else F.col(f"__p.{n}") for n in ("street", "city", "region", "postal_code", "country")}
        return df.withColumns(new).drop("__p")


@dataclass
class QualityCheck(Stage):
    """Passes rows on and observes their completeness under ``name`` (an ``Observation``)."""

    observation: object = field(default=None, repr=False)
    kind = "quality"

    def apply(self, df: DataFrame) -> DataFrame:
        filled = [F.count(F.when(~is_empty(value_of(df, c)), 1)).alias(f"filled_{c}") for c in data_columns(df)]
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *filled)


STAGES: dict[str, type[Stage]] = {s.kind: s for s in (Rename, Select, Exclude, Transform, Compute, Filter, Lookup, ConvertCurrency, Enrich, FunctionStage, Deduplicate, Normalize, Validate, Analyze, Locate, QualityCheck)}


def register_stage(kind: str, stage: type[Stage]) -> None:
    STAGES[kind] = stage
