"""Reading and writing records by the ending of a path, and sources that Spark lacks."""

from __future__ import annotations

import fnmatch
import re
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.operators.stages import SEQ, ident, with_sequence

WRAPPERS = ("items", "records", "data", "results", "rows")
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}


def register_reader(ending: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    """A file ending (``.x``) or a scheme (``x://``)."""
    READERS[ending.lower()] = f


def register_writer(ending: str, f: Callable[[DataFrame, str], None]) -> None:
    WRITERS[ending.lower()] = f


def _pick(table: dict, path: str):
    scheme = re.match(r"^\w+://", path)
    if scheme and scheme[0] in table:
        return table[scheme[0]]
    name = path.split("?")[0].rstrip("/").lower().removesuffix(".gz")
    found = next((f for e, f in sorted(table.items(), key=lambda x: -len(x[0])) if name.endswith(e)), None)
    if found is None:
        raise ValueError(f"no reader or writer for {path}; there are {', '.join(sorted(table))}")
    return found


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of a file or folder; ``limit`` keeps the first ones."""
    df = _pick(READERS, path)(spark, path)
    return df if limit is None else with_sequence(df).orderBy(SEQ).limit(limit).drop(SEQ)


def write_records(df: DataFrame, path: str) -> None:
    _pick(WRITERS, path)(df, path)


def find_records(df: DataFrame, limit: int | None = None, **where) -> DataFrame:
    """Rows whose fields, as text, equal the given values."""
    for k, v in where.items():
        df = df.filter(ident(k).cast("string") == str(v))
    return df if limit is None else df.limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object a line; blank lines are skipped, anything else that is no object fails."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, an object that wraps one under a usual name, or one object."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    for w in WRAPPERS:
        if w in df.columns and isinstance(df.schema[w].dataType, T.ArrayType) and isinstance(df.schema[w].dataType.elementType, T.StructType):
            return df.select(F.explode(w).alias("r")).select("r.*")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and texts; surplus cells are dropped."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path, inferSchema=False)


def column_names(names: list[str], most: int = 55) -> dict[str, str]:
    """Names safe for stores: letters, digits and _, lower case, at most 55 long, ``_2`` on a clash."""
    out: dict[str, str] = {}
    for n in names:
        base = re.sub(r"[^0-9a-zA-Z_]+", "_", n).strip("_").lower()[:most] or "field"
        base = "_" + base if base[0].isdigit() else base
        name, i = base, 2
        while name in out.values():
            name, i = f"{base}_{i}", i + 1
        out[n] = name
    return out


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; columns without a type as text."""
    out = []
    for f in df.schema.fields:
        c = ident(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.select(*[ident(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else ident(f.name) for f in df.schema.fields]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Each part file is one JSON array, a record a line; ``read_json`` reads the folder. Nothing is collected."""

    def run(batches):
        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + r for i, r in enumerate(rows)])], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    df.select(F.to_json(F.struct(*[ident(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def upsert(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key at the place of its first occurrence, each field from the last record that has it;
    records with a null key stay rows of their own. Combined before the shuffle."""
    rows = with_sequence(df)
    whole = F.lit(True)
    for k in key:
        whole = whole & ident(k).isNotNull()
    rest = [c for c in df.columns if c not in key and c != SEQ]
    merged = rows.filter(whole).groupBy(*[ident(k) for k in key]).agg(F.min(SEQ).alias(SEQ), *[F.max_by(ident(c), F.when(ident(c).isNotNull(), F.col(SEQ))).alias(c) for c in rest])
    return merged.unionByName(rows.filter(~whole).select(*key, SEQ, *rest)).select(*df.columns, *([] if SEQ in df.columns else [SEQ]))


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


_SQLITE = {"INTEGER": "bigint", "BIGINT": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "TEXT": "string", "VARCHAR": "string", "JSON": "string"}


class SQLiteSource(DataSource):
    """Tables of an SQLite file (reachable by every executor), read in ranges of rowid. Format ``loom_sqlite``.

    Options: ``path``, ``table`` (``items``), ``partitions``.
    """

    @classmethod
    def name(cls) -> str:
        return "loom_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            rows = con.execute(f'PRAGMA table_info("{self.options.get("table", "items")}")').fetchall()
        if not rows:
            raise ValueError("there is no such table")
        return ", ".join(f"`{r[1]}` {_SQLITE.get(r[2].upper().split('(')[0], 'string')}" for r in rows)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SQLiteReader(dict(self.options), schema)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.parts, self.schema = options["path"], options.get("table", "items"), int(options.get("partitions", 4)), schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.schema.fields]
        names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for r in con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high)):
                yield tuple(None if v is None else bool(v) if isinstance(k, T.BooleanType) else float(v) if isinstance(k, T.DoubleType) else str(v) if isinstance(k, T.StringType) else v for v, k in zip(r, kinds))


def _arrow(result, whole: bool = False):
    """The Arrow batches of a DuckDB result (its table with ``whole``), by the names of either major version."""
    if whole:
        yield (result.to_arrow_table if hasattr(result, "to_arrow_table") else result.fetch_arrow_table)()
    else:
        yield from (result.to_arrow_reader if hasattr(result, "to_arrow_reader") else result.fetch_record_batch)(10_000)


class DuckDBSource(DataSource):
    """Tables of a DuckDB file, as Arrow batches. Format ``loom_duckdb``. Options: ``path``, ``table``."""

    @classmethod
    def name(cls) -> str:
        return "loom_duckdb"

    def _table(self, con) -> str:
        names = [r[0] for r in con.execute("SHOW TABLES").fetchall()]
        t = self.options.get("table") or ("items" if "items" in names else names[0] if len(names) == 1 else None)
        if t not in names:
            raise ValueError(f"choose a table of {', '.join(names)}")
        return t

    def schema(self) -> T.StructType:
        import duckdb
        from pyspark.sql.pandas.types import from_arrow_schema

        with duckdb.connect(self.options["path"], read_only=True) as con:
            return from_arrow_schema(next(_arrow(con.execute(f'SELECT * FROM "{self._table(con)}" LIMIT 0'), whole=True)).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DuckDBReader(self.options["path"], self.options.get("table"), self)


class _DuckDBReader(DataSourceReader):
    def __init__(self, path: str, table: str | None, source: DuckDBSource) -> None:
        import duckdb

        self.path = path
        with duckdb.connect(path, read_only=True) as con:
            self.table = source._table(con)

    def read(self, partition) -> Iterator:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as con:
            yield from _arrow(con.execute(f'SELECT * FROM "{self.table}"'))


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(SQLiteSource)
    spark.dataSource.register(DuckDBSource)


def _sqlite(spark: SparkSession, path: str) -> DataFrame:
    register_sources(spark)
    return spark.read.format("loom_sqlite").option("path", path).load()


def _duckdb(spark: SparkSession, path: str) -> DataFrame:
    register_sources(spark)
    return spark.read.format("loom_duckdb").option("path", path).load()


def write_sqlite(df: DataFrame, path: str, table: str = "items", key: list[str] | None = None, batch: int = 1000) -> None:
    """Rows into an SQLite file on the driver, in batches as they come (an upsert with ``key``): for results
    that one file can hold; nothing is gathered in memory."""
    df = flat_columns(df)
    names = column_names(df.columns)
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.BooleanType: "BOOLEAN"}
    cols = ", ".join(f'"{names[f.name]}" {kinds.get(type(f.dataType), "TEXT")}' for f in df.schema.fields)
    unique = f", UNIQUE ({', '.join(names[k] for k in key)})" if key else ""
    sets = ", ".join(f'"{n}" = coalesce(excluded."{n}", "{n}")' for c, n in names.items() if c not in (key or []))
    conflict = f" ON CONFLICT ({', '.join(names[k] for k in key)}) DO UPDATE SET {sets}" if key and sets else " ON CONFLICT DO NOTHING" if key else ""
    with sqlite3.connect(path) as con:
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({cols}{unique})')
        sql = f'INSERT INTO "{table}" ({", ".join(chr(34) + n + chr(34) for n in names.values())}) VALUES ({", ".join("?" * len(names))}){conflict}'
        rows = []
        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(v if v is None or isinstance(v, (int, float, str, bytes)) else str(v) for v in r))
            if len(rows) >= batch:
                con.executemany(sql, rows)
                rows = []
        con.executemany(sql, rows)


def read_sitemap(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """``(loc, lastmod)`` of sitemap files (gzipped or not); ``since`` keeps what changed from then on."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, changefreq string, priority double").load(path)
    out = df.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"), F.col("priority"))
    return out if since is None else out.filter(F.col("lastmod").isNull() | (F.col("lastmod").try_cast("timestamp") >= F.lit(since).cast("timestamp")))


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """PostgreSQL, MySQL and others by JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    flat_columns(df).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


for _ending, _reader in ((".jsonl", read_jsonl), (".ndjson", read_jsonl), (".json", read_json), (".csv", read_csv), (".parquet", lambda s, p: s.read.parquet(p)), (".sqlite", _sqlite), (".db", _sqlite), (".duckdb", _duckdb), (".xml", read_sitemap)):
    register_reader(_ending, _reader)
for _ending, _writer in ((".json", write_json_array), (".jsonl", write_jsonl), (".ndjson", write_jsonl), (".csv", write_csv), (".parquet", write_parquet), (".sqlite", write_sqlite)):
    register_writer(_ending, _writer)
