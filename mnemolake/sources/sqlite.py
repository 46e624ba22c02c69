"""SQLite files as a Spark data source: a partition for each range of rowids.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").schema("id long, content string").option("table", "messages").load(path)

Tasks open the file read-only by its URI and read their range, some rows at a time, so a
file is never a cell and may be of any size. The schema names the columns to be read;
one that the table lacks is null. The file must lie in a folder that the driver
and all executors mount; ``sqlite_of`` reads files that only Spark reaches.

Options: table, or query (one SELECT, read as one partition a file); rows, of a range (100000);
pushdown (false): comparisons go to SQLite, for which the session must set
``spark.sql.python.filterPushdown.enabled``, as ``sqlite_table`` looks up.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from mnemolake.session import ship

#: SQLite's own rules turn a value into the type that is asked for.
CASTS = {LongType: "INTEGER", IntegerType: "INTEGER", ShortType: "INTEGER", ByteType: "INTEGER", BooleanType: "INTEGER", DoubleType: "REAL", FloatType: "REAL", StringType: "TEXT", BinaryType: "BLOB"}
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows that a task hands on together, and partitions of a file at most.
BATCH, MOST_PARTITIONS = 8192, 100_000


def local_path(path: str) -> str:
    """The mounted path of a file: URI or a plain path."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        url = urlparse(path)
        if url.scheme != "file":
            raise ValueError(f"SQLite files are opened where they lie; {url.scheme}: is no mounted folder")
        return unquote(url.path)
    return path


def opened(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    db.execute("PRAGMA query_only = ON")
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def named(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


@dataclass
class Rowids(InputPartition):
    """Rowids from low up to, not including, high; null: all rows."""

    path: str
    low: int | None
    high: int | None


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options
        self.table, self.query = options.get("table"), options.get("query", "").strip()
        if bool(self.table) == bool(self.query):
            raise ValueError("either a table or a query is asked for")
        if self.query and (not re.match(r"(?i)select\b", self.query) or ";" in self.query):
            raise ValueError("a single SELECT without a semicolon is asked for")
        for f in schema.fields:
            if type(f.dataType) not in CASTS:
                raise ValueError(f"SQLite has no values of type {f.dataType.simpleString()}: {f.name}")
        self.where: list[str] = []
        self.values: list[object] = []

    def _pushed(self, f: Filter) -> tuple[str | None, list[object]]:
        attribute = getattr(f, "attribute", ())
        fields = {x.name: x.dataType for x in self.schema.fields}
        # text is compared byte by byte by both; numbers as the type that the schema gives
        if self.query or len(attribute) != 1 or type(fields.get(attribute[0])) not in (LongType, IntegerType, StringType):
            return None, []
        column = f"CAST({named(attribute[0])} AS {CASTS[type(fields[attribute[0]])]}) COLLATE BINARY"
        plain = lambda v: isinstance(v, (int, str)) and not isinstance(v, bool) and (not isinstance(v, int) or abs(v) < 1 << 63)
        if isinstance(f, IsNull):
            return f"{column} IS NULL", []
        if isinstance(f, IsNotNull):
            return f"{column} IS NOT NULL", []
        if isinstance(f, In) and all(map(plain, f.value)):
            return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if type(f) in COMPARED and plain(f.value):
            return f"{column} {COMPARED[type(f)]} ?", [f.value]
        return None, []

    def files(self) -> list[str]:
        path = local_path(self.options["path"])
        found = [path] if os.path.isfile(path) else sorted(x for x in glob.glob(os.path.join(path, "**") if os.path.isdir(path) else path, recursive=True) if os.path.isfile(x))
        if not found:
            raise FileNotFoundError(path)
        return [x for x in found if not re.search(r"-(?:wal|shm|journal)$|\.crc$|/_SUCCESS$", x)]

    def partitions(self) -> list[InputPartition]:
        rows, out = int(self.options.get("rows", "100000")), []
        for path in self.files():
            if self.query:
                out.append(Rowids(path, None, None))
                continue
            db = opened(path)
            try:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [self.table]).fetchone():
                    continue  # a store of another version has no such table, and so no rows
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {named(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without rowids
                    out.append(Rowids(path, None, None))
                    continue
            finally:
                db.close()
            if low is not None:
                step = max(rows, -(-(high - low + 1) // MOST_PARTITIONS))
                out += [Rowids(path, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out

    def read(self, partition: Rowids) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        if partition is None:
            return
        db = opened(partition.path)
        try:
            if self.query:
                source, has = f"({self.query})", None
            else:
                source = named(self.table)
                has = {r[1] for r in db.execute(f"PRAGMA table_info({source})")} | {"rowid"}
            column = lambda f: f"CAST({named(f.name)} AS {CASTS[type(f.dataType)]})" if has is None or f.name in has else "NULL"
            where, values = list(self.where), list(self.values)
            if has is not None and any(named(f.name) in w for f in self.schema.fields if f.name not in has for w in where):
                source, where, values = self._with_nulls(source, has), list(self.where), list(self.values)
            if partition.low is not None:
                where.append("rowid >= ? AND rowid < ?")
                values += [partition.low, partition.high]
            sql = f"SELECT {', '.join(map(column, self.schema.fields)) or '1'} FROM {source}" + (f" WHERE {' AND '.join(where)}" if where else "")
            rows = db.execute(sql, values)
            while batch := rows.fetchmany(BATCH):
                arrays = [pa.array(map(bool_of, c) if pa.types.is_boolean(f.type) else c, f.type) for c, f in zip(zip(*batch, strict=True), kind, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kind)
        finally:
            db.close()

    def _with_nulls(self, source: str, has: set[str]) -> str:
        """The table with the columns that it lacks, as filters name them."""
        more = [f"NULL AS {named(f.name)}" for f in self.schema.fields if f.name not in has]
        return f"(SELECT rowid, *, {', '.join(more)} FROM {source})"


class PushingReader(SQLiteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of single columns go to SQLite; Spark keeps the others."""
        for f in filters:
            sql, values = self._pushed(f)
            if sql is None:
                yield f
            else:
                self.where.append(sql)
                self.values += values


def bool_of(v: object) -> bool | None:
    return None if v is None else bool(v)


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        raise ValueError("give a schema: its columns are those that are read")

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else SQLiteReader
        return kind(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, rows: int = 100_000) -> DataFrame:
    """The columns that schema names of a table of all SQLite files at path, a partition for
    ``rows`` rowids."""
    ship(spark)
    spark.dataSource.register(SQLiteSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite").schema(schema).option("table", table).option("rows", str(rows)).option("pushdown", pushdown).load(path)


#: Columns of a state database; stores of older versions lack some.
MESSAGES = "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, platform_message_id string, active long"
SESSIONS = "id string, cwd string"


def state_messages(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """Messages of a state database: message_id, conversation_id, role, content, created_at,
    workspace_path, and the store's own ids.

    Inactive messages go, and ones with neither content nor calls. An assistant's message that
    only calls tools is a tool's; a tool's message tells name, call, input and output. Times
    are seconds, or milliseconds if over 10**10. A store whose messages lack a needed column
    or that has no such table has no messages; one without sessions has no workspaces.
    """
    m = sqlite_table(spark, path, "messages", MESSAGES, rows)
    s = sqlite_table(spark, path, "sessions", SESSIONS, rows).filter("id is not null").groupBy(F.col("id").alias("_s")).agg(F.first("cwd", ignorenulls=True).alias("cwd"))
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    m = m.filter("session_id is not null and role in ('user', 'assistant', 'tool', 'system') and (active is null or active <> 0)").filter(filled("content") | filled("tool_calls"))
    role = F.when((F.col("role") == "assistant") & ~filled("content") & filled("tool_calls"), "tool").otherwise(F.col("role"))
    part = lambda label, c: F.when(filled(c), F.concat(F.lit(label), F.col(c)))
    body = F.concat_ws("\n\n", part("Tool: ", "tool_name"), part("Call ID: ", "tool_call_id"), part("Input:\n", "tool_calls"), part("Output:\n", "content"))
    content: Column = F.when(role == "tool", body).when(filled("content"), F.col("content"))
    millis = F.when(F.col("timestamp") > 1e10, F.col("timestamp")).otherwise(F.col("timestamp") * 1000)
    out = m.join(s, F.col("session_id") == F.col("_s"), "left").select(
        F.coalesce("platform_message_id", F.concat("session_id", F.lit(":"), F.col("id").cast("string"))).alias("message_id"),
        F.col("session_id").alias("conversation_id"),
        role.alias("role"),
        content.alias("content"),
        F.timestamp_millis(millis.cast("long")).alias("created_at"),
        F.when(F.col("cwd") != "", F.col("cwd")).alias("workspace_path"),
        F.col("id").alias("store_id"),
        "tool_call_id",
        "tool_name",
    )
    return out.filter("content is not null")
