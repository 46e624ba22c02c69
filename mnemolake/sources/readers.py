"""History readers and bundle files.

Lines are read as text and parsed in the plan, so a malformed one costs itself and not
the scan. Where order matters, rows carry the file and the place in it.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import ranges as R


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, line_no, line): every line of text files with its number from 0 in its file.

    Files are read in byte ranges, as Spark splits them, so one file goes to many tasks; range
    is where a line's byte range begins. A first pass counts the lines of each range, and
    running sums of the counts number them: no task orders a file. Lines end with a line
    feed, or with a carriage return before it; compressed files are one range.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    # rows of a range stand together, in order: their ids count up by one
    rows = text.select(*at, F.monotonically_increasing_id().alias("_row"), "value")
    sizes = rows.groupBy("file", "range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("range")) - F.col("_n")
    known = sizes.select("file", "range", (before - F.col("_first")).alias("_shift"))
    lines = rows.join(known, ["file", "range"])
    return lines.select("file", "range", (F.col("_row") + F.col("_shift")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, line_no, json) of the lines that hold an object; others are skipped."""
    return _objects(text_lines(spark, path).withColumnRenamed("line", "json"))


def _objects(lines: DataFrame) -> DataFrame:
    return lines.filter(F.try_parse_json("json").isNotNull() & F.trim("json").startswith("{"))


def pack(lines: DataFrame, file: Column, order: Sequence[str], path: str) -> None:
    """Writes the lines (line) of many small files as packs: text files whose lines bear the name
    of their file and a tab. A file's lines stand in one pack, in order; the number of packs
    grows with the bytes, not with the files."""
    named = lines.withColumn("_file", file)
    named.repartition("_file").sortWithinPartitions("_file", *order).select(F.concat("_file", F.lit("\t"), F.coalesce("line", F.lit("")))).write.text(path)


def packed_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As json_lines, of the files in packs: file is the name that a line bears, line_no rises
    with a line's place in its file, as it is the place in the pack."""
    lines, parts = text_lines(spark, path), F.split("line", "\t", 2)
    return _objects(lines.select(F.get(parts, 0).alias("file"), "range", "line_no", F.get(parts, 1).alias("json")))


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines, but a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, records: str) -> DataFrame:
    """The objects of a nested array, e.g. '$.data.items'."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json(F.get_json_object("value", records), "array<string>")).alias("json"))


def recipe(lines: DataFrame, source: str, fields: dict[str, str], roles: dict[str, str]) -> DataFrame:
    """Maps paths to messages: id, conversation_id, role, text, at. Unknown roles go; an id
    that is missing is a hash of what the row holds; a bad time fails."""
    get = lambda n: F.get_json_object("json", fields[n]) if n in fields else F.lit(None).cast("string")
    role = F.lit(None).cast("string")
    for k, v in roles.items():
        role = F.when(F.lower(get("role")) == k, v).otherwise(role)
    ident = F.coalesce(get("id"), F.substring(F.sha2(F.concat_ws(chr(31), F.lit(source), get("conversation"), get("role"), get("text"), get("at")), 256), 1, 24))
    return lines.select(F.lit(source).alias("source"), ident.alias("id"), get("conversation").alias("conversation_id"), role.alias("role"), get("text").alias("text"), F.to_timestamp(get("at")).alias("at")).filter("role is not null")


def with_carried_session(lines: DataFrame) -> DataFrame:
    """A row of type session sets id and cwd for the rows after it; a range of a file takes over
    what the ranges before it have set last."""
    is_session = F.coalesce(F.get_json_object("json", "$.type") == "session", F.lit(False))
    of = lambda path: F.when(is_session, F.get_json_object("json", path))
    return R.carried(lines, ["file"], ["line_no"], {"session_id": of("$.id"), "cwd": of("$.cwd")}).filter(~is_session)


def with_tool_names(lines: DataFrame) -> DataFrame:
    """The name of a call goes to its result, by call id within the file."""
    call = F.get_json_object("json", "$.call_id")
    named = lines.select("file", call.alias("call_id"), F.get_json_object("json", "$.name").alias("tool_name")).filter("call_id is not null and tool_name is not null").dropDuplicates(["file", "call_id"])
    return lines.withColumn("call_id", call).join(named, ["file", "call_id"], "left")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that a source may lack become nulls of the given type."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def messages_with_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages that are not empty, with their conversation's columns if it is known."""
    c = conversations.select(F.col("id").alias("_c"), "workspace_path", "git_root")
    return messages.filter(F.trim(F.coalesce("content", F.lit(""))) != "").join(c, F.col("conversation_id") == F.col("_c"), "left").drop("_c").orderBy("conversation_id", "created_at", "id")


def active_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.coalesce("dedup_status", F.lit("active")) == "active")


def gathered_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Text parts per message, in time order."""
    text = parts.filter("type = 'text'").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "id", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return messages.join(text, messages["id"] == text["message_id"], "left").drop("message_id")


def item_messages(items: DataFrame, key: Column, path: str = "$.messages") -> DataFrame:
    """Key-value rows whose JSON value holds an array of messages."""
    return items.filter(key).select("key", F.posexplode(F.from_json(F.get_json_object("value", path), "array<string>")).alias("no", "json"))


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """One read-only SELECT over SQLite files that Spark can reach, which it ships as binaries
    of under 2 GiB each."""
    if ";" in query or not query.strip().lower().startswith("select"):
        raise ValueError("a single SELECT without a semicolon is asked for")

    return sqlite_of(spark.read.format("binaryFile").load(path).select("content"), query, schema)


def sqlite_of(files: DataFrame, query: str, schema: str, rows: int = 10_000) -> DataFrame:
    """The rows that one read-only SELECT gives of each file (content), some at a time. A file is
    opened by the task that reads it, in memory, so it must fit one."""

    def run(batches):  # noqa: ANN001, ANN202
        import sqlite3

        for pdf in batches:
            for raw in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(raw))
                db.execute("PRAGMA query_only = ON")
                yield from pd.read_sql_query(query, db, chunksize=rows)
                db.close()

    return files.select("content").mapInPandas(run, schema)


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of plain or zstd-framed text files."""

    @F.pandas_udf("string")
    def opened(raw: pd.Series) -> pd.Series:
        import zstandard

        def one(b: bytes) -> str:
            b = bytes(b)
            if b[:4] == b"\x28\xb5\x2f\xfd":
                b = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b), read_across_frames=True).read()
            return b.decode("utf-8", "replace")

        return raw.map(one)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), opened("content").alias("text"))


def text_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*", most_bytes: int = 2 << 20) -> DataFrame:
    """(file, at, text) of files that are no larger and, by their first 1024 bytes, not binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path)).filter(F.col("length") <= most_bytes)
    text = files.filter(~F.contains(F.substring("content", 1, 1024), F.lit(bytearray(b"\x00"))))
    return text.select(F.col("path").alias("file"), F.col("modificationTime").alias("at"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def found_lines(texts: DataFrame, pattern: str, fixed: bool = False, context: int = 0) -> DataFrame:
    """(file, line_no, line, context, at) of the matching lines of text files."""
    lines = texts.select("file", "at", F.split("text", "\n").alias("ls")).select("file", "at", "ls", F.posexplode("ls").alias("no", "line"))
    hit = F.contains(F.col("line"), F.lit(pattern)) if fixed else F.col("line").rlike(pattern)
    around = F.slice("ls", F.greatest(F.col("no") + 1 - context, F.lit(1)), F.least(F.lit(2 * context + 1), F.col("no") + 1 + context)) if context else F.array("line")
    return lines.filter(hit).select("file", (F.col("no") + 1).alias("line_no"), "line", around.alias("context"), "at")


def grep(spark: SparkSession, path: str, pattern: str, glob: str = "*", most_bytes: int = 2 << 20, fixed: bool = False, context: int = 0) -> DataFrame:
    """(file, line_no, line, context, at) of matching lines. As the tool that this stands for
    does, it skips binary files (a NUL byte in their first 1024) and, where that is a feature
    of a search through a workspace, files of over most_bytes. ``trigrams`` searches by an index."""
    return found_lines(text_files(spark, path, glob, most_bytes), pattern, fixed, context)


def find_files(spark: SparkSession, path: str, glob: str, limit: int | None = 100) -> DataFrame:
    """The newest files, newest first; without a limit all of them, in no order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    found = found.select("path", "length", "modificationTime")
    return found if limit is None else found.orderBy(F.desc("modificationTime"), "path").limit(limit)


def federated(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several stores, without deleted ones."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.filter("deleted_at is null and status <> 'deleted'")


def export_bundle(tables: dict[str, DataFrame], folder: str, redact: dict[str, Sequence[str]] | None = None) -> None:
    """Each table as JSON lines; the columns named in redact are nulled."""
    from mnemolake.operators.lifecycle import redact_bundle

    for name, df in tables.items():
        redact_bundle(df, list((redact or {}).get(name, ()))).write.mode("overwrite").json(f"{folder}/{name}")
