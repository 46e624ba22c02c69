"""Agents' session files as messages: one converter for each shape of line.

All take numbered JSON lines (readers.json_lines) and give file, message_id,
conversation_id, role, content, created_at, workspace_path, in the order of files and lines.
Lines of other kinds, and those without visible text, go. Times that cannot be read are
the epoch, as the sources' own tools have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.ranges import numbered
from mnemolake.sources.readers import with_carried_session

COLUMNS = ("file", "message_id", "conversation_id", "role", "content", "created_at", "workspace_path")
_EPOCH = "1970-01-01T00:00:00Z"


def _get(path: str, json: str = "json") -> Column:
    return F.get_json_object(json, path)


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def file_stem(file: Column) -> Column:
    """A file's name without its folder and extensions of sessions."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.(?:jsonl|txt)(?:\.zstd)?$", "")


def read_time(value: Column) -> Column:
    """ISO text, or seconds or milliseconds as a number."""
    number = value.try_cast("double")
    millis = F.when(number > 1e10, number).otherwise(number * 1000)
    return F.coalesce(F.timestamp_millis(millis.cast("long")), F.try_to_timestamp(value), F.lit(_EPOCH).cast("timestamp"))


def visible_text(content: Column) -> Column:
    """A string, or the text blocks of an array, line by line; null if there is none."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.trim(b["text"])), lambda t: t != "")
    array = F.trim(content).startswith("[") & blocks.isNotNull()
    return F.when(array, _filled(F.array_join(texts, "\n"))).otherwise(_filled(content))


def _messages(lines: DataFrame, message_id: Column, conversation: Column, role: Column, content: Column, at: Column, workspace: Column) -> DataFrame:
    ident = F.coalesce(message_id, F.concat(conversation, F.lit(":"), F.col("line_no").cast("string")))
    out = lines.select("file", "line_no", ident.alias("message_id"), conversation.alias("conversation_id"), role.alias("role"), content.alias("content"), read_time(at).alias("created_at"), workspace.alias("workspace_path"))
    return out.filter("role is not null and content is not null").orderBy("file", "line_no").select(*COLUMNS)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines numbered from 1 among those of their file that hold an object."""
    return numbered(lines, ["file"], ["line_no"], "_no").withColumn("line_no", F.col("_no") + 1).drop("_no")


def transcripts(lines: DataFrame) -> DataFrame:
    """{type: user | assistant, message: {content}, sessionId, uuid, cwd, timestamp}."""
    kind = _get("$.type")
    own = F.coalesce(_get("$.sessionId"), F.lit("unknown-session"))
    return _messages(numbered_lines(lines), _get("$.uuid"), own, F.when(kind.isin("user", "assistant"), kind), visible_text(_get("$.message.content")), _get("$.timestamp"), _get("$.cwd"))


def rollouts(lines: DataFrame) -> DataFrame:
    """{type: response_item, payload: {type: message | function_call | function_call_output}}:
    tools' calls and results are messages too; a result bears the name that its call, by id
    in the same file, was given."""
    rows = numbered_lines(lines).filter(_get("$.type") == "response_item")
    kind = F.regexp_replace(_get("$.payload.type"), "^custom_tool_call", "function_call")
    call = F.coalesce(_get("$.payload.call_id"), _get("$.payload.id"))
    rows = rows.withColumns({"kind": kind, "call": call})
    named = rows.filter("kind = 'function_call' and call is not null").select(F.col("file").alias("_f"), F.col("call").alias("_c"), F.coalesce(_get("$.payload.name"), F.lit("tool")).alias("called"), "line_no")
    named = named.groupBy("_f", "_c").agg(F.max_by("called", "line_no").alias("called"))
    rows = rows.join(named, (F.col("file") == F.col("_f")) & (F.col("call") == F.col("_c")), "left")
    said = _get("$.payload.role")
    role = F.when(F.col("kind") == "message", F.when(said == "developer", "system").when(said.isin("user", "assistant", "system"), said)).when(F.col("kind").isin("function_call", "function_call_output", "web_search_call"), "tool")
    name = F.when(F.col("kind") == "web_search_call", "web_search").otherwise(F.coalesce("called", _get("$.payload.name"), F.lit("tool")))
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label + ": "), c))
    sent = F.when(F.col("kind") == "web_search_call", _get("$.payload.action")).otherwise(F.coalesce(_get("$.payload.arguments"), _get("$.payload.input")))
    back = F.coalesce(_get("$.payload.output"), _get("$.payload.result"))
    tool = F.concat_ws("\n", F.concat(F.lit("Tool: "), name), part("Call ID", F.col("call")), part("Status", _get("$.payload.status")), part("Input", F.when(F.col("kind") != "function_call_output", sent)), part("Output", F.when(F.col("kind") == "function_call_output", back)))
    content = F.when(F.col("kind") == "message", visible_text(_get("$.payload.content"))).otherwise(tool)
    return _messages(rows, F.lit(None).cast("string"), file_stem(F.col("file")), role, content, _get("$.timestamp"), F.lit(None).cast("string"))


def carried_sessions(lines: DataFrame) -> DataFrame:
    """{type: session, id, cwd} sets both for the messages after it; {type: message, message:
    {role: user | assistant | toolResult, content}}."""
    rows = with_carried_session(numbered_lines(lines)).filter(_get("$.type") == "message")
    said = _get("$.message.role")
    role = F.when(said == "toolResult", "tool").when(said.isin("user", "assistant"), said)
    text = visible_text(_get("$.message.content"))
    content = F.when(role == "tool", F.concat(F.lit("Tool: "), F.coalesce(_get("$.message.toolName"), F.lit("tool")), F.lit("\n\n"), text)).otherwise(text)
    own = F.coalesce(_get("$.sessionId"), F.col("session_id"), file_stem(F.col("file")))
    return _messages(rows, _get("$.id"), own, role, content, F.coalesce(_get("$.timestamp"), _get("$.message.timestamp")), F.coalesce(_get("$.cwd"), F.col("cwd")))


def envelopes(lines: DataFrame) -> DataFrame:
    """{type, message: {role, content}, isSidechain, origin: {kind}}: side chains go, and what
    users did not write themselves."""
    said = F.coalesce(_get("$.message.role"), _get("$.type"))
    role = F.when(said.isin("user", "assistant", "system"), said)
    aside = F.coalesce(_get("$.isSidechain") == "true", F.lit(False))
    written = (role != "user") | _get("$.origin").isNull() | F.coalesce(_get("$.origin.kind") == "human", F.lit(False))
    own = F.coalesce(_get("$.sessionId"), file_stem(F.col("file")))
    return _messages(numbered_lines(lines).filter(~aside & F.coalesce(written, F.lit(False))), _get("$.uuid"), own, role, visible_text(_get("$.message.content")), F.coalesce(_get("$.timestamp"), _get("$.message.timestamp")), _get("$.cwd"))


def loose_messages(lines: DataFrame) -> DataFrame:
    """A message is the row itself, its payload or its message, whichever has a role; ids of
    conversations are sought in both, then in the file's name."""
    at = lambda p: F.coalesce(_get(f"$.{p}"), _get(f"$.payload.{p}"), _get(f"$.message.{p}"))
    said = at("role")
    role = F.when(said.isin("user", "assistant", "tool", "system"), said)
    own = F.coalesce(at("conversationId"), at("sessionId"), file_stem(F.col("file")))
    time = F.coalesce(at("createdAt"), at("timestamp"))
    return _messages(numbered_lines(lines), F.coalesce(at("messageId"), at("id")), own, role, visible_text(at("content")), time, F.coalesce(at("cwd"), at("workspacePath")))


def framed_sessions(lines: DataFrame) -> DataFrame:
    """{type: session, id, cwd} holds for its whole file; {type: user/message, data: {role, source:
    {kind: user}, content}} and {type: assistant/message, data: {message}}."""
    is_head = _get("$.type") == "session"
    head = lines.filter(is_head).groupBy(F.col("file").alias("_f")).agg(F.min_by(F.struct(_get("$.id").alias("id"), _get("$.cwd").alias("cwd")), "line_no").alias("h"))
    kind = _get("$.type")
    user = (kind == "user/message") & (_get("$.data.source.kind") == "user")
    inner = F.when(user, _get("$.data")).when(kind == "assistant/message", _get("$.data.message"))
    rows = numbered_lines(lines).withColumn("inner", inner).join(head, F.col("file") == F.col("_f"), "left").filter("inner is not null")
    said = _get("$.role", "inner")
    own = F.coalesce(F.col("h.id"), file_stem(F.col("file")))
    ident = F.coalesce(_get("$.id", "inner"), F.concat(own, F.lit(":"), _get("$.seq")))
    return _messages(rows, ident, own, F.when(said.isin("user", "assistant"), said), visible_text(_get("$.content", "inner")), _get("$.time"), F.col("h.cwd"))
