"""Sources and sinks: text files, conversation logs and exports, the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "session_id string, timestamp string, role string, text string, seq long"


def text_files(spark: SparkSession, path: str, in_order: bool = False) -> DataFrame:
    """path and text, a row for each whole file; in order of their paths if asked."""
    found = _text_files(spark, path)
    return found.orderBy("path") if in_order else found


def _text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def content_text(content: Column) -> Column:
    """A JSON string, or the text blocks of a JSON array, joined; trimmed."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    said = F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
    return F.trim(F.when(content.startswith("["), F.array_join(F.transform(said, lambda b: b["text"]), "\n\n")).otherwise(content))


def log_turns(whole: DataFrame) -> DataFrame:
    """Turns of event logs (value, the file's text; file, its name), one JSON object a line: user and assistant events; lines that can't be read are skipped.

    A session without an id has its file's name; seq is the line's number in its file.
    """
    raw = whole.select("file", F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    j = F.col("value")
    ok = raw.where((F.trim(j) != "") & F.try_parse_json(j).isNotNull()).where(F.get_json_object(j, "$.type").isin("user", "assistant"))
    stem = F.regexp_replace("file", r"\.jsonl\z", "")
    return ok.select(
        F.coalesce(F.get_json_object(j, "$.sessionId"), stem).alias("session_id"), F.coalesce(F.get_json_object(j, "$.timestamp"), F.lit("")).alias("timestamp"),
        F.get_json_object(j, "$.type").alias("role"), content_text(F.get_json_object(j, "$.message.content")).alias("text"), F.col("seq").cast("long").alias("seq"), "file",
    )


def jsonl_turns(spark: SparkSession, path: str) -> DataFrame:
    """log_turns() of the files at path."""
    return log_turns(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")))


def export_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON exports: an array of conversations, or an object with one under `conversations`; either naming of the fields."""
    one = "struct<sender:string,role:string,text:string,content:string,created_at:string,timestamp:string>"
    conv = f"struct<uuid:string,id:string,chat_messages:array<{one}>,messages:array<{one}>>"
    whole = text_files(spark, path).select("path", F.trim("text").alias("j"))
    listed = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{conv}>")).otherwise(F.from_json("j", f"struct<conversations:array<{conv}>>")["conversations"])
    convs = whole.select("path", F.posexplode(listed).alias("c", "conv"))
    said = convs.select("path", "c", "conv.uuid", "conv.id", F.posexplode(F.coalesce("conv.chat_messages", "conv.messages")).alias("seq", "m"))
    role = F.coalesce("m.sender", "m.role")
    return said.select(
        F.coalesce("uuid", "id", F.concat_ws("#", "path", "c")).alias("session_id"), F.coalesce("m.created_at", "m.timestamp", F.lit("")).alias("timestamp"),
        F.when(role == "human", "user").otherwise(role).alias("role"), content_text(F.coalesce("m.text", "m.content")).alias("text"), F.col("seq").cast("long").alias("seq"),
    )


def archive_lines(turns: DataFrame) -> DataFrame:
    """value: `=== time  [source:session] ===` blocks, to write with .write.text()."""
    head = F.concat(F.lit("=== "), F.col("timestamp"), F.lit("  ["), F.col("source"), F.lit(":"), F.substring("session_id", 1, 8), F.lit("] ===\n"))
    said = F.concat(F.lit("User: "), F.col("user_text"), F.when(F.col("assistant_text") != "", F.concat(F.lit("\n\nAssistant: "), F.col("assistant_text"))).otherwise(""))
    return turns.select(F.concat(head, said, F.lit("\n")).alias("value"))


#: The line that begins an archived turn: time, source, first letters of the session.
_HEAD = r"=== ([^\n]*?)  \[([^:\]\n]*):([^\]\n]*)\] ==="


def archive_turns(whole: DataFrame) -> DataFrame:
    """timestamp, source, session (its first letters), user_text, assistant_text, and place of the blocks in archived texts (value): the inverse of archive_lines().

    A block begins with its header line and ends before the next one; a text that looks like a header can't be told from one.
    """
    blocks = F.filter(F.split(F.concat(F.lit("\n"), "value"), rf"\n(?={_HEAD}\n)"), lambda b: b != "")
    each = whole.select(F.posexplode(blocks).alias("place", "block"))
    first = F.substring_index("block", "\n", 1)
    body = F.regexp_replace(F.substring("block", F.length(first) + 2, F.length("block")), r"\n+\z", "")
    at = F.instr(body, "\n\nAssistant: ")
    user = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    reply = F.when(at > 0, F.substring(body, at + 13, F.length("block"))).otherwise("")
    head = [F.regexp_extract(first, _HEAD, i + 1).alias(c) for i, c in enumerate(("timestamp", "source", "session"))]
    return each.where(first.rlike(_HEAD)).select(*head, F.regexp_replace(user, r"\AUser: ", "").alias("user_text"), reply.alias("assistant_text"), "place")
