"""Token streams: server-sent event chunks to text, as a batch and as a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = "[DONE]"


def parse_events(buffer: str) -> tuple[list[str], bool, str]:
    """(deltas, done, rest) of what has arrived: events end at a blank line; data lines hold JSON; what can't be read is skipped."""
    deltas: list[str] = []
    done = False
    while True:
        cut, size = buffer.find("\n\n"), 2
        if cut < 0:
            cut, size = buffer.find("\r\n\r\n"), 4
        if cut < 0:
            return deltas, done, buffer
        event, buffer = buffer[:cut], buffer[cut + size :]
        for line in event.split("\n"):
            line = line.rstrip("\r")
            if not line.startswith("data:"):
                continue
            said = line[5:].removeprefix(" ")
            if said == DONE:
                done = True
                continue
            try:
                delta = json.loads(said)["choices"][0]["delta"]["content"]
            except (ValueError, LookupError, TypeError):
                continue
            if isinstance(delta, str):
                deltas.append(delta)


def delta_of(data: Column, path: str = "choices[0].delta.content", type_field: str | None = None, type_value: str | None = None) -> Column:
    """The text that an event's JSON adds: the string at path, empty if it isn't one or the type differs."""
    v = F.try_variant_get(F.try_parse_json(data), "$." + path, "variant")
    said = F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))
    return said if type_field is None else F.when(F.coalesce(F.get_json_object(data, "$." + type_field) == type_value, F.lit(False)), said).otherwise("")


def is_stop(line: Column, stop: str = DONE, type_field: str = "type") -> Column:
    """Whether a line ends its stream: it is the stop word as data, or its JSON is of that type."""
    bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    typed = F.get_json_object(F.substring(bare, 7, 1 << 30), "$." + type_field) == stop
    return (bare == f"data: {stop}") | (bare.startswith("data: ") & F.coalesce(typed, F.lit(False)))


def line_deltas(chunks: DataFrame, path: str = "choices[0].delta.content", type_field: str | None = None, type_value: str | None = None, stop: str = DONE) -> DataFrame:
    """stream_id, place, delta and stopped of chunks (stream_id, seq, chunk), line by line as a client reads them.

    Lines end at a newline, blanks around them go; those that don't begin with "data: " are skipped, as is a last one
    without an end; a stop line says nothing. Text that comes after a stop line is still read.
    """
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("raw"))
    lines = F.split("raw", "\n")
    ended = whole.select("stream_id", F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("place", "line")).withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))
    data = ended.where(F.col("line").startswith("data: "))
    stopped = is_stop(F.col("line"), stop, type_field or "type")
    said = delta_of(F.substring("line", 7, 1 << 30), path, type_field, type_value)
    return data.select("stream_id", "place", F.when(stopped, "").otherwise(said).alias("delta"), stopped.alias("stopped"))


def flushed(states: DataFrame) -> DataFrame:
    """session_id, role, text to store for states (session_id, status, user_text, user_flushed, pending): what a stream leaves when it ends.

    Only an answer with a 2xx status leaves anything; the user's message is stored with the first flush alone, and pending text
    as another message of the assistant.
    """
    ok = states.where(F.col("status").between(200, 299) & (F.col("pending") != ""))
    first = ok.where(~F.col("user_flushed")).select("session_id", F.lit("user").alias("role"), F.col("user_text").alias("text"))
    return first.unionByName(ok.select("session_id", F.lit("assistant").alias("role"), F.col("pending").alias("text")))


def accumulate(chunks: DataFrame) -> DataFrame:
    """stream_id, text, done of chunks (stream_id, seq, chunk), whole: the batch twin of accumulate_stream."""
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("raw"))
    events = F.split(F.regexp_replace("raw", "\r\n", "\n"), "\n\n")
    complete = F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0)))
    lines = F.filter(F.flatten(F.transform(complete, lambda e: F.split(e, "\n"))), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", ""))
    return whole.select("stream_id", F.array_join(F.transform(data, lambda d: F.when(d == DONE, "").otherwise(delta_of(d))), "").alias("text"), F.array_contains(data, DONE).alias("done"))


def accumulate_stream(chunks: DataFrame, flush_seconds: int = 8) -> DataFrame:
    """stream_id, text, final: pending text of each stream, when it ends or pauses for so long. Chunks are taken in order of seq within a micro-batch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, pending, done = state.get if state.exists else ("", "", False)
        if state.hasTimedOut:
            if pending:
                yield pd.DataFrame({"stream_id": [key[0]], "text": [pending], "final": [False]})
            state.update((buffer, "", done))
            return
        got = pd.concat(list(frames)).sort_values("seq")
        deltas, ended, buffer = parse_events(buffer + "".join(got["chunk"]))
        pending += "".join(deltas)
        if ended:
            yield pd.DataFrame({"stream_id": [key[0]], "text": [pending], "final": [True]})
            state.remove()
            return
        state.update((buffer, pending, done))
        state.setTimeoutDuration(flush_seconds * 1000)

    return chunks.groupBy("stream_id").applyInPandasWithState(take, "stream_id string, text string, final boolean", "buffer string, pending string, done boolean", "append", "ProcessingTimeTimeout")
