"""Conversations: pairing of turns, renderings, windows over turns, idle sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what stands between the two sides of a stored exchange.
BETWEEN = "\n\u001f\n"


def pair_turns(turns: DataFrame, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """session, seq, user_text, assistant_text: each user turn with the assistant turn next to it, else with an empty one.

    Other roles and blank texts don't count; assistant turns that follow no user turn are dropped.
    """
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim(F.col("text")) != ""))
    w = Window.partitionBy(session).orderBy(seq)
    out = said.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w)).where("role = 'user'")
    reply = F.when(F.col("_role") == "assistant", F.col("_text")).otherwise("")
    return out.select(session, seq, F.trim("text").alias("user_text"), F.trim(reply).alias("assistant_text"))


def rendered_turn(user: Column, assistant: Column) -> Column:
    return F.when(assistant != "", F.concat(F.lit("User: "), user, F.lit("\n\nAssistant: "), assistant)).otherwise(F.concat(F.lit("User: "), user))


def exchange(user: Column, assistant: Column) -> Column:
    return F.concat(user, F.lit(BETWEEN), assistant)


def exchange_parts(text: Column) -> tuple[Column, Column]:
    """user and assistant of an exchange, at its first separator; one newline beside it goes; without one all is the user's."""
    at = F.instr(text, "\u001f")
    user = F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\n\z", "")).otherwise(text)
    return user, F.when(at > 0, F.regexp_replace(F.substring(text, at + 1, F.length(text)), r"\A\n", "")).otherwise("")


def in_order(session: str, seq: str, line: Column) -> list[Column]:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), line.alias("line"))))
    return [F.array_join(F.transform(ordered, lambda x: x["line"]), "")]


def render(pairs: DataFrame, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """session and its pairs as Markdown, in order."""
    line = F.concat(F.lit("**User:** "), F.col("user_text"), F.lit("\n\n**Assistant:** "), F.col("assistant_text"), F.lit("\n\n"))
    return pairs.groupBy(session).agg(in_order(session, seq, line)[0].alias("rendered"))


def last_turns(turns: DataFrame, most: int, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """What a model is sent: system turns, and the last 2 * most others."""
    others = Window.partitionBy(session).orderBy(F.col(seq).desc())
    kept = turns.where("role <> 'system'").withColumn("_r", F.row_number().over(others)).where(F.col("_r") <= 2 * most).drop("_r")
    return turns.where("role = 'system'").unionByName(kept)


def last_user_message(turns: DataFrame, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    return turns.where("role = 'user'").groupBy(session).agg(F.max_by("text", seq).alias("last_user"))


def unsummarized(turns: DataFrame, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """The pair that each assistant turn completes: the turn before it, and it."""
    w = Window.partitionBy(session).orderBy(seq)
    both = turns.withColumn("_before", F.lag("text").over(w))
    return both.where("role = 'assistant' AND _before IS NOT NULL").select(session, seq, F.col("_before").alias("user_text"), F.col("text").alias("assistant_text"))


def filter_turns(turns: DataFrame, session: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Turns of a session and of UTC dates [since, until); times that can't be read go only if a date is asked for."""
    out = turns if session is None else turns.where(F.col("session_id") == session)
    when = F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", "+00:00"))
    if since:
        out = out.where(when >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(when < F.lit(until).cast("timestamp"))
    return out


def captured(turns: DataFrame, predicate: Column, most: int = 3, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """The first user turns of each session for which the predicate holds."""
    w = Window.partitionBy(session).orderBy(seq)
    return turns.where("role = 'user'").where(predicate).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def orphans(memories: DataFrame, now: str, minutes: int = 5, source: str = "chat") -> DataFrame:
    """Stored chat turns, not of session mode, that are older than so many whole minutes."""
    j = F.col("metadata")
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.try_to_timestamp("timestamp"))) / 60)
    mode = F.coalesce(F.get_json_object(j, "$.mode"), F.lit(""))
    return memories.where((F.col("category") == "conversation") & (F.get_json_object(j, "$.source") == source) & (mode != "session") & (age > minutes))


def idle_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", pause: int = 600) -> DataFrame:
    """user, session_start, session_end, n_events: sessions end where more than pause whole seconds pass."""
    w = Window.partitionBy(user).orderBy("_s", "_id")
    sec = events.select(user, F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"), F.col("event_id").alias("_id"))
    begun = sec.withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(w) > pause).cast("int"), F.lit(1)))
    numbered = begun.withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(user, "session_no").agg(F.min("_s").alias("session_start"), F.max("_s").alias("session_end"), F.count("*").alias("n_events"))


def restored_turns(sessions: DataFrame) -> DataFrame:
    """session_id, turn, role, text of stored sessions (session_id, messages: a JSON array): users' and assistants' messages in order.

    What can't be read as an array leaves no turns; messages without a role or text are skipped.
    """
    kind = "array<struct<role:string,content:string>>"
    each = sessions.select("session_id", F.posexplode(F.from_json("messages", kind)).alias("turn", "m"))
    return each.where(F.col("m.role").isin("user", "assistant") & F.col("m.content").isNotNull()).select("session_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
