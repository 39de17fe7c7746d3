"""Metadata: the JSON tail and the columns lifted out of it, tags and flags, search by fields, tags and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import comma_parts

#: Keys that have columns of their own.
LIFTED = ("collection", "category", "tags", "timestamp", "keep", "bad")
FLAGS = ("keep", "bad")


def tags_text(json: Column) -> Column:
    """$.tags as a comma-separated string, from an array or a string."""
    raw = F.get_json_object(json, "$.tags")
    return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), ",")).otherwise(raw), F.lit(""))


def with_flag(tags: Column, flag: str, on: Column) -> Column:
    """tags with the flag appended if it is on and not yet a substring of them."""
    add = F.coalesce(on, F.lit(False)) & ~F.contains(tags, F.lit(flag))
    return F.when(add, F.when(tags == "", F.lit(flag)).otherwise(F.concat(tags, F.lit("," + flag)))).otherwise(tags)


def split_metadata(df: DataFrame, json: str = "metadata") -> DataFrame:
    """df with collection, category, tags and timestamp out of the JSON, which keeps the rest (null if nothing)."""
    j = F.col(json)
    out = df.withColumns({
        "collection": F.coalesce(F.nullif(F.get_json_object(j, "$.collection"), F.lit("")), F.lit("memory")),
        "category": F.coalesce(F.get_json_object(j, "$.category"), F.lit("")),
        "meta_timestamp": F.nullif(F.get_json_object(j, "$.timestamp"), F.lit("")),
        "tags": tags_text(j),
    })
    for flag in FLAGS:
        out = out.withColumn("tags", with_flag(F.col("tags"), flag, F.get_json_object(j, f"$.{flag}") == "true"))
    rest = F.map_filter(fields(j), lambda k, v: ~k.isin(*LIFTED))
    return out.withColumn(json, F.when(F.size(rest) > 0, F.to_json(rest)))


def fields(json: Column) -> Column:
    """A JSON object's fields, each with its own type and what is within it."""
    return F.from_json(json, "map<string,variant>")


def merge_metadata(df: DataFrame, json: str = "metadata") -> DataFrame:
    """The inverse: the JSON with collection always, category and tags where they say something."""
    none = F.create_map().cast("map<string,variant>")

    def one(key: str) -> Column:
        return F.create_map(F.lit(key), F.col(key).cast("variant"))

    merged = F.map_concat(
        F.map_filter(F.coalesce(fields(F.col(json)), none), lambda k, v: ~k.isin(*LIFTED)),
        one("collection"), F.when(F.col("category") != "", one("category")).otherwise(none), F.when(F.col("tags") != "", one("tags")).otherwise(none),
    )
    return df.withColumn(json, F.to_json(merged))


def backfilled_tags(tags: Column, keep: Column, bad: Column) -> Column:
    """Old rows: tags split at commas, trimmed, flags added unless they are there exactly."""
    parts = comma_parts(tags)
    for flag, on in (("keep", keep), ("bad", bad)):
        parts = F.when(on & ~F.array_contains(parts, flag), F.concat(parts, F.array(F.lit(flag)))).otherwise(parts)
    return F.array_join(parts, ",")


def protected(tags: Column) -> Column:
    """A substring test, as flags are set: bookkeeping is protected too. See protected_exactly."""
    return F.contains(F.coalesce(tags, F.lit("")), F.lit("keep"))


def protected_exactly(tags: Column) -> Column:
    return F.array_contains(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), "keep")


def json_equals(json: Column, key: str, value) -> Column:
    """Equality of value and type class: 1 equals 1.0, but not "1"; a missing key equals nothing."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, (int, float)):
        same = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    else:
        same = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(value)))
    return F.coalesce(same, F.lit(False))


def search_by_metadata(
    memories: DataFrame, fields: dict | None = None, limit: int = 0, after: str = "", before: str = "", tag: str | None = None, compat: bool = False
) -> DataFrame:
    """Newest first: rows with all fields (collection and category by column, others in the JSON), the tag pattern, and a time in [after, before).

    limit 0 is no limit. compat takes twice the limit before it looks into the JSON, and so may return too few.
    """
    out = memories
    if after:
        out = out.where(F.col("timestamp") >= after)
    if before:
        out = out.where(F.col("timestamp") < before)
    if tag is not None:
        out = out.where(F.col("tags").ilike(f"%{tag}%"))
    fields = fields or {}
    for key in ("collection", "category"):
        if key in fields:
            out = out.where(F.col(key) == fields[key])
    newest = [F.col("timestamp").desc(), F.col("id")]
    if compat and limit:
        out = out.orderBy(*newest).limit(2 * limit)
    for key, value in fields.items():
        if key not in ("collection", "category"):
            out = out.where(json_equals(F.col("metadata"), key, value))
    out = out.orderBy(*newest)
    return out.limit(limit) if limit else out
