"""Model routing, API formats, settings: small tables beside the data."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How two kinds of chat endpoints name things.
FORMATS = {
    "openai": {
        "path": "/chat/completions", "auth_header": "Authorization", "auth_prefix": "Bearer ", "auth_extra": {}, "response_content": "choices[0].message.content",
        "stream_content": "choices[0].delta.content", "stream_type_field": None, "stream_type_value": None, "stream_stop": "[DONE]",
    },
    "anthropic": {
        "path": "/messages", "auth_header": "x-api-key", "auth_prefix": "", "auth_extra": {"anthropic-version": "2023-06-01"}, "response_content": "content[0].text",
        "stream_content": "delta.text", "stream_type_field": "type", "stream_type_value": "content_block_delta", "stream_stop": "message_stop",
    },
}
#: Parts of local addresses.
LOCAL = ("localhost", "127.0.0.", "192.168.", "10.", "0.0.0.0")


def load_format(name: str = "", dirs: tuple[str, ...] = ()) -> dict:
    """The format of this name from the first directory that has name.json, else a built-in one. What a file doesn't say is as in the first built-in."""
    import json
    from pathlib import Path

    name = name or "openai"
    base = FORMATS["openai"]
    for path in (Path(d) / f"{name}.json" for d in dirs):
        try:
            said = json.loads(path.read_text("utf-8"))
        except (OSError, ValueError):
            continue  # a file that is missing or can't be read: the next directory
        text = {k: v for k, v in said.items() if k in base and k != "auth_extra" and isinstance(v, str)}
        extra = said.get("auth_extra")
        return base | text | {"auth_extra": {k: v for k, v in extra.items() if isinstance(v, str)} if isinstance(extra, dict) else {}}
    if name not in FORMATS:
        raise ValueError(f"unknown API format {name!r}")
    return FORMATS[name]


def format_names(dirs: tuple[str, ...] = ()) -> list[str]:
    """Names of built-in formats and of files, in order."""
    from pathlib import Path

    return sorted({*FORMATS, *(p.stem for d in dirs for p in Path(d).glob("*.json"))})


def glob_regex(pattern: Column) -> Column:
    """A glob with * and ? as a regular expression for a whole string."""
    plain = F.regexp_replace(pattern, r"([.\\+^$(){}|])", r"\\$1")
    return F.concat(F.lit(r"\A"), F.replace(F.replace(plain, F.lit("*"), F.lit("[\\s\\S]*")), F.lit("?"), F.lit("[\\s\\S]")), F.lit(r"\z"))


def route(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """requests (request_id, model) with endpoint: the first (by ord) of endpoints (ord, name, models) with a pattern that matches, else the last.

    Distinct models, which are few, are routed once each.
    """
    patterns = endpoints.select("ord", "name", F.explode(F.split("models", ",")).alias("p")).withColumn("p", F.trim("p")).where("p <> ''").withColumn("re", glob_regex(F.col("p")))
    models = requests.select("model").distinct()
    hit = models.join(F.broadcast(patterns), F.expr("model RLIKE re")).groupBy("model").agg(F.min_by("name", "ord").alias("found"))
    last = endpoints.agg(F.max_by("name", "ord").alias("last"))
    return requests.join(hit, "model", "left").crossJoin(F.broadcast(last)).withColumn("endpoint", F.coalesce("found", "last")).drop("found", "last")


def is_local(url: Column) -> Column:
    out = F.lit(False)
    for part in LOCAL:
        out = out | url.contains(part)
    return out


def string_at(json: Column, path: str) -> Column:
    """The string at a dotted and bracketed path, else empty."""
    v = F.try_variant_get(F.try_parse_json(json), "$." + path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def request_body(messages: Column, model: Column, kind: str = "openai", max_tokens: int = 4096) -> Column:
    """JSON for messages, array<struct<role, content>>; the second kind hoists system messages."""
    if kind == "openai":
        return F.to_json(F.struct(model.alias("model"), messages.alias("messages")))
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    return F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), F.nullif(system, F.lit("")).alias("system"), F.filter(messages, lambda m: m["role"] != "system").alias("messages")))


def clamped(value: Column, ceiling: int) -> Column:
    return value if ceiling <= 0 else F.when((value <= 0) | (value > ceiling), F.lit(ceiling)).otherwise(value)


def persona_budget(context: Column, percent: float, ceiling: int, small: int = 32768) -> Column:
    """Bytes for the persona: of a small context a share, 500 at least, never above the ceiling."""
    share = F.greatest(F.lit(500), F.floor(context * 4.0 * percent / 100).cast("int"))
    return F.when((context > 0) & (context < small), F.least(share, F.lit(ceiling)) if ceiling > 0 else share).otherwise(F.lit(ceiling))


def headers(kind: str, key: Column) -> Column:
    f = FORMATS[kind]
    extra = [F.lit(x) for pair in f["auth_extra"].items() for x in pair]
    return F.create_map(F.lit(f["auth_header"]), F.concat(F.lit(f["auth_prefix"]), key), *extra)


@dataclass
class Settings:
    """What an INI file may set; section names don't matter to us."""

    limit: int = 5
    min_score: float = 0.4
    vector_weight: float = 7.0
    bm25_weight: float = 3.0
    bm25_enabled: bool = True
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_chunk_size: int = 300
    max_search_limit: int = 0
    cleanup_max_age_hours: float = 336.0
    stream_flush_seconds: int = 8
    #: Model names and what they stand for: the section `models`.
    model_aliases: dict = field(default_factory=dict)


def load_settings(text: str) -> Settings:
    parser = configparser.ConfigParser(comment_prefixes=("#", ";"), inline_comment_prefixes=("#",), interpolation=None, strict=False)
    parser.optionxform = str  # names of models have capitals
    parser.read_string(text)
    out = Settings()
    for section in parser.sections():
        for f in fields(Settings):
            if f.type != "dict" and parser.has_option(section, f.name):
                raw = parser.get(section, f.name).strip()
                setattr(out, f.name, raw.lower() in ("true", "yes", "1") if f.type == "bool" else {"int": int, "float": float}[f.type](raw))
    out.model_aliases = {k: v.strip() for k, v in parser.items("models")} if parser.has_section("models") else {}
    if out.max_search_limit > 0 and not 0 < out.limit <= out.max_search_limit:
        out.limit = out.max_search_limit
    return out


def resolved(model: Column, aliases: dict[str, str]) -> Column:
    """What a model's name stands for; a name that is no alias stands for itself, and aliases aren't followed twice."""
    if not aliases:
        return model
    known = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return F.coalesce(F.element_at(known, model), model)
