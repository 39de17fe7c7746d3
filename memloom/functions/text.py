"""Column expressions over text: keyword tokens, Markdown pieces, paths, previews, prompt escapes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search drops.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it as be was are been being have has had do does did will "
    "would could should may might shall can this that these those i you he she we they me him her us them my your his "
    "its our their not no so if then than too very just about up out all also into over after"
).split()
SHORTEST_TOKEN, LONGEST_TOKEN, HEX_FROM = 3, 19, 6


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; lower() would also turn, say, the Kelvin sign into k."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def runs(text: Column) -> Column:
    """The runs of [a-z0-9] of three letters or more."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"([a-z0-9]{{{SHORTEST_TOKEN},}})"), F.lit(1))


def is_token(run: Column) -> Column:
    """Whether keyword search keeps a run: 19 letters at most, no stop word, no long bare hexadecimal. Meant for exploded runs, where it is compiled."""
    stop = [w for w in STOP_WORDS if len(w) >= SHORTEST_TOKEN]
    return (F.length(run) <= LONGEST_TOKEN) & ~run.isin(*stop) & ~((F.length(run) >= HEX_FROM) & run.rlike("^[0-9a-f]+$"))


def tokens(text: Column) -> Column:
    """Keyword tokens of one text, as an array."""
    return F.filter(runs(text), is_token)


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))


def heading_text(line: Column) -> Column:
    return F.when(F.instr(line, " ") > 0, F.substring(line, F.instr(line, " ") + 1, F.length(line))).otherwise(line)


def clean_markdown(text: Column) -> Column:
    """Without inline image data, runs of spaces and runs of blank lines."""
    for pattern, to in ((r"!\[[^\]]*\]\(data:[^)]*\)", ""), (r"data:image/[^;]*;base64,[A-Za-z0-9+/=]+", ""), (" {2,}", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return text


def paragraphs(text: Column) -> Column:
    """Runs of lines between blank ones (empty, or a lone carriage return), right-trimmed."""
    marked = F.regexp_replace(F.concat(F.regexp_replace(text, "^(\r?\n)+", ""), F.lit("\n")), "\n(\r?\n)+", "\u0000")
    parts = F.filter(F.split(marked, "\u0000"), lambda p: (p != "") & (p != "\n"))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"[\n\r ]+\z", ""))


def short_home(text: Column, home: str) -> Column:
    """Every "<home>/" as "~/"."""
    return F.replace(text, F.lit(home.rstrip("/") + "/"), F.lit("~/")) if home.strip("/") else text


def preview(text: Column, most: int = 200) -> Column:
    """The first bytes, and an ellipsis if there are more; a character cut in two is left out."""
    cut = F.rtrim(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), F.lit("\ufffd"))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def prompt_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


#: What makes a message worth keeping.
CAPTURE = (r"remember|zapamatuj|pamatuj", r"prefer|like|love|hate|want|need", r"my\s+\w+\s+is|is\s+my", r"i (always|never|usually)", r"important|decision|decided")


def worth_capturing(text: Column) -> Column:
    n = F.length(text)
    injected = text.contains("<relevant-memories>") | (text.startswith("<") & text.contains("</"))
    said = F.lit(False)
    for pattern in CAPTURE:
        said = said | text.rlike(f"(?i){pattern}")
    return n.between(10, 500) & ~injected & said


def base64url(binary: Column) -> Column:
    return F.rtrim(F.translate(F.base64(binary), "+/", "-_"), F.lit("="))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def new_token() -> Column:
    """A random token of 32 bytes, a new one at each evaluation."""
    return base64url(F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()), 256)))


def comma_parts(text: Column) -> Column:
    """What stands between commas, trimmed of blanks, without empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"\A[ \t]+|[ \t]+\z", "")), lambda t: t != "")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_home(path: Column, home: str) -> Column:
    """A path that begins with ~ from the home directory on."""
    return F.when(path.startswith("~"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)


def expires(now: Column, ttl_seconds: int = 86_400) -> Column:
    """When something that begins now ends, as UTC text."""
    return iso_utc(now + F.make_interval(secs=F.lit(ttl_seconds)))
