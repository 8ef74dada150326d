"""Parsing of model responses and logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as regular expressions know it; Spark's trim() takes off spaces alone.
SPACE = r"[ \t\n\x0B\f\r]"


def strip(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def strip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def repair_tags(c: Column, tag: str) -> Column:
    """Back-ticked tags go, lower-case tags become upper-case, an opening bracket that is missing comes back.

    A well-formed opening tag gains a second bracket, which extraction doesn't mind."""
    up, low = tag.upper(), tag.lower()
    c = F.regexp_replace(c, f"`<{up}>`|`</{up}>`", "")
    for old, new in ((f"<{low}>", f"<{up}>"), (f"</{low}>", f"</{up}>"), (f"{up}>", f"<{up}>"), (f"</<{up}>", f"</{up}>")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _between(c: Column, start: str, end: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s){start}(.*?){end}"), F.lit(1))


def tagged_blocks(c: Column, tag: str, fence: str, fall_back: bool) -> Column:
    """Stripped bodies between tags, in order; where there are none and fall_back holds, those of fenced blocks."""
    up = tag.upper()
    fixed = repair_tags(c, tag)
    found = _between(fixed, f"<{up}>", f"</{up}>")
    if fall_back:
        found = F.when(F.size(found) == 0, _between(fixed, f"```{fence}", "```")).otherwise(found)
    return F.transform(found, lambda x: strip(F.regexp_replace(x, f"<{up}>|</{up}>|```{fence}|```", "")))


def code_blocks(c: Column) -> Column:
    return tagged_blocks(c, "code", "python", True)


def plan_blocks(c: Column) -> Column:
    return tagged_blocks(c, "plan", "text", False)


def pick(blocks: Column, index: int = -1) -> Column:
    """One of the blocks, from 0 or from the end; the empty string where there is none."""
    return F.coalesce(F.try_element_at(blocks, F.lit(index + 1 if index >= 0 else index)), F.lit(""))


def last_code(c: Column) -> Column:
    return pick(code_blocks(c))


def last_plan(c: Column) -> Column:
    return pick(plan_blocks(c))


def thinking(c: Column, token: str = "</think>") -> Column:
    """What stands before the last token; empty without one, or with it at the very start."""
    size = F.length(c) - F.length(F.substring_index(c, token, -1)) - len(token)
    return F.when(c.contains(token) & (size > 0), F.substring(c, F.lit(1), size)).otherwise("")


def completion(c: Column, token: str = "</think>") -> Column:
    """What stands after the last token, without newlines at its ends; all of it where thinking() is empty."""
    return strip_newlines(F.when(thinking(c, token) != "", F.substring_index(c, token, -1)).otherwise(c))


def strip_ansi(c: Column) -> Column:
    """c without colour codes."""
    return F.regexp_replace(c, "\\x1B\\[[0-9;]*m", "")


def error_tail(c: Column, lines: int = 10, failed: Column | None = None) -> Column:
    """The last lines of a log; NONE for an empty log or where `failed` is false."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"\n\z", ""), "\n")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - (lines - 1), F.lit(1)), F.lit(lines)), "\n")
    empty = c.isNull() | (c == "")
    return F.when(empty if failed is None else empty | ~failed, "NONE").otherwise(tail)


def before_examples(doc: Column) -> Column:
    """A docstring up to its first mention of examples."""
    return strip(F.substring_index(doc, "Examples", 1))


def dotted_head(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def dotted_rest(name: Column) -> Column:
    """All after the first dot; the name itself without one."""
    return F.element_at(F.split(name, r"\.", 2), -1)


def is_media(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpe?g|bmp)\z")


def unique_name(base: str) -> Column:
    """base, 12 hex digits and the epoch second; differs on each call."""
    return F.concat(F.lit(f"{base}_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12), F.lit("_"), F.unix_timestamp().cast("string"))


def first_choice(response: Column) -> Column:
    """Content of a chat completion's first choice; empty where there is none."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))


def chat_request(model: str, messages: Column, temperature: float = 0.0) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature")))
