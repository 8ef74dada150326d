"""Token id arrays. Ids come from any tokenizer; white_space_ids() needs none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def white_space_ids(text: Column, size: int = 1000) -> Column:
    """A stand-in tokenizer: each word's id is its length, below size."""
    return F.transform(F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != ""), lambda w: F.pmod(F.length(w), F.lit(size)).cast("int"))


def pad(ids: Column, length: int, pad_id: int = 0) -> Column:
    """ids cut or filled up at the right to one length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), length)), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 where pad() keeps an id, 0 where it fills up. What a lambda holds is worked out for each place, so ids stay out of one."""
    kept = F.greatest(F.size(ids), F.lit(0))
    return F.slice(F.concat(F.array_repeat(F.lit(1), F.least(kept, F.lit(length))), F.array_repeat(F.lit(0), length)), 1, length)


def labels(padded: Column, prompt_length: Column) -> Column:
    """Padded ids with the prompt's places ignored; fill stays as it is. The prompt's length is worked out once, not for each place."""
    start = F.least(F.greatest(prompt_length, F.lit(0)).cast("int"), F.size(padded))
    return F.concat(F.array_repeat(F.lit(IGNORED), start), F.slice(padded, start + 1, F.size(padded)))


def last_place(ids: Column, token_id: int) -> Column:
    """Ids up to and with the last token_id: their number, or 0 without it."""
    back = F.array_position(F.reverse(ids), F.lit(token_id)).cast("int")
    return F.when(back > 0, F.size(ids) - back + 1).otherwise(0)


def split_last(ids: Column, token_id: int) -> Column:
    """struct(thinking, answer): the ids through the last token_id, and those after it."""
    at = last_place(ids, token_id)
    return F.struct(F.slice(ids, F.lit(1), at).alias("thinking"), F.slice(ids, at + 1, F.size(ids)).alias("answer"))


def without_prompt(ids: Column, prompt_length: Column) -> Column:
    return F.slice(ids, prompt_length + 1, F.greatest(F.size(ids), F.lit(1)))
