"""Prompt and completion datasets from sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import messages, tokens
from tessera.functions.templates import PLAIN, TEMPLATES, fill
from tessera.operators.columns import normalise_names, require


def prepare(df: DataFrame, x: str = "reviewed_description", y: str = "code", template: str = "code", suppress_thinking: bool = True, system_role: bool = True) -> DataFrame:
    """prompt, completion, expected_code: chat messages of each sample, and nothing else."""
    rows = require(normalise_names(df), x, y)
    system, user = TEMPLATES[template]
    said = messages.user_text(fill(user, **{c: F.col(c) for c in rows.columns}), suppress_thinking)
    return rows.select(messages.prompt(F.lit(system), said, system_role).alias("prompt"), messages.completion(fill(PLAIN["completion"], code=F.col(y))).alias("completion"), F.col(y).alias("expected_code"))


def for_tuning(prepared: DataFrame, bos: str = "<s>", eos: str = "</s>") -> DataFrame:
    """messages: prompt and completion as one rendered chat."""
    return prepared.select(messages.render(F.concat("prompt", "completion"), bos, eos).alias("messages"))


def tokenised(df: DataFrame, length: int, x: str = "reviewed_description", y: str = "code", eos: str = "</s>") -> DataFrame:
    """input_ids, attention_mask, labels of prompt and response, both closed by the end mark, with the prompt ignored by the labels."""
    rows = require(normalise_names(df, strip=False), x, y)
    said = fill(PLAIN["code_text"], reviewed_description=F.col(x))
    # Both end marks stand between spaces: the parts' ids are the whole's. Each part is split once, as a column.
    ids = lambda c: tokens.white_space_ids(messages.with_eos(c, eos=f" {eos} "))
    split = rows.select(ids(said).alias("said"), ids(F.col(y)).alias("answer"))
    whole = split.select(F.size("said").alias("start"), F.concat("said", "answer").alias("ids"))
    padded = tokens.pad(F.col("ids"), length)
    return whole.select(padded.alias("input_ids"), tokens.attention(F.col("ids"), length).alias("attention_mask"), tokens.labels(padded, F.col("start")).alias("labels"))
