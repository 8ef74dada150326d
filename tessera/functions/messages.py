"""Chat messages: arrays of struct(role, content), and their rendering as one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_THINK = "/no_think"
DEFAULT_SYSTEM = "You are a helpful assistant."


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def user_text(text: Column, suppress_thinking: bool = False) -> Column:
    return F.concat(text, F.lit(f"\n{NO_THINK}")) if suppress_thinking else text


def prompt(system: Column, user: Column, system_role: bool = True) -> Column:
    """System and user messages; without a system role both in one user message."""
    if system_role:
        return F.array(message("system", system), message("user", user))
    return F.array(message("user", F.concat_ws("\n\n", system, user)))


def completion(content: Column) -> Column:
    return F.array(message("assistant", content))


def _turn(role: Column, content: Column, bos: str, eos: str) -> Column:
    return F.concat(F.lit(bos), role, F.lit("\n"), F.trim(content), F.lit(eos))


def render(messages: Column, bos: str = "<s>", eos: str = "</s>", default_system: str = DEFAULT_SYSTEM, open_turn: bool = False) -> Column:
    """All messages as one text, behind a default system turn where the first has another role."""
    body = F.array_join(F.transform(messages, lambda m: _turn(m["role"], m["content"], bos, eos)), "")
    first = F.try_element_at(messages, F.lit(1))["role"]
    start = F.when(first.eqNullSafe("system"), "").otherwise(_turn(F.lit("system"), F.lit(default_system), bos, eos))
    return F.concat(start, body, F.lit(f"{bos}assistant\n" if open_turn else ""))


def with_eos(prompt_text: Column, response: Column | None = None, eos: str = "</s>") -> Column:
    """A prompt closed by the end mark, and its response likewise if there is one."""
    parts = [prompt_text, F.lit(eos)]
    return F.concat(*parts, *([response, F.lit(eos)] if response is not None else []))
