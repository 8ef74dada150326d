"""Prompt templates: text with {slots} compiled on the driver into concatenations."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own wording, by name. Chat templates are (system, user).
TEMPLATES = {
    "plan": ("You plan short animations.", "Write a numbered scene plan between <PLAN> and </PLAN> for:\n{reviewed_description}"),
    "code_with_plan": ("You write animation scripts.", "Description:\n{reviewed_description}\n\nFollow this plan:\n{code_plan}\n\nAnswer with the script between <CODE> and </CODE>."),
    "code": ("You write animation scripts.", "Description:\n{reviewed_description}\n\nAnswer with the script between <CODE> and </CODE>."),
    "docs_feedback": ("You repair animation scripts.", "Description:\n{reviewed_description}\n\nScript:\n{initial_code}\n\nInterface notes:\n{api_info}\n\nRenderer output:\n{render_errors}\n\nAnswer with the repaired script between <CODE> and </CODE>."),
    "docs": ("You check animation scripts against the interface.", "Description:\n{reviewed_description}\n\nScript:\n{initial_code}\n\nInterface notes:\n{api_info}\n\nAnswer with the corrected script between <CODE> and </CODE>."),
    "feedback": ("You repair animation scripts.", "Description:\n{reviewed_description}\n\nScript:\n{initial_code}\n\nRenderer output:\n{render_errors}\n\nAnswer with the repaired script between <CODE> and </CODE>."),
}
#: Plain templates.
PLAIN = {
    "code_text": "Write an animation script for: {reviewed_description}\n<CODE>\n",
    "thinking_text": "Write an animation script for: {reviewed_description}\nNotes:\n{thinking_content}\n<CODE>\n",
    "docs_text": "Description: {reviewed_description}\nScript:\n{initial_code}\nInterface notes:\n{api_info}\n<CODE>\n",
    "completion": "<CODE>\n{code}\n</CODE>",
    "no_doc": "Nothing is documented under {invalid_param}.",
    "question": "{question}\n(from {source_type} {source_file})",
    "answer": "{answer}",
}


def slots(template: str) -> list[str]:
    """Names of a template's slots, in order."""
    return list(dict.fromkeys(name for _, name, _, _ in string.Formatter().parse(template) if name is not None))


def fill(template: str, **columns: Column) -> Column:
    """The template with columns in its slots. Columns without a slot are ignored; a slot without a column is a KeyError; null makes null."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(columns[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def generation_template(feedback: Column, docs: Column, plan: Column) -> Column:
    """Name of the template for a generation, by what there is to go on."""
    return (
        F.when(feedback & docs, "docs_feedback").when(feedback, "feedback").when(docs, "docs").when(plan, "code_with_plan").otherwise("code")
    )


def choose(name: Column, **columns: Column) -> Column:
    """The user text of the chat template that `name` says."""
    branches = [(k, fill(user, **columns)) for k, (_, user) in TEMPLATES.items() if set(slots(user)) <= set(columns)]
    return reduce(lambda acc, kv: acc.when(name == kv[0], kv[1]), branches[1:], F.when(name == branches[0][0], branches[0][1]))
