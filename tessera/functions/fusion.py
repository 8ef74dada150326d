"""Scores, their fusion, and run labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

TEXT_WEIGHT, VISUAL_WEIGHT = 0.2, 0.8
#: Scores of a blank program, by column.
BLANK_SCORES = {
    "codebert_similarity": 0.0,
    "codebleu": 0.0,
    "ngram_match_score": 0.0,
    "weighted_ngram_match_score": 0.0,
    "syntax_match_score": 0.0,
    "dataflow_match_score": 0.0,
    "ast_distance_norm": 0.0,
    "ast_distance_raw": 0.0,
    "ast_distance_max": 0.0,
}
#: A summary averages these.
SUMMARY = (
    "codebert_similarity", "codebleu", "ngram_match_score", "weighted_ngram_match_score", "syntax_match_score", "dataflow_match_score",
    "ast_distance_norm", "ast_distance_raw", "ast_distance_max", "syntax_error", "manim_render_success", "ssim_score", "visual_semantic_score", "visual_similarity", "codebertbleu",
)


def geometric(a: Column, b: Column) -> Column:
    """Geometric mean; negative products count as 0."""
    return F.sqrt(F.greatest(a * b, F.lit(0.0)))


def weighted(text: Column, visual: Column, text_weight: float = TEXT_WEIGHT, visual_weight: float = VISUAL_WEIGHT) -> Column:
    """Weighted sum; weights are within 0 and 1 and need not sum to 1."""
    for w in (text_weight, visual_weight):
        if not 0 <= w <= 1:
            raise ValueError(f"a weight of {w} is outside 0 to 1")
    return text * F.lit(text_weight) + visual * F.lit(visual_weight)


def zero_if_blank(score: Column, code: Column) -> Column:
    return F.when(is_blank(code), 0.0).otherwise(score)


def zero_if_missing(score: Column, path: Column) -> Column:
    return F.when(path.isNull(), 0.0).otherwise(score)


def visual_or_zero(score: Column, code: Column, path: Column, exists: Column) -> Column:
    """A visual score where there is code and a rendered file, else 0."""
    return F.when(~is_blank(code) & path.isNotNull() & exists, score).otherwise(0.0)


def blank_metrics(code: Column, metrics: dict[str, Column], empty_as_null: bool = False) -> list[Column]:
    """Metric columns in which a blank program has BLANK_SCORES (or nulls) and counts as a syntax error."""
    blank = is_blank(code)
    out = [F.when(blank, F.lit(None).cast("double") if empty_as_null else F.lit(BLANK_SCORES[k])).otherwise(metrics[k]).alias(k) for k in BLANK_SCORES]
    return [*out, F.when(blank, True).otherwise(metrics["syntax_error"]).alias("syntax_error")]


def advantage(reward: Column, group: Column) -> Column:
    """Reward less its group's mean."""
    from pyspark.sql import Window

    return reward - F.avg(reward).over(Window.partitionBy(group))


def sanitised(name: Column) -> Column:
    return F.translate(name, "/-.", "___")


def model_name(path: Column, rank: Column) -> Column:
    """Last part of a path with underscores, and the adapter rank."""
    return F.concat(F.translate(F.substring_index(path, "/", -1), "-", "_"), F.lit("_lora_r"), rank.cast("string"))


def adapter_label(path: Column) -> Column:
    """What follows the last _lora_ of a path's last part, behind the parent folder where that part is a checkpoint."""
    last = F.substring_index(path, "/", -1)
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(last.contains("checkpoint"), F.concat(parent, F.lit("_"), last)).otherwise(last)
    return F.substring_index(name, "_lora_", -1)


def run_label(text: Column, visual: Column, geometric_mean: Column) -> Column:
    """Suffix of a run by the rewards that it uses."""
    return F.when(text & visual & geometric_mean, "_geomean_text_visual").when(text & visual, "_mean_text_visual").when(visual, "_visual").when(text, "_text").otherwise("")


def token_budget(total: Column, portion: Column) -> tuple[Column, Column]:
    """(prompt, completion) tokens: the floor of a portion, and the rest."""
    first = F.floor(total * portion).cast("int")
    return first, (total - first).cast("int")


def steps_per_epoch(rows: Column, batch: Column, accumulation: Column, devices: Column) -> Column:
    """Whole steps; null without devices."""
    return F.floor(rows / F.nullif(batch * accumulation * devices, F.lit(0))).cast("long")


def is_mixture(text: Column, marks: tuple[str, ...] = ("moe", "mixtral", "experts", "num_experts", "router")) -> Column:
    return F.lower(text).rlike("|".join(marks))


#: Optimisation parameters of the two trainers.
HYPER = {"gspo": ("sequence", 0.0, 3e-4, 4e-4), "grpo": ("token", 0.005, 0.2, None)}


def hyper(trainer: Column) -> Column:
    """struct(level, beta, epsilon, epsilon_high) for a trainer's name."""
    out = None
    for name, (level, beta, eps, high) in HYPER.items():
        s = F.struct(F.lit(level).alias("level"), F.lit(beta).alias("beta"), F.lit(eps).alias("epsilon"), F.lit(high).cast("double").alias("epsilon_high"))
        out = F.when(trainer == name, s) if out is None else out.when(trainer == name, s)
    return out


#: Evaluation modes.
MODES = tuple(f"{base}{rag}{fb}" for base in ("base", "sft", "sft_grpo", "sft_gspo") for rag in ("", "_rag") for fb in ("", "_fb"))


def mode_flags(mode: Column) -> Column:
    """struct(known, rag, fb) of a mode."""
    return F.struct(mode.isin(*MODES).alias("known"), mode.contains("_rag").alias("rag"), mode.contains("_fb").alias("fb"))


def mode_status(mode: Column, adapter: Column) -> Column:
    """ok, or what does not fit between a mode and an adapter path. The order of the tests counts."""
    path = F.lower(F.coalesce(adapter, F.lit("")))
    needs = lambda name, extra=F.lit(True): F.when(path == "", f"{name} adapter is missing").when(path.contains(name) & extra, "ok").otherwise(f"not an {name} adapter")
    return (
        F.when(mode.contains("sft_gspo"), needs("sft_gspo"))
        .when(mode.contains("sft_grpo"), needs("sft_grpo"))
        .when(mode.contains("sft"), needs("sft", ~path.rlike("grpo|gspo")))
        .when(mode.contains("base"), F.when(path == "", "ok").otherwise("adapter ignored"))
        .otherwise("unknown mode")
    )


def checked_range(c: Column, low: float, high: float, what: str) -> Column:
    """c, or an error where it is outside a range."""
    return F.when(c.between(low, high), c).otherwise(F.raise_error(F.concat(F.lit(f"{what} is out of range: "), c.cast("string"))))
