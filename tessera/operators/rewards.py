"""Rewards of generated programs and their evaluation table.

Expensive stages (render, encode) run once for each distinct program: programs are data, so equal ones are joined to one result.
Rows that need no such stage are told apart before it, since a conditional does not keep Python code from running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fusion import SUMMARY, geometric, weighted, zero_if_blank
from tessera.functions.text import is_blank

#: Registered rewards: a name and the column it makes of a table of scores.
REWARDS: dict[str, Callable[[], Column]] = {
    "text": lambda: geometric(F.col("codebert_similarity"), F.col("codebleu")),
    "visual": lambda: geometric(F.col("ssim_score"), F.col("visual_semantic_score")),
    "geo": lambda: geometric(REWARDS["text"](), REWARDS["visual"]()),
    "arithmetic": lambda: weighted(REWARDS["text"](), REWARDS["visual"]()),
}


def reward(name: str, code: str = "generated_code") -> Column:
    """A registered reward; a blank program and a missing score count as 0."""
    return zero_if_blank(F.coalesce(REWARDS[name](), F.lit(0.0)), F.col(code))


def once_each(df: DataFrame, column: str, stage: Callable[[DataFrame], DataFrame], result: str) -> DataFrame:
    """df with `result`: what `stage` makes of a table of the distinct, non-blank values of `column`."""
    distinct = df.select(column).where(~is_blank(F.col(column))).distinct()
    return df.join(stage(distinct).select(column, result), column, "left")


def paired(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Rows of equal place. What either side lacks is left out, as the shorter list ends a pairing."""
    return left.join(right, list(key))


def unpaired(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys that only one side has: empty where the lists are of equal length."""
    a, b = left.select(*key).withColumn("_l", F.lit(1)), right.select(*key).withColumn("_r", F.lit(1))
    return a.join(b, list(key), "full").where("_l IS NULL OR _r IS NULL").select(*key)


def evaluation_rows(df: DataFrame) -> DataFrame:
    """The wide evaluation row: scores, fused scores, render outcome and texts."""
    return df.withColumns({"visual_similarity": geometric(F.col("ssim_score"), F.col("visual_semantic_score")), "codebertbleu": geometric(F.col("codebert_similarity"), F.col("codebleu"))})


def summary(df: DataFrame, metrics: tuple[str, ...] = SUMMARY, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Mean of each metric, booleans as 0 and 1, nulls left out, and the number of rows as `count`. A column that is missing is an error."""
    if missing := [m for m in metrics if m not in df.columns]:
        raise KeyError(f"missing metrics: {', '.join(missing)}")
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in metrics] + ([F.count(F.lit(1)).alias(count)] if count else [])
    return df.groupBy(*by).agg(*means) if by else df.agg(*means)


def running_mean(df: DataFrame, value: Column, order: str, partition: list[str]) -> Column:
    """Mean of the values so far."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(w) / F.count(F.lit(1)).over(w)


def best_checkpoint(df: DataFrame, run: str, checkpoint: str, loss: str) -> DataFrame:
    """run, best: the checkpoint of least loss, the smaller name of equal ones."""
    return df.groupBy(run).agg(F.min(F.struct(loss, checkpoint))[checkpoint].alias("best"))


def keep_last(df: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """The n latest rows of each run."""
    w = Window.partitionBy(run).orderBy(F.desc(step))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
