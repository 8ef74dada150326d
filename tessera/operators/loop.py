"""The generate, render, repair loop over a table that shrinks as rows succeed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.templates import choose, generation_template
from tessera.sources.store import written

Generate = Callable[[DataFrame], DataFrame]


def requests(df: DataFrame) -> DataFrame:
    """df (reviewed_description, initial_code, api_info, render_errors, code_plan) with template and request of each row's next generation."""
    said = [F.coalesce(c, F.lit("")) for c in ("reviewed_description", "initial_code", "api_info", "render_errors", "code_plan")]
    names = dict(zip(("reviewed_description", "initial_code", "api_info", "render_errors", "code_plan"), said, strict=True))
    kind = generation_template(F.col("render_errors").isNotNull(), F.col("api_info").isNotNull(), F.col("code_plan").isNotNull())
    return df.withColumn("template", kind).withColumn("request", choose(F.col("template"), **names))


def planned(samples: DataFrame, planner: Generate | None = None) -> DataFrame:
    """samples with code_plan: the one they have, or the last plan in what a planner answers (`response` for `request`) to a plan's request.

    Both a plan and a planner is an error. Without either code_plan is null."""
    if "code_plan" in samples.columns:
        if planner is not None:
            raise ValueError("samples that have a plan need no planner")
        return samples
    if planner is None:
        return samples.withColumn("code_plan", F.lit(None).cast("string"))
    asked = samples.withColumn("request", choose(F.lit("plan"), reviewed_description=F.coalesce("reviewed_description", F.lit(""))))
    plan = text.pick(text.plan_blocks(F.col("response")))
    return planner(asked).select(*samples.columns, plan.alias("code_plan"))


def run_rounds(samples: DataFrame, generate: Generate, render: Generate, rounds: int, notes: Generate | None = None, force_all: bool = False) -> DataFrame:
    """The last response of each sample (id, reviewed_description, optional code_plan).

    Up to rounds + 1 rounds. generate adds `response` to rows with `request`; render adds `success` and `errors` to rows with `code`;
    notes adds `api_info` to rows with `initial_code`. A row leaves at its first success, unless all rounds are forced;
    a success that is null is none. Each round is written to the shared
    folder, so later ones do not generate again."""
    if not 0 <= rounds <= 10:
        raise ValueError("rounds must be between 0 and 10")
    plan = F.col("code_plan") if "code_plan" in samples.columns else F.lit(None).cast("string")
    todo = samples.select("id", "reviewed_description", plan.alias("code_plan"), *[F.lit(None).cast("string").alias(c) for c in ("initial_code", "api_info", "render_errors")])
    done = None
    for n in range(rounds + 1):
        answered = generate(requests(todo)).withColumn("code", text.last_code(F.col("response")))
        shown = render(answered)
        now = written(shown.select("id", "reviewed_description", "code_plan", "initial_code", "api_info", "template", "response", "code", F.coalesce("success", F.lit(False)).alias("success"), "errors", F.lit(n).alias("round")), f"round{n}")
        last = n == rounds
        out = now if last else now.where("false") if force_all else now.where("success")
        done = out if done is None else done.unionByName(out)
        if last:
            break
        left = now if force_all else now.where("NOT success")
        if left.isEmpty():
            break
        todo = left.select("id", "reviewed_description", "code_plan", F.col("code").alias("initial_code"), F.lit(None).cast("string").alias("api_info"), text.error_tail(text.strip_ansi(F.col("errors")), failed=~F.col("success")).alias("render_errors"))
        if notes is not None:
            todo = notes(todo.drop("api_info"))
    return done


def first_success(attempts: DataFrame, key: str, order: str, success: str) -> DataFrame:
    """The attempts of each key up to its first success; all of them where none succeeds."""
    from pyspark.sql import Window

    stop = F.min(F.when(F.col(success), F.col(order))).over(Window.partitionBy(key))
    return attempts.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")
