"""An evaluation from samples to the wide result table: generate, extract, compare programs, render, compare frames, fuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fusion, text
from tessera.operators import codebleu, rewards, treedist
from tessera.operators.loop import requests
from tessera.sources.store import spread, written

Stage = Callable[[DataFrame], DataFrame]

#: Columns of the result, in order.
RESULT = (
    "codebert_similarity", "codebleu", "ngram_match_score", "weighted_ngram_match_score", "syntax_match_score", "dataflow_match_score",
    "ast_distance_norm", "ast_distance_raw", "ast_distance_max", "syntax_error", "ssim_score", "visual_semantic_score", "visual_similarity", "codebertbleu",
    "manim_render_success", "manim_render_info", "manim_render_error", "raw_generated_code", "raw_generated_thinking", "raw_generated_code_plan", "raw_rag_info", "raw_initial_code",
    "text_script", "expected_code", "generated_code",
)


def code_metrics(df: DataFrame, similar: Stage, empty_as_null: bool = False) -> DataFrame:
    """id and the ten program metrics of df (id, generated_code, expected_code).

    similar adds codebert_similarity, from whatever encoder it holds. Blank programs never reach it or the parsers."""
    full = spread(df.where(~text.is_blank(F.col("generated_code"))).select("id", "generated_code", "expected_code"), "id")
    bleu = codebleu.codebleu(full, ["id"], "generated_code", "expected_code")
    tree = full.select("id", treedist.code_distance("generated_code", "expected_code").alias("t"))
    near = similar(full).select("id", "codebert_similarity")
    got = df.select("id", "generated_code").join(bleu, "id", "left").join(tree, "id", "left").join(near, "id", "left")
    names = {
        "codebert_similarity": F.col("codebert_similarity"), "codebleu": F.col("codebleu"), "ngram_match_score": F.col("ngram"), "weighted_ngram_match_score": F.col("weighted"),
        "syntax_match_score": F.col("syntax"), "dataflow_match_score": F.col("dataflow"), "ast_distance_norm": F.col("t.norm"), "ast_distance_raw": F.col("t.raw"), "ast_distance_max": F.col("t.max"),
        "syntax_error": F.col("t.syntax_error"),
    }
    return got.select("id", *fusion.blank_metrics(F.col("generated_code"), names, empty_as_null))


def evaluate(samples: DataFrame, generate: Stage, render: Stage, similar: Stage, visual: Stage, strict: bool = False) -> DataFrame:
    """id and RESULT for samples (id, text_script, expected_code, code_plan).

    generate adds response to rows with request; render adds artifact, success, info, errors to rows with code; similar adds
    codebert_similarity; visual adds ssim_score and visual_semantic_score to rows with generated_artifact and expected_artifact. Each distinct program is rendered
    once. An expected program that doesn't render is an error if strict, else its visual scores are 0. Each row of samples gives one row, whether its id is null or
    repeated. The sentinel of an answer that took too long holds no code, so it scores as a blank program."""
    asked = samples.select("id", "expected_code", F.col("text_script").alias("reviewed_description"), "code_plan", *[F.lit(None).cast("string").alias(c) for c in ("initial_code", "api_info", "render_errors")])
    # Rows have a number of their own from here on, fixed by being written.
    answered = written(generate(requests(asked)).withColumn("_row", F.monotonically_increasing_id()), "responses")
    rows = answered.select(F.col("_row").alias("id"), F.col("id").alias("_id"), F.col("reviewed_description").alias("text_script"), "expected_code", "code_plan", "response", text.last_code(text.completion(F.col("response"))).alias("generated_code"), text.thinking(F.col("response")).alias("thinking"))
    programs = rows.select(F.col("generated_code").alias("code")).union(rows.select("expected_code")).where(~text.is_blank(F.col("code"))).distinct()
    shown = written(render(programs).select("code", "artifact", "success", "info", "errors"), "renders")
    got = shown.select(F.col("code").alias("generated_code"), F.col("artifact").alias("generated_artifact"), F.col("success").alias("manim_render_success"), F.col("info").alias("manim_render_info"), F.col("errors").alias("manim_render_error"))
    want = shown.select(F.col("code").alias("expected_code"), F.col("artifact").alias("expected_artifact"), F.col("success").alias("expected_ok"))
    both = rows.join(got, "generated_code", "left").join(want, "expected_code", "left")
    if strict and not both.where("expected_ok IS NOT TRUE").isEmpty():
        raise RuntimeError("an expected program does not render")
    pairs = both.where("manim_render_success AND expected_ok").select("id", "generated_artifact", "expected_artifact")
    seen = visual(pairs).select("id", "ssim_score", "visual_semantic_score")
    wide = both.join(code_metrics(rows, similar), "id").join(seen, "id", "left")
    filled = wide.withColumns({
        "ssim_score": F.coalesce("ssim_score", F.lit(0.0)), "visual_semantic_score": F.coalesce("visual_semantic_score", F.lit(0.0)), "manim_render_success": F.coalesce("manim_render_success", F.lit(False)),
        "raw_generated_code": F.col("response"), "raw_generated_thinking": F.col("thinking"), "raw_generated_code_plan": F.coalesce("code_plan", F.lit("")), "raw_rag_info": F.lit(""), "raw_initial_code": F.lit(""),
    })
    return rewards.evaluation_rows(filled).select(F.col("_id").alias("id"), *RESULT)


def augmented(samples: DataFrame, generate: Stage, notes: Stage, x: str = "reviewed_description") -> DataFrame:
    """samples (id, ...) with initial_code, extracted from a first generation, and api_info on the names in it."""
    asked = samples.select("id", F.col(x).alias("reviewed_description"), *[F.lit(None).cast("string").alias(c) for c in ("code_plan", "initial_code", "api_info", "render_errors")])
    first = written(generate(requests(asked)).select("id", text.last_code(F.col("response")).alias("initial_code")), "first")
    return samples.join(notes(first), "id")
