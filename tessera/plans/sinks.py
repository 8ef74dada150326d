"""Queries: sinks that commit, and files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import manifest, store
from tessera.sources.store import table


@query("SELECT 'eval/' || p_partkey AS value, 'eval' AS job FROM part UNION ALL SELECT 'eval/last', 'last'")
def manifest_once(spark: SparkSession, d: str) -> DataFrame:
    """A manifest to which a job that is run twice adds its lines once."""
    path = store.shared_path(spark, "manifest")
    rows = table(spark, d, "part").select(F.concat(F.lit("eval/"), "p_partkey").alias("value"))
    for _ in range(2):
        manifest.append_once(rows, path, "eval")
    manifest.append_once(spark.range(1).select(F.lit("eval/last").alias("value")), path, "last")
    return manifest.read_once(spark, path)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS DOUBLE) / 50 ELSE 0.0::DOUBLE END AS score FROM part")
def rendered_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of rows whose artifact is there, 0 for the others; artifacts are written for the odd sizes only."""
    path, parts = store.shared_path(spark, "renders"), table(spark, d, "part")
    parts.where("p_size % 2 = 1").select("p_size", F.col("p_name").alias("value")).repartition("p_size").write.partitionBy("p_size").text(path)
    files = store.files_in(spark, path).select(F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("name"), "size")
    rows = parts.select("p_partkey", F.concat(F.lit("p_size="), "p_size").alias("artifact"), (F.col("p_size").cast("double") / 50).alias("score"))
    return store.only_with_files(rows, files, "artifact", "score").select("p_partkey", "score")
