"""Queries: alignments by dynamic time warping, exact and approximate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors, warping
from tessera.functions.vectors import rounded
from tessera.plans.registry import query
from tessera.plans.similarity import _NEIGHBOURS_SQL, _UNITS_SQL, _frames, _neighbours


def _path_sql(source: str, key: str, cost: str) -> str:
    """The steps (key, step, i, j) of an optimal path: the table of distances row by row, the move that leads to each cell from the three
    cells before it (ties: above, before, both), then the moves walked back from the last cell."""
    cell = f"[{cost.format(a='rows[i + 1]', b='cols[j]')}, above[j], above[j + 1]]"
    move = "CASE WHEN up[j + 1] <= line[j] AND up[j + 1] <= up[j] THEN 0 WHEN line[j] <= up[j] THEN 1 ELSE 2 END"
    return f"""WITH RECURSIVE source AS (SELECT * FROM {source} WHERE len(rows) > 0 AND len(cols) > 0),
steps AS (
  SELECT {key}, rows, cols, 0 AS i, list_concat([0.0::DOUBLE], list_transform(cols, lambda c: 'inf'::DOUBLE)) AS above FROM source
  UNION ALL
  SELECT {key}, rows, cols, i + 1, list_reduce(list_transform(range(1, len(cols) + 1), lambda j: {cell}), lambda row, c: list_append(row, c[1] + least(row[len(row)], c[2], c[3])), ['inf'::DOUBLE]) FROM steps WHERE i < len(rows)
), pairs AS (SELECT {key}, i, len(cols) AS m, above AS line, lag(above) OVER (PARTITION BY {key} ORDER BY i) AS up FROM steps),
moves AS (SELECT {key}, any_value(m) AS m, max(i) AS n, flatten(list(list_transform(range(1, m + 1), lambda j: CAST({move} AS TINYINT)) ORDER BY i)) AS moves FROM pairs WHERE i > 0 GROUP BY {key}),
walk AS (
  SELECT {key}, 0 AS back, CAST(n AS BIGINT) AS i, CAST(m AS BIGINT) AS j FROM moves
  UNION ALL
  SELECT {key}, back + 1, i - (move <> 1)::INT, j - (move <> 0)::INT FROM (SELECT w.*, t.moves[(w.i - 1) * t.m + w.j] AS move FROM walk w JOIN moves t ON t.{key} = w.{key} WHERE w.i > 1 OR w.j > 1))
SELECT {key}, CAST(max(back) OVER (PARTITION BY {key}) - back AS INT) AS step, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j FROM walk"""


def _steps(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.posexplode("w.path").alias("step", "at")).select(key, "step", "at.i", "at.j")


@query(_path_sql(f"(SELECT vec_id, a AS rows, b AS cols FROM {_NEIGHBOURS_SQL})", "vec_id", "abs({a} - {b})"))
def warp_path(spark: SparkSession, d: str) -> DataFrame:
    """Which element of a series goes with which of its neighbour's: the steps of the exact alignment of whole series."""
    n = _neighbours(spark, d).select("vec_id", *[F.col(c).cast("array<double>").alias(c) for c in ("a", "b")])
    return _steps(n.select("vec_id", warping.warp("a", "b").alias("w")), "vec_id")


@query(_path_sql(_UNITS_SQL, "pair_id", "(1.0 - list_dot_product({a}, {b}))"))
def frame_warp_path(spark: SparkSession, d: str) -> DataFrame:
    """Which frame of a sequence goes with which of the other, by their unit embeddings."""
    f = _frames(spark, d).select("pair_id", "side", F.struct("k", vectors.normalise(F.col("embedding")).alias("e")).alias("f"))
    line = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("f")))), lambda x: x["e"])
    g = f.groupBy("pair_id").agg(line(0).alias("a"), line(1).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return _steps(g.select("pair_id", warping.warp_vectors("a", "b").alias("w")), "pair_id")


@query()
def fast_warp(spark: SparkSession, d: str) -> DataFrame:
    """The distance in linear time (radius 1, and 8), beside the exact one, and how much larger it is; whole series."""
    n = _neighbours(spark, d).select("vec_id", *[F.col(c).cast("array<double>").alias(c) for c in ("a", "b")])
    found = n.select("vec_id", warping.warp("a", "b").alias("w"), warping.fast_warp()("a", "b").alias("near"), warping.fast_warp(8)("a", "b").alias("wide"))
    exact, near, wide = (F.col(f"{c}.distance") for c in ("w", "near", "wide"))
    gap = F.when(exact > 0, near / exact - 1).otherwise(0.0)
    return found.select("vec_id", rounded(exact).alias("exact"), rounded(near).alias("near"), rounded(wide).alias("wide"), rounded(gap).alias("gap"), F.size("near.path").alias("steps"))
