"""Similarity of sequences: exact dynamic time warping, structural similarity, frame sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, K1, K2, RANGE = 7, 0.01, 0.03, 255.0


def stride(source_fps: Column, target_fps: float = 5) -> Column:
    """Frames from one sampled frame to the next."""
    return F.greatest(F.lit(1), F.floor(source_fps / target_fps).cast("int"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def similarity(distance: Column, n: Column, m: Column, sharpness: float = 1.0) -> Column:
    """exp(-sharpness * distance / the longer length)."""
    return F.exp(-sharpness * distance / F.greatest(n, m))


def dtw_fold(a: Column, b: Column, cost: Callable[[Column, Column], Column] | None = None) -> Column:
    """Exact warping distance of two arrays by a fold over rows of the cost table; null for an empty one.

    Any cost of two elements may be given; absolute difference otherwise."""
    cost = cost or (lambda x, y: F.abs(x - y))
    inf = F.lit(float("inf"))

    def row(prev: Column, x: Column) -> Column:
        # prev: distances of the row above, behind one cell for the border. The new row is built left to right.
        start = F.array(inf)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            start,
            lambda acc, j: F.concat(acc, F.array(cost(x, F.element_at(b, j)) + F.least(F.element_at(acc, -1), F.element_at(prev, j), F.element_at(prev, j + 1)))),
        )

    first = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: inf))
    table = F.aggregate(a, first, row)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(table, -1))


def dtw(cost: np.ndarray, band: int | None = None) -> np.ndarray:
    """Exact warping distances through cost tables of one shape (table, row, column), by their anti-diagonals; with a band only cells near the diagonal count."""
    count, n, m = cost.shape
    if not n or not m:
        return np.full(count, np.nan)
    if band is not None:
        i, j = np.indices((n, m))
        cost = np.where(np.abs(i * (m - 1) - j * (n - 1)) <= max(band, 1) * max(n, m), cost, np.inf)
    acc = np.full((n + 1, m + 1, count), np.inf)
    acc[0, 0] = 0.0
    cost = np.moveaxis(cost, 0, 2)
    for d in range(2, n + m + 1):
        r = np.arange(max(1, d - m), min(n, d - 1) + 1)
        c = d - r
        acc[r, c] = cost[r - 1, c - 1] + np.minimum(np.minimum(acc[r - 1, c], acc[r, c - 1]), acc[r - 1, c - 1])
    return acc[n, m]


#: Cells of cost tables that are warped at once at most.
CELLS = 1 << 22


@F.pandas_udf(T.DoubleType())
def dtw_series(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Warping distance of two arrays of numbers by absolute difference; pairs of the same lengths are warped together. Null without numbers on both sides."""
    for a, b in pairs:
        out: list[float | None] = [None] * len(a)
        shapes: dict[tuple[int, int], list[int]] = {}
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is not None and y is not None and len(x) and len(y):
                shapes.setdefault((len(x), len(y)), []).append(k)
        for (n, m), rows in shapes.items():
            step = max(1, CELLS // (n * m))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                x, y = (np.array([s.iloc[k] for k in some], float) for s in (a, b))
                for k, v in zip(some, dtw(np.abs(x[:, :, None] - y[:, None, :])).tolist(), strict=True):
                    out[k] = v
        yield pd.Series(out, dtype="float64")


def window_sums(v: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sums over all whole windows of frames (frame, row, column), as differences of prefix sums: a window costs the same whatever its size."""
    c = np.pad(v.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return c[:, window:, window:] - c[:, :-window, window:] - c[:, window:, :-window] + c[:, :-window, :-window]


def moments(v: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance of each window of some frames: what a frame brings to each of its comparisons."""
    n = window * window
    mean = window_sums(v, window) / n
    return mean, (window_sums(v * v, window) - n * mean * mean) / (n - 1)


def ssim_known(x: np.ndarray, of_x: tuple[np.ndarray, np.ndarray], y: np.ndarray, of_y: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> np.ndarray:
    """ssim() of frames whose moments() are known; one frame on either side meets all of the other."""
    n = window * window
    (mx, vx), (my, vy) = of_x, of_y
    cxy = (window_sums(x * y, window) - n * mx * my) / (n - 1)
    c1, c2 = (K1 * RANGE) ** 2, (K2 * RANGE) ** 2
    return (((2 * mx * my + c1) * (2 * cxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean((1, 2))


def ssim(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean structural similarity of pairs of gray frames (pair, row, column) over all whole windows, with sample covariance."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return ssim_known(x, moments(x, window), y, moments(y, window), window)


def resize_area(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """A frame at another size, each new pixel the mean of the area that it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        cover = np.clip(np.minimum(edges[1:, None], np.arange(1, old + 1)) - np.maximum(edges[:-1, None], np.arange(old)), 0, None)
        return cover / cover.sum(1, keepdims=True)

    return weights(frame.shape[0], height) @ frame.astype(np.float64) @ weights(frame.shape[1], width).T


@F.pandas_udf(T.DoubleType())
def ssim_frames(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Structural similarity of two flat frames of the given width; a frame is one row of its pair, whatever its size. NaN without frames of equal size on both sides."""
    for a, b, width in pairs:
        out = np.full(len(a), np.nan)
        size = np.array([-1 if x is None or y is None or len(x) != len(y) else len(x) for x, y in zip(a, b, strict=True)])
        shape = np.where(size < 0, 0, width.to_numpy())
        for n, w in set(zip(size.tolist(), shape.tolist(), strict=True)):
            if n > 0:
                at = np.flatnonzero((size == n) & (shape == w))
                x, y = (np.array([s.iloc[i] for i in at.tolist()]).reshape(len(at), -1, w) for s in (a, b))
                out[at] = ssim(x, y)
        yield pd.Series(out)


def best_match(matrix: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair, rows, cols: the best value of each row and of each column of a long table (pair, i, j, ssim), in order."""
    long = matrix.select(pair, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("k")), F.struct(F.lit(1).alias("side"), F.col("j").alias("k")))).alias("s"), "ssim")
    best = long.groupBy(pair, "s").agg(F.max("ssim").alias("v"))
    line = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("s.side") == side, F.struct("s.k", "v")))), lambda x: x["v"])
    return best.groupBy(pair).agg(line(0).alias("rows"), line(1).alias("cols"))
