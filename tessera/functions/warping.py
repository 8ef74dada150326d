"""Alignments by dynamic time warping: the exact path in bounded memory, and an approximation in linear time.

A path steps from the first elements of two series to the last; each step goes on by one in the first series, in the second, or in both. Walking back, ties go to the cell with
the smaller place in the first series, then to that in the second, then to both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of elements x[i] and y[i], row by row.
Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Cells whose moves are held at once while a path is walked back.
CELLS = 1 << 20
FIRST, SECOND, BOTH = 0, 1, 2


def absolute(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y)


def dot_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One less the product of two unit vectors."""
    return 1.0 - (x * y).sum(1)


class Table:
    """The table of warping distances of two series, by anti-diagonals: cell (i, j) is on line i + j. A line is held by i, infinite outside the table."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cost: Cost):
        self.a, self.b, self.cost, self.n, self.m = a, b, cost, len(a), len(b)

    def start(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Line 0, and what is before it."""
        line = np.full(self.n, np.inf)
        line[0] = self.cost(self.a[:1], self.b[:1])[0]
        return 0, np.full(self.n, np.inf), line

    def rows(self, line: int, last: tuple[int, int]) -> tuple[int, int]:
        """The range of i on a line, within what can lead to `last`."""
        return max(0, line - last[1]), min(last[0], line) + 1

    def next(self, line: int, before: np.ndarray, now: np.ndarray, last: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Line + 1, which move led to each of its cells, and its range."""
        low, high = self.rows(line + 1, last)
        i = np.arange(low, high)
        came = np.full((3, high - low), np.inf)
        down = i > 0
        came[FIRST, down] = now[i[down] - 1]
        came[SECOND] = now[low:high]
        came[BOTH, down] = before[i[down] - 1]
        move = came.argmin(0)
        out = np.full(self.n, np.inf)
        out[low:high] = self.cost(self.a[low:high], self.b[line + 1 - i]) + came[move, np.arange(high - low)]
        return out, move.astype(np.uint8), low, high


def path(a: np.ndarray, b: np.ndarray, cost: Cost = absolute, cells: int = CELLS) -> tuple[float, np.ndarray]:
    """The warping distance of two series and an optimal path, rows (i, j) from the first elements to the last.

    Where the whole table has more cells than `cells`, lines are gone through without keeping moves, each cell carrying the cell where its own way back
    crosses the middle line; the halves before and after that are done alike, from the lines kept at their start. So memory is linear in the lengths, and
    the path that of the whole table, ties included."""
    if not len(a) or not len(b):
        return float("nan"), np.zeros((0, 2), np.int64)
    table = Table(a, b, cost)
    end = (table.n - 1, table.m - 1)
    steps: list[tuple[int, int]] = [end]
    todo = [(table.start(), end)]
    distance = None
    while todo:
        (line, before, now), last = todo.pop()
        goal = last[0] + last[1]
        width = min(last[0], last[1]) + 1
        if goal - line < 2 or (goal - line) * width <= cells:
            value = _walked(table, line, before, now, last, steps)
            distance = value if distance is None else distance
            continue
        middle = (line + goal) // 2
        kept = (line, before, now)
        while line < middle:
            out, _, _, _ = table.next(line, before, now, last)
            line, before, now = line + 1, now, out
        # Each cell beyond the middle knows the i and j of the cell, on the middle line or the one before it, that its way back meets first.
        half = (line, before, now)
        cross_before, cross_now = np.arange(table.n), np.arange(table.n)
        side_before, side_now = np.full(table.n, middle - 1), np.full(table.n, middle)
        while line < goal:
            out, move, low, high = table.next(line, before, now, last)
            i = np.arange(low, high)
            above = np.maximum(i - 1, 0)
            cross, side = np.zeros(table.n, np.int64), np.zeros(table.n, np.int64)
            cross[low:high] = np.choose(move, [cross_now[above], cross_now[i], cross_before[above]])
            side[low:high] = np.choose(move, [side_now[above], side_now[i], side_before[above]])
            line, before, now = line + 1, now, out
            cross_before, cross_now, side_before, side_now = cross_now, cross, side_now, side
        distance = float(now[last[0]]) if distance is None else distance
        met = int(cross_now[last[0]])
        # The later half is walked first: the path is written from its end.
        todo.append((kept, (met, int(side_now[last[0]]) - met)))
        todo.append((half, last))
    return float(distance), np.array(steps[::-1], np.int64)


def _walked(table: Table, line: int, before: np.ndarray, now: np.ndarray, last: tuple[int, int], steps: list[tuple[int, int]]) -> float:
    """Walk back from `last` to the lines that are given, keeping all moves between; the cells met are added to steps. The distance at `last`."""
    start, moves = line, []
    while line < last[0] + last[1]:
        out, move, low, _ = table.next(line, before, now, last)
        moves.append((move, low))
        line, before, now = line + 1, now, out
    i, j = last
    while i + j > start:
        move, low = moves[i + j - start - 1]
        step = move[i - low]
        i, j = i - (step != SECOND), j - (step != FIRST)
        steps.append((int(i), int(j)))
    return float(now[last[0]])


def paths(a: np.ndarray, b: np.ndarray, cost: Cost = absolute) -> tuple[np.ndarray, list[np.ndarray]]:
    """path() for pairs of series of the same two lengths, their elements along the first axis and pairs along the second, all through their tables together."""
    (n, count), m = a.shape[:2], len(b)
    pair = np.arange(count)

    def prices(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return cost(a[i].reshape(-1, *a.shape[2:]), b[j].reshape(-1, *b.shape[2:])).reshape(len(i), count)

    # Row i of the table is row i + 1 here, below a row outside the table.
    before, now = np.full((n + 1, count), np.inf), np.full((n + 1, count), np.inf)
    now[1] = prices(np.zeros(1, int), np.zeros(1, int))[0]
    moves = np.zeros((n + m - 1, n, count), np.uint8)
    for line in range(1, n + m - 1):
        low, high = max(0, line - m + 1), min(n - 1, line) + 1
        i = np.arange(low, high)
        best, move = now[low:high].copy(), moves[line, low:high]
        for step, came in ((SECOND, now[low + 1 : high + 1]), (BOTH, before[low:high])):
            less = came < best
            best[less], move[less] = came[less], step
        before, now = now, np.full((n + 1, count), np.inf)
        now[low + 1 : high + 1] = prices(i, line - i) + best
    distance = now[n].copy()
    i, j = np.full(count, n - 1), np.full(count, m - 1)
    met = [(i, j)]
    while (i + j).any():
        step = moves[i + j, i, pair]
        inside = i + j > 0
        i, j = i - (inside & (step != SECOND)), j - (inside & (step != FIRST))
        met.append((i, j))
    ways = np.array(met)[::-1]
    return distance, [np.unique(ways[:, :, k], axis=0) for k in range(count)]


def halved(x: np.ndarray) -> np.ndarray:
    """Means of two neighbours each; an odd last element is left out."""
    n = len(x) // 2 * 2
    return (x[0:n:2] + x[1:n:2]) / 2


def around(coarse: list[tuple[int, int]], n: int, m: int, radius: int) -> tuple[list[int], list[int]]:
    """For each row of a table of n by m the first and last column near the path through the halved table: within `radius` of its cells, both ways, and no row left out."""
    size = -(-n // 2)
    low, high = [m] * size, [-1] * size
    for i, j in coarse:
        for k in range(max(0, i - radius), min(size, i + radius + 1)):
            low[k], high[k] = min(low[k], j), max(high[k], j)
    first, last = [], []
    for i in range(n):
        k = min(i // 2, size - 1)
        if high[k] < 0:  # a radius of 0 and an odd last element
            k -= 1
        first.append(max(0, 2 * (low[k] - radius)))
        last.append(min(m - 1, 2 * (high[k] + radius) + 1))
    last[-1] = m - 1
    return first, last


def _banded(a: np.ndarray, b: np.ndarray, cost: Cost, first: list[int], last: list[int]) -> tuple[float, list[tuple[int, int]]]:
    """The best path within a band, its cells gone through row by row."""
    inf = float("inf")
    rows, moves, above, shift = len(a), [], [], 0
    for i in range(rows):
        low, high = first[i], last[i]
        price = cost(np.broadcast_to(a[i], (high - low + 1, *a.shape[1:])), b[low : high + 1]).tolist()
        row, move, left = [], bytearray(high - low + 1), inf
        for j in range(low, high + 1):
            k = j - shift
            up = above[k] if 0 <= k < len(above) else inf
            both = above[k - 1] if 0 < k <= len(above) else inf
            best, step = up, FIRST
            if left < best:
                best, step = left, SECOND
            if both < best:
                best, step = both, BOTH
            if best == inf and i == j == 0:
                best = 0.0
            left = price[j - low] + best
            row.append(left)
            move[j - low] = step
        moves.append(move)
        above, shift = row, low
    i, j, out = rows - 1, len(b) - 1, []
    distance = above[j - shift]
    while True:
        out.append((i, j))
        if i == j == 0:
            return distance, out[::-1]
        step = moves[i][j - first[i]]
        i, j = i - (step != SECOND), j - (step != FIRST)


def fast_path(a: np.ndarray, b: np.ndarray, radius: int = 1, cost: Cost = absolute) -> tuple[float, list[tuple[int, int]]]:
    """A warping distance that is never too small, and its path, in time and memory linear in the lengths (Salvador and Chan 2007).

    The series are halved until one is shorter than radius + 2, where the path is exact; each finer table is gone through only near the path of the one
    before. Series shorter than radius + 2 therefore give the exact distance."""
    if not len(a) or not len(b):
        return float("nan"), []
    levels = [(a, b)]
    while len(levels[-1][0]) >= radius + 2 and len(levels[-1][1]) >= radius + 2:
        levels.append((halved(levels[-1][0]), halved(levels[-1][1])))
    x, y = levels.pop()
    distance, found = _banded(x, y, cost, [0] * len(x), [len(y) - 1] * len(x))
    for x, y in levels[::-1]:
        distance, found = _banded(x, y, cost, *around(found, len(x), len(y), radius))
    return distance, found


_STEPS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
_FOUND = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("path", _STEPS)])


#: Pairs whose series and paths are Python objects at once.
SLICE = 512


def _series(column: pa.ListArray, k: int) -> np.ndarray | None:
    """Numbers, or vectors, of a row as an array of doubles; None where there are none."""
    row = column[k]
    if not row.is_valid or not len(row.values):
        return None
    if pa.types.is_nested(row.values.type):
        return np.array([v.values.to_numpy(zero_copy_only=False) for v in row.values], float)
    return row.values.to_numpy(zero_copy_only=False).astype(float)


def _over(pairs: Iterator[tuple[pa.Array, pa.Array]], find: Callable[[list], list]) -> Iterator[pa.Array]:
    """Distances and paths as Arrow arrays: eight bytes a step, and no object for each."""
    for a, b in pairs:
        distance, sizes = np.full(len(a), np.nan), np.full(len(a), -1)
        steps = [np.zeros((0, 2), np.int32)]
        for at in range(0, len(a), SLICE):
            given = [(k, x, y) for k in range(at, min(len(a), at + SLICE)) if (x := _series(a, k)) is not None and (y := _series(b, k)) is not None]
            for (k, _, _), (found, way) in zip(given, find([g[1:] for g in given]), strict=True):
                distance[k], sizes[k] = found, len(way)
                steps.append(np.asarray(way, np.int32))
            steps = [np.concatenate(steps)]
        none = sizes < 0
        ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
        at = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(steps[0][:, i])) for i in (0, 1)], ["i", "j"])
        way = pa.ListArray.from_arrays(pa.array(ends), at, mask=pa.array(none))
        yield pa.StructArray.from_arrays([pa.array(distance, mask=none), way], ["distance", "path"])


def _exact(pairs: list[tuple[np.ndarray, np.ndarray]], cost: Cost) -> list[tuple[float, np.ndarray]]:
    """Pairs of the same lengths whose tables are small together, others one by one."""
    out: list = [None] * len(pairs)
    shapes: dict[tuple[int, ...], list[int]] = {}
    for k, (x, y) in enumerate(pairs):
        shapes.setdefault((len(x), len(y), *x.shape[1:], *y.shape[1:]), []).append(k)
    for (n, m, *_), rows in shapes.items():
        step = CELLS // (n * m)
        if step < 2:
            for k in rows:
                out[k] = path(*pairs[k], cost)
            continue
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            distance, ways = paths(*(np.stack([pairs[k][side] for k in some], 1) for side in (0, 1)), cost)
            for k, d, way in zip(some, distance.tolist(), ways, strict=True):
                out[k] = (d, way)
    return out


@F.arrow_udf(_FOUND)
def warp(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """distance, path (i, j from 0) of two arrays of numbers by absolute difference; nulls without numbers on both sides."""
    yield from _over(pairs, lambda rows: _exact(rows, absolute))


@F.arrow_udf(_FOUND)
def warp_vectors(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """distance, path of two arrays of unit vectors by one less their product; nulls without vectors on both sides."""
    yield from _over(pairs, lambda rows: _exact(rows, dot_distance))


def fast_warp(radius: int = 1):
    """As warp(), in linear time near the paths of halved series; the distance is never too small."""

    @F.arrow_udf(_FOUND)
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _over(pairs, lambda rows: [fast_path(a, b, radius) for a, b in rows])

    return run


def fast_warp_vectors(radius: int = 1):
    """As warp_vectors(), in linear time near the paths of halved series."""

    @F.arrow_udf(_FOUND)
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _over(pairs, lambda rows: [fast_path(a, b, radius, dot_distance) for a, b in rows])

    return run
