import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import warping

SERIES = st.lists(st.integers(0, 4), min_size=1, max_size=14)


def plain(a, b, cost=lambda x, y: abs(x - y), near=None):
    """Distance and path through the whole table (or the cells of `near`), cell by cell; ties as the module says."""
    inf = float("inf")
    d = {}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if near is None or (i, j) in near:
            best = min(((d.get((i - 1, j), (inf,))[0], 0), (d.get((i, j - 1), (inf,))[0], 1), (d.get((i - 1, j - 1), (inf,))[0], 2)), key=lambda x: x[0])
            d[i, j] = (cost(a[i], b[j]) + (0 if i == j == 0 else best[0]), best[1])
    i, j = len(a) - 1, len(b) - 1
    distance, out = d[i, j][0], [(i, j)]
    while (i, j) != (0, 0):
        step = d[i, j][1]
        i, j = i - (step != 1), j - (step != 0)
        out.append((i, j))
    return distance, out[::-1]


def plain_fast(a, b, radius, cost=lambda x, y: abs(x - y)):
    """The approximation by sets of cells."""
    if len(a) < radius + 2 or len(b) < radius + 2:
        return plain(a, b, cost)
    half = lambda x: [(x[i] + x[i + 1]) / 2 for i in range(0, len(x) - len(x) % 2, 2)]
    _, coarse = plain_fast(half(a), half(b), radius, cost)
    wide = {(i + p, j + q) for i, j in coarse for p in range(-radius, radius + 1) for q in range(-radius, radius + 1)}
    near = {(2 * i + p, 2 * j + q) for i, j in wide for p in (0, 1) for q in (0, 1)}
    return plain(a, b, cost, near)


@settings(max_examples=150, deadline=None)
@given(SERIES, SERIES, st.sampled_from([1, 7, 1000]))
def test_path_of_the_whole_table(a, b, cells):
    distance, steps = warping.path(np.array(a, float), np.array(b, float), cells=cells)
    assert (distance, [tuple(s) for s in steps]) == plain(a, b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 4))
def test_fast_path(a, b, radius):
    distance, steps = warping.fast_path(np.array(a, float), np.array(b, float), radius)
    assert (distance, [tuple(s) for s in steps]) == plain_fast(a, b, radius)
    exact = plain(a, b)[0]
    assert distance >= exact and (min(len(a), len(b)) >= radius + 2 or distance == exact)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 5), st.randoms(use_true_random=False))
def test_pairs_together(n, m, count, rng):
    a, b = (np.array([[float(rng.randrange(4)) for _ in range(count)] for _ in range(k)]) for k in (n, m))
    distance, ways = warping.paths(a, b)
    for k in range(count):
        assert (distance[k], [tuple(s) for s in ways[k].tolist()]) == plain(a[:, k], b[:, k])


def test_no_radius_leaves_no_row_out():
    rng = random.Random(1)
    for n in range(1, 40):
        a, b = np.array([rng.random() for _ in range(n)]), np.array([rng.random() for _ in range(41 - n)])
        distance, steps = warping.fast_path(a, b, 0)
        assert steps[0] == (0, 0) and steps[-1] == (n - 1, 40 - n) and distance >= plain(a, b)[0] - 1e-12
        assert all((p - i, q - j) in ((0, 1), (1, 0), (1, 1)) for (i, j), (p, q) in itertools.pairwise(steps))


def test_halves_and_vectors():
    rng = np.random.default_rng(7)
    for n, m in ((1, 9), (9, 1), (33, 20), (64, 64), (2, 50)):
        a, b = rng.normal(size=(n, 5)), rng.normal(size=(m, 5))
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        whole, halves = warping.path(a, b, warping.dot_distance), warping.path(a, b, warping.dot_distance, cells=1)
        want = plain(a, b, lambda x, y: 1.0 - (x * y).sum())
        for distance, steps in (whole, halves):
            assert math.isclose(distance, want[0]) and [tuple(s) for s in steps] == want[1]


def test_memory_is_linear():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=4000).cumsum(), rng.normal(size=4000).cumsum()
    tracemalloc.start()
    distance, steps = warping.path(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the whole table has 128 MB
    cells = np.abs(a[steps[:, 0]] - b[steps[:, 1]])
    assert math.isclose(cells.sum(), distance, rel_tol=1e-9)
    assert distance <= warping.fast_path(a, b)[0]


def test_columns(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 3.0]), ([], [1.0]), (None, [1.0]), ([2.0], [2.0, 2.0]), ([2.0], [2.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for found in (warping.warp("a", "b"), warping.fast_warp()("a", "b")):
        got = df.select(found.alias("w")).select("w.*").collect()
        assert got[0]["distance"] == 1.0 and [tuple(s) for s in got[0]["path"]] == [(0, 0), (1, 1), (2, 1)]
        assert got[1]["path"] is None and got[2]["distance"] is None and got[3] == got[4]
    unit = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "a array<array<double>>, b array<array<double>>")
    for found in (warping.warp_vectors("a", "b"), warping.fast_warp_vectors(2)("a", "b")):
        assert [tuple(s) for s in unit.select(found.alias("w")).select("w.path").first()["path"]] == [(0, 0), (0, 1), (1, 2)]
    assert df.limit(0).select(F.size(warping.warp("a", "b")["path"])).collect() == []


def test_paths_of_a_batch_are_no_objects():
    """A batch's paths take eight bytes a step and little more, whatever the number of pairs."""
    import tracemalloc

    import pyarrow as pa

    series, way = pa.array([[1.0, 2.0]] * 20_000 + [None, []], pa.list_(pa.float64())), np.zeros((127, 2), np.int64)
    tracemalloc.start()
    (out,) = warping._over(iter([(series, series)]), lambda rows: [(0.5, way)] * len(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20 and len(out) == 20_002
    assert out[0].as_py() == {"distance": 0.5, "path": [{"i": 0, "j": 0}] * 127} and out[20_001].as_py() == out[20_000].as_py() == {"distance": None, "path": None}
