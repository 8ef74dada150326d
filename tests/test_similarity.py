import ast
import math
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import sequence, vectors
from tessera.operators import codebleu, codegraph, rewards, treedist

PROGRAMS = ["x = 1", "y = f(x)\nz = 2", "for i in range(3):\n    print(i)", "def f(a):\n    return a + 1", "x = [1, 2]\ny = x[0]", "class A(B):\n    def g(self):\n        self.h()"]


def plain_distance(a, b):
    """Tree distance by its recursion over forests."""

    def convert(t):
        if isinstance(t, str):
            return (t, ())
        inner = []
        for field, v in ast.iter_fields(t):
            if isinstance(v, list):
                inner += [x if isinstance(x, ast.AST) else str(x) for x in v]
            else:
                inner.append(v if isinstance(v, ast.AST) else f"{field}: {v}")
        return (type(t).__name__, tuple(convert(x) for x in inner))

    @lru_cache(None)
    def size(f):
        return sum(1 + size(t[1]) for t in f)

    @lru_cache(None)
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (l1, c1), (l2, c2) = f[-1], g[-1]
        return min(d(f[:-1] + c1, g) + 1, d(f, g[:-1] + c2) + 1, d(f[:-1], g[:-1]) + d(c1, c2) + (l1 != l2))

    return d((convert(a),), (convert(b),))


@pytest.mark.parametrize("a", PROGRAMS)
@pytest.mark.parametrize("b", PROGRAMS)
def test_tree_distance(a, b):
    ta, tb = ast.parse(a), ast.parse(b)
    got = treedist.tree_distance(treedist.postorder(ta), treedist.postorder(tb))
    assert got == plain_distance(ta, tb) == treedist.tree_distance(treedist.postorder(tb), treedist.postorder(ta))
    assert (got == 0) == (a == b)


def test_distance_columns(spark):
    df = spark.createDataFrame([("x = 1", "x = 2"), ("x = (", "x = 1"), ("x = 1", "x ="), ("", "x = 1"), (None, "x")], "g string, e string")
    rows = df.select(treedist.code_distance("g", "e").alias("t")).select("t.*").collect()
    assert rows[0]["raw"] == 1.0 and math.isclose(rows[0]["norm"], 1 / (rows[0]["max"] + 1e-7))
    assert [(r["raw"], r["syntax_error"], r["reference_error"]) for r in rows[1:3]] == [(None, True, False), (None, False, True)]
    assert rows[3]["raw"] > 0 and rows[4]["syntax_error"]
    assert [r[0] for r in df.select(treedist.tree_nodes("g")).collect()][:2] == [len(treedist.postorder(ast.parse("x = 1"))[0]), None]


SCENE = """
class Show(Scene):
    def construct(self):
        a = Circle(radius=2)
        b = lib.Square()
        a.shift(UP)
        b.scale(2)
        Line(a, b).set_color(RED)
        self.camera.background_color = a.color
        self.play(Create(a), run_time=b.width, lag=[a.x, b])
        "text".join(a)
        c = d = a
"""


def test_names():
    calls, touched = codegraph.names_of(SCENE)
    assert {"Circle", "lib.Square", "Circle.shift", "lib.scale", "Line", "Line.set_color", "self.play", "Scene.play", "Create", "text.join"} == calls
    # Both readings of self stand side by side; a list is not looked into.
    assert {"self.camera.background_color", "Scene.camera.background_color", "Circle.color", "Circle", "lib.width", "lib"} >= touched >= {"Circle.color", "lib.width", "Circle", "Scene.camera.background_color"}
    assert "Circle.x" not in touched
    assert codegraph.names_of("x = (") == (set(), set()) == codegraph.names_of(None)
    assert codegraph.names_of_many(["a = Dot()", "a.move()"])[0] == {"Dot", "Dot.move"}
    assert codegraph.names_of("a.move()")[0] == {"a.move"}


def test_name_filters(spark):
    df = spark.createDataFrame([(["self.x", "Scene.play", "np.array", "Dot", "Dot", "a.b.c", "print"], ["Dot", "Line"])], "n array<string>, v array<string>")
    kept = df.select(codegraph.filter_names(F.col("n")).alias("n"), "v")
    assert kept.first()["n"] == ["Dot", "a.b.c"]
    assert kept.select(codegraph.vars_beyond_calls(F.col("v"), F.col("n"))).first()[0] == ["Line"]


def plain_dtw(a, b):
    @lru_cache(None)
    def d(i, j):
        c = abs(a[i] - b[j])
        before = [d(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
        return c + min(before, default=0.0)

    return d(len(a) - 1, len(b) - 1)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=8), st.lists(st.integers(0, 9), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_dtw_of_arrays(a, b):
    cost = np.abs(np.subtract.outer(np.array(a, float), np.array(b, float)))
    both = np.stack([cost, 2 * cost])
    want = plain_dtw(tuple(a), tuple(b))
    assert sequence.dtw(both).tolist() == [want, 2 * want] == sequence.dtw(both.transpose(0, 2, 1)).tolist()
    assert (sequence.dtw(both, 0) >= sequence.dtw(both)).all() and (sequence.dtw(both, 100) == sequence.dtw(both)).all()


def test_dtw_columns(spark):
    rng = random.Random(1)
    rows = [([rng.random() for _ in range(rng.randrange(1, 9))], [rng.random() for _ in range(rng.randrange(1, 9))]) for _ in range(20)] + [([], [1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(sequence.dtw_fold(F.col("a"), F.col("b")).alias("x"), sequence.dtw_series("a", "b").alias("y"), sequence.dtw_fold(F.col("a"), F.col("a")).alias("z")).collect()
    for (a, b), r in zip(rows[:20], got, strict=False):
        assert math.isclose(r["x"], plain_dtw(tuple(a), tuple(b))) and math.isclose(r["x"], r["y"]) and r["z"] == 0
    assert [(r["x"], r["y"]) for r in got[20:]] == [(None, None)] * 2


def plain_ssim(a, b):
    out = []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            p, q = a[y : y + 7, x : x + 7].ravel().astype(float), b[y : y + 7, x : x + 7].ravel().astype(float)
            c = np.cov(p, q)
            c1, c2 = 2.55**2, 7.65**2
            out.append((2 * p.mean() * q.mean() + c1) * (2 * c[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (c[0, 0] + c[1, 1] + c2)))
    return float(np.mean(out))


def test_ssim(spark):
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, (9, 8)) for _ in range(4)]
    assert np.allclose(sequence.ssim(np.array(frames[:2] * 2), np.array([frames[0], frames[0], frames[1], frames[1]])), [1, plain_ssim(frames[1], frames[0]), plain_ssim(frames[0], frames[1]), 1])
    big = [rng.integers(0, 256, (20, 8)) for _ in range(2)]
    rows = [(i, frames[i].ravel().tolist(), frames[(i + 1) % 4].ravel().tolist()) for i in range(4)] + [(4, big[0].ravel().tolist(), big[1].ravel().tolist()), (5, None, rows_of := big[0].ravel().tolist()), (6, rows_of[:72], rows_of)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, a array<int>, b array<int>").select("k", sequence.ssim_frames("a", "b", F.lit(8)).alias("s")).collect()}
    for k in range(4):
        assert math.isclose(got[k], plain_ssim(frames[k], frames[(k + 1) % 4]), rel_tol=1e-9)
    assert math.isclose(got[4], plain_ssim(*big), rel_tol=1e-9) and all(got[k] is None or math.isnan(got[k]) for k in (5, 6))
    assert sequence.resize_area(np.full((6, 4), 7.0), 3, 2).tolist() == [[7.0, 7.0]] * 3


@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3), st.lists(st.floats(-5, 5), min_size=3, max_size=3))
@settings(max_examples=20, deadline=None)
def test_cosine(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0]
    assert got is None or -1.000001 <= got <= 1.000001


def test_codebleu(spark):
    same = "def f(a):\n    b = a + 1\n    return b\n"
    df = spark.createDataFrame([(1, same, same), (2, "x = (", same), (3, "y = 2", same), (4, same, "x = (")], "k int, c string, r string")
    got = {r["k"]: r for r in codebleu.codebleu(df, ["k"], "c", "r").collect()}
    assert math.isclose(got[1]["codebleu"], 1.0) and got[2]["syntax"] == 0 and got[3]["codebleu"] < 0.3 and got[4]["syntax"] is None
    counts = codebleu.clipped_counts(spark.createDataFrame([(1, "a a b", "a c")], "k int, c string, r string"), ["k"], "c", "r", 1).first()
    assert (counts["matched"], counts["total"]) == (1, 3)


def test_rewards(spark):
    rows = [(1, "x = 1", 0.25, 1.0, 0.5, 0.5), (2, " ", 0.9, 0.9, 0.9, 0.9), (3, "y", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, generated_code string, codebert_similarity double, codebleu double, ssim_score double, visual_semantic_score double")
    got = {r["k"]: (r["t"], r["v"], r["g"], r["a"]) for r in df.select("k", *[rewards.reward(n).alias(n[0]) for n in ("text", "visual", "geo", "arithmetic")]).collect()}
    assert got[1] == (0.5, 0.5, 0.5, pytest.approx(0.5)) and got[2] == (0.0,) * 4 and got[3][:2] == (0.0, 1.0)
    with pytest.raises(KeyError, match="ast_distance_norm"):
        rewards.summary(df)
    seen = []

    def stage(d):
        seen.append(d.count())
        return d.withColumn("r", F.length("generated_code"))

    out = rewards.once_each(df.union(df), "generated_code", stage, "r")
    assert seen == [2] and out.count() == 6


def test_runs_of_words_stay_in_their_pair(spark):
    """A pair's runs are counted where the pair is: none is a row of its own, and rows that lie by their keys aren't moved."""
    df = spark.createDataFrame([(1, "a a b", "a c a"), (2, None, "x"), (2, "x y", None), (3, "", " \n"), (4, "x", None)], "k int, c string, r string")
    found = codebleu.clipped_counts(df.repartition(4, "k"), ["k"], "c", "r", 1, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 2, 3), (1, 2, 0, 2), (2, 1, 1, 2), (2, 2, 0, 1), (4, 1, 0, 1)]
    scores = {r["k"]: r for r in codebleu.ngram_scores(df, ["k"], "c", "r", order=2, heavy=("a",), light=0.5).collect()}
    assert scores[1]["weighted"] == 2.0 / 2.5 and scores[2]["weighted"] == 1.0 and scores[3]["weighted"] is None and scores[3]["brevity"] == 1.0
