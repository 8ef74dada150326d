import ast
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import treedist, treescript
from tessera.plans.catalog import QUERIES


def tree(parents, labels):
    """Post-order labels and leftmost leaves of the tree in which node k hangs, as the last child, under node parents[k]."""
    children = {}
    for k, p in enumerate(parents):
        children.setdefault(p, []).append(k + 1)
    names, left = [], []

    def visit(v):
        first = len(names)
        for c in children.get(v, ()):
            visit(c)
        names.append(labels[v])
        left.append(first if len(names) - 1 > first else len(names) - 1)

    visit(0)
    return names, left


@st.composite
def trees(draw, most=14):
    n = draw(st.integers(1, most))
    return tree([draw(st.integers(0, k)) for k in range(n - 1)], [draw(st.sampled_from("abc")) for _ in range(n)])


def parents(left):
    out, above = {}, []
    for v in range(len(left) - 1, -1, -1):
        while above and left[above[-1]] > v:
            above.pop()
        out[v] = above[-1] if above else None
        above.append(v)
    return out


def is_mapping(a, b, pairs):
    """Every node once; partners keep the order of nodes and of ancestors."""
    assert sorted(i for i, _ in pairs if i >= 0) == list(range(len(a[0]))) and sorted(j for _, j in pairs if j >= 0) == list(range(len(b[0])))
    both = [p for p in pairs if p[0] >= 0 and p[1] >= 0]
    below = lambda t, u, v: t[1][v] <= u <= v
    return all((i < k) == (j < m) and below(a, i, k) == below(b, j, m) for i, j in both for k, m in both if (i, j) != (k, m))


@settings(max_examples=300, deadline=None)
@given(trees(), trees(), st.sampled_from([1, 5, 4096]))
def test_against_plain_distances(a, b, block):
    distance, pairs = treescript.script(a, b, block)
    assert distance == treedist.tree_distance(a, b)
    assert distance == sum(i < 0 or j < 0 or a[0][i] != b[0][j] for i, j in pairs)
    assert is_mapping(a, b, pairs)
    assert treescript.at_least(a, b) <= distance


@settings(max_examples=60, deadline=None)
@given(trees(40))
def test_turning_round(a):
    left = np.array(a[1])
    labels, turned, origin = treescript._turned(np.arange(len(left)), left)
    again, back, _ = treescript._turned(labels, turned)
    assert again.tolist() == list(range(len(left))) and back.tolist() == a[1]
    up, over = parents(a[1]), parents(turned.tolist())
    assert all(up[int(origin[v])] == (None if p is None else int(origin[p])) for v, p in over.items())


def long_program(n, seed):
    rng = random.Random(seed)
    lines = []
    for k in range(n):
        lines.append(rng.choice([f"a{k % 7} = b{rng.randrange(5)} + {k % 3}", f"for i in c{k % 4}:\n    d(i, e={k % 5})", f"if a{k % 7}:\n    f(g(h))\nelse:\n    x.y = [1, {k % 9}]", f"def m{k}(self, p):\n    return p * {rng.randrange(4)}"]))
    return "\n".join(lines)


def test_two_programs_of_three_thousand_nodes():
    a, b = (treedist.postorder(ast.parse(long_program(150, s))) for s in (1, 2))
    assert 3000 < len(a[0]) < 4500 and 3000 < len(b[0]) < 4500
    tracemalloc.start()
    distance, pairs = treescript.script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 2 * len(a[0]) * len(b[0]) + 16 * len(a[0]) * treescript.BLOCK
    assert distance == sum(i < 0 or j < 0 or a[0][i] != b[0][j] for i, j in pairs)
    assert treescript.at_least(a, b) <= distance < len(a[0])


def test_deep_and_wide_trees():
    chain = (["a"] * 900, [0] * 900)
    comb = tree([k - k % 2 for k in range(400)], ["a", "b"] * 201)
    wide = (["x"] * 700 + ["r"], [*range(700), 0])
    for t in (chain, comb, wide):
        assert treescript.script(t, t)[0] == 0
    assert treescript.script(chain, (["a"] * 850, [0] * 850))[0] == 50
    assert treescript.script(wide, (["x"] * 650 + ["r"], [*range(650), 0]))[0] == 50


def test_columns(spark):
    rows = [("x = 1", "x = 2"), ("x = (", "x = 1"), ("x = 1", None), ("", "x = 1"), ("x = 1", "x = 1"), ("a", "def f():\n    return [1, 2, 3, 4]")]
    df = spark.createDataFrame(rows, "g string, e string").coalesce(1)
    got = [r["t"] for r in df.select(treescript.code_script()("g", "e").alias("t")).collect()]
    assert [tuple(e) for e in got[0]["edits"]] == [("rename", 2, 2, "value: 1", "value: 2")] or got[0]["edits"][0]["op"] == "rename"
    assert got[1]["distance"] is None and got[2]["edits"] is None
    assert got[3]["distance"] == len(got[3]["edits"]) > 0 and {e["op"] for e in got[3]["edits"]} == {"insert"}
    assert got[4]["distance"] == 0 and got[4]["edits"] == []
    cut = [r["t"] for r in df.select(treescript.code_script(3)("g", "e").alias("t")).collect()]
    assert cut[0] == got[0] and cut[5]["distance"] is None and cut[5]["at_least"] > 3


def test_scripts_are_worked_out_once_and_behind_the_shuffle(spark):
    """A filter on a script went before the shuffle that deals out the rows, into the scan's one task."""
    for name in ("tree_script", "tree_script_counts", "tree_within"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM"), name


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(trees(), trees()), max_size=6))
def test_columns_of_edits_are_those_of_the_mapping(rows):
    got = treescript._scripts([(0, d, ((a[0], b[0]), *places)) for a, b in rows for d, *places in [treescript._differing(a, b)]] + [(None, None, None)]).to_pylist()
    assert got.pop() == {"at_least": None, "distance": None, "edits": None}
    for (a, b), r in zip(rows, got, strict=True):
        distance, pairs = treescript.script(a, b)
        named = [("insert" if i < 0 else "delete" if j < 0 else "rename", i if i >= 0 else None, j if j >= 0 else None, a[0][i] if i >= 0 else None, b[0][j] if j >= 0 else None) for i, j in pairs if i < 0 or j < 0 or a[0][i] != b[0][j]]
        assert (r["distance"], [tuple(e.values()) for e in r["edits"]]) == (distance, named)
