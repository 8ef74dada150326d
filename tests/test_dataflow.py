import ast
import random

import pandas as pd
import pytest

from tessera.operators import codebleu, codegraph, dataflow

N, O = dataflow.NOTHING, dataflow.OUTSIDE  # noqa: E741
CASES = {
    "x = 1\nif c:\n    x = 2\ny = x": [(0, N, O), (0, N, O), (1, 0, 0), (1, 0, 1)],
    "x = 1\nif c:\n    x = 2\nelif d:\n    x = 3\nelse:\n    x = 4\ny = x": [(0, N, O)] * 4 + [(1, 0, 1), (1, 0, 2), (1, 0, 3)],
    "i = 0\nwhile i < 3:\n    i = i + 1\nz = i": [(0, N, O), (0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1)],
    "for i in xs:\n    if i:\n        continue\n    y = i\nelse:\n    y = 0\nz = y": [(0, 1, O), (2, 0, 0), (2, N, O), (3, 2, 1)],
    "while a:\n    y = 1\n    break\n    y = 2\nz = y": [(0, N, O), (0, N, O), (1, 0, 0)],
    "x = 1\nx += y\nx[i] = z\nw = x": [(0, N, O), (0, 0, 0), (0, 1, O), (0, 2, O), (0, 0, 1), (0, 3, O), (4, 0, 1), (4, 0, 2)],
    "a, (b, *c) = f(d)\n(e := b)": [(0, 1, O), (0, 2, O), (3, 1, O), (3, 2, O), (4, 1, O), (4, 2, O), (5, 3, 0)],
    "x = 1\ndel x\ny = x": [(0, N, O), (1, 0, O)],
    "try:\n    x = 1\n    x = 2\nexcept E as e:\n    y = x\nfinally:\n    z = 1": [(0, N, O), (0, N, O), (1, 2, O), (3, 0, 0), (3, 0, 1), (4, N, O)],
    "with a as b:\n    c = b": [(0, 1, O), (2, 0, 0)],
    "x = 1\ndef f(x):\n    y = x\n    return y\ny = x": [(0, N, O), (1, N, O), (2, 0, 0), (3, N, O), (4, 3, 0)],
    "x = 1\nx = 2\ndef f():\n    return lambda q: q\ny = [i for i in x if i]": [(0, N, O), (0, N, O), (1, N, O), (2, 0, 1), (3, N, O)],
    "def f():\n    global x\n    x = 1\n    y = x": [(0, N, O), (1, N, O), (2, 1, 0)],
    "class A:\n    x = 1\n    y = x\n    def g(self):\n        return x": [(0, N, O), (1, N, O), (2, 1, 0), (3, N, O), (4, N, O)],
    "v = 1\nv = 2\ndef f():\n    w = v": [(0, N, O), (0, N, O), (1, N, O), (2, 0, 0), (2, 0, 1)],
    "match p:\n    case [a, *b]:\n        c = a\n    case {'k': d, **e}:\n        c = d\nf = c": [(0, 1, O), (2, 1, O), (3, 0, 0), (4, 1, O), (5, 1, O), (3, 5, 0), (6, 3, 0), (6, 3, 1)],
    "import os.path, sys as s\nt = os": [(0, N, O), (1, N, O), (2, 0, 0)],
    "": [],
}


@pytest.mark.parametrize("code", CASES)
def test_hand_made_programs(code):
    assert dataflow.edges(ast.parse(code)) == CASES[code]


def made(rng, depth=0):
    """A random program of assignments, branches and loops, as nested lists."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if depth == 3 or kind < 0.5:
            out.append(("set", rng.choice("abc"), rng.sample("abc", rng.randrange(0, 3))))
        elif kind < 0.75:
            out.append(("if", made(rng, depth + 1), made(rng, depth + 1) if rng.random() < 0.6 else []))
        else:
            out.append(("while", made(rng, depth + 1)))
    return out


def written(block, indent=""):
    lines = []
    for s in block:
        if s[0] == "set":
            lines.append(f"{indent}{s[1]} = f({', '.join(s[2])})".replace("f(", "[").replace(")", "]"))
        elif s[0] == "if":
            lines += [f"{indent}if t:", *written(s[1], indent + " "), *([f"{indent}else:", *written(s[2], indent + " ")] if s[2] else [])]
        else:
            lines += [f"{indent}while t:", *written(s[1], indent + " ")]
    return lines


def walked(block, rng, state, place, seen):
    """One run with random turns: notes which definition each read name has."""
    for s in block:
        if s[0] == "set":
            seen |= {(place[id(s)], v, state.get(v)) for v in s[2]}
            state[s[1]] = place[id(s)]
        elif s[0] == "if":
            walked(s[1] if rng.random() < 0.5 else s[2], rng, state, place, seen)
        else:
            while rng.random() < 0.55:
                walked(s[1], rng, state, place, seen)


def test_random_programs_against_their_runs():
    rng = random.Random(4)
    for _ in range(120):
        block = made(rng)
        sets, todo = [], list(reversed(block))
        while todo:
            s = todo.pop()
            if s[0] == "set":
                sets.append(s)
            else:
                todo += reversed([x for part in s[1:] for x in part])
        place, rank, count = {}, {}, {}
        for k, s in enumerate(sets):
            place[id(s)] = k
            rank[k] = count.get(s[1], 0)
            count[s[1]] = rank[k] + 1
        seen = set()
        for _ in range(1500):
            walked(block, rng, {}, place, seen)
        want = []
        for k, s in enumerate(sets):
            for v in s[2]:
                ranks = sorted(rank[d] for p, x, d in seen if (p, x) == (k, v) and d is not None)
                want += [(s[1], v, r) for r in ranks or [O]]
            if not s[2]:
                want.append((s[1], None, O))
        got = dataflow.edges(ast.parse("\n".join(written(block))))
        names = {}
        renamed = []
        for variable, source, r in want:
            a = names.setdefault(variable, len(names))
            renamed.append((a, N if source is None else names.setdefault(source, len(names)), r))
        assert got == renamed, "\n".join(written(block))


def test_names_alone_change_nothing():
    a = "def f(p):\n    q = p\n    for r in q:\n        q = r\n    return q"
    b = a.replace("p", "x").replace("q", "y").replace("r", "z").replace("foz", "for").replace("zetuzn", "return")
    assert dataflow.edges(ast.parse(a)) == dataflow.edges(ast.parse(b))
    assert dataflow.flows(ast.parse(a)) != dataflow.flows(ast.parse(a.replace("q = r", "q = p")))


def test_long_and_deep_programs(spark):
    """Thousands of terms, branches and statements; nothing recurses with a program's size."""
    long = "x = " + " + ".join(["y"] * 5000)
    chain = "if a:\n    x = 0\n" + "".join(f"elif b{i}:\n    x = {i}\n" for i in range(600)) + "y = x"
    many = "x = 0\n" + "x = x + y\n" * 3000
    calls = "x = a" + ".b()" * 900
    tree = ast.parse(chain)
    assert len(dataflow.edges(tree)) == 601 + 601
    df = spark.createDataFrame([(i, c, c) for i, c in enumerate([long, chain, many, calls, long + " +" * 3])], "k int, code string, expected string")
    rows = {r["k"]: r for r in codebleu.codebleu(df.where("k < 4"), ["k"], "code", "expected").collect()}
    assert all(r["syntax"] == 1.0 and r["dataflow"] == 1.0 for r in rows.values()) and len(rows) == 4
    flow = {r["k"]: r["e"] for r in df.select("k", dataflow.flow_edges("code").alias("e")).collect()}
    assert flow[4] is None and len(flow[2]) == 1 + 2 * 3000
    assert len(df.select(codegraph.code_names("code")).collect()) == 5


def test_shapes_without_recursion():
    def plain(node, found):
        inner = [plain(c, found) for c in ast.iter_child_nodes(node)]
        text = f"{type(node).__name__}({','.join(inner)})"
        if inner:
            found[text] = found.get(text, 0) + 1
        return text

    rng = random.Random(6)
    for _ in range(60):
        a, b = (ast.parse("\n".join(written(made(rng)))) for _ in range(2))
        fa, fb, shapes = {}, {}, {}
        plain(a, fa)
        plain(b, fb)
        ca, cb = codebleu.subtrees(a, shapes), codebleu.subtrees(b, shapes)
        assert sorted(ca.values()) == sorted(fa.values())
        assert sum((ca & cb).values()) == sum(min(n, fb.get(k, 0)) for k, n in fa.items())


def test_programs_are_read_once_and_shares_are_those_of_common_numbers(spark):
    """Each program was parsed and walked for each row that has it."""
    texts = ["x = 1", "def f(a):\n    return a + 1", "for i in y:\n    x = f(i)\n    x = f(x)", "class A(B):\n    def c(self):\n        d = E(1)\n        return d", "x = (", "", "f(g(h))\nf(g(1))"]
    read = [codebleu._read(x) for x in texts]
    for c, x in zip(texts, read, strict=True):
        for r, y in zip(texts, read, strict=True):
            if x is not None and y is not None:
                shapes = {}
                assert codebleu._common(x[:2], y[:2]) == codebleu._share(codebleu.subtrees(ast.parse(c), shapes), codebleu.subtrees(ast.parse(r), shapes)), (c, r)
    calls = []
    parse, codebleu.parse = codebleu.parse, lambda code: calls.append(code) or parse(code)
    try:
        codebleu._read_short.cache_clear()
        pairs = (pd.Series(texts * 3), pd.Series(texts[1:] * 3 + texts[:3]))
        assert len(next(codebleu.tree_matches.func(iter([pairs])))) == 21 and sorted(calls) == sorted(texts)
    finally:
        codebleu.parse = parse
