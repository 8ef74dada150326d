"""Distance between the syntax trees of two programs: Zhang and Shasha's ordered tree edit distance with unit costs."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import treescript
from tessera.operators.codegraph import parse


def postorder(tree: ast.AST) -> tuple[list[str], list[int]]:
    """Labels in post-order, and for each node the place of its leftmost leaf. Scalar fields are leaves named `field: value`."""
    labels: list[str] = []
    left: list[int] = []

    def children(node: ast.AST) -> list:
        out: list = []
        for field, value in ast.iter_fields(node):
            if isinstance(value, list):
                out += [v if isinstance(v, ast.AST) else str(v) for v in value]
            else:
                out.append(value if isinstance(value, ast.AST) else f"{field}: {value}")
        return out

    stack: list = [(tree, None, None)]
    while stack:
        node, below, first = stack.pop()
        if isinstance(node, str):
            labels.append(node)
            left.append(len(labels) - 1)
        elif below is None:
            stack.append((node, True, len(labels)))
            stack += [(c, None, None) for c in reversed(children(node))]
        else:
            labels.append(type(node).__name__)
            left.append(first if first < len(labels) - 1 else len(labels) - 1)
    return labels, left


#: Programs of at most so many characters are read once, as long as the worker remembers them.
SHORT = 1 << 12


def tree_of(code: str | None) -> tuple[list[str], list[int]] | None:
    """A program's postorder(); None where it doesn't parse."""
    return _short_tree(code) if code is None or len(code) <= SHORT else _tree(code)


def _tree(code: str | None) -> tuple[list[str], list[int]] | None:
    return None if (tree := parse(code)) is None else postorder(tree)


@lru_cache(4096)
def _short_tree(code: str | None) -> tuple[list[str], list[int]] | None:
    return _tree(code)


def _keyroots(left: tuple[int, ...]) -> list[int]:
    return sorted({lowest: i for i, lowest in enumerate(left)}.values())


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Fewest insertions, deletions and renamings that turn one tree into the other."""
    if a == b:
        return 0
    kinds: dict[str, int] = {}
    xa, xb = (tuple(kinds.setdefault(s, len(kinds)) for s in labels) for labels in (a[0], b[0]))
    if len(xa) * len(xb) > treescript.SMALL:
        return treescript.script(a, b)[0]
    return _distance(xa, tuple(a[1]), xb, tuple(b[1]))


@lru_cache(512)
def _distance(xa: tuple[int, ...], ka: tuple[int, ...], xb: tuple[int, ...], kb: tuple[int, ...]) -> int:
    """The distance depends on shapes and on which labels are equal, so generations that differ in names alone share it."""
    dist = [[0] * len(xb) for _ in xa]
    roots_b = _keyroots(kb)
    for i in _keyroots(ka):
        li = ka[i]
        for j in roots_b:
            lj = kb[j]
            # One node against a tree: all but one node are inserted, and that one is renamed unless the label is there.
            if li == i:
                label, there = xa[i], 0
                for y in range(lj, j + 1):
                    there = there or xb[y] == label
                    if kb[y] == lj:
                        dist[i][y] = y - lj + 1 - there
                continue
            if lj == j:
                label, there = xb[j], 0
                for x in range(li, i + 1):
                    there = there or xa[x] == label
                    if ka[x] == li:
                        dist[x][j] = x - li + 1 - there
                continue
            above = list(range(j - lj + 2))
            forest = [above]
            for x in range(li, i + 1):
                label, back, known = xa[x], forest[ka[x] - li], dist[x]
                whole = ka[x] == li
                now = left = x - li + 1
                row = [now]
                for y in range(lj, j + 1):
                    at = y - lj
                    left += 1
                    if (best := above[at + 1] + 1) < left:
                        left = best
                    if whole and kb[y] == lj:
                        if (best := above[at] + (label != xb[y])) < left:
                            left = best
                        known[y] = left
                    elif (best := back[kb[y] - lj] + known[y]) < left:
                        left = best
                    row.append(left)
                forest.append(row)
                above = row
    return dist[-1][-1]


@F.pandas_udf(T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("norm", "raw", "max")], *[T.StructField(c, T.BooleanType()) for c in ("syntax_error", "reference_error")]]))
def code_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Distance of generated and expected programs, by the larger tree; nulls where either doesn't parse."""
    for generated, expected in pairs:
        rows = []
        for g, e in zip(generated, expected, strict=True):
            ta, tb = tree_of(g), tree_of(e)
            if ta is None or tb is None:
                rows.append((None, None, None, ta is None, tb is None))
                continue
            raw, most = float(tree_distance(ta, tb)), float(max(len(ta[0]), len(tb[0])))
            rows.append((raw / (most + 1e-7), raw, most, False, False))
        yield pd.DataFrame(rows, columns=["norm", "raw", "max", "syntax_error", "reference_error"]).astype({"norm": "float64", "raw": "float64", "max": "float64"})


@F.pandas_udf(T.IntegerType())
def tree_nodes(codes: pd.Series) -> pd.Series:
    """Nodes of each program's tree; null where it doesn't parse."""
    return codes.map(lambda c: None if (t := parse(c)) is None else len(postorder(t)[0])).astype("Int32")
