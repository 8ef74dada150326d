"""Edit scripts between syntax trees, for trees of thousands of nodes.

The distance is Zhang and Shasha's. Its subproblems are pairs of a node of one tree and a subtree of the other that starts a path (a key root); paths go to the leftmost
or to the rightmost leaf, whichever leaves fewer subproblems for the two trees. All key roots of the second tree, in blocks, go through a row of the table
together: with unit costs a row is a running minimum, so it is a few array operations. Key roots that hold others wait for them within a row, level by level.

For trees of n and m nodes: 2 * n * m small integers for the distances and for walking a script back, and n * BLOCK for the rows in work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.codegraph import parse

#: Columns of the second tree that are worked on together.
BLOCK = 4096
#: Pairs of trees with at most so many pairs of nodes are remembered.
SMALL = 1 << 18
#: Labels in post-order, and for each node the place of its leftmost leaf.
Tree = tuple[list[str], list[int]]


def key_roots(left: np.ndarray) -> np.ndarray:
    """The last node of each path, in order."""
    return np.sort(len(left) - 1 - np.unique(left[::-1], return_index=True)[1])


def mirrored(left: np.ndarray) -> np.ndarray:
    """The place of each node in the post-order of the tree whose children are turned round."""
    depth, above = np.zeros(len(left), np.int64), []
    for v in range(len(left) - 1, -1, -1):
        while above and left[above[-1]] > v:
            above.pop()
        depth[v] = len(above)
        above.append(v)
    return len(left) - 1 - (left + depth)


def _turned(labels: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mirrored tree, and for each of its nodes the place in the given one."""
    to = mirrored(left)
    origin = np.argsort(to)
    size = np.arange(len(left)) - left + 1
    return labels[origin], np.arange(len(left)) - size[origin] + 1, origin


def _work(left: np.ndarray) -> int:
    roots = key_roots(left)
    return int((roots - left[roots] + 1).sum())


class Block:
    """Key roots of the second tree side by side: for each a border and its subtree's nodes, as columns."""

    def __init__(self, roots: np.ndarray, left: np.ndarray, labels: np.ndarray):
        sizes = roots - left[roots] + 2
        self.width = int(sizes.sum())
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = np.repeat(np.arange(len(roots)), sizes)
        low = left[roots][segment]
        self.offset = np.arange(self.width) - start
        self.node = low + self.offset - 1
        self.inner = self.offset > 0
        node = np.where(self.inner, self.node, 0)
        self.path = self.inner & (left[node] == low)
        self.back = np.where(self.inner, start + left[node] - low, 0)
        self.label = labels[node]
        self.safe = node
        self.before = np.maximum(np.arange(self.width) - 1, 0)
        # A segment's level: one above those in this block that hold its nodes off the path.
        owner = {int(left[r]): s for s, r in enumerate(roots)}
        level = np.zeros(len(roots), np.int64)
        for s, r in enumerate(roots):
            firsts = np.unique(left[left[r] : r + 1])
            level[s] = max((level[owner[f]] + 1 for f in firsts.tolist() if f in owner and owner[f] < s), default=0)
        # A running minimum must not run on into the next segment: later segments lie far below.
        self.fall = -segment * np.int64(1 << 20)
        self.levels = [np.flatnonzero(level[segment] == k) for k in range(int(level.max()) + 1)]


def _settled(cand: np.ndarray, block: Block, columns: np.ndarray | slice) -> np.ndarray:
    """Rows in which a node may also be inserted after any cell to the left."""
    offset, fall = block.offset[columns], block.fall[columns]
    return np.minimum.accumulate(cand - offset + fall) - fall + offset


def distances(xa: np.ndarray, la: np.ndarray, xb: np.ndarray, lb: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The distance of each subtree of one tree to each of the other."""
    kind = np.int16 if len(xa) + len(xb) < 1 << 15 else np.int32
    known = np.zeros((len(xa), len(xb)), kind)
    roots = key_roots(lb)
    ends = np.cumsum(roots - lb[roots] + 2)
    cuts, at = [0], 0
    while at < len(roots):
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        cuts.append(at)
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = Block(roots[low:high], lb, xb)
        for i in key_roots(la).tolist():
            _through(part, i, xa, la, known)
    return known


def _through(b: Block, i: int, xa: np.ndarray, la: np.ndarray, known: np.ndarray) -> None:
    """The rows of one key root of the first tree through a block of the second."""
    first = int(la[i])
    rows = np.empty((i - first + 2, b.width), known.dtype)
    rows[0] = b.offset
    one = [slice(None)] if len(b.levels) == 1 else b.levels
    for x in range(first, i + 1):
        prev, back, row = rows[x - first], rows[int(la[x]) - first], rows[x - first + 1]
        if la[x] != first:
            cand = np.minimum(prev + 1, np.where(b.inner, back[b.back] + known[x, b.safe], prev + 1))
            row[:] = _settled(cand, b, slice(None))
            continue
        for c in one:
            path, inner = b.path[c], b.inner[c]
            before = prev[b.before[c]]
            cand = np.where(path, before + (b.label[c] != xa[x]), back[b.back[c]] + known[x, b.safe[c]])
            cand = np.where(inner, np.minimum(cand, prev[c] + 1), prev[c] + 1)
            done = _settled(cand, b, c)
            row[c] = done
            known[x, b.node[c][path]] = done[path]


def script(a: Tree, b: Tree, block: int = BLOCK) -> tuple[int, list[tuple[int, int]]]:
    """The distance of two trees and a cheapest mapping: pairs (i, j) of places in post-order; -1 where a node has no partner. Pairs are kept before nodes are
    taken out, and that before others are put in."""
    arrays = _numbered(a, b)
    if len(a[0]) * len(b[0]) > SMALL:
        return _mapped(*arrays, block)
    distance, pairs = _remembered(*[x.tobytes() for x in arrays], block)
    return distance, list(pairs)


def _numbered(a: Tree, b: Tree) -> list[np.ndarray]:
    """Labels as numbers, equal where they are equal, and places of leftmost leaves, of both trees."""
    kinds: dict[str, int] = {}
    return [np.array(v, np.int64) for t in (a, b) for v in ([kinds.setdefault(x, len(kinds)) for x in t[0]], t[1])]


@lru_cache(256)
def _remembered(*given) -> tuple[int, list[tuple[int, int]]]:
    """Small trees by their shapes and which labels are equal: generations that differ in names alone share a mapping."""
    return _mapped(*[np.frombuffer(x, np.int64) for x in given[:4]], given[4])


def _differing(a: Tree, b: Tree) -> tuple[int, list[int], list[int]]:
    """The distance, and the places of those pairs of a cheapest mapping that are edits."""
    arrays = _numbered(a, b)
    if len(a[0]) * len(b[0]) > SMALL:
        return _unlike(*arrays)
    return _unlike_remembered(*[x.tobytes() for x in arrays])


@lru_cache(1024)
def _unlike_remembered(*given) -> tuple[int, list[int], list[int]]:
    return _unlike(*[np.frombuffer(x, np.int64) for x in given])


def _unlike(xa: np.ndarray, la: np.ndarray, xb: np.ndarray, lb: np.ndarray) -> tuple[int, list[int], list[int]]:
    distance, pairs = _mapped(xa, la, xb, lb, BLOCK)
    kept = [(i, j) for i, j in pairs if i < 0 or j < 0 or xa[i] != xb[j]]
    return distance, [i for i, _ in kept], [j for _, j in kept]


def _mapped(xa: np.ndarray, la: np.ndarray, xb: np.ndarray, lb: np.ndarray, block: int) -> tuple[int, list[tuple[int, int]]]:
    ya, ra, oa = _turned(xa, la)
    yb, rb, ob = _turned(xb, lb)
    if _work(ra) * _work(rb) < _work(la) * _work(lb):
        xa, la, xb, lb = ya, ra, yb, rb
    else:
        oa, ob = np.arange(len(xa)), np.arange(len(xb))
    known = distances(xa, la, xb, lb, block)
    pairs: list[tuple[int, int]] = []
    todo = [(len(xa) - 1, len(xb) - 1)]
    while todo:
        todo += _walked(*todo.pop(), xa, la, xb, lb, known, pairs)
    pairs = [(int(oa[i]) if i >= 0 else -1, int(ob[j]) if j >= 0 else -1) for i, j in pairs]
    return int(known[-1, -1]), sorted(pairs)


def _walked(i: int, j: int, xa: np.ndarray, la: np.ndarray, xb: np.ndarray, lb: np.ndarray, known: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Walk back through the table of two subtrees; the pairs of subtrees off the path that it meets are left to be walked."""
    p, q = int(la[i]), int(lb[j])
    nodes = np.arange(q, j + 1)
    on, back, offset = lb[nodes] == q, lb[nodes] - q, np.arange(j - q + 2)
    rows = np.empty((i - p + 2, j - q + 2), known.dtype)
    rows[0] = offset
    for x in range(p, i + 1):
        prev = rows[x - p]
        away = rows[int(la[x]) - p][back] + known[x, q : j + 1]
        best = np.where(on, prev[:-1] + (xb[nodes] != xa[x]), away) if la[x] == p else away
        cand = np.append(prev[0] + 1, np.minimum(prev[1:] + 1, best))
        rows[x - p + 1] = np.minimum.accumulate(cand - offset) + offset
    left = []
    x, y = i, j
    while x >= p or y >= q:
        here = rows[x - p + 1, y - q + 1]
        if x >= p and y >= q:
            if la[x] == p and lb[y] == q:
                if here == rows[x - p, y - q] + (xa[x] != xb[y]):
                    pairs.append((x, y))
                    x, y = x - 1, y - 1
                    continue
            elif here == rows[int(la[x]) - p, int(lb[y]) - q] + known[x, y]:
                left.append((x, y))
                x, y = int(la[x]) - 1, int(lb[y]) - 1
                continue
        if x >= p and here == rows[x - p, y - q + 1] + 1:
            pairs.append((x, -1))
            x -= 1
        else:
            pairs.append((-1, y))
            y -= 1
    return left


def _degrees(left: list[int]) -> Counter:
    """How many nodes have how many children."""
    found, above = Counter(), []  # above: (node, children so far)
    for v in range(len(left) - 1, -1, -1):
        while above and left[above[-1][0]] > v:
            found[above.pop()[1]] += 1
        if above:
            above[-1][1] += 1
        above.append([v, 0])
    found.update(n for _, n in above)
    return found


def at_least(a: Tree, b: Tree) -> int:
    """A distance that two trees have at least, in linear time: by their labels, of which an operation mends one a side, and by their numbers of children, of which it
    changes three at most."""
    return _least(len(a[0]), Counter(a[0]), _degrees(a[1]), len(b[0]), Counter(b[0]), _degrees(b[1]))


def _least(n: int, x: Counter, p: Counter, m: int, y: Counter, q: Counter) -> int:
    labels = max(n, m) - sum(min(k, y[label]) for label, k in x.items() if label in y)
    return max(labels, -(-sum(abs(p[k] - q[k]) for k in p.keys() | q.keys()) // 3))


_EDIT = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("i", "j")], *[T.StructField(c, T.StringType()) for c in ("was", "becomes")]])
_SCRIPT = T.StructType([T.StructField("at_least", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("edits", T.ArrayType(_EDIT))])


def edits(a: Tree, b: Tree) -> tuple[int, list[dict]]:
    """The distance, and what is deleted, inserted and renamed, by place in post-order."""
    distance, *places = _differing(a, b)
    out = []
    for i, j in zip(*places, strict=True):
        op = "insert" if i < 0 else "delete" if j < 0 else "rename"
        out.append({"op": op, "i": i if i >= 0 else None, "j": j if j >= 0 else None, "was": a[0][i] if i >= 0 else None, "becomes": b[0][j] if j >= 0 else None})
    return distance, out


#: Programs of at most so many characters are parsed once, as long as the worker remembers them.
SHORT = 1 << 12


def _read(code: str | None) -> tuple[Tree, Counter, Counter] | None:
    """A program's tree, its labels and its numbers of children, each counted; None where it doesn't parse."""
    from tessera.operators.treedist import postorder

    found = parse(code)
    if found is None:
        return None
    tree = postorder(found)
    return tree, Counter(tree[0]), _degrees(tree[1])


@lru_cache(1024)
def _read_short(code: str | None) -> tuple[Tree, Counter, Counter] | None:
    return _read(code)


def _scripts(rows: list[tuple[int | None, int | None, tuple | None]]) -> pa.StructArray:
    """Rows of (at_least, distance, (trees, places of the edits)) as a column; the edits of all rows are flat lists."""
    offsets, i, j, was, becomes = [0], [], [], [], []
    for *_, found in rows:
        if found is not None:
            (a, b), left, right = found
            i += left
            j += right
            was += [a[x] if x >= 0 else None for x in left]
            becomes += [b[y] if y >= 0 else None for y in right]
        offsets.append(len(i))
    i, j = np.array(i, np.int32), np.array(j, np.int32)
    op = pa.DictionaryArray.from_arrays(pa.array(np.where(i < 0, 0, np.where(j < 0, 1, 2)).astype(np.int8)), pa.array(["insert", "delete", "rename"])).cast(pa.string())
    each = pa.StructArray.from_arrays([op, pa.array(i, mask=i < 0), pa.array(j, mask=j < 0), pa.array(was, pa.string()), pa.array(becomes, pa.string())], ["op", "i", "j", "was", "becomes"])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each, mask=pa.array([r[2] is None for r in rows], pa.bool_()))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)] + [lists], ["at_least", "distance", "edits"])


def code_script(most: int | None = None):
    """at_least, distance and edits that turn a program's tree into another's; nulls where either doesn't parse. With `most`, trees that are surely further apart are not compared:
    at_least says by how much, distance and edits are null; what is compared has its distance, whatever it is.

    A filter on the result would else be worked out before a shuffle that deals out the rows, and once more behind it."""

    def read(code: str | None) -> tuple[Tree, Counter, Counter] | None:
        return _read_short(code) if code is None or len(code) <= SHORT else _read(code)

    def one(c: str | None, e: str | None) -> tuple:
        x, y = read(c), read(e)
        if x is None or y is None:
            return None, None, None
        (a, *p), (b, *q) = x, y
        least = _least(len(a[0]), *p, len(b[0]), *q)
        if most is not None and least > most:
            return least, None, None
        distance, *places = _differing(a, b)
        return least, distance, ((a[0], b[0]), *places)

    @F.arrow_udf(_SCRIPT)
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for code, expected in pairs:
            yield _scripts([one(c, e) for c, e in zip(code.to_pylist(), expected.to_pylist(), strict=True)])

    return run.asNondeterministic()
