"""CodeBLEU: n-gram and weighted n-gram match counted within each pair, syntax and data-flow match from the programs' trees."""

from __future__ import annotations

import ast
import keyword
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.codegraph import parse
from tessera.operators.dataflow import flows

#: Weight of a token that is no keyword of the language; a keyword has weight 1.
OTHER_WEIGHT = 0.2
ORDER = 4
_GAPS = re.compile(r"[ \t\n]+")


def words(text: str | None) -> list[str]:
    """Words between blanks, tabs and line ends."""
    return [w for w in _GAPS.split(text or "") if w]


#: Programs of at most so many characters are read once, as long as the worker remembers them.
SHORT = 1 << 12


def _runs(text: str | None, n: int) -> Counter:
    w = words(text)
    return Counter(w if n == 1 else zip(*(w[i:] for i in range(n)), strict=False))


@lru_cache(8192)
def _runs_short(text: str | None, n: int) -> Counter:
    return _runs(text, n)


def _counts(texts: list[str | None], n: int) -> Counter:
    """Runs of n words, of each text for itself. Not to be changed: a worker remembers those of short texts."""
    each = [_runs_short(x, n) if x is None or len(x) <= SHORT else _runs(x, n) for x in texts]
    if len(each) == 1:
        return each[0]
    found: Counter = Counter()
    for counts in each:
        found.update(counts)
    return found


def _matches(orders: tuple[int, ...], heavy: frozenset[str]):
    """For each order how many of the candidate's runs the reference has, each as often at most, and how many it has in all; of the reference's words how many are
    heavy and how many others, all and matched. A pair is counted where it is: no run leaves its row."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("matched", "total", "all", "both")]))
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for candidate, reference in pairs:
            rows = []
            for c, r in zip(candidate, reference, strict=True):
                matched, total, every, both = [], [], [0, 0], [0, 0]
                for n in orders:
                    a, b = _counts(c, n), _counts(r, n)
                    shared = a & b
                    matched.append(shared.total())
                    total.append(a.total())
                    if n == 1:
                        for counts, out in ((b, every), (shared, both)):
                            out[0] = sum(counts[w] for w in heavy if w in counts)
                            out[1] = counts.total() - out[0]
                rows.append((matched, total, every, both))
            yield pd.DataFrame(rows, columns=["matched", "total", "all", "both"])

    return run


def matched(df: DataFrame, keys: list[str], candidate: str, reference: str, orders: tuple[int, ...], heavy: tuple[str, ...] = ()) -> DataFrame:
    """keys, x: what _matches() says of each key's candidates and references; a null text has no words. Texts of one key are put together, which moves nothing where rows already lie by the keys."""
    texts = df.groupBy(*keys).agg(F.collect_list(candidate).alias("_cand"), F.collect_list(reference).alias("_ref"))
    return texts.select(*keys, _matches(orders, frozenset(heavy))("_cand", "_ref").alias("x"))


def clipped_counts(df: DataFrame, keys: list[str], candidate: str, reference: str, *orders: int) -> DataFrame:
    """keys, n, matched, total: a candidate's runs of n words that the reference has, each as often at most, and all its runs."""
    both = F.arrays_zip(F.array(*map(F.lit, orders)).alias("n"), F.col("x.matched").alias("matched"), F.col("x.total").alias("total"))
    found = matched(df, keys, candidate, reference, orders).select(*keys, F.explode(both).alias("y"))
    return found.select(*keys, "y.n", "y.matched", "y.total").where("total > 0")


def ngram_scores(df: DataFrame, keys: list[str], candidate: str, reference: str, order: int = ORDER, heavy: tuple[str, ...] = tuple(keyword.kwlist), light: float = OTHER_WEIGHT) -> DataFrame:
    """keys, p1..pn, brevity, bleu, weighted.

    A precision without matches counts as 1/(2*total), one of a candidate too short for it as next to nothing. weighted is the weighted
    share of the reference's words that the candidate has, each as often at most; null for a reference without words."""
    weighed = lambda c: F.col(f"x.{c}")[0] + F.col(f"x.{c}")[1] * light
    sums = matched(df, keys, candidate, reference, tuple(range(1, order + 1)), heavy).select(
        *keys,
        *[F.col(f"x.{c}")[n - 1].alias(f"{c[0]}{n}") for n in range(1, order + 1) for c in ("matched", "total")],
        (F.col("x.all")[0] + F.col("x.all")[1]).alias("lr"), weighed("both").alias("wm"), weighed("all").alias("wt"),
    )
    lc = F.col("t1")
    brevity = F.when(lc >= F.col("lr"), 1.0).when(lc == 0, 0.0).otherwise(F.exp(1.0 - F.col("lr") / lc))
    shares = [F.when(F.col(f"t{n}") > 0, F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(F.lit(1.0) / (2.0 * F.col(f"t{n}")))).alias(f"p{n}") for n in range(1, order + 1)]
    got = sums.select(*keys, *shares, brevity.alias("brevity"), (F.col("wm") / F.nullif(F.col("wt"), F.lit(0.0))).alias("weighted"))
    logs = [F.log(F.coalesce(f"p{n}", F.lit(1e-9))) for n in range(1, order + 1)]
    return got.withColumn("bleu", F.col("brevity") * F.exp(sum(logs[1:], logs[0]) / order))


def subtrees(tree: ast.AST, shapes: dict[tuple, int]) -> Counter:
    """Shapes of a tree's inner nodes: node kinds without names and values. A shape is the number that `shapes`, shared by the trees that are compared, gives
    its kind and its children's shapes; any depth is gone through without recursion."""
    found: Counter = Counter()
    done: list[int] = []
    todo: list[tuple[ast.AST, int | None]] = [(tree, None)]
    while todo:
        node, start = todo.pop()
        if start is None:
            todo.append((node, len(done)))
            todo += [(c, None) for c in reversed(list(ast.iter_child_nodes(node)))]
            continue
        inner = tuple(done[start:])
        del done[start:]
        shape = shapes.setdefault((type(node).__name__, inner), len(shapes))
        done.append(shape)
        if inner:
            found[shape] += 1
    return found


def _share(candidate: Counter, reference: Counter) -> float:
    """Part of the reference that the candidate has; nothing asked counts as all of it."""
    total = sum(reference.values())
    return sum(min(c, candidate[k]) for k, c in reference.items()) / total if total else 1.0


def _read(code: str | None) -> tuple[list[tuple], Counter, Counter] | None:
    """A program's shapes in the order of their numbers, its inner nodes by shape, and its data flow; None where it doesn't parse."""
    tree = parse(code)
    if tree is None:
        return None
    shapes: dict[tuple, int] = {}
    found = subtrees(tree, shapes)
    return list(shapes), found, flows(tree)


@lru_cache(4096)
def _read_short(code: str | None) -> tuple[list[tuple], Counter, Counter] | None:
    return _read(code)


def _common(candidate: tuple[list[tuple], Counter], reference: tuple[list[tuple], Counter]) -> float:
    """_share() of inner nodes by shape, where each program has numbers of its own: those of equal shapes are found from the leaves up."""
    known = {shape: k for k, shape in enumerate(candidate[0])}
    same: list[int] = []
    for kind, inner in reference[0]:
        there = tuple(same[k] for k in inner)
        same.append(-1 if -1 in there else known.get((kind, there), -1))
    total = sum(reference[1].values())
    return sum(min(c, candidate[1][same[k]]) for k, c in reference[1].items() if same[k] >= 0) / total if total else 1.0


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("syntax", "dataflow")]))
def tree_matches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Syntax and data-flow match of candidates with references; 0 for a candidate, null for a reference that doesn't parse."""

    def read(code: str | None) -> tuple[list[tuple], Counter, Counter] | None:
        return _read_short(code) if code is None or len(code) <= SHORT else _read(code)

    for candidate, reference in pairs:
        rows = []
        for c, r in zip(candidate, reference, strict=True):
            tc, tr = read(c), read(r)
            if tr is None:
                rows.append((None, None))
            elif tc is None:
                rows.append((0.0, 0.0))
            else:
                rows.append((_common(tc[:2], tr[:2]), _share(tc[2], tr[2])))
        yield pd.DataFrame(rows, columns=["syntax", "dataflow"]).astype("float64")


def codebleu(df: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """keys, ngram, weighted, syntax, dataflow, codebleu: four matches at equal weights."""
    b = ngram_scores(df, keys, candidate, reference).withColumnRenamed("bleu", "ngram").select(*keys, "ngram", "weighted")
    t = df.select(*keys, tree_matches(candidate, reference).alias("t")).select(*keys, "t.syntax", "t.dataflow")
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("ngram", "weighted", "syntax", "dataflow")]
    return t.join(b, keys, "left").withColumn("codebleu", sum(parts[1:], parts[0]) / 4)
