"""Data flow of a program: which definitions of which variables each definition is computed from.

Every scope (module, class body, function) becomes a control-flow graph whose points define and use names. Reaching definitions are found by a worklist
until nothing changes, so branches join and loops feed themselves. Variables are numbered by scope in order of first appearance, and a variable's definitions in the order
of the text, so that programs which differ in names alone have the same edges.
"""

from __future__ import annotations

import ast
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.codegraph import parse

#: Source of a definition that uses no variable, and the definition of a variable that none reaches.
NOTHING, OUTSIDE = -1, -1
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


@dataclass
class Definition:
    """A name given a value from others. A weak one changes part of a value and leaves what reached it."""

    name: str
    sources: tuple[str, ...]
    weak: bool = False


@dataclass
class Point:
    """A place of a control-flow graph: what it defines, and the points before it."""

    before: set[int]
    definitions: list[Definition] = field(default_factory=list)
    ends: tuple[str, ...] = ()  # names that are deleted here


@dataclass
class Scope:
    parent: Scope | None
    kind: str  # module, class, function
    points: list[Point] = field(default_factory=list)
    inner: list[tuple[Scope, ast.AST]] = field(default_factory=list)
    outward: set[str] = field(default_factory=set)  # declared global or nonlocal


def used(*nodes: ast.AST | None) -> tuple[str, ...]:
    """Names that expressions read, each once, in order; not those that a comprehension or lambda binds itself."""
    found: dict[str, None] = {}
    todo: list[tuple[ast.AST, frozenset[str]]] = [(n, frozenset()) for n in reversed(nodes) if n is not None]
    while todo:
        node, bound = todo.pop()
        if isinstance(node, ast.Name):
            if node.id not in bound and not isinstance(node.ctx, ast.Del):
                found[node.id] = None
            continue
        if isinstance(node, _COMPREHENSIONS):
            bound = bound | {n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name)}
        elif isinstance(node, ast.Lambda):
            bound = bound | {a.arg for a in _arguments(node.args)}
        todo += [(c, bound) for c in reversed(list(ast.iter_child_nodes(node)))]
    return tuple(found)


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]


def targets(node: ast.AST, sources: tuple[str, ...]) -> Iterator[Definition]:
    """What an assignment to a target defines, from left to right."""
    todo = [node]
    while todo:
        t = todo.pop()
        if isinstance(t, ast.Name):
            yield Definition(t.id, sources)
        elif isinstance(t, ast.Tuple | ast.List):
            todo += reversed(t.elts)
        elif isinstance(t, ast.Starred):
            todo.append(t.value)
        elif isinstance(t, ast.Attribute | ast.Subscript):
            base = t
            while isinstance(base, ast.Attribute | ast.Subscript):
                base = base.value
            if isinstance(base, ast.Name):
                rest = [n for n in used(t) if n not in sources]
                yield Definition(base.id, (*sources, *rest), weak=True)


def patterns(node: ast.AST, sources: tuple[str, ...]) -> Iterator[Definition]:
    """Names that a pattern binds."""
    for n in ast.walk(node):
        name = n.name if isinstance(n, ast.MatchAs | ast.MatchStar) else n.rest if isinstance(n, ast.MatchMapping) else None
        if name:
            yield Definition(name, sources)


class Graph:
    """Builds a scope's control-flow graph. Statements nest at most as deep as the language's indentation allows; chains of elif are gone through in a loop."""

    def __init__(self, scope: Scope):
        self.scope = scope
        self.loops: list[tuple[int, set[int]]] = []  # where continue leads, and the points that break
        self.tries: list[set[int]] = []  # points from which a handler may be reached

    def point(self, before: Iterable[int], *reads: ast.AST | None, definitions: Iterable[Definition] = ()) -> int:
        """A new point that reads expressions (which may define names by := and hold lambdas) and then defines names."""
        at = len(self.scope.points)
        point = Point(set(before))
        for node in reads:
            for n in ast.walk(node) if node is not None else ():
                if isinstance(n, ast.NamedExpr):
                    point.definitions.append(Definition(n.target.id, used(n.value)))
                elif isinstance(n, ast.Lambda):
                    self.scope.inner.append((Scope(self.scope, "function"), n))
        point.definitions += definitions
        self.scope.points.append(point)
        for reached in self.tries:
            reached.add(at)
        return at

    def block(self, statements: list[ast.stmt], at: set[int]) -> set[int]:
        for s in statements:
            at = self.statement(s, at)
        return at

    def statement(self, s: ast.stmt, at: set[int]) -> set[int]:
        if isinstance(s, ast.If):
            out: set[int] = set()
            while True:
                test = self.point(at, s.test)
                out |= self.block(s.body, {test})
                if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If):
                    s, at = s.orelse[0], {test}
                    continue
                return out | self.block(s.orelse, {test})
        if isinstance(s, ast.While | ast.For | ast.AsyncFor):
            over = s.test if isinstance(s, ast.While) else s.iter
            head = self.point(at, over, definitions=() if isinstance(s, ast.While) else targets(s.target, used(s.iter)))
            broken: set[int] = set()
            self.loops.append((head, broken))
            self.scope.points[head].before |= self.block(s.body, {head})
            self.loops.pop()
            return self.block(s.orelse, {head}) | broken
        if isinstance(s, ast.With | ast.AsyncWith):
            bound = [d for i in s.items if i.optional_vars is not None for d in targets(i.optional_vars, used(i.context_expr))]
            return self.block(s.body, {self.point(at, *[i.context_expr for i in s.items], definitions=bound)})
        if isinstance(s, ast.Try | ast.TryStar):
            return self.attempt(s, at)
        if isinstance(s, ast.Match):
            here = {self.point(at, s.subject)}
            out = set()
            for case in s.cases:
                here = {self.point(here, case.guard, definitions=patterns(case.pattern, used(s.subject)))}
                out |= self.block(case.body, here)
            return out | here
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            reads = [*s.decorator_list, *s.args.defaults, *[d for d in s.args.kw_defaults if d is not None]]
            self.scope.inner.append((Scope(self.scope, "function"), s))
            return {self.point(at, *reads, definitions=[Definition(s.name, used(*reads))])}
        if isinstance(s, ast.ClassDef):
            reads = [*s.decorator_list, *s.bases, *[k.value for k in s.keywords]]
            self.scope.inner.append((Scope(self.scope, "class"), s))
            return {self.point(at, *reads, definitions=[Definition(s.name, used(*reads))])}
        return self.simple(s, at)

    def attempt(self, s: ast.Try | ast.TryStar, at: set[int]) -> set[int]:
        reached = set(at)
        self.tries.append(reached)
        done = self.block(s.body, at)
        self.tries.pop()
        out = self.block(s.orelse, done)
        for h in s.handlers:
            out |= self.block(h.body, {self.point(reached, h.type, definitions=[Definition(h.name, used(h.type))] if h.name else ())})
        return self.block(s.finalbody, out or reached) if s.finalbody else out

    def simple(self, s: ast.stmt, at: set[int]) -> set[int]:
        bound: list[Definition] = []
        if isinstance(s, ast.Assign):
            bound = [d for t in s.targets for d in targets(t, used(s.value))]
        elif isinstance(s, ast.AnnAssign) and s.value is not None:
            bound = list(targets(s.target, used(s.value)))
        elif isinstance(s, ast.AugAssign):
            bound = [Definition(d.name, (d.name, *[n for n in d.sources if n != d.name]), d.weak) for d in targets(s.target, used(s.value))]
        elif isinstance(s, ast.Import | ast.ImportFrom):
            bound = [Definition((a.asname or a.name).split(".")[0], ()) for a in s.names if a.name != "*"]
        elif isinstance(s, ast.Global | ast.Nonlocal):
            self.scope.outward |= set(s.names)
        here = self.point(at, *([s] if isinstance(s, ast.Expr | ast.Return | ast.Raise | ast.Assert | ast.Assign | ast.AnnAssign | ast.AugAssign) else []), definitions=bound)
        if isinstance(s, ast.Delete):
            self.scope.points[here].ends = tuple(t.id for t in s.targets if isinstance(t, ast.Name))
        if isinstance(s, ast.Break | ast.Continue) and self.loops:
            head, broken = self.loops[-1]
            if isinstance(s, ast.Break):
                broken.add(here)
            else:
                self.scope.points[head].before.add(here)
        return set() if isinstance(s, ast.Return | ast.Raise | ast.Break | ast.Continue) else {here}


def scopes(tree: ast.Module) -> list[Scope]:
    """The program's scopes with their graphs, outer ones first."""
    module = Scope(None, "module")
    todo, out = deque([(module, tree)]), []
    while todo:
        scope, node = todo.popleft()
        graph = Graph(scope)
        at: set[int] = set()
        if isinstance(node, _FUNCTIONS):
            at = {graph.point((), definitions=[Definition(a.arg, ()) for a in _arguments(node.args)])}
        if isinstance(node, ast.Lambda):
            graph.point(at, node.body)
        else:
            graph.block(node.body, at)
        out.append(scope)
        todo += scope.inner
    return out


def reaching(scope: Scope) -> tuple[list[list[int]], list[int]]:
    """The numbers of each point's definitions, and, as the bits of an integer, the definitions that reach it."""
    own: list[list[int]] = []
    by_name: dict[str, int] = {}
    n = 0
    for p in scope.points:
        own.append(list(range(n, n + len(p.definitions))))
        for d in p.definitions:
            by_name[d.name] = by_name.get(d.name, 0) | 1 << n
            n += 1
    after: list[list[int]] = [[] for _ in scope.points]
    for i, p in enumerate(scope.points):
        for b in p.before:
            after[b].append(i)
    # Only what can be reached from the scope's first point counts.
    live, stack = set(), [0] if own else []
    while stack:
        if (i := stack.pop()) not in live:
            live.add(i)
            stack += after[i]
    into, out = [0] * len(own), [0] * len(own)
    todo, waiting = deque(sorted(live)), set(live)
    while todo:
        i = todo.popleft()
        waiting.discard(i)
        p = scope.points[i]
        into[i] = 0
        for b in p.before:
            into[i] |= out[b]
        now = into[i]
        for name in p.ends:
            now &= ~by_name.get(name, 0)
        for k, d in zip(own[i], p.definitions, strict=True):
            now = (now if d.weak else now & ~by_name[d.name]) | 1 << k
        if now != out[i]:
            out[i] = now
            for j in after[i]:
                if j not in waiting:
                    waiting.add(j)
                    todo.append(j)
    return own, into


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def edges(tree: ast.Module) -> list[tuple[int, int, int]]:
    """(variable, source, definition) for each definition and each definition that reaches a name which it reads.

    Within a scope that is what the graph says; a name of an outer scope may have any of its definitions there, as a function may be called at any time, and
    class bodies are not looked through from functions. A name declared global or nonlocal has the definitions that reach it in the function itself, or else the outer ones. NOTHING: no name is read. OUTSIDE: a name that no definition reaches."""
    found = scopes(tree)
    names = [{d.name for p in s.points for d in p.definitions} - s.outward for s in found]
    place = {id(s): i for i, s in enumerate(found)}
    flow = [reaching(s) for s in found]
    of: list[dict[str, list[int]]] = []  # by scope and name, its definitions in order
    for s, (own, _) in zip(found, flow, strict=True):
        by: dict[str, list[int]] = {}
        for p, numbers in zip(s.points, own, strict=True):
            for d, k in zip(p.definitions, numbers, strict=True):
                by.setdefault(d.name, []).append(k)
        of.append(by)
    order = [{name: {k: r for r, k in enumerate(ks)} for name, ks in by.items()} for by in of]

    def home(i: int, name: str) -> int | None:
        """The scope that a name belongs to, seen from scope i."""
        s, first = found[i], True
        while s is not None:
            j = place[id(s)]
            if name in names[j] and (first or s.kind != "class"):
                return j
            s, first = s.parent, False
        return None

    numbers: dict[tuple[int | None, str], int] = {}
    number = lambda i, name: numbers.setdefault((i, name), len(numbers))
    out = []
    for i, (s, (own, into)) in enumerate(zip(found, flow, strict=True)):
        for p, ks, reached in zip(s.points, own, into, strict=True):
            for d, k in zip(p.definitions, ks, strict=True):
                variable = number(home(i, d.name), d.name)
                if not d.sources:
                    out.append((variable, NOTHING, OUTSIDE))
                for name in d.sources:
                    j = home(i, name)
                    here = [order[i][name][b] for b in _bits(reached) if b in order[i].get(name, ())]
                    if j == i or (name in s.outward and here):
                        ranks = sorted(here)
                    else:
                        ranks = [] if j is None else sorted(order[j][name].values())
                    out += [(variable, number(j, name), r) for r in ranks or [OUTSIDE]]
    return out


def flows(tree: ast.Module) -> Counter:
    return Counter(edges(tree))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("variable", "source", "definition")])))
def flow_edges(codes: pd.Series) -> pd.Series:
    """edges() of each program, in order; null where it doesn't parse."""
    return codes.map(lambda c: None if (t := parse(c)) is None else [dict(zip(("variable", "source", "definition"), e, strict=True)) for e in edges(t)])
