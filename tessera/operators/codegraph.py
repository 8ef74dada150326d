"""Static reading of Python programs: names that are called or read, with light types, as a struct column.

A program becomes a flat list of events (a class begins or ends, a variable is bound, a name is stored, used or called), which is replayed to spell the names. A class is
replayed twice: before its bases are known `self.x` stays as it is, afterwards it is read through the first base. Both spellings are kept; filter_names() drops the first.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Literal, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import dotted_head, dotted_rest

#: Names that say nothing about the interface.
EXCLUDED = (
    "self", "print", "len", "range", "int", "str", "float", "list", "dict", "set", "tuple", "bool", "type", "object", "np", "math", "random",
    "add", "remove", "clear", "play", "wait", "show", "hide",
)


class Ref(NamedTuple):
    """A dotted expression: attributes, innermost first, of a name, of a value that is written out, or of what a call gives."""

    kind: Literal["name", "literal", "result"]
    root: str | Ref | None
    attributes: tuple[str, ...]


class Event(NamedTuple):
    """Something that a program does, in reading order. `names` are a class's bases or the variables that an assignment binds."""

    kind: Literal["class", "end", "bind", "store", "use", "call"]
    ref: Ref | None = None
    name: str = ""
    names: tuple[str, ...] = ()


def reference(node: ast.AST) -> Ref | None:
    """The dotted expression that a node is, if it is one."""
    attributes: list[str] = []
    while isinstance(node, ast.Attribute):
        attributes.append(node.attr)
        node = node.value
    dotted = tuple(reversed(attributes))
    if isinstance(node, ast.Name):
        return Ref("name", node.id, dotted)
    if dotted and isinstance(node, ast.Constant):
        return Ref("literal", str(node.value), dotted)
    if dotted and isinstance(node, ast.Call):
        return Ref("result", reference(node.func), dotted)
    return None


def events(tree: ast.AST) -> Iterator[Event]:
    """What a program does, from top to bottom. Values inside containers and operators are not looked at, calls anywhere are."""
    todo: list[ast.AST | Event] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, Event):
            yield node
            continue
        used: list[ast.AST] = []
        if isinstance(node, ast.ClassDef):
            yield Event("class", name=node.name, names=tuple(b.id for b in node.bases if isinstance(b, ast.Name)))
            todo.append(Event("end"))
        elif isinstance(node, ast.Assign):
            if isinstance(node.value, ast.Call):
                yield Event("bind", reference(node.value.func), names=tuple(t.id for t in node.targets if isinstance(t, ast.Name)))
            yield from (Event("store", reference(t)) for t in node.targets if isinstance(t, ast.Attribute))
            used = [node.value]
        elif isinstance(node, ast.Call):
            yield Event("call", reference(node.func))
            used = [*node.args, *(k.value for k in node.keywords)]
        yield from (Event("use", reference(v)) for v in used if isinstance(v, ast.Name | ast.Attribute))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))


@dataclass
class Names:
    """Names that programs call and touch, with what has been learned of variables' types and classes' bases on the way."""

    called: set[str] = field(default_factory=set)
    touched: set[str] = field(default_factory=set)
    types: dict[str, str] = field(default_factory=dict)
    bases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def spelled(self, ref: Ref | None, inside: str | None) -> str | None:
        """A reference as a dotted name: `self` of a class is its first base, a typed variable its type, a call's result what was called."""
        if ref is None:
            return None
        if ref.kind == "result":
            made = self.spelled(ref.root, inside)
            owner = made and made.split(".", 1)[0]
        elif ref.kind == "literal" or not ref.attributes:
            owner = ref.root
        elif ref.root == "self" and inside is not None:
            owner = next(iter(self.bases.get(inside, ())), "self")
        else:
            owner = self.types.get(ref.root, ref.root)
        return None if owner is None else ".".join((owner, *ref.attributes))

    def read(self, program: list[Event]) -> None:
        """Replay a program. A class is replayed twice: its bases are known only at its end."""
        open_classes: list[tuple[Event, int]] = []  # and where the class's events begin; -1 in its second reading
        at = 0
        while at < len(program):
            event, at = program[at], at + 1
            inside = open_classes[-1][0].name if open_classes else None
            if event.kind == "class":
                open_classes.append((event, at))
            elif event.kind == "end":
                opened, begin = open_classes.pop()
                if begin >= 0:
                    self.bases[opened.name] = opened.names
                    open_classes.append((opened, -1))
                    at = begin
            elif event.kind == "use" and event.ref is not None and not event.ref.attributes:
                if event.ref.root in self.types:
                    self.touched.add(self.types[event.ref.root])
            elif (name := self.spelled(event.ref, inside)) is not None:
                if event.kind == "bind":
                    self.types.update(dict.fromkeys(event.names, name.split(".", 1)[0]))
                else:
                    (self.called if event.kind == "call" else self.touched).add(name)


def parse(code: str | None) -> ast.Module | None:
    """The program's tree, or None where it is none."""
    try:
        return ast.parse(code) if code is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def names_of(code: str | None) -> tuple[set[str], set[str]]:
    """(called, touched) names of a program; empty where it doesn't parse."""
    return names_of_many([code])


def names_of_many(codes: Iterable[str | None]) -> tuple[set[str], set[str]]:
    """Names of several snippets read one after the other, with what earlier ones told about types."""
    names = Names()
    for code in codes:
        if (tree := parse(code)) is not None:
            names.read(list(events(tree)))
    return names.called, names.touched


_NAMES = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("calls", "vars")])


def _sorted(pairs: list[tuple[set[str], set[str]]]) -> pd.DataFrame:
    return pd.DataFrame({"calls": [sorted(a) for a, _ in pairs], "vars": [sorted(b) for _, b in pairs]})


@F.pandas_udf(_NAMES)
def code_names(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Sorted names of each program."""
    for part in codes:
        yield _sorted([names_of(c) for c in part])


@F.pandas_udf(_NAMES)
def session_names(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Sorted names of the snippets of each array, read one after the other without forgetting; null: none."""
    for part in codes:
        yield _sorted([names_of_many(() if c is None else c) for c in part])


@F.pandas_udf(T.BooleanType())
def parses(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: parse(c) is not None)


def filter_names(names: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Distinct names in order, without those whose head or rest is excluded."""
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~dotted_head(n).isin(*excluded) & ~dotted_rest(n).isin(*excluded))))


def vars_beyond_calls(names: Column, calls: Column) -> Column:
    return F.array_sort(F.array_except(names, calls))
