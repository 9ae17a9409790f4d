"""What the language front ends produce: patterns, clauses and expressions, nothing bound to a table yet.

Expressions are tuples: ("lit", v) ("param", name) ("var", name) ("prop", x, key) ("call", name, args, distinct)
("bin", op, x, y) ("not", x) ("neg", x) ("null", x, negated) ("case", subject, [(when, then)], default) ("list", [..])
("map", {..}) ("index", x, i) ("slice", x, from, to) ("each", var, list, where, out) ("exists", patterns, where)
("count", patterns, where) ("star",).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

Expr = tuple


@dataclass
class Node:
    var: str
    labels: tuple[str, ...] = ()
    props: dict[str, Expr] = field(default_factory=dict)
    where: Expr | None = None


@dataclass
class Rel:
    var: str
    types: tuple[str, ...] = ()
    direction: str = "out"
    props: dict[str, Expr] = field(default_factory=dict)
    hops: tuple[int, int | None] | None = None  # None: one edge
    where: Expr | None = None


@dataclass
class Path:
    nodes: list[Node]
    rels: list[Rel]
    var: str | None = None
    shortest: str | None = None  # "one" or "all"


@dataclass
class Match:
    paths: list[Path]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Unwind:
    value: Expr
    var: str


@dataclass
class Project:
    """WITH or RETURN."""

    items: list[tuple[Expr, str]]
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # expression, descending
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None  # WHERE of WITH, HAVING of RETURN
    star: bool = False
    group: list[Expr] | None = None


@dataclass
class Create:
    paths: list[Path]


@dataclass
class Merge:
    path: Path
    on_create: list[tuple]
    on_match: list[tuple]


@dataclass
class Delete:
    variables: list[str]
    detach: bool


@dataclass
class Set:
    """items: ("prop", var, key, expr) ("map", var, expr, merge) ("labels", var, labels)."""

    items: list[tuple]


@dataclass
class Remove:
    """items: ("prop", var, key) ("labels", var, labels)."""

    items: list[tuple]


@dataclass
class Union:
    parts: list[list]
    all: bool


def walk(x) -> Iterator:
    """All expressions in an expression, pattern, clause or list of them, itself included."""
    if isinstance(x, tuple):
        if x and isinstance(x[0], str):
            yield x
        for y in x:
            if isinstance(y, tuple | list | dict | Node | Rel | Path):
                yield from walk(y)
    elif isinstance(x, list):
        for y in x:
            yield from walk(y)
    elif isinstance(x, dict):
        yield from walk(list(x.values()))
    elif hasattr(x, "__dataclass_fields__"):
        for name in x.__dataclass_fields__:
            yield from walk(getattr(x, name))


def conjuncts(x: Expr | None) -> list[Expr]:
    if x is None:
        return []
    return conjuncts(x[2]) + conjuncts(x[3]) if x[0] == "bin" and x[1] == "AND" else [x]


def aggregates(x) -> bool:
    from arcweave.functions.scalar import AGGREGATES

    return any(y[0] == "call" and y[1] in AGGREGATES or y[0] == "star" for y in walk(x))


def text_of(x: Expr) -> str:
    """The column name of an expression without alias."""
    kind = x[0]
    if kind == "var":
        return x[1]
    if kind == "prop":
        return f"{text_of(x[1])}.{x[2]}"
    if kind == "call":
        return f"{x[1]}({', '.join(text_of(a) for a in x[2])})"
    if kind == "star":
        return "count(*)"
    if kind == "lit":
        return str(x[1])
    return kind
