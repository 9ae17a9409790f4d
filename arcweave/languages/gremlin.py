"""Gremlin: a chain of steps over a traverser, which is one row with the current element."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from arcweave.functions.scalar import AGGREGATES, regex_test
from arcweave.graph import PropertyGraph
from arcweave.languages.cypher import Result
from arcweave.languages.lexer import ParseError, Tokens, number, unquoted
from arcweave.operators import mutations
from arcweave.plans.compiler import Compiler
from arcweave.plans.tree import Node, Rel

_TESTS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "within": lambda c, *v: c.isin(*v), "without": lambda c, *v: ~c.isin(*v), "between": lambda c, a, b: (c >= a) & (c < b), "inside": lambda c, a, b: (c > a) & (c < b), "outside": lambda c, a, b: (c < a) | (c > b),
    "containing": lambda c, v: c.contains(v), "startingWith": lambda c, v: c.startswith(v), "endingWith": lambda c, v: c.endswith(v), "regex": lambda c, v: regex_test(c, F.lit(v), v),
    "notContaining": lambda c, v: ~c.contains(v), "notStartingWith": lambda c, v: ~c.startswith(v), "notEndingWith": lambda c, v: ~c.endswith(v),
}


def parse(text: str) -> list[tuple[str, list]]:
    t = Tokens(text, r"[().,\[\]{}:;-]")
    if t.name() != "g":
        t.fail("g")
    steps = []
    while t.sign("."):
        steps.append(_step(t))
    t.sign(";")
    if not t.done():
        t.fail("the end")
    return steps


def _step(t: Tokens) -> tuple[str, list]:
    name, args = t.name(), []
    t.need_sign("(")
    while not t.sign(")"):
        args.append(_value(t))
        t.sign(",")
    return name, args


def _value(t: Tokens):
    """A literal, or ("call", name, args, following steps) for predicates and inner traversals."""
    if t.sign("["):
        out = []
        while not t.sign("]"):
            out.append(_value(t))
            t.sign(",")
        return out
    kind, v = t.peek()
    if t.sign("-"):
        return -number(t.next()[1])
    t.next()
    if kind == "number":
        return number(v)
    if kind == "string":
        return unquoted(v)
    if kind != "name":
        t.i -= 1
        t.fail("a value")
    if v in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[v]
    names = [v]
    if v in ("P", "TextP", "__", "Order", "T") and t.sign("."):
        names = [t.name()]
    if t.peek() != ("sign", "("):
        return ("name", names[0])
    t.i -= 1
    steps = [_step(t)]
    while t.sign("."):
        steps.append(_step(t))
    return ("steps", steps)


_STAYS = {"has", "hasNot", "hasLabel", "hasId", "where", "filter", "not", "and", "as", "dedup", "order", "by", "limit", "skip", "range", "id", "values", "valueMap", "elementMap"}


def asked(steps: list, i: int) -> tuple[list[str], set[str], set[int]]:
    """Of the element that step i moves to: labels that it must have, properties that are read while it is the current
    one, and the steps which the labels make needless."""
    labels, keys, done, filtering = [], set(), set(), True
    for j, (name, args) in enumerate(steps[i + 1 :], i + 1):
        if name not in _STAYS:
            break
        filtering &= name in ("has", "hasLabel", "hasId", "hasNot")
        if name == "hasLabel" and len(args) == 1 and filtering:
            labels.append(args[0])
            done.add(j)
        elif name == "has" and len(args) == 3:
            keys.add(args[1])
        elif name in ("has", "hasNot", "by") and args and isinstance(args[0], str):
            keys.add(args[0])
        elif name in ("values", "valueMap", "elementMap"):
            keys |= set(args)
            break
    return labels, keys, done


class Traversal:
    """df: the compiler's bindings; ``here`` is the current variable, or ``value`` a current column.

    What the steps behind a move ask of the element is read along with it: labels choose the tables, and properties
    come from the same scan.
    """

    def __init__(self, graph: PropertyGraph):
        needs: dict[str, set[str]] = defaultdict(set)
        self.c = Compiler(graph, {}, needs)
        self.n, self.here, self.value, self.named = 0, None, None, {}
        self.base, self.ordering = None, []
        self.ahead: tuple[list[str], set[str], set[int]] = [], set(), set()

    def run(self, steps: list, top: bool = False) -> None:
        done: set[int] = set()
        for i, (name, args) in enumerate(steps):
            if i in done:
                continue
            if top and name not in ("property", "from", "to"):
                self.flush()
            self.ahead = [], set(), set()
            if name in ("V", "out", "in", "both"):
                self.ahead = asked(steps, i)
                done |= self.ahead[2]
            elif name in ("E", "outE", "inE", "bothE"):
                self.ahead = [], asked(steps, i)[1], set()
            self.step(name, args)

    def fresh(self) -> str:
        self.n += 1
        return f"_t{self.n}"

    @property
    def df(self):
        return self.c.df

    @df.setter
    def df(self, df):
        self.c.df = df

    def property(self, key: str):
        """The current element's property; read from its table on first use."""
        name, kind = f"{self.here}__{key}", self.c.kinds[self.here]
        if name not in self.df.columns:
            if kind == "node":
                other = self.c.graph.node_scan((), (key,)).select(F.col("id").alias("_k"), F.col(f"`{key}`").alias(name))
            else:
                other = self.c.graph.edge_scan((), (key,)).select(F.col("eid").alias("_k"), F.col(f"`{key}`").alias(name))
            self.df = self.df.join(other, F.col(self.here) == F.col("_k")).drop("_k")
        return F.col(f"`{name}`")

    def label(self):
        name, kind = f"{self.here}____l", self.c.kinds[self.here]
        if name not in self.df.columns:
            if kind == "node":
                other = self.c.graph.node_scan((), (), True).select(F.col("id").alias("_k"), F.col("labels").alias(name))
            else:
                other = self.c.graph.edge_scan((), (), True).select(F.col("eid").alias("_k"), F.col("type").alias(name))
            self.df = self.df.join(other, F.col(self.here) == F.col("_k")).drop("_k")
        return F.col(name)

    def test(self, c, p):
        if not isinstance(p, tuple):
            return c == F.lit(p)
        out = None
        for name, args in p[1]:
            if name in ("and", "or"):
                other = self.test(c, args[0])
                out = out & other if name == "and" else out | other
            elif name == "not":
                out = ~self.test(c, args[0])
            elif name == "negate":
                out = ~out
            else:
                if name not in _TESTS:
                    raise ParseError(f"unknown predicate {name}")
                flat = args[0] if len(args) == 1 and isinstance(args[0], list) else args
                out = _TESTS[name](c, *flat)
        return out

    def hop(self, types: list[str], direction: str, to: str) -> None:
        """to: "node", "edge"."""
        if self.here is None or self.c.kinds[self.here] != "node":
            raise ParseError("a step along edges needs a vertex")
        edge, far = self.fresh(), self.fresh()
        r, n = Rel(edge, tuple(types), direction), Node(far, tuple(self.ahead[0]))
        self.c.needs[far if to == "node" else edge] |= self.ahead[1]
        e = self.c._edge(r, self.here, far)
        self.df = self.df.join(e, self.here)
        self.c.kinds[edge], self.c.kinds[far] = "edge", "node"
        if not self.c._bare(n, self.c._implied(r, "b")):
            self.df = self.df.join(self.c._node(n), far)
        self.df = self.df.withColumn(f"{edge}__near", F.col(self.here)).withColumn(f"{edge}__far", F.col(far)).withColumn(f"{edge}__dir", F.lit(direction))
        if to == "node":
            self.here = far
        else:
            self.here, self.base = edge, edge

    def end(self, which: str) -> None:
        edge = self.here
        e = self.c.graph.edge_scan().select(F.col("eid").alias("_k"), "src", "dst")
        v = self.fresh()
        ends = {"outV": "src", "inV": "dst"}
        if which in ends:
            self.df = self.df.join(e.select("_k", F.col(ends[which]).alias(v)), F.col(edge) == F.col("_k")).drop("_k")
        elif which == "otherV":
            self.df = self.df.withColumn(v, F.col(f"{edge}__far"))
        else:
            self.df = self.df.join(e.select("_k", F.explode(F.array("src", "dst")).alias(v)), F.col(edge) == F.col("_k")).drop("_k")
        self.c.kinds[v] = "node"
        self.here = v

    def inner(self, steps, negate: bool = False) -> None:
        """Keep the rows from which a traversal reaches something (or not)."""
        key = self.fresh()
        sub = Traversal(self.c.graph)
        sub.n = self.n + 1000
        ids = self.df.select(F.col(self.here).alias(key)).distinct()
        sub.c.df, sub.c.kinds, sub.here = ids, {key: self.c.kinds[self.here]}, key
        sub.run(steps)
        self.df = self.df.join(sub.df.select(F.col(key).alias("_hit")), F.col(self.here) == F.col("_hit"), "left_anti" if negate else "left_semi")

    def current(self):
        return self.value if self.value is not None else F.col(self.here)

    def step(self, name: str, args: list) -> None:
        c = self.c
        if name == "V":
            v = self.fresh()
            c.needs[v] |= self.ahead[1]
            self.df = c._node(Node(v, tuple(self.ahead[0])))
            c.kinds[v], self.here = "node", v
            if args:
                self.df = self.df.where(F.col(v).isin(*args))
        elif name == "E":
            e, a, b = self.fresh(), self.fresh(), self.fresh()
            c.needs[e] |= self.ahead[1]
            self.df = c._edge(Rel(e), a, b).withColumn(f"{e}__near", F.col(a)).withColumn(f"{e}__far", F.col(b))
            c.kinds |= {e: "edge", a: "node", b: "node"}
            self.here = e
            if args:
                self.df = self.df.where(F.col(e).isin(*args))
        elif name in ("out", "in", "both"):
            self.hop(args, name, "node")
        elif name in ("outE", "inE", "bothE"):
            self.hop(args, name[:-1], "edge")
        elif name in ("outV", "inV", "bothV", "otherV"):
            self.end(name)
        elif name == "has":
            if len(args) == 3:
                self.step("hasLabel", args[:1])
                args = args[1:]
            p = self.property(args[0])
            self.df = self.df.where(p.isNotNull() if len(args) == 1 else self.test(p, args[1]))
        elif name == "hasNot":
            p = self.property(args[0])
            self.df = self.df.where(p.isNull())
        elif name == "hasLabel":
            label = self.label()
            test = F.arrays_overlap(label, F.array(*map(F.lit, args))) if c.kinds[self.here] == "node" else F.lower(label).isin(*[a.lower() for a in args])
            self.df = self.df.where(test)
        elif name == "hasId":
            self.df = self.df.where(F.col(self.here).isin(*args))
        elif name == "is":
            self.df = self.df.where(self.test(self.current(), args[0]))
        elif name in ("where", "filter"):
            self.inner(args[0][1])
        elif name == "not":
            self.inner(args[0][1], True)
        elif name == "and":
            for a in args:
                self.inner(a[1])
        elif name in ("as",):
            self.named[args[0]] = (self.here, self.value)
        elif name == "select":
            if len(args) == 1:
                self.here, self.value = self.named[args[0]]
            else:
                self.value = F.struct(*[(v if v is not None else F.col(h)).alias(a) for a in args for h, v in [self.named[a]]])
        elif name == "values":
            parts = [self.property(a) for a in args]
            v = self.fresh()
            self.df = self.df.withColumn(v, parts[0]) if len(parts) == 1 else self.df.withColumn(v, F.explode(F.array(*parts)))
            self.df = self.df.where(F.col(v).isNotNull())
            self.value = F.col(v)
        elif name in ("valueMap", "elementMap"):
            keys = args or [p for t in (c.graph.vertices if c.kinds[self.here] == "node" else c.graph.edges) for p in t.properties]
            self.value = F.struct(*[self.property(k).alias(k) for k in dict.fromkeys(keys)])
        elif name == "id":
            self.value = F.col(self.here)
        elif name == "label":
            label = self.label()
            self.value = F.try_element_at(label, F.lit(1)) if c.kinds[self.here] == "node" else label
        elif name == "constant":
            self.value = F.lit(args[0])
        elif name == "dedup":
            self._only_current()
            self.df = self.df.dropDuplicates(["_now"])
        elif name == "order":
            self.ordering = []
        elif name == "by":
            key = args[0] if args and isinstance(args[0], str) else None
            down = any(a == ("name", "desc") or a == ("name", "decr") for a in args)
            if getattr(self, "grouping", None) is not None:
                k = self.property(key) if key else self.current()
                self._group_by(k)
                return
            x = self.property(key) if key else self.current()
            self.ordering.append(x.desc_nulls_first() if down else x.asc_nulls_last())
            self.df = self.df.orderBy(*self.ordering)
        elif name == "limit":
            self.df = self.df.limit(args[0])
        elif name == "skip":
            self.df = self.df.offset(args[0])
        elif name == "range":
            self.df = self.df.offset(args[0]).limit(args[1] - args[0])
        elif name in ("count", "sum", "mean", "min", "max", "fold"):
            x = self.current()
            out = F.count(F.lit(1)) if name == "count" else AGGREGATES["collect" if name == "fold" else name](x, False)
            self.df, self.ordering = self.df.agg(out.alias("value")), []
            self.value = F.col("value")
        elif name == "unfold":
            v = self.fresh()
            self.df = self.df.withColumn(v, F.explode(self.value))
            self.value = F.col(v)
        elif name in ("groupCount", "group"):
            self.grouping = name
        elif name == "addV":
            graph = c.graph
            ident = mutations.next_id(graph)
            v = self.fresh()
            self.df = graph.spark.range(1).select(F.lit(ident).cast("bigint").alias(v))
            self.pending = ("node", ident, args[0] if args else "vertex", {})
            c.kinds[v], self.here = "node", v
        elif name == "addE":
            self.pending = ("edge", None, args[0], {})
            self.ends = {"from": F.col(self.here) if self.here else None, "to": F.col(self.here) if self.here else None}
        elif name in ("from", "to"):
            a = args[0]
            if isinstance(a, str):
                self.ends[name] = F.col(self.named[a][0])
            else:
                sub = Traversal(c.graph)
                sub.run(a[1])
                self.df = self.df.crossJoin(sub.df.select(F.col(sub.here).alias(f"_{name}")).limit(1)) if self.df is not None else sub.df.select(F.col(sub.here).alias(f"_{name}"))
                self.ends[name] = F.col(f"_{name}")
        elif name == "property":
            if getattr(self, "pending", None):
                self.pending[3][args[0]] = args[1]
            else:
                kind = c.kinds[self.here]
                rows = self.df.select(F.col(self.here).alias("id" if kind == "node" else "eid"), F.lit(args[1]).alias("value"))
                c.graph = mutations.set_property(c.graph, rows, args[0], kind)
        elif name == "drop":
            kind = c.kinds[self.here]
            ids = self.df.select(F.col(self.here).alias("id" if kind == "node" else "eid"))
            c.graph = mutations.delete_nodes(c.graph, ids) if kind == "node" else mutations.delete_edges(c.graph, ids)
        else:
            raise ParseError(f"unknown step {name}")

    def flush(self) -> None:
        pending = getattr(self, "pending", None)
        if not pending:
            return
        kind, ident, label, props = pending
        graph = self.c.graph
        if kind == "node":
            rows = graph.spark.range(1).select(F.lit(ident).cast("bigint").alias("id"), *[F.lit(v).alias(k) for k, v in props.items()])
            self.c.graph = graph.with_vertices(rows, label)
        else:
            rows = self.df.select(self.ends["from"].alias("src"), self.ends["to"].alias("dst"), *[F.lit(v).alias(k) for k, v in props.items()])
            self.c.graph = mutations.create_edges(graph, rows, label)
        self.pending = None

    def _only_current(self) -> None:
        self.df = self.df.withColumn("_now", self.current())

    def _group_by(self, key) -> None:
        if self.grouping == "groupCount":
            self.df = self.df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value"))
        else:
            self.df = self.df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(self.current())).alias("value"))
        self.value, self.grouping, self.ordering = F.struct("key", "value"), None, []


def execute(graph: PropertyGraph, text: str) -> Result:
    """Rows with one column ``value``: the current value, or the id of the current element."""
    t = Traversal(graph)
    t.run(parse(text), top=True)
    if getattr(t, "grouping", None):
        t._group_by(t.current())
    t.flush()
    rows = None
    if t.df is not None and t.ordering:  # later steps may have moved rows
        t.df = t.df.orderBy(*t.ordering)
    if t.df is not None:
        rows = t.df.select("key", "value") if {"key", "value"} == set(t.df.columns) else t.df.select(t.current().alias("value"))
    return Result(rows, t.c.graph)
