"""From clauses to one DataFrame: a table of bindings that scans, joins and aggregates build up.

A node or edge variable ``v`` is a column ``v`` with its id; the properties that the query names are columns
``v__key``, read where the variable is bound. A vertex table is joined only for what an edge table's declaration
doesn't say already, and only columns that are named are read, so that Parquet gets the filters and the column list.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.cluster import checkpointed, partitions_for
from arcweave.functions.scalar import AGGREGATES, SCALARS, list_index, regex_test
from arcweave.graph import PropertyGraph, oriented
from arcweave.plans.tree import Expr, Match, Node, Path, Project, Rel, Unwind, aggregates, conjuncts, text_of, walk


class QueryError(ValueError):
    pass


def needs_of(clauses) -> dict[str, set[str]]:
    """Properties that a query reads of each variable; "__labels" and "__type" stand for those."""
    needs: dict[str, set[str]] = defaultdict(set)
    for x in walk(clauses):
        if x[0] == "prop" and isinstance(x[1], tuple) and x[1][0] == "var":
            needs[x[1][1]].add(x[2])
        elif x[0] == "call" and x[1] in ("labels", "haslabel", "type") and x[2] and x[2][0][0] == "var":
            needs[x[2][0][1]].add("__type" if x[1] == "type" else "__labels")
    names: list[tuple[str, str]] = []
    for c in clauses:
        if isinstance(c, Project):
            names += [(e[1], a) for e, a in c.items if e[0] == "var" and e[1] != a]
    for _ in names:
        for old, new in names:
            needs[old] |= needs[new]
    return needs


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict, needs: dict[str, set[str]] | None = None):
        self.graph, self.params = graph, params
        self.needs = needs if needs is not None else defaultdict(set)
        self.df: DataFrame | None = None
        self.kinds: dict[str, str] = {}  # node, edge, value or path
        self.of: dict[str, set[str]] = defaultdict(set)  # labels that a node carries for sure; types an edge may have
        self.marks: dict[int, str] = {}
        self.fresh = count()

    # --- expressions ---

    def column(self, x: Expr, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        kind = x[0]
        go = lambda y: self.column(y, local)
        if kind == "lit":
            return F.lit(x[1])
        if kind == "param":
            if x[1] not in self.params:
                raise QueryError(f"no value for parameter ${x[1]}")
            v = self.params[x[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
        if kind == "var":
            if x[1] in local:
                return local[x[1]]
            if x[1] not in self.kinds:
                import difflib

                near = difflib.get_close_matches(x[1], self.kinds, 1)
                raise QueryError(f"undefined variable {x[1]}" + (f"; did you mean {near[0]}?" if near else ""))
            return F.col(f"`{x[1]}`")
        if kind == "prop":
            base = x[1]
            if base[0] == "var" and self.kinds.get(base[1]) in ("node", "edge") and base[1] not in local:
                return F.col(f"`{base[1]}__{x[2]}`")
            return go(base)[x[2]]
        if kind == "bin":
            return self._binary(x[1], x[2], x[3], go)
        if kind == "not":
            return ~go(x[1])
        if kind == "neg":
            return -go(x[1])
        if kind == "null":
            return go(x[1]).isNotNull() if x[2] else go(x[1]).isNull()
        if kind == "case":
            out = None
            for when, then in x[2]:
                test = go(when) if x[1] is None else go(x[1]) == go(when)
                out = F.when(test, go(then)) if out is None else out.when(test, go(then))
            return out if x[3] is None else out.otherwise(go(x[3]))
        if kind == "list":
            return F.array(*[go(y) for y in x[1]])
        if kind == "map":
            return F.create_map(*[c for k, y in x[1].items() for c in (F.lit(k), go(y))])
        if kind == "index":
            if x[2][0] == "lit" and isinstance(x[2][1], str):
                return F.try_element_at(go(x[1]), go(x[2]))
            if isinstance(self._type(x[1], local), T.StringType):
                i = go(x[2])
                c = F.substring(go(x[1]), F.when(i < 0, i).otherwise(i + 1), F.lit(1))
                return F.when(c != "", c)
            return list_index(go(x[1]), go(x[2]))
        if kind == "slice":
            a = go(x[2]) if x[2] is not None else F.lit(0)
            if isinstance(self._type(x[1], local), T.StringType):
                b = go(x[3]) if x[3] is not None else F.char_length(go(x[1]))
                return F.substring(go(x[1]), a + 1, F.greatest(b - a, F.lit(0)))
            n = F.size(go(x[1]))
            b = go(x[3]) if x[3] is not None else n
            a, b = (F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(i).cast("int") for i in (a, b))
            return F.slice(go(x[1]), a + 1, F.greatest(F.least(b, n) - a, F.lit(0)))
        if kind == "each":
            values = go(x[2])
            inside = lambda v: {**local, x[1]: v}
            if x[3] is not None:
                values = F.filter(values, lambda v: self.column(x[3], inside(v)))
            return values if x[4] is None else F.transform(values, lambda v: self.column(x[4], inside(v)))
        if kind in ("exists", "count"):
            return F.col(self.marks[id(x)])
        if kind == "star":
            return F.count(F.lit(1))
        if kind == "call":
            return self._call(x, go, local)
        raise QueryError(f"unknown expression {kind}")

    def _type(self, x: Expr, local=None) -> T.DataType | None:
        if x[0] == "lit":
            return T.StringType() if isinstance(x[1], str) else T.LongType() if isinstance(x[1], int) and not isinstance(x[1], bool) else T.DoubleType() if isinstance(x[1], float) else None
        if local or self.df is None or aggregates(x):
            return None
        return self.df.select(self.column(x)).schema[0].dataType

    def _binary(self, op: str, x: Expr, y: Expr, go) -> Column:
        if op == "IN":
            if y[0] == "list":
                return go(x).isin(*[go(v) for v in y[1]]) if y[1] else F.lit(False)
            if y[0] == "param":
                return go(x).isin(*self.params[y[1]])
            return F.array_contains(go(y), go(x))
        a, b = go(x), go(y)
        if op == "AND":
            return a & b
        if op == "OR":
            return a | b
        if op == "XOR":
            return a != b
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "+" and any(isinstance(self._type(v), T.StringType) for v in (x, y)):
            return F.concat(a.cast("string"), b.cast("string"))
        if op == "+" and any(isinstance(self._type(v), T.ArrayType) for v in (x, y)):
            return F.concat(a, b)
        if op == "||":
            return F.concat(a, b)
        if op in "+-*":
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        if op == "/":
            if all(isinstance(self._type(v), T.IntegralType) for v in (x, y)):
                return F.when(b != 0, ((a - F.try_mod(a, b)) / b).cast("bigint"))
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        if op == "^":
            return F.pow(a, b)
        if op == "STARTS":
            return a.startswith(b)
        if op == "ENDS":
            return a.endswith(b)
        if op == "CONTAINS":
            return a.contains(b)
        if op == "=~":
            constant = y[1] if y[0] == "lit" else self.params.get(y[1]) if y[0] == "param" else None
            return regex_test(a, b, constant if isinstance(constant, str) else None)
        if op == "LIKE":
            return F.like(a, b)
        raise QueryError(f"unknown operator {op}")

    def _call(self, x: Expr, go, local) -> Column:
        name, args, distinct = x[1], x[2], x[3]
        if name in AGGREGATES:
            if name == "count" and args and args[0][0] == "star":
                return F.count(F.lit(1))
            return AGGREGATES[name](*[go(a) for a in args], distinct)
        if args and args[0][0] == "var" and args[0][1] in self.kinds and args[0][1] not in local:
            v, kind = args[0][1], self.kinds[args[0][1]]
            if name in ("id", "elementid", "element_id"):
                return F.col(f"`{v}`")
            if name == "labels":
                return F.col(f"`{v}____labels`")
            if name == "type":
                return F.col(f"`{v}____type`")
            if name == "haslabel":
                return F.array_contains(F.col(f"`{v}____labels`"), go(args[1]))
            if name in ("length", "path_length") and kind == "path":
                return F.col(f"`{v}__length`")
        if name in ("size", "length"):
            c, kind = go(args[0]), self._type(args[0], local)
            return F.char_length(c).cast("bigint") if isinstance(kind, T.StringType) else F.when(c.isNotNull(), F.size(c)).cast("bigint")
        if name not in SCALARS:
            raise QueryError(f"unknown function {name}")
        return SCALARS[name](*[go(a) for a in args])

    # --- subqueries in expressions ---

    def _prepare(self, x) -> None:
        """Add a column to the bindings for each EXISTS or COUNT subquery in x: a join on the shared variables."""
        for y in list(walk(x)):
            if y[0] in ("exists", "count") and id(y) not in self.marks:
                name = f"_mark{next(self.fresh)}"
                sub, shared = self._sub(y)
                if y[0] == "exists":
                    found = sub.select(*[F.col(f"`{s}`") for s in shared]).distinct().withColumn(name, F.lit(True))
                    self.df = self._join_on(self.df, found, shared, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
                else:
                    found = sub.groupBy(*shared).agg(F.count(F.lit(1)).alias(name))
                    self.df = self._join_on(self.df, found, shared, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
                self.marks[id(y)] = name

    def _sub(self, x: Expr) -> tuple[DataFrame, list[str]]:
        inner = Compiler(self.graph, self.params, needs_of([Match(x[1], x[2])]))
        inner.match(Match(x[1], x[2]))
        shared = [v for v in inner.kinds if v in self.kinds and inner.kinds[v] != "path"]
        if not shared:
            raise QueryError("a subquery must share a variable with what surrounds it")
        return inner.df, shared

    @staticmethod
    def _join_on(left: DataFrame, right: DataFrame, shared: list[str], how: str) -> DataFrame:
        renamed = right.withColumnsRenamed({s: f"_r_{s}" for s in shared})
        on = None
        for s in shared:
            c = F.col(f"`{s}`") == F.col(f"`_r_{s}`")
            on = c if on is None else on & c
        out = left.crossJoin(renamed) if on is None and how == "inner" else left.join(renamed, F.lit(True) if on is None else on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{s}" for s in shared])

    def where(self, x: Expr | None) -> None:
        rest = []
        for c in conjuncts(x):
            inner, how = (c[1], "left_anti") if c[0] == "not" else (c, "left_semi")
            if inner[0] == "exists":
                sub, shared = self._sub(inner)
                self.df = self._join_on(self.df, sub.select(*[F.col(f"`{s}`") for s in shared]), shared, how)
            else:
                rest.append(c)
        for c in rest:
            self._prepare(c)
            self.df = self.df.where(self.column(c))

    # --- patterns ---

    def _node(self, n: Node) -> DataFrame:
        wanted = sorted(k for k in self.needs[n.var] | set(n.props) if not k.startswith("__"))
        with_labels = "__labels" in self.needs[n.var]
        df = self.graph.node_scan(n.labels, wanted, with_labels)
        for k, v in n.props.items():
            df = df.where(F.col(f"`{k}`") == self.column(v))
        names = {k: f"{n.var}__{k}" for k in wanted} | {"id": n.var} | ({"labels": f"{n.var}____labels"} if with_labels else {})
        return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])

    def _edge(self, r: Rel, a: str, b: str, tables=None) -> DataFrame:
        wanted = sorted(k for k in self.needs[r.var] | set(r.props) if not k.startswith("__"))
        with_type = "__type" in self.needs[r.var]
        df = self.graph.edge_scan(r.types, wanted, with_type, tables)
        for k, v in r.props.items():
            df = df.where(F.col(f"`{k}`") == self.column(v))
        df = oriented(df, r.direction)
        names = [("a", a), ("b", b), ("eid", r.var)] + [(k, f"{r.var}__{k}") for k in wanted] + ([("type", f"{r.var}____type")] if with_type else [])
        return df.select(*[F.col(f"`{x}`").alias(y) for x, y in names])

    def _bare(self, n: Node, implied: set[str]) -> bool:
        """The edges say all that is asked of the node."""
        return set(n.labels) <= implied and not n.props and not self.needs[n.var]

    def _implied(self, r: Rel, end: str) -> set[str]:
        """Labels of the near ("a") or far ("b") end of a step."""
        source, target = (self.graph.end_labels(r.types, e) for e in ("source", "target"))
        if r.direction == "both":
            return source & target
        return source if (end == "a") == (r.direction == "out") else target

    def _bind(self, n: Node) -> None:
        """Bind a node, or hold a bound one to what is asked of it here."""
        if n.var in self.kinds:
            if n.labels or n.props:
                only = Node("_again", n.labels, n.props)
                ids = self._node(only).select("_again")
                self.df = self.df.join(ids, F.col(f"`{n.var}`") == F.col("_again"), "left_semi")
        else:
            scan = self._node(n)
            self.df = scan if self.df is None else self.df.crossJoin(scan)
            self.kinds[n.var] = "node"
        self.of[n.var] |= set(n.labels)
        if n.where is not None:
            self.where(n.where)

    def _reach(self, n: Node, implied: set[str]) -> None:
        """What is still to be read of a node that a join has just bound."""
        self.kinds[n.var] = "node"
        self.of[n.var] |= set(n.labels) | implied
        if not self._bare(n, implied):
            self.df = self.df.join(self._node(n), n.var)
        if n.where is not None:
            self.where(n.where)

    @staticmethod
    def _flip(r: Rel) -> Rel:
        return Rel(r.var, r.types, {"out": "in", "in": "out"}.get(r.direction, r.direction), r.props, r.hops, r.where)

    def _path(self, p: Path) -> None:
        if p.shortest:
            return self._shortest(p)
        start = next((i for i, n in enumerate(p.nodes) if n.var in self.kinds), 0)
        lengths: list[Column] = []
        todo = [(i, i + 1, p.rels[i]) for i in range(start, len(p.rels))] + [(i + 1, i, self._flip(p.rels[i])) for i in reversed(range(start))]
        first = p.nodes[start]
        fresh = first.var not in self.kinds
        if not (fresh and todo and p.nodes[todo[0][1]].var != first.var and todo[0][2].hops is None and self._bare(first, self._implied(todo[0][2], "a")) and first.where is None):
            self._bind(first)
        for i, j, r in todo:
            lengths.append(self._step(p.nodes[i], r, p.nodes[j]))
        if p.var:
            total = F.lit(0).cast("bigint")
            for c in lengths:
                total = total + c
            self.df = self.df.withColumn(f"{p.var}__length", total).withColumn(p.var, F.lit(None).cast("bigint"))
            self.kinds[p.var] = "path"

    def _step(self, a: Node, r: Rel, b: Node) -> Column:
        if r.hops is not None:
            return self._walks(a, r, b)
        closing = b.var in self.kinds or a.var == b.var
        far = f"_far{next(self.fresh)}" if closing else b.var
        e = self._edge(r, a.var, far)
        if r.var in self.kinds:  # the same edge again
            e = e.withColumnRenamed(r.var, "_same")
        if a.var not in self.kinds:  # the edges bind the start, too
            self.df = e if self.df is None else self.df.crossJoin(e)
            self.kinds[a.var] = "node"
        else:
            self.df = self.df.join(e, a.var)
        if r.var in self.kinds:
            self.df = self.df.where(F.col(f"`{r.var}`") == F.col("_same")).drop("_same")
        self.kinds[r.var] = "edge"
        self.of.setdefault(r.var, set(r.types))
        if closing:
            self.df = self.df.where(F.col(f"`{b.var}`") == F.col(f"`{far}`")).drop(far)
            self._bind(b)
        else:
            self._reach(b, self._implied(r, "b"))
        if r.where is not None:
            self.where(r.where)
        return F.lit(1).cast("bigint")

    def _walks(self, a: Node, r: Rel, b: Node) -> Column:
        """Walks of r.hops edges from the bound a. Bounded ones are counted by end and level, so that the number of
        rows between levels is that of (start, end) pairs; those of the last level go on as they are. The number of
        partitions grows with the edges, so that a task's share doesn't. Unbounded walks use an edge once at most."""
        low, high = r.hops
        edges = lambda tables=None: self._edge(Rel("_e", r.types, r.direction, r.props), "_x", "_y", tables).select("_x", "_y", "_e")
        starts = self.df.select(F.col(f"`{a.var}`").alias("_s")).distinct()
        n, levels = f"_len{next(self.fresh)}", []
        if high is not None:
            cur = starts.select("_s", F.col("_s").alias("_t"), F.lit(1).cast("bigint").alias("_n"))
            if low == 0:
                levels.append(cur.withColumn(n, F.lit(0)))
            near = [t for t in self.graph.vertices if t.labels is None or self.of[a.var] <= set(t.labels)]
            for k in range(1, high + 1):  # each level reads the edges that its nodes can have
                used, near = self.graph.step_from(near, r.types, r.direction)
                e = edges(used).select("_x", "_y")
                spread = partitions_for(self.graph.spark, e.count())
                cur = cur.repartition(spread, "_t").join(e.repartition(spread, "_x"), F.col("_t") == F.col("_x")).select("_s", F.col("_y").alias("_t"), "_n")
                if k < high:
                    cur = cur.repartition(spread, "_s", "_t").groupBy("_s", "_t").agg(F.sum("_n").alias("_n"))
                if k >= low:
                    levels.append(cur.withColumn(n, F.lit(k)))
        else:
            cur = starts.select("_s", F.col("_s").alias("_t"), F.array().cast("array<bigint>").alias("_p"))
            if low == 0:
                levels.append(cur.select("_s", "_t", F.lit(1).cast("bigint").alias("_n"), F.lit(0).alias(n)))
            e, k = checkpointed(edges()), 0
            while True:
                k += 1
                cur = cur.join(e, (F.col("_t") == F.col("_x")) & ~F.array_contains("_p", F.col("_e")))
                cur = checkpointed(cur.select("_s", F.col("_y").alias("_t"), F.concat("_p", F.array("_e")).alias("_p")))
                if cur.isEmpty():
                    break
                if k >= low:
                    levels.append(cur.select("_s", "_t", F.lit(1).cast("bigint").alias("_n"), F.lit(k).alias(n)))
        if not levels:
            levels = [starts.select("_s", F.col("_s").alias("_t"), F.lit(1).cast("bigint").alias("_n"), F.lit(0).alias(n)).limit(0)]
        reach = levels[0]
        for x in levels[1:]:
            reach = reach.unionByName(x)
        reach = reach.select("_s", "_t", n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("col")
        closing = b.var in self.kinds
        far = f"_far{next(self.fresh)}" if closing else b.var
        self.df = self.df.join(reach.withColumnRenamed("_t", far), F.col(f"`{a.var}`") == F.col("_s")).drop("_s")
        if closing:
            self.df = self.df.where(F.col(f"`{b.var}`") == F.col(f"`{far}`")).drop(far)
            self._bind(b)
        else:
            self._reach(b, self._implied(r, "b") if low > 0 else set())
        return F.col(n).cast("bigint")

    def _shortest(self, p: Path) -> None:
        """Breadth-first from all starts at once; each level is written and joined once. Needs a single relationship."""
        if len(p.rels) != 1:
            raise QueryError("a shortest path has one relationship")
        a, b, r = p.nodes[0], p.nodes[1], p.rels[0]
        low, high = r.hops or (1, 1)
        self._bind(a)
        e = checkpointed(self._edge(Rel("_e", r.types, r.direction, r.props), "_x", "_y").groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_m")))
        starts = self.df.select(F.col(f"`{a.var}`").alias("_s")).distinct()
        seen = checkpointed(starts.select("_s", F.col("_s").alias("_t"), F.lit(0).alias("_d"), F.lit(1).cast("bigint").alias("_n")))
        goals = None
        if b.var in self.kinds:
            goals = self.df.select(F.col(f"`{a.var}`").alias("_s"), F.col(f"`{b.var}`").alias("_t")).distinct()
        cur, parts, k = seen, [seen], 0
        while high is None or k < high:
            k += 1
            new = cur.join(e, F.col("_t") == F.col("_x")).groupBy("_s", F.col("_y").alias("_t")).agg(F.sum(F.col("_n") * F.col("_m")).alias("_n"))
            cur = checkpointed(new.join(seen, ["_s", "_t"], "left_anti").select("_s", "_t", F.lit(k).alias("_d"), "_n"))
            if cur.isEmpty():
                break
            parts.append(cur)
            seen = seen.unionByName(cur)
            if goals is not None and goals.join(seen, ["_s", "_t"], "left_anti").isEmpty():
                break
        found = seen.where(F.col("_d") >= low)
        n = f"_len{next(self.fresh)}"
        found = found.withColumnRenamed("_d", n)
        if p.shortest == "all":
            found = found.select("_s", "_t", n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("col")
        else:
            found = found.drop("_n")
        if b.var in self.kinds:
            self.df = self.df.join(found, (F.col(f"`{a.var}`") == F.col("_s")) & (F.col(f"`{b.var}`") == F.col("_t"))).drop("_s", "_t")
            self._bind(b)
        else:
            self.df = self.df.join(found.withColumnRenamed("_t", b.var), F.col(f"`{a.var}`") == F.col("_s")).drop("_s")
            self._reach(b, set())
        if p.var:
            self.df = self.df.withColumn(f"{p.var}__length", F.col(n).cast("bigint")).withColumn(p.var, F.lit(None).cast("bigint"))
            self.kinds[p.var] = "path"

    # --- clauses ---

    def match(self, c: Match) -> None:
        if c.optional and self.df is not None:
            return self._optional(c)
        todo = list(c.paths)
        while todo:  # paths that share a variable with what is bound come first
            at = next((i for i, p in enumerate(todo) if self.df is not None and any(n.var in self.kinds for n in p.nodes)), 0)
            self._path(todo.pop(at))
        self.where(c.where)

    def _optional(self, c: Match) -> None:
        inner = Compiler(self.graph, self.params, self.needs)
        inner.fresh = self.fresh
        own = {n.var for p in c.paths for n in p.nodes} | {r.var for p in c.paths for r in p.rels}
        inside = [x for x in conjuncts(c.where) if {y[1] for y in walk(x) if y[0] == "var"} <= own]
        across = [x for x in conjuncts(c.where) if x not in inside]
        where = None
        for x in inside:
            where = x if where is None else ("bin", "AND", where, x)
        if c.paths and any(p.rels and p.rels[0].hops for p in c.paths) or any(p.shortest for p in c.paths):
            # Walks start from what is bound, not from everywhere.
            for p in c.paths:
                if p.nodes[0].var in self.kinds:
                    inner.df = self.df.select(F.col(f"`{p.nodes[0].var}`")).distinct()
                    inner.kinds[p.nodes[0].var] = "node"
                    break
        inner.match(Match(c.paths, where))
        shared = [v for v in inner.kinds if v in self.kinds and inner.kinds[v] != "path"]
        keep = [x for x in inner.df.columns if not any(x == s or x.startswith(f"{s}__") for s in shared)]
        right = inner.df.select(*[F.col(f"`{s}`").alias(f"_r_{s}") for s in shared], *[F.col(f"`{k}`") for k in keep])
        on = F.lit(True)
        for s in shared:
            on = on & (F.col(f"`{s}`") == F.col(f"`_r_{s}`"))
        self.kinds.update(inner.kinds)
        for x in across:
            on = on & self.column(x)
        self.df = self.df.join(right, on, "left").drop(*[f"_r_{s}" for s in shared])

    def unwind(self, c: Unwind) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select()
        self.df = self.df.select("*", F.explode(self.column(c.value)).alias(c.var))
        self.kinds[c.var] = "value"

    def _number(self, x: Expr) -> int:
        return int(self.params[x[1]] if x[0] == "param" else x[1])

    def project(self, c: Project, final: bool) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select()
        items = list(c.items)
        if c.star:
            items = [(("var", v), v) for v in self.kinds if not v.startswith("_")] + items
        self._prepare([e for e, _ in items])
        aliases = {a for _, a in items}
        outs, kinds = [], {}
        for e, alias in items:
            kind = self.kinds.get(e[1]) if e[0] == "var" else "value"
            kinds[alias] = kind or "value"
            outs.append((self.column(e), alias, e))
            if kind in ("node", "edge", "path") and not final:
                extra = [x for x in self.df.columns if x.startswith(f"{e[1]}__")]
                outs += [(F.col(f"`{x}`"), alias + x[len(e[1]) :], ("var", x)) for x in extra]
        grouped = c.group is not None or any(aggregates(e) for e, _ in items)
        order, hidden = [], []
        for x, descending in c.order:
            same = next((a for e, a in items if e == x), None)
            name = same or (x[1] if x[0] == "var" and x[1] in aliases else None)
            if name is None:
                name = f"_order{len(hidden)}"
                outs.append((self.column(self._seen_through(x, items)), name, self._seen_through(x, items)))
                hidden.append(name)
            order.append(F.col(f"`{name}`").desc_nulls_first() if descending else F.col(f"`{name}`").asc_nulls_last())
        if grouped:
            keys = [col.alias(name) for col, name, e in outs if not aggregates(e)]
            sums = [col.alias(name) for col, name, e in outs if aggregates(e)]
            extra = [self.column(g).alias(f"_group{i}") for i, g in enumerate(c.group or []) if g not in [e for _, _, e in outs]]
            df = self.df.groupBy(*keys, *extra).agg(*sums) if sums else self.df.select(*keys, *extra).distinct()
            self.df = df.select(*[F.col(f"`{name}`") for _, name, _ in outs])
        else:
            self.df = self.df.select(*[col.alias(name) for col, name, _ in outs])
        if c.distinct:
            self.df = self.df.distinct()
        self.of = defaultdict(set, {a: self.of[e[1]] for e, a in items if e[0] == "var"})
        self.kinds, self.marks = kinds, {}
        if c.where is not None:
            self.where(c.where)
        if order:
            self.df = self.df.orderBy(*order)
        if c.skip is not None:
            self.df = self.df.offset(self._number(c.skip))
        if c.limit is not None:
            self.df = self.df.limit(self._number(c.limit))
        if hidden:
            self.df = self.df.drop(*hidden)

    @staticmethod
    def _seen_through(x: Expr, items) -> Expr:
        """An ORDER BY expression with aliases replaced by what they name."""
        by = {a: e for e, a in items}

        def sub(y):
            if isinstance(y, tuple):
                if len(y) == 2 and y[0] == "var" and y[1] in by:
                    return by[y[1]]
                return tuple(sub(z) for z in y)
            return [sub(z) for z in y] if isinstance(y, list) else y

        return sub(x)


__all__ = ["Compiler", "QueryError", "needs_of", "text_of"]
