"""SPARQL 1.1 queries and updates on a TripleStore: solutions are rows with one term column per variable."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.cluster import checkpointed
from arcweave.languages.lexer import Tokens, number, unquoted
from arcweave.functions import vectors
from arcweave.functions.scalar import regex_test
from arcweave.rdf import RDF_TYPE, TERM, XSD, TripleStore, blank, iri, iri_column, literal, matches, term_column

_SIGNS = r"<[^<>\s\"{}|^`]*>|\?[A-Za-z_]\w*|\$[A-Za-z_]\w*|_:[A-Za-z0-9_]+|[A-Za-z_][\w-]*:[\w.-]*\w|[A-Za-z_][\w-]*:|:[\w-]+|@[A-Za-z-]+|\^\^|&&|\|\||!=|<=|>=|[-+*/^|?=<>!(){}\[\],.;:]"
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


@dataclass
class Group:
    """Elements of a group graph pattern, in order: ("triples", [...]) ("filter", e) ("optional", g) ("union", [g]) ("minus", g)
    ("bind", e, v) ("values", vars, rows) ("select", s) ("group", g) ("graph", name, g)."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Select:
    items: list[tuple] | None  # (expression, variable); None: *
    where: Group
    distinct: bool = False
    group: list[tuple] = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    template: list | None = None  # CONSTRUCT
    ask: bool = False
    describe: list | None = None


@dataclass
class Result:
    rows: DataFrame | None
    store: TripleStore


class Parser:
    def __init__(self, text: str):
        # The name pattern would take the prefix of a prefixed name: signs come first here.
        self.t = Tokens.__new__(Tokens)
        import re

        pattern = re.compile(rf"(?P<space>\s+|#[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<number>(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<sign>{_SIGNS})|(?P<name>[A-Za-z_]\w*)", re.S)
        self.t.items, self.t.text, self.t.i, at = [], text, 0, 0
        while at < len(text):
            m = pattern.match(text, at)
            if not m:
                from arcweave.languages.lexer import ParseError

                raise ParseError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.t.items.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.prefixes: dict[str, str] = {"xsd": XSD, "rdf": RDF_TYPE[:-4]}
        self.base, self.fresh = "", count()

    def prologue(self) -> None:
        t = self.t
        while True:
            if t.word("PREFIX"):
                name = t.next()[1][:-1]
                self.prefixes[name] = t.next()[1][1:-1]
            elif t.word("BASE"):
                self.base = t.next()[1][1:-1]
            else:
                return

    def query(self) -> Select:
        self.prologue()
        t = self.t
        if t.word("SELECT"):
            return self._select()
        if t.word("ASK"):
            t.word("WHERE")
            return Select(None, self._group(), ask=True)
        if t.word("CONSTRUCT"):
            t.need_sign("{")
            template = self._triples()
            t.need_sign("}")
            t.need_word("WHERE")
            return self._modifiers(Select(None, self._group(), template=template))
        if t.word("DESCRIBE"):
            terms = []
            while t.peek()[0] == "sign" and t.peek()[1] != "{":
                terms.append(self._term())
            where = self._group() if t.word("WHERE") or t.peek() == ("sign", "{") else Group()
            return Select(None, where, describe=terms)
        t.fail("a query")

    def _select(self) -> Select:
        t, distinct = self.t, bool(self.t.word("DISTINCT", "REDUCED"))
        items: list | None = []
        if t.sign("*"):
            items = None
        else:
            while not t.ahead("WHERE") and t.peek() != ("sign", "{"):
                if t.sign("("):
                    e = self._expression()
                    t.need_word("AS")
                    items.append((e, self._variable()))
                    t.need_sign(")")
                else:
                    v = self._variable()
                    items.append((("var", v), v))
        t.word("WHERE")
        return self._modifiers(Select(items, self._group(), distinct))

    def _modifiers(self, s: Select) -> Select:
        t = self.t
        while True:
            if t.word("GROUP BY"):
                while t.peek()[1][:1] in "?$" and t.peek()[0] == "sign" or t.peek() == ("sign", "("):
                    if t.sign("("):
                        e = self._expression()
                        v = self._variable() if t.word("AS") else f"_g{next(self.fresh)}"
                        t.need_sign(")")
                        s.group.append((e, v))
                    else:
                        v = self._variable()
                        s.group.append((("var", v), v))
            elif t.word("HAVING"):
                s.having.append(self._primary())
            elif t.word("ORDER BY"):
                while True:
                    d = t.word("DESC", "ASC")
                    if d or t.peek() == ("sign", "(") or t.peek()[1][:1] == "?":
                        s.order.append((self._primary(), d == "DESC"))
                    else:
                        break
            elif t.word("LIMIT"):
                s.limit = int(t.next()[1])
            elif t.word("OFFSET"):
                s.offset = int(t.next()[1])
            else:
                return s

    def _variable(self) -> str:
        kind, v = self.t.next()
        if v[:1] not in "?$" or len(v) < 2:
            self.t.i -= 1
            self.t.fail("a variable")
        return v[1:]

    def _group(self) -> Group:
        t, g = self.t, Group()
        t.need_sign("{")
        if t.word("SELECT"):
            g.parts.append(("select", self._select()))
        while not t.sign("}"):
            if t.word("FILTER"):
                g.parts.append(("filter", self._primary()))
            elif t.word("OPTIONAL"):
                g.parts.append(("optional", self._group()))
            elif t.word("MINUS"):
                g.parts.append(("minus", self._group()))
            elif t.word("BIND"):
                t.need_sign("(")
                e = self._expression()
                t.need_word("AS")
                g.parts.append(("bind", e, self._variable()))
                t.need_sign(")")
            elif t.word("VALUES"):
                g.parts.append(self._values())
            elif t.word("GRAPH"):
                name = self._term()
                g.parts.append(("graph", name, self._group()))
            elif t.word("SERVICE"):
                t.word("SILENT")
                self._term()
                g.parts.append(("group", self._group()))
            elif t.peek() == ("sign", "{"):
                options = [self._group()]
                while t.word("UNION"):
                    options.append(self._group())
                g.parts.append(("union", options) if len(options) > 1 else ("group", options[0]))
            elif not t.sign("."):
                g.parts.append(("triples", self._triples()))
        return g

    def _values(self) -> tuple:
        t = self.t
        if t.sign("("):
            names = []
            while not t.sign(")"):
                names.append(self._variable())
        else:
            names = [self._variable()]
        rows = []
        t.need_sign("{")
        while not t.sign("}"):
            many = t.sign("(")
            row = [None if t.word("UNDEF") else self._term() for _ in names]
            if many:
                t.need_sign(")")
            rows.append(row)
        return ("values", names, rows)

    def _triples(self) -> list[tuple]:
        t, out = self.t, []
        while True:
            s = self._node(out)
            while True:
                p = self._path()
                while True:
                    out.append((s, p, self._node(out)))
                    if not t.sign(","):
                        break
                if not t.sign(";"):
                    break
                if t.peek()[1] in (".", "}", "]"):
                    break
            if not t.sign("."):
                return out
            kind, v = t.peek()
            if v in ("}", "{") or (kind == "name" and v.upper() in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE")):
                return out

    def _node(self, out: list) -> tuple:
        if self.t.sign("["):
            node = ("var", f"_b{next(self.fresh)}")
            while not self.t.sign("]"):
                p = self._path()
                out.append((node, p, self._node(out)))
                self.t.sign(";")
            return node
        return self._term()

    def _path(self):
        x = self._path_sequence()
        if self.t.peek() != ("sign", "|"):
            return x
        options = [x]
        while self.t.sign("|"):
            options.append(self._path_sequence())
        return ("alt", options)

    def _path_sequence(self):
        steps = [self._path_step()]
        while self.t.sign("/"):
            steps.append(self._path_step())
        return steps[0] if len(steps) == 1 else ("seq", steps)

    def _path_step(self):
        t = self.t
        if t.sign("^"):
            return ("inv", self._path_step())
        if t.sign("("):
            x = self._path()
            t.need_sign(")")
        else:
            x = self._term(verb=True)
        op = t.sign("+", "*") or (t.sign("?") if t.peek() == ("sign", "?") else None)
        return ("closure", x, op) if op else x

    def _term(self, verb: bool = False) -> tuple:
        t = self.t
        kind, v = t.next()
        if kind == "sign":
            if v[0] in "?$" and len(v) > 1:
                return ("var", v[1:])
            if v[0] == "<" and v.endswith(">"):
                return ("term", iri(v[1:-1] if "://" in v or ":" in v or not self.base else self.base + v[1:-1]))
            if v.startswith("_:"):
                return ("var", f"_n{v[2:]}") if not verb else ("term", blank(v[2:]))
            if ":" in v:
                prefix, _, name = v.partition(":")
                return ("term", iri(self.prefixes.get(prefix, prefix + ":") + name))
            if v == "-" and t.peek()[0] == "number":
                return ("term", literal(-number(t.next()[1])))
        if kind == "number":
            return ("term", literal(number(v)))
        if kind == "string":
            text = unquoted(v)
            if t.sign("^^"):
                return ("term", ("literal", text, self._term()[1][1], None))
            if t.peek()[1][:1] == "@":
                return ("term", ("literal", text, None, t.next()[1][1:]))
            return ("term", literal(text))
        if kind == "name" and v == "a":
            return ("term", iri(RDF_TYPE))
        if kind == "name" and v.lower() in ("true", "false"):
            return ("term", literal(v.lower() == "true"))
        t.i -= 1
        t.fail("a term")

    # expressions

    def _expression(self):
        x = self._and()
        while self.t.sign("||"):
            x = ("or", x, self._and())
        return x

    def _and(self):
        x = self._compare()
        while self.t.sign("&&"):
            x = ("and", x, self._compare())
        return x

    def _compare(self):
        t, x = self.t, self._add()
        op = t.sign("=", "!=", "<", "<=", ">", ">=")
        if op:
            return ("cmp", op, x, self._add())
        negated = bool(t.word("NOT IN"))
        if negated or t.word("IN"):
            t.need_sign("(")
            values = []
            while not t.sign(")"):
                values.append(self._expression())
                t.sign(",")
            return ("in", x, values, negated)
        return x

    def _add(self):
        x = self._multiply()
        while op := self.t.sign("+", "-"):
            x = ("num", op, x, self._multiply())
        return x

    def _multiply(self):
        x = self._unary()
        while op := self.t.sign("*", "/"):
            x = ("num", op, x, self._unary())
        return x

    def _unary(self):
        if self.t.sign("!"):
            return ("not", self._unary())
        if self.t.sign("-"):
            return ("num", "-", ("term", literal(0)), self._unary())
        return self._primary()

    def _primary(self):
        t = self.t
        if t.sign("("):
            x = self._expression()
            t.need_sign(")")
            return x
        if t.word("NOT EXISTS"):
            return ("exists", self._group(), True)
        if t.word("EXISTS"):
            return ("exists", self._group(), False)
        kind, v = t.peek()
        if kind == "name" and v.lower() not in ("true", "false") and t.peek(1) == ("sign", "("):
            name = t.next()[1].upper()
            t.next()
            distinct, args, separator = bool(t.word("DISTINCT")), [], " "
            while not t.sign(")"):
                if t.sign(";"):
                    t.need_word("SEPARATOR")
                    t.need_sign("=")
                    separator = unquoted(t.next()[1])
                elif t.sign("*") and not args:
                    args.append(("star",))
                else:
                    args.append(self._expression())
                t.sign(",")
            return ("call", name, args, distinct, separator)
        return self._term()


def _num(c: Column) -> Column:
    return c["value"].try_cast("double")


def _of_number(x: Column) -> Column:
    """A number as a term; whole ones are written without a fraction."""
    whole = x.cast("bigint").cast("string")
    text = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), whole).otherwise(x.cast("string"))
    null = F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.struct(F.lit("literal").alias("kind"), text.alias("value"), F.lit(XSD + "double").alias("datatype"), null.alias("lang")))


def _of_text(x: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.struct(F.lit("literal").alias("kind"), x.cast("string").alias("value"), null.alias("datatype"), null.alias("lang")))


def _of_bool(x: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.struct(F.lit("literal").alias("kind"), x.cast("string").alias("value"), F.lit(XSD + "boolean").alias("datatype"), null.alias("lang")))


def _zone(a: Column) -> Column:
    """Z, an offset like +02:00, or nothing, as the end of a date and time has it."""
    return F.regexp_extract(a["value"], r"T[0-9:.]+(Z|[+-]\d\d:\d\d)$", 1)


def _offset(a: Column) -> Column:
    """The zone as a duration: PT0S, PT2H, -PT3H30M; null where there is none."""
    zone = _zone(a)
    of = lambda i, unit: F.when((n := F.regexp_extract(zone, r"(\d\d):(\d\d)", i).try_cast("int")) > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    body, sign = F.concat(of(1, "H"), of(2, "M")), F.when(zone.startswith("-"), "-").otherwise("")
    return F.when(zone != "", F.when(body == "", "PT0S").otherwise(F.concat(sign, F.lit("PT"), body)))


_TEXTS = {
    "STR": lambda a: a["value"],
    "LANG": lambda a: F.coalesce(a["lang"], F.lit("")),
    "DATATYPE": lambda a: F.coalesce(a["datatype"], F.lit(XSD + "string")),
    "UCASE": lambda a: F.upper(a["value"]), "UPPER": lambda a: F.upper(a["value"]),
    "LCASE": lambda a: F.lower(a["value"]), "LOWER": lambda a: F.lower(a["value"]),
    "CONCAT": lambda *a: F.concat_ws("", *[x["value"] for x in a]),
    "SUBSTR": lambda s, i, n=None: F.substring(s["value"], F.greatest(_num(i), F.lit(1)).cast("int"), F.lit(1 << 30) if n is None else F.greatest(_num(n), F.lit(0)).cast("int")),
    "STRBEFORE": lambda s, x: F.when(F.instr(s["value"], x["value"]) > 0, F.substring(s["value"], F.lit(1), F.instr(s["value"], x["value"]) - 1)).otherwise(""),
    "STRAFTER": lambda s, x: F.when(F.instr(s["value"], x["value"]) > 0, F.substring(s["value"], F.instr(s["value"], x["value"]) + F.char_length(x["value"]), F.lit(1 << 30))).otherwise(""),
    "ENCODE_FOR_URI": lambda a: F.replace(F.replace(F.replace(F.url_encode(a["value"]), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")),
    "TZ": lambda a: _zone(a), "STRUUID": lambda: F.uuid(),
    "MD5": lambda a: F.md5(a["value"]), "SHA1": lambda a: F.sha1(a["value"]), "SHA256": lambda a: F.sha2(a["value"], 256), "SHA384": lambda a: F.sha2(a["value"], 384), "SHA512": lambda a: F.sha2(a["value"], 512),
}
_VECTORS = {"COSINE_SIMILARITY": vectors.cosine_similarity, "EUCLIDEAN_DISTANCE": vectors.euclidean_distance, "DOT_PRODUCT": vectors.dot_product, "MANHATTAN_DISTANCE": vectors.manhattan_distance}
_TEXTS["ENCODEFORURI"] = _TEXTS["ENCODE_FOR_URI"]
_NUMBERS = {
    "STRLEN": lambda a: F.char_length(a["value"]).cast("double"),
    "ABS": lambda a: F.abs(_num(a)), "CEIL": lambda a: F.ceil(_num(a)).cast("double"), "FLOOR": lambda a: F.floor(_num(a)).cast("double"), "ROUND": lambda a: F.floor(_num(a) + 0.5).cast("double"),
    "RAND": lambda: F.rand(),
    **{k: (lambda f: lambda a: f(a["value"].try_cast("timestamp")).cast("double"))(f) for k, f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}.items()},
}
_BOOLS = {
    "STRSTARTS": lambda a, b: a["value"].startswith(b["value"]), "STRENDS": lambda a, b: a["value"].endswith(b["value"]), "CONTAINS": lambda a, b: a["value"].contains(b["value"]),
    "ISIRI": lambda a: a["kind"] == "iri", "ISURI": lambda a: a["kind"] == "iri", "ISBLANK": lambda a: a["kind"] == "blank", "ISLITERAL": lambda a: a["kind"] == "literal",
    "ISNUMERIC": lambda a: (a["kind"] == "literal") & _num(a).isNotNull(), "SAMETERM": lambda a, b: a == b,
    "LANGMATCHES": lambda a, b: F.when(b["value"] == "*", a["value"] != "").otherwise(F.lower(a["value"]).startswith(F.lower(b["value"]))),
}


@dataclass
class Solutions:
    """Rows with a term column for each variable; ``loose`` variables may be unbound (null) in some rows."""

    df: DataFrame
    loose: frozenset = frozenset()


class Evaluator:
    """Patterns over the default graph, over the graph of a name, or (graph: a variable) over each named graph."""

    def __init__(self, store: TripleStore, graph: tuple | None = None):
        self.store, self.graph = store, graph
        self.ahead: list[Column] = []
        t = store.triples
        where = F.col("g").isNull() if graph is None else F.col("g").isNotNull() if graph[0] == "var" else F.col("g") == graph[1][1]
        self.triples = t.where(where)
        self.keep = ["g"] if graph and graph[0] == "var" else []

    # --- patterns ---

    def _pairs(self, p) -> DataFrame:
        """s, o of a path, and g where each named graph is searched by itself."""
        kind, keep = p[0], self.keep
        if kind == "term":
            return self.triples.where(matches(F.col("p"), p[1])).select("s", "o", *keep)
        if kind == "inv":
            return self._pairs(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
        if kind == "alt":
            out = self._pairs(p[1][0])
            for x in p[1][1:]:
                out = out.unionByName(self._pairs(x))
            return out
        if kind == "seq":
            out = self._pairs(p[1][0])
            for x in p[1][1:]:
                out = out.withColumnRenamed("o", "m").join(self._pairs(x).withColumnRenamed("s", "m"), ["m", *keep]).select("s", "o", *keep)
            return out
        step = checkpointed(self._pairs(p[1]).distinct())
        own = self.triples.select(F.explode(F.array("s", "o")).alias("s"), *keep).distinct().select("s", F.col("s").alias("o"), *keep)
        if p[2] == "?":
            return step.unionByName(own).distinct()
        seen = front = step
        while True:  # transitive closure, new pairs only
            far = front.withColumnRenamed("o", "m").join(step.withColumnRenamed("s", "m"), ["m", *keep]).select("s", "o", *keep).distinct()
            front = checkpointed(far.join(seen, ["s", "o", *keep], "left_anti"))
            if front.isEmpty():
                break
            seen = checkpointed(seen.unionByName(front))
        return seen if p[2] == "+" else seen.unionByName(own).distinct()

    def _pattern(self, triple: tuple) -> Solutions:
        s, p, o = triple
        if p[0] == "var":
            df, places = self.triples.select("s", "p", "o", *self.keep), [("s", s), ("p", p), ("o", o)]
        else:
            df, places = self._pairs(p), [("s", s), ("o", o)]
        if self.keep:
            df, places = df.withColumn("g", iri_column(F.col("g"))), [*places, ("g", self.graph)]
        names: dict[str, str] = {}
        for column, x in places:
            if x[0] == "term":
                df = df.where(matches(F.col(column), x[1]))
            elif x[1] in names:
                df = df.where(F.col(names[x[1]]) == F.col(column))
            else:
                names[x[1]] = column
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in names.items()]))

    @staticmethod
    def _compatible(left: Solutions, right: Solutions, names: dict[str, str]) -> Column:
        """Equal where both are bound; names: of shared variables, on the right."""
        on = F.lit(True)
        for c, r in names.items():
            same = F.col(c) == F.col(r)
            on = on & (same | F.col(c).isNull() | F.col(r).isNull() if c in left.loose or c in right.loose else same)
        return on

    def _join(self, left: Solutions | None, right: Solutions) -> Solutions:
        """Compatible solutions: equal shared variables, where an unbound one goes with anything."""
        if left is None:
            return right
        shared = [c for c in right.df.columns if c in left.df.columns]
        if not shared:
            return Solutions(left.df.crossJoin(right.df), left.loose | right.loose)
        rest = [c for c in right.df.columns if c not in shared]
        open_ = [c for c in shared if c in left.loose or c in right.loose]
        loose = frozenset(c for c in left.loose | right.loose if c not in shared or c in left.loose and c in right.loose)
        if not open_:
            return Solutions(left.df.join(right.df, shared).select(*left.df.columns, *rest), loose)
        names = {c: f"_r_{c}" for c in shared}
        other = right.df.withColumnsRenamed(names)
        out = [F.coalesce(F.col(c), F.col(names[c])).alias(c) if c in open_ else F.col(c) for c in left.df.columns]
        if len(open_) < len(shared) or len(open_) > 3:
            return Solutions(left.df.join(other, self._compatible(left, right, names)).select(*out, *rest), loose)
        # No variable is bound throughout: rows are joined by what is bound in them, pattern by pattern.
        found = None
        options = lambda side: [[(c, b) for c, b in zip(open_, bits, strict=True)] for bits in product((True, False), repeat=len(open_)) if all(b or c in side.loose for c, b in zip(open_, bits, strict=True))]
        for x, y in product(options(left), options(right)):
            one, two, on = left.df, other, F.lit(True)
            for (c, b), (_, d) in zip(x, y, strict=True):
                one = one.where(F.col(c).isNotNull() if b else F.col(c).isNull())
                two = two.where(F.col(names[c]).isNotNull() if d else F.col(names[c]).isNull())
                on = on & (F.col(c) == F.col(names[c])) if b and d else on
            part = one.join(two, on).select(*out, *rest)
            found = part if found is None else found.unionByName(part)
        return Solutions(found, loose)

    def group(self, g: Group) -> Solutions:
        """Elements in the order of the text; filters hold for the whole group."""
        rows: Solutions | None = None
        filters = [x for part in g.parts if part[0] == "filter" for x in self._conjuncts(part[1])]
        nothing = lambda: Solutions(self.store.spark.range(1).select())
        for part in g.parts:
            kind = part[0]
            if kind == "triples":
                todo = list(part[1])
                while todo:  # those that share a variable with what is there come first
                    have = set(rows.df.columns) if rows is not None else set()
                    at = next((i for i, x in enumerate(todo) if have & {y[1] for y in x if y[0] == "var"}), 0)
                    rows = self._join(rows, self._pattern(todo.pop(at)))
            elif kind == "union":
                rows = self._join(rows, self._union([self.group(option) for option in part[1]]))
            elif kind == "group":
                rows = self._join(rows, self.group(part[1]))
            elif kind == "select":
                rows = self._join(rows, self.select(part[1]))
            elif kind == "graph":
                rows = self._join(rows, Evaluator(self.store, part[1]).group(part[2]))
            elif kind == "values":
                rows = self._join(rows, self._values(part[1], part[2]))
            elif kind == "bind":
                rows = rows or nothing()
                sure = part[1][0] == "term" or part[1][0] == "var" and part[1][1] not in rows.loose
                rows = Solutions(rows.df.withColumn(part[2], self.term(part[1])), rows.loose | (frozenset() if sure else {part[2]}))
            elif kind == "optional":
                inner = Group([x for x in part[1].parts if x[0] != "filter"])
                rows = self._optional(rows or nothing(), self.group(inner), [x[1] for x in part[1].parts if x[0] == "filter"])
            elif kind == "minus":
                rows = rows or nothing()
                rows = Solutions(self._without(rows, self.group(part[1])), rows.loose)
        rows = rows or nothing()
        for c in filters:
            if c[0] == "exists" or c[0] == "not" and c[1][0] == "exists":
                inner, negated = (c, c[2]) if c[0] == "exists" else (c[1], not c[1][2])
                rows = Solutions(self._exists(rows, self.group(inner[1]), "left_anti" if negated else "left_semi"), rows.loose)
            else:
                rows = Solutions(rows.df.where(self.truth(c)), rows.loose)
        return rows

    @staticmethod
    def _union(options: list[Solutions]) -> Solutions:
        every = {c: None for x in options for c in x.df.columns}
        loose = {c for c in every for x in options if c in x.loose or c not in x.df.columns}
        out = None
        for x in options:
            out = x.df if out is None else out.unionByName(x.df, allowMissingColumns=True)
        return Solutions(out.select(*every), frozenset(loose))

    def _exists(self, left: Solutions, right: Solutions, how: str) -> DataFrame:
        shared = [x for x in right.df.columns if x in left.df.columns]
        if not shared:
            return left.df.join(right.df.limit(1).select(F.lit(1).alias("_any")), F.lit(True), how)
        names = {c: f"_r_{c}" for c in shared}
        return left.df.join(right.df.select(*shared).withColumnsRenamed(names), self._compatible(left, right, names), how)

    def _without(self, left: Solutions, right: Solutions) -> DataFrame:
        """MINUS: a compatible solution takes the row away if the two have a bound variable in common."""
        shared = [x for x in right.df.columns if x in left.df.columns]
        if not shared:
            return left.df
        names = {c: f"_r_{c}" for c in shared}
        on = self._compatible(left, right, names)
        if all(c in left.loose or c in right.loose for c in shared):
            both = F.lit(False)
            for c, r in names.items():
                both = both | (F.col(c).isNotNull() & F.col(r).isNotNull())
            on = on & both
        return left.df.join(right.df.select(*shared).withColumnsRenamed(names), on, "left_anti")

    def _optional(self, left: Solutions, right: Solutions, filters: list) -> Solutions:
        shared = [c for c in right.df.columns if c in left.df.columns]
        names = {c: f"_r_{c}" for c in shared}
        on = self._compatible(left, right, names)
        for f in filters:
            on = on & self.truth(f)
        rest = [c for c in right.df.columns if c not in shared]
        out = [F.coalesce(F.col(c), F.col(names[c])).alias(c) if c in left.loose and c in names else F.col(c) for c in left.df.columns]
        df = left.df.join(right.df.withColumnsRenamed(names), on, "left").select(*out, *rest)
        return Solutions(df, left.loose | frozenset(rest))

    @staticmethod
    def _conjuncts(x) -> list:
        return Evaluator._conjuncts(x[1]) + Evaluator._conjuncts(x[2]) if x[0] == "and" else [x]

    def _values(self, names: list[str], rows: list) -> Solutions:
        from pyspark.sql import types as T

        data = [tuple(x[1] if x else None for x in r) for r in rows]
        df = self.store.spark.createDataFrame(data, T.StructType([T.StructField(n, TERM) for n in names]))
        return Solutions(df, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in data)))

    # --- expressions ---

    def truth(self, x) -> Column:
        kind = x[0]
        if kind == "and":
            return self.truth(x[1]) & self.truth(x[2])
        if kind == "or":
            return self.truth(x[1]) | self.truth(x[2])
        if kind == "not":
            return ~self.truth(x[1])
        if kind == "cmp":
            a, b = self.term(x[2]), self.term(x[3])
            m, n, s, t = _num(a), _num(b), a["value"], b["value"]
            op = x[1]
            if op in ("=", "!="):
                same = F.coalesce(m == n, (a["kind"] == b["kind"]) & (s == t) & (F.coalesce(a["lang"], F.lit("")) == F.coalesce(b["lang"], F.lit(""))))
                return same if op == "=" else ~same
            pick = {"<": lambda u, v: u < v, "<=": lambda u, v: u <= v, ">": lambda u, v: u > v, ">=": lambda u, v: u >= v}[op]
            return F.coalesce(pick(m, n), pick(s, t))
        if kind == "in":
            out = F.lit(False)
            for v in x[2]:
                out = out | self.truth(("cmp", "=", x[1], v))
            return ~out if x[3] else out
        if kind == "call":
            name, args = x[1], x[2]
            if name == "BOUND":
                return self.term(args[0]).isNotNull()
            if name == "REGEX":
                flags = args[2][1][1] if len(args) > 2 else ""
                prefix, constant = "(?i)" if "i" in flags else "", args[1][1][1] if args[1][0] == "term" else None
                return regex_test(self.term(args[0])["value"], F.concat(F.lit(prefix), self.term(args[1])["value"]), None if constant is None else prefix + constant)
            if name in _BOOLS:
                return _BOOLS[name](*[self.term(a) for a in args])
        t = self.term(x)
        return F.coalesce(F.when(t["datatype"] == XSD + "boolean", t["value"] == "true"), _num(t) != 0, t["value"] != "")

    def term(self, x) -> Column:
        kind = x[0]
        if kind == "var":
            return F.col(x[1])
        if kind == "term":
            return term_column(x[1])
        if kind == "num":
            a, b = _num(self.term(x[2])), _num(self.term(x[3]))
            return _of_number({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[x[1]])
        if kind in ("and", "or", "not", "cmp", "in"):
            return _of_bool(self.truth(x))
        if kind == "call":
            name, args = x[1], x[2]
            if name == "COALESCE":
                return F.coalesce(*[self.term(a) for a in args])
            if name == "IF":
                return F.when(self.truth(args[0]), self.term(args[1])).otherwise(self.term(args[2]))
            if name == "REPLACE":
                s, p, r = (self.term(a)["value"] for a in args[:3])
                flags = args[3][1][1] if len(args) > 3 else None
                return _of_text(F.replace(s, p, r) if flags is None else F.regexp_replace(s, F.concat(F.lit("(?i)" if "i" in flags else ""), p), r))
            if name in ("IRI", "URI"):
                return iri_column(self.term(args[0])["value"])
            if name == "BNODE":
                own = F.concat(F.lit("b"), F.md5(self.term(args[0])["value"])) if args else F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
                return F.struct(F.lit("blank").alias("kind"), own.alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
            if name == "UUID":
                return iri_column(F.concat(F.lit("urn:uuid:"), F.uuid()))
            if name == "TIMEZONE":
                text = _offset(self.term(args[0]))
                return F.when(text.isNotNull(), F.struct(F.lit("literal").alias("kind"), text.alias("value"), F.lit(XSD + "dayTimeDuration").alias("datatype"), F.lit(None).cast("string").alias("lang")))
            if name == "VECTOR":
                return _of_text(F.concat(F.lit("["), F.array_join(F.array(*[self.term(a)["value"] for a in args]), ", "), F.lit("]")))
            if name in _VECTORS:
                x, y = (F.from_json(self.term(a)["value"], "array<double>") for a in args)
                return _of_number(_VECTORS[name](x, y))
            if name == "STRDT":
                a = self.term(args[0])
                return F.struct(F.lit("literal").alias("kind"), a["value"].alias("value"), self.term(args[1])["value"].alias("datatype"), F.lit(None).cast("string").alias("lang"))
            if name == "STRLANG":
                a = self.term(args[0])
                return F.struct(F.lit("literal").alias("kind"), a["value"].alias("value"), F.lit(None).cast("string").alias("datatype"), self.term(args[1])["value"].alias("lang"))
            if name == "NOW":
                return _of_text(F.now().cast("string"))
            if name in _NUMBERS:
                return _of_number(_NUMBERS[name](*[self.term(a) for a in args]))
            if name in _TEXTS:
                return _of_text(_TEXTS[name](*[self.term(a) for a in args]))
            if name in _BOOLS or name in ("BOUND", "REGEX"):
                return _of_bool(self.truth(x))
            if name in AGGREGATES:
                return self._aggregate(x)
        raise ValueError(f"unknown expression {x[:2]}")

    def _before(self, c: Column) -> Column:
        """A column that is computed ahead of the aggregation."""
        self.ahead.append(c.alias(f"_a{len(self.ahead)}"))
        return F.col(f"_a{len(self.ahead) - 1}")

    def _aggregate(self, x) -> Column:
        name, args, distinct = x[1], x[2], x[3]
        if name == "COUNT":
            if args[0] == ("star",):
                return _of_number(F.count(F.lit(1)).cast("double"))
            c = self._before(self.term(args[0]))
            return _of_number((F.count_distinct(c) if distinct else F.count(c)).cast("double"))
        c = self._before(self.term(args[0]))
        n = self._before(_num(c))
        if name == "SUM":
            return _of_number(F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), F.lit(0.0)))
        if name == "AVG":
            return _of_number(F.sum_distinct(n) / F.count_distinct(n) if distinct else F.avg(n))
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            return f(self._before(F.when(c.isNotNull(), F.struct(n.alias("n"), c["value"].alias("v"), c.alias("t")))))["t"]
        if name == "SAMPLE":
            return F.min(c)
        text = self._before(c["value"])
        values = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
        return _of_text(F.array_join(values, x[4]))

    # --- queries ---

    def _has_aggregate(self, x) -> bool:
        return isinstance(x, tuple) and (x[0] == "call" and x[1] in AGGREGATES or any(self._has_aggregate(y) for y in x) or any(self._has_aggregate(z) for y in x if isinstance(y, list) for z in y))

    def select(self, s: Select) -> Solutions:
        rows = self.group(s.where)
        df, sure = rows.df, {c for c in rows.df.columns if c not in rows.loose}
        items = s.items if s.items is not None else [(("var", c), c) for c in df.columns if not c.startswith("_")]
        order_columns = []
        if s.group or any(self._has_aggregate(e) for e, _ in items):
            keys, ahead = [self.term(e).alias(v) for e, v in s.group], []
            self.ahead = ahead
            sums = [(e, v) for e, v in items if self._has_aggregate(e)]
            hidden = [(h, f"_h{i}") for i, h in enumerate(s.having)]
            ordering = [(e, f"_o{i}") for i, (e, _) in enumerate(s.order) if self._has_aggregate(e)]
            aggs = [self.term(e).alias(v) for e, v in sums] + [self.truth(h).alias(v) for h, v in hidden if self._has_aggregate(h)] + [self.term(e).alias(v) for e, v in ordering]
            for c in ahead:  # one may build on another
                df = df.select("*", c)
            df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
            for h, v in hidden:
                df = df.where(F.col(v) if self._has_aggregate(h) else self.truth(h))
            order_columns = [next((v for e2, v in ordering if e2 is e), None) for e, _ in s.order]
            items = [(("var", v), v) if self._has_aggregate(e) else (e, v) for e, v in items]
        else:
            for e, v in items:
                if e != ("var", v):
                    df = df.withColumn(v, self.term(e))
        if s.order and not s.distinct:
            df = df.orderBy(*self._order(s, df, order_columns))
        df = df.select(*[(F.col(v) if v in df.columns else self.term(e) if e[0] != "var" else F.lit(None).cast(TERM)).alias(v) for e, v in items])
        if s.distinct:
            df = df.distinct()
            if s.order:
                df = df.orderBy(*self._order(s, df, order_columns))
        if s.offset:
            df = df.offset(s.offset)
        return Solutions(df if s.limit is None else df.limit(s.limit), frozenset(c for c in df.columns if c not in sure))

    def _order(self, s: Select, df: DataFrame, names: list) -> list[Column]:
        out = []
        for i, (e, descending) in enumerate(s.order):
            c = F.col(names[i]) if names and names[i] else self.term(e)
            for x in (_num(c), c["value"]):
                out.append(x.desc_nulls_first() if descending else x.asc_nulls_last())
        return out

    def quads(self, rows: DataFrame, blocks: list[tuple[str | None, list[tuple]]]) -> DataFrame:
        """Triples of templates, each with its graph."""
        out = None
        for g, triples in blocks:
            part = self.template(rows, triples).withColumn("g", F.lit(g).cast("string"))
            out = part if out is None else out.unionByName(part)
        return out

    def template(self, rows: DataFrame, triples: list[tuple]) -> DataFrame:
        out = None
        for t in triples:
            columns = [(term_column(x[1]) if x[0] == "term" else F.col(x[1]) if x[1] in rows.columns else F.lit(None)).alias(c) for c, x in zip("spo", t, strict=True)]
            part = rows.select(*columns).where("s is not null and p is not null and o is not null")
            out = part if out is None else out.unionByName(part)
        return out.distinct()


def execute(store: TripleStore, text: str) -> Result:
    p = Parser(text)
    p.prologue()
    if p.t.peek()[1].upper() in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
        q, ev = p.query(), Evaluator(store)
        if q.ask:
            return Result(ev.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result")), store)
        if q.template is not None:
            return Result(ev.template(ev.group(q.where).df, q.template), store)
        if q.describe is not None:
            terms = [x for x in q.describe if x[0] == "term"]
            rows = ev.group(q.where).df if q.where.parts else None
            about = None
            for x in q.describe:
                df = store.spark.range(1).select(term_column(x[1]).alias("s")) if x in terms else rows.select(F.col(x[1]).alias("s"))
                about = df if about is None else about.unionByName(df)
            return Result(store.triples.join(about.distinct(), "s", "left_semi").select("s", "p", "o"), store)
        return Result(ev.select(q).df, store)
    while not p.t.done():
        store = _update(store, p)
        p.t.sign(";")
        p.prologue()
    return Result(None, store)


def _ground(store: TripleStore, triples: list[tuple], graph: str | None) -> DataFrame:
    """Data triples; blank nodes in them are nodes of that name."""
    term = lambda x: x[1] if x[0] == "term" else blank(x[1].removeprefix("_n"))
    return TripleStore.of(store.spark, [(*map(term, t), graph) for t in triples]).triples


def _quad_block(p: Parser) -> list[tuple[str | None, list[tuple]]]:
    t, out = p.t, []
    t.need_sign("{")
    while not t.sign("}"):
        if t.word("GRAPH"):
            name = p._term()[1][1]
            t.need_sign("{")
            out.append((name, [] if t.peek() == ("sign", "}") else p._triples()))
            t.need_sign("}")
            t.sign(".")
        else:
            out.append((None, p._triples()))
    return out


def _update(store: TripleStore, p: Parser) -> TripleStore:
    t = p.t
    if t.word("INSERT DATA"):
        for g, triples in _quad_block(p):
            store = store.insert(_ground(store, triples, g))
        return store
    if t.word("DELETE DATA"):
        for g, triples in _quad_block(p):
            store = store.delete(_ground(store, triples, g))
        return store
    if t.word("CLEAR", "DROP"):
        t.word("SILENT")
        if t.word("ALL"):
            return store.clear(everything=True)
        if t.word("DEFAULT"):
            return store.clear()
        t.word("GRAPH")
        return store.clear(p._term()[1][1])
    if t.word("CREATE"):
        t.word("SILENT")
        t.word("GRAPH")
        p._term()
        return store
    if how := t.word("COPY", "MOVE", "ADD"):
        t.word("SILENT")

        def name():
            if t.word("DEFAULT"):
                return None
            t.word("GRAPH")
            return p._term()[1][1]

        source = name()
        t.need_word("TO")
        return store.copy_graph(source, name(), how != "ADD", how == "MOVE")
    if t.word("LOAD"):
        t.word("SILENT")
        return store.insert(TripleStore.read_ntriples(store.spark, p._term()[1][1]).triples)
    if t.word("DELETE WHERE"):
        blocks = _quad_block(p)
        where = Group([("triples", list(b)) if g is None else ("graph", ("term", iri(g)), Group([("triples", list(b))])) for g, b in blocks])
        ev = Evaluator(store)
        return store.delete(checkpointed(ev.quads(checkpointed(ev.group(where).df), blocks)))
    gone = _quad_block(p) if t.word("DELETE") else []
    new = _quad_block(p) if t.word("INSERT") else []
    t.need_word("WHERE")
    ev = Evaluator(store)
    rows = checkpointed(ev.group(p._group()).df)
    if gone:
        store = store.delete(ev.quads(rows, gone))
    return store.insert(ev.quads(rows, new)) if new else store
