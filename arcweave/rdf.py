"""RDF triples as a DataFrame of terms, and updates as pure functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "datatype", "lang")])
SCHEMA = T.StructType([T.StructField(c, TERM) for c in "spo"] + [T.StructField("g", T.StringType())])
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def iri(value: str) -> tuple:
    return ("iri", value, None, None)


def blank(value: str) -> tuple:
    return ("blank", value, None, None)


def literal(value, lang: str | None = None, datatype: str | None = None) -> tuple:
    if isinstance(value, bool):
        return ("literal", str(value).lower(), XSD + "boolean", None)
    if isinstance(value, int):
        return ("literal", str(value), XSD + "integer", None)
    if isinstance(value, float):
        return ("literal", repr(value), XSD + "double", None)
    return ("literal", str(value), datatype, lang)


def term_column(term: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("kind", "value", "datatype", "lang"), term, strict=True)])


def iri_column(value: Column) -> Column:
    """An IRI term from a string column; null stays null."""
    null = F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.struct(F.lit("iri").alias("kind"), value.cast("string").alias("value"), null.alias("datatype"), null.alias("lang")))


def literal_column(value: Column, datatype: str | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.struct(F.lit("literal").alias("kind"), value.cast("string").alias("value"), F.lit(datatype).cast("string").alias("datatype"), null.alias("lang")))


@dataclass(frozen=True)
class TripleStore:
    """triples: s, p, o (terms) and g (graph name or null), a set."""

    triples: DataFrame

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple]) -> TripleStore:
        return TripleStore(spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else None) for r in rows], SCHEMA))

    @property
    def spark(self) -> SparkSession:
        return self.triples.sparkSession

    def sparql(self, text: str) -> DataFrame:
        from arcweave.languages.sparql import execute

        return execute(self, text).rows

    def execute(self, text: str):
        """Rows and store after a query or update."""
        from arcweave.languages.sparql import execute

        return execute(self, text)

    def graphql(self, text: str, vocabulary: str, **variables) -> DataFrame:
        """A GraphQL query whose types and fields are the vocabulary's."""
        from arcweave.languages.graphql import execute_rdf

        return execute_rdf(self, text, vocabulary, variables)

    def save(self, path: str, salts: int = 8) -> None:
        """A folder for each predicate: a pattern that names one reads that folder only. A frequent predicate's triples
        are written by up to ``salts`` tasks."""
        rows = self.triples.select("s", "o", "g", F.col("p.value").alias("predicate"))
        rows.repartition("predicate", F.pmod(F.xxhash64("s"), F.lit(salts))).write.partitionBy("predicate").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TripleStore:
        schema = T.StructType([SCHEMA["s"], SCHEMA["o"], SCHEMA["g"], T.StructField("predicate", T.StringType())])
        null = F.lit(None).cast("string")
        p = F.struct(F.lit("iri").alias("kind"), F.col("predicate").alias("value"), null.alias("datatype"), null.alias("lang"))
        return TripleStore(spark.read.schema(schema).parquet(path).select("s", p.alias("p"), "o", "g"))

    def find(self, s: tuple | None = None, p: tuple | None = None, o: tuple | None = None) -> DataFrame:
        df = self.triples
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:
                df = df.where(matches(F.col(name), term))
        return df

    def insert(self, rows: DataFrame) -> TripleStore:
        """The rows that aren't there yet are added; those that are stay where they are."""
        return replace(self, triples=self.triples.unionByName(_beyond(_quads(rows).distinct(), self.triples)))

    def delete(self, rows: DataFrame) -> TripleStore:
        return replace(self, triples=_beyond(self.triples, _quads(rows)))

    def clear(self, graph: str | None = None, everything: bool = False) -> TripleStore:
        keep = F.lit(False) if everything else F.col("g").isNotNull() if graph is None else (F.col("g") != graph) | F.col("g").isNull()
        return replace(self, triples=self.triples.where(keep))

    def copy_graph(self, source: str | None, target: str | None, clear: bool = True, drop: bool = False) -> TripleStore:
        """COPY (clear), ADD (not clear) and MOVE (drop the source)."""
        where = F.col("g").isNull() if source is None else F.col("g") == source
        rows = self.triples.where(where).withColumn("g", F.lit(target).cast("string"))
        store = self.clear(target) if clear else self
        store = store.insert(rows)
        return store.clear(source) if drop else store

    @staticmethod
    def read_ntriples(spark: SparkSession, path: str) -> TripleStore:
        """N-Triples files, a line a triple, parsed by expressions where they are read."""
        text = F.trim("value")
        subject = r"^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.*?)\s*\.\s*$"
        part = lambda i: F.regexp_extract(text, subject, i)
        lines = spark.read.text(path).where(text.rlike(subject))
        return TripleStore(lines.select(_parsed(part(1)).alias("s"), _parsed(part(2)).alias("p"), _parsed(part(3)).alias("o"), F.lit(None).cast("string").alias("g")).distinct())

    def write_ntriples(self, path: str) -> None:
        self.triples.select(F.concat_ws(" ", *[_written(F.col(c)) for c in "spo"], F.lit(".")).alias("value")).write.text(path)


def _parsed(c: Column) -> Column:
    body = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    for old, new in ((r"\\", "\0"), (r"\n", "\n"), (r"\"", '"'), ("\0", "\\")):
        body = F.replace(body, F.lit(old), F.lit(new))
    empty = lambda x: F.when(x != "", x)
    kind = F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "blank").otherwise("literal")
    value = F.when(c.startswith("<"), F.regexp_extract(c, "^<(.*)>$", 1)).when(c.startswith("_:"), F.substring(c, 3, 1 << 20)).otherwise(body)
    return F.struct(kind.alias("kind"), value.alias("value"), empty(F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)).alias("datatype"), empty(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1)).alias("lang"))


def _written(c: Column) -> Column:
    text = c["value"]
    for old, new in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    tail = F.when(c["lang"].isNotNull(), F.concat(F.lit("@"), c["lang"])).when(c["datatype"].isNotNull(), F.concat(F.lit("^^<"), c["datatype"], F.lit(">"))).otherwise("")
    return F.when(c["kind"] == "iri", F.concat(F.lit("<"), c["value"], F.lit(">"))).when(c["kind"] == "blank", F.concat(F.lit("_:"), c["value"])).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))


def _beyond(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows that others don't have, null graphs alike."""
    others = others.withColumnsRenamed({c: f"_{c}" for c in "spog"})
    on = F.lit(True)
    for c in "spog":
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(others, on, "left_anti")


def _quads(rows: DataFrame) -> DataFrame:
    if "g" not in rows.columns:
        rows = rows.withColumn("g", F.lit(None).cast("string"))
    return rows.select("s", "p", "o", "g")


def matches(column: Column, term: tuple) -> Column:
    """Equality with a constant term, as conditions on fields that a scan can take."""
    out = column["kind"] == term[0]
    for name, x in zip(("value", "datatype", "lang"), term[1:], strict=True):
        if x is not None:
            out = out & (column[name] == x)
        elif term[0] == "literal":
            out = out & column[name].isNull()
    return out


def local_name(value: str) -> str:
    return re.split(r"[#/:]", value)[-1]
