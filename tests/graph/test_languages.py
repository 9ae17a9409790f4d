"""Mills along a river and the valleys they stand in, in every language; the answers are worked out by hand."""

import pytest

from arcweave.graph import PropertyGraph
from arcweave.languages import graphql, gremlin
from arcweave.languages.lexer import ParseError
from arcweave.plans.compiler import QueryError
from arcweave.rdf import TripleStore, iri, literal
from arcweave.sources import snapshots


@pytest.fixture(scope="module")
def rivers(spark):
    """Oak feeds Elm and Yew, Elm feeds Fir and Yew, Fir feeds Oak; Oak and Elm stand in Long, Fir and Yew in Deep, none in Bare."""
    mills = spark.createDataFrame([(10, "Oak", 120), (11, "Elm", 45), (12, "Fir", 80), (13, "Yew", 45)], "id long, name string, power long")
    valleys = spark.createDataFrame([(20, "Long", 300), (21, "Deep", 640), (22, "Bare", 150)], "id long, name string, depth long")
    feeds = spark.createDataFrame([(100, 10, 11, 7), (101, 11, 12, 3), (102, 12, 10, 2), (103, 10, 13, 5), (104, 11, 13, 1)], "eid long, src long, dst long, flow long")
    stands = spark.createDataFrame([(110, 10, 20), (111, 11, 20), (112, 12, 21), (113, 13, 21)], "eid long, src long, dst long")
    g = PropertyGraph(spark).with_vertices(mills, "Mill").with_vertices(valleys, "Valley")
    return g.with_edges(feeds, "FEEDS", "Mill", "Mill").with_edges(stands, "STANDS_IN", "Mill", "Valley")


CYPHER = [
    ("MATCH (m:Mill) RETURN m.name ORDER BY m.name", [("Elm",), ("Fir",), ("Oak",), ("Yew",)]),
    ("MATCH (a:Mill)-[:FEEDS]->(b) WHERE a.power > 50 RETURN a.name, b.name", [("Oak", "Elm"), ("Oak", "Yew"), ("Fir", "Oak")]),
    ("MATCH (a:Mill)-[r:FEEDS]->(b) WHERE r.flow >= 2 AND r.flow <= 3 RETURN a.name", [("Elm",), ("Fir",)]),
    ("MATCH (a:Mill {name: 'Oak'})-[:FEEDS*1..2]->(b) RETURN b.name AS n, count(*) AS c ORDER BY n", [("Elm", 1), ("Fir", 1), ("Yew", 2)]),
    ("MATCH (a:Mill {name: 'Oak'})-[:feeds]->{1,2}(b) RETURN count(*) AS c", [(4,)]),
    ("MATCH (m:Mill)-[:STANDS_IN]->(v:Valley) RETURN v.name AS v, count(*) AS n, collect(m.name) AS l ORDER BY v", [("Deep", 2, ["Fir", "Yew"]), ("Long", 2, ["Elm", "Oak"])]),
    ("MATCH q = shortestPath((a:Mill {name: 'Oak'})-[:FEEDS*]->(b:Mill {name: 'Fir'})) RETURN length(q) AS l", [(2,)]),
    ("MATCH q = allShortestPaths((a:Mill {name: 'Fir'})-[*]-(b:Valley {name: 'Long'})) RETURN length(q) AS l", [(2,), (2,)]),
    ("MATCH (m:Mill) OPTIONAL MATCH (m)-[:FEEDS]->(f) RETURN m.name AS n, count(f) AS c ORDER BY n", [("Elm", 2), ("Fir", 1), ("Oak", 2), ("Yew", 0)]),
    ("MATCH (m:Mill) WHERE NOT EXISTS { (m)-[:FEEDS]->() } RETURN m.name", [("Yew",)]),
    ("MATCH (m:Mill) WHERE EXISTS { (m)-[:FEEDS]->() } OR m.power = 45 RETURN count(*) AS c", [(4,)]),
    ("MATCH (m:Mill) WITH m, COUNT { (m)-[:FEEDS]->() } AS c WHERE c > 1 RETURN m.name AS n, c + 1 AS d ORDER BY n", [("Elm", 3), ("Oak", 3)]),
    ("MATCH (a)-[:FEEDS]->(b)-[:FEEDS]->(c), (a)-[:FEEDS]->(c) RETURN a.name, b.name, c.name", [("Oak", "Elm", "Yew")]),
    ("MATCH (n) RETURN labels(n) AS l, count(*) AS c ORDER BY c", [(["Valley"], 3), (["Mill"], 4)]),
    ("MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS c ORDER BY t", [("FEEDS", 5), ("STANDS_IN", 4)]),
    ("MATCH (a:Mill {name: 'Fir'})-[:FEEDS*]->(b) RETURN b.name AS n, count(*) AS c ORDER BY n", [("Elm", 1), ("Fir", 1), ("Oak", 1), ("Yew", 2)]),
    ("MATCH (a:Mill)-[:FEEDS*0..1]->(b) RETURN count(*) AS n", [(9,)]),
    ("MATCH (m:Mill) RETURN m.power > 50 AS x, toString(m.power) AS t ORDER BY t LIMIT 2", [(True, "120"), (False, "45")]),
    ("MATCH (a:Mill)-[:FEEDS]-(b:Mill) RETURN a.name AS n, count(*) AS c ORDER BY c DESC, n SKIP 1", [("Oak", 3), ("Fir", 2), ("Yew", 2)]),
    ("UNWIND [2, 5] AS x RETURN [y IN [1, 4, 6] WHERE y > x | y * 3] AS l, x / 2 AS h, x % 3 AS m", [([12, 18], 1, 2), ([18], 2, 2)]),
    ("MATCH (m:Mill) RETURN m.name AS n UNION ALL MATCH (v:Valley) RETURN v.name AS n", [("Oak",), ("Elm",), ("Fir",), ("Yew",), ("Long",), ("Deep",), ("Bare",)]),
    ("MATCH (m:Mill) WHERE m.power IN $powers AND m.name <> $no RETURN m.name", [("Fir",), ("Yew",)]),
    ("MATCH (m:Mill)-[:FEEDS]->(f) RETURN m.name AS n, count(f) AS c HAVING c > 1", [("Elm", 2), ("Oak", 2)]),
    ("MATCH (m:Mill) RETURN max(m.power) - min(m.power) AS d, 1 / 0 AS z", [(75, None)]),
    ("RETURN 'wind'[1] AS a, 'stream'[1..3] AS b, {k: 8}['k'] AS c, reverse('ab') AS d", [("i", "tr", 8, "ba")]),
    ("MATCH (m:Mill) WHERE m.power > 999 RETURN sum(m.power) AS s, count(*) AS n", [(0, 0)]),
    ("MATCH (m:Mill) WHERE m.name =~ '^[EF]' RETURN m.name", [("Elm",), ("Fir",)]),
    ("MATCH (m:Mill) WHERE m.name =~ '(' RETURN m.name", []),
]


@pytest.mark.parametrize(("text", "want"), CYPHER)
def test_cypher(rivers, text, want):
    got = [tuple(r) for r in rivers.cypher(text, powers=[45, 80], no="Elm").collect()]
    assert got == want if "ORDER BY" in text else sorted(map(str, got)) == sorted(map(str, want))


def test_errors(rivers):
    with pytest.raises(QueryError, match="did you mean valley"):
        rivers.cypher("MATCH (valley:Valley) RETURN valey.name")
    with pytest.raises(ParseError):
        rivers.cypher("MATCH (m RETURN m")
    with pytest.raises(QueryError, match="unknown function"):
        rivers.cypher("MATCH (m:Mill) RETURN nothing_such(m.power)")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_declared_ends_save_the_vertex_join(rivers):
    assert "Join" not in physical(rivers.cypher("MATCH (a:Mill)-[:FEEDS]->(b:Mill) RETURN count(*) AS n"))


def test_gremlin_reads_each_element_once(rivers):
    plan = physical(rivers.gremlin("g.V().hasLabel('Mill').has('power', gt(50)).values('name')"))
    assert "Join" not in plan and plan.count("Scan") <= 2  # the final plan may be shown beside the initial one
    assert physical(rivers.gremlin("g.V().hasLabel('Mill').out('STANDS_IN').hasLabel('Valley').count()")).count("Join") == physical(rivers.gremlin("g.V().hasLabel('Mill').out('STANDS_IN').count()")).count("Join")


WRITES = [
    ("CREATE (x:Mill {name: 'Ash', power: 9})-[:FEEDS {flow: 4}]->(y:Lake {name: 'Blue'})", "MATCH (a:Mill)-[r:FEEDS]->(b:Lake) RETURN a.name, r.flow, b.name", [("Ash", 4, "Blue")]),
    ("MATCH (m:Mill {name: 'Elm'}) DETACH DELETE m", "MATCH (a)-[r]->(b) RETURN count(*) AS n", [(5,)]),
    ("MATCH (:Mill)-[r:FEEDS]->() DELETE r", "MATCH (a)-[r]->(b) RETURN count(*) AS n", [(4,)]),
    ("MATCH (m:Mill) SET m.power = m.power + 1, m:Old", "MATCH (m:Old) RETURN sum(m.power) AS s", [(294,)]),
    ("MATCH (m:Mill {name: 'Elm'}) SET m += {power: 1, river: 'Inn'}", "MATCH (m:Mill) WHERE m.river = 'Inn' RETURN m.name, m.power", [("Elm", 1)]),
    ("MATCH (m:Mill {name: 'Elm'}) SET m = {name: 'Helm'}", "MATCH (m:Mill) WHERE m.power IS NULL RETURN m.name", [("Helm",)]),
    ("MATCH (m:Mill) REMOVE m.power", "MATCH (m:Mill) RETURN count(m.power) AS n", [(0,)]),
    ("MATCH (m:Mill {name: 'Elm'}) REMOVE m:Mill", "MATCH (m:Mill) RETURN count(*) AS n", [(3,)]),
    ("MERGE (m:Mill {name: 'Sal'}) ON CREATE SET m.power = 1 ON MATCH SET m.power = 2", "MATCH (m:Mill {name: 'Sal'}) RETURN m.power", [(1,)]),
    ("MERGE (m:Mill {name: 'Elm'}) ON CREATE SET m.power = 1 ON MATCH SET m.power = 2", "MATCH (m:Mill {name: 'Elm'}) RETURN m.power", [(2,)]),
    ("MATCH (a:Mill), (b:Valley {name: 'Deep'}) MERGE (a)-[:STANDS_IN]->(b)", "MATCH (a)-[:STANDS_IN]->(b) RETURN count(*) AS n", [(6,)]),
]


@pytest.mark.parametrize(("write", "read", "want"), WRITES)
def test_writes_give_a_new_graph(rivers, write, read, want):
    before = rivers.cypher("MATCH (n) RETURN count(*) AS n").first()[0]
    assert [tuple(r) for r in rivers.execute(write).graph.cypher(read).collect()] == want
    assert rivers.cypher("MATCH (n) RETURN count(*) AS n").first()[0] == before


GREMLIN = [
    ("g.V().hasLabel('Mill').has('power', gt(50)).out('FEEDS').values('name').dedup()", ["Elm", "Oak", "Yew"]),
    ("g.V().has('name', 'Elm').outE('FEEDS').inV().count()", [2]),
    ("g.V().hasLabel('Mill').outE('FEEDS').has('flow', gte(5)).inV().values('name')", ["Elm", "Yew"]),
    ("g.V().hasLabel('Mill').order().by('power', desc).limit(2).values('name')", ["Oak", "Fir"]),
    ("g.V().hasLabel('Mill').not(__.out('FEEDS')).values('name')", ["Yew"]),
    ("g.V().hasLabel('Mill').where(__.out('STANDS_IN').has('depth', gt(500))).values('name')", ["Fir", "Yew"]),
    ("g.V().hasLabel('Mill').values('power').mean()", [72.5]),
    ("g.V().hasLabel('Valley').in('STANDS_IN').values('name').fold()", [["Elm", "Fir", "Oak", "Yew"]]),
    ("g.V().hasLabel('Valley').in('STANDS_IN').hasLabel('Mill').count()", [4]),
    ("g.V().hasLabel('Valley').in('STANDS_IN').hasLabel('Valley').count()", [0]),
    ("g.V().limit(7).hasLabel('Mill').count()", [4]),
    ("g.V().hasLabel('Mill', 'Valley').count()", [7]),
    ("g.V().hasNot('depth').count()", [4]),
    ("g.E().hasLabel('STANDS_IN').count()", [4]),
    ("g.V(11).both('FEEDS').id()", [10, 12, 13]),
    ("g.V().as('a').out('STANDS_IN').has('depth', lt(500)).select('a').values('name')", ["Elm", "Oak"]),
    ("g.V().hasLabel('Mill').has('name', within('Fir', 'Yew')).values('power').sum()", [125]),
    ("g.V().hasLabel('Mill').has('power', gt(40).and(lt(90))).count()", [3]),
    ("g.V().hasLabel('Mill').has('name', regex('[')).count()", [0]),
]


@pytest.mark.parametrize(("text", "want"), GREMLIN)
def test_gremlin(rivers, text, want):
    assert sorted([r[0] for r in rivers.gremlin(text).collect()], key=str) == sorted(want, key=str)


def test_gremlin_order_and_writes(rivers):
    assert [r[0] for r in rivers.gremlin("g.V().hasLabel('Valley').order().by('depth').values('name')").collect()] == ["Bare", "Long", "Deep"]
    g = gremlin.execute(rivers, "g.addV('Mill').property('name', 'Ash').property('power', 3)").graph
    assert g.gremlin("g.V().hasLabel('Mill').count()").first()[0] == 5
    assert gremlin.execute(g, "g.V().has('name', 'Ash').drop()").graph.gremlin("g.V().count()").first()[0] == 7
    assert gremlin.execute(rivers, "g.V().has('name', 'Fir').property('power', 7)").graph.gremlin("g.V().has('power', 7).values('name')").first()[0] == "Fir"


def test_graphql(rivers):
    q = "query Q($n: String) { mills: mill(name: $n) { name FEEDS { ...what } STANDS_IN { depth } } } fragment what on Mill { name power }"
    assert [r.asDict() for r in rivers.graphql(q, n="Elm").orderBy("FEEDS_name").collect()] == [
        {"name": "Elm", "FEEDS_name": "Fir", "FEEDS_power": 80, "STANDS_IN_depth": 300},
        {"name": "Elm", "FEEDS_name": "Yew", "FEEDS_power": 45, "STANDS_IN_depth": 300},
    ]
    assert [tuple(r) for r in rivers.graphql("{ mill(power_gte: 60, orderBy: {power: DESC}, first: 1) { name } }").collect()] == [("Oak",)]
    made = graphql.execute(rivers, 'mutation { createMill(name: "Lin", power: 5) { name } }').graph
    assert made.cypher("MATCH (m:Mill {name: 'Lin'}) RETURN m.power AS p").first()[0] == 5
    gone = graphql.execute(rivers, "mutation { deleteMill(id: 11) { id } }").graph
    assert gone.cypher("MATCH (m:Mill) RETURN count(*) AS n").first()[0] == 3


def test_snapshots_lookups_and_checks(spark, rivers, tmp_path):
    snapshots.save(rivers, str(tmp_path / "g"))
    back = snapshots.load(spark, str(tmp_path / "g"))
    text = "MATCH (m:Mill)-[:STANDS_IN]->(v) RETURN m.name AS m, v.name AS v ORDER BY m"
    assert back.cypher(text).collect() == rivers.cypher(text).collect() and back.schema() == rivers.schema()
    assert rivers.dangling_edges().count() == 0 and rivers.duplicate_ids().count() == 0
    assert rivers.info() == {"nodes": 7, "edges": 9, "vertex_tables": 2, "edge_tables": 2}
    assert {r.neighbor for r in rivers.neighbors([10], "out", ("FEEDS",)).collect()} == {11, 13}
    assert rivers.nodes_by_property("name", "Fir").first()["id"] == 12
    assert {r["id"] for r in rivers.nodes_in_range("power", 45, 120, include_low=False, include_high=False).collect()} == {12}
    assert {(r.label, r["count"]) for r in rivers.label_counts().collect()} == {("Mill", 4), ("Valley", 3)}


EX = "http://ex/"
PREFIX = "PREFIX ex: <http://ex/> "


@pytest.fixture(scope="module")
def store(spark):
    """oak (named Oak, power 120) feeds elm (Elm, 45), which feeds yew (named Eibe in German); in graph g1 oak is in Long, in g2 elm is in Deep."""
    t = lambda a, p, o, *g: (iri(EX + a), iri(EX + p), o, *g)
    rows = [t("oak", "name", literal("Oak")), t("oak", "power", literal(120)), t("elm", "name", literal("Elm")), t("elm", "power", literal(45))]
    rows += [t("oak", "feeds", iri(EX + "elm")), t("elm", "feeds", iri(EX + "yew")), t("yew", "name", literal("Eibe", "de"))]
    return TripleStore.of(spark, rows)


@pytest.fixture(scope="module")
def graphs(store):
    return store.execute(PREFIX + "INSERT DATA { GRAPH ex:g1 { ex:oak ex:in ex:long . ex:long ex:name 'Long' } GRAPH ex:g2 { ex:elm ex:in ex:deep . ex:elm ex:name 'Elm' } }").store


SPARQL = [
    ("SELECT ?n WHERE { ?p ex:name ?n ; ex:power ?a . FILTER(?a > 60) }", [("Oak",)]),
    ("SELECT ?n ?m WHERE { ?p ex:name ?n OPTIONAL { ?p ex:feeds ?q . ?q ex:name ?m } } ORDER BY ?n", [("Eibe", None), ("Elm", "Eibe"), ("Oak", "Elm")]),
    ("SELECT (COUNT(*) AS ?c) (AVG(?a) AS ?av) (SUM(?a) AS ?s) WHERE { ?p ex:power ?a }", [("2", "82.5", "165")]),
    ("SELECT ?p (COUNT(?o) AS ?c) WHERE { ?p ?x ?o } GROUP BY ?p HAVING (COUNT(?o) > 1) ORDER BY DESC(?c) ?p LIMIT 1", [(EX + "elm", "3")]),
    ("SELECT ?n WHERE { ?p ex:name ?n MINUS { ?p ex:power ?a } }", [("Eibe",)]),
    ("SELECT ?n WHERE { ?p ex:name ?n FILTER NOT EXISTS { ?p ex:feeds ?z } }", [("Eibe",)]),
    ("SELECT ?n WHERE { ?p ex:name ?n FILTER EXISTS { ?q ex:power 45 } } ORDER BY ?n", [("Eibe",), ("Elm",), ("Oak",)]),
    ("SELECT ?n WHERE { ?p ex:name ?n FILTER NOT EXISTS { ?q ex:power 45 } }", []),
    ("SELECT ?x WHERE { ex:oak ex:feeds+ ?x } ORDER BY ?x", [(EX + "elm",), (EX + "yew",)]),
    ("SELECT ?n WHERE { ex:oak ex:feeds/ex:feeds/ex:name ?n }", [("Eibe",)]),
    ("SELECT ?x WHERE { ex:elm ^ex:feeds ?x }", [(EX + "oak",)]),
    ("SELECT ?v WHERE { { ?v ex:power 120 } UNION { ?v ex:power 45 } } ORDER BY ?v", [(EX + "elm",), (EX + "oak",)]),
    ("SELECT ?u WHERE { ?p ex:name ?n BIND(CONCAT(UCASE(?n), '!') AS ?u) VALUES ?n { 'Elm' } }", [("ELM!",)]),
    ("SELECT ?n WHERE { ?p ex:name ?n FILTER(LANG(?n) = 'de' || REGEX(?n, '^o', 'i')) } ORDER BY ?n", [("Eibe",), ("Oak",)]),
    ("SELECT ?n WHERE { ?p ex:name ?n FILTER REGEX(?n, '(') }", []),
    ("SELECT (IF(?a > 60, 'strong', 'weak') AS ?k) WHERE { ?p ex:power ?a } ORDER BY ?k", [("strong",), ("weak",)]),
    ("SELECT (GROUP_CONCAT(?n ; SEPARATOR = '|') AS ?l) (MAX(?a) AS ?m) WHERE { ?p ex:name ?n ; ex:power ?a }", [("Elm|Oak", "120")]),
    ("SELECT ?n WHERE { { SELECT ?p WHERE { ?p ex:power ?a } ORDER BY ?a LIMIT 1 } ?p ex:name ?n }", [("Elm",)]),
    ("SELECT DISTINCT (STRLEN(?n) AS ?k) WHERE { ?p ex:name ?n FILTER(?n IN ('Oak', 'Elm')) } ORDER BY ?k", [("3",)]),
    # Unbound variables go with anything.
    ("SELECT ?x ?n WHERE { ?x ex:name ?n VALUES (?x ?n) { (ex:oak UNDEF) (UNDEF 'Elm') } } ORDER BY ?n", [(EX + "elm", "Elm"), (EX + "oak", "Oak")]),
    ("SELECT ?p ?m WHERE { ?p ex:power ?a OPTIONAL { ?p ex:feeds ?q . ?q ex:power ?b . BIND(ex:elm AS ?m) } ?m ex:power 45 } ORDER BY ?p", [(EX + "elm", EX + "elm"), (EX + "oak", EX + "elm")]),
    ("SELECT ?x ?y WHERE { { ?x ex:power 120 } UNION { ?y ex:power 45 } ?x ex:feeds ?y } ORDER BY ?x ?y", [(EX + "oak", EX + "elm"), (EX + "oak", EX + "elm")]),
    # The order of the text counts.
    ("SELECT ?n ?q WHERE { ?p ex:name ?n OPTIONAL { ?p ex:feeds ?q } ?q ex:power 45 } ORDER BY ?n", [("Eibe", EX + "elm"), ("Oak", EX + "elm")]),
    ("SELECT ?n WHERE { ?p ex:power ?a MINUS { ?p ex:name 'Oak' } ?q ex:feeds ?p . ?q ex:name ?n }", [("Oak",)]),
    ("SELECT ?p WHERE { ?p ex:name ?n MINUS { ?z ex:power 45 } } ORDER BY ?p", [(EX + "elm",), (EX + "oak",), (EX + "yew",)]),
    # Functions.
    ("SELECT (TZ('2020-01-02T03:04:05+02:30') AS ?a) (TIMEZONE('2020-01-02T03:04:05-03:00') AS ?b) (TIMEZONE('2020-01-02T03:04:05Z') AS ?c) (TZ('2020-01-02T03:04:05') AS ?d) WHERE { }", [("+02:30", "-PT3H", "PT0S", "")]),
    ("SELECT (isBLANK(BNODE()) AS ?a) (isBLANK(BNODE('x')) AS ?b) (isIRI(UUID()) AS ?c) (STRLEN(SHA512('a')) AS ?d) WHERE { }", [("true", "true", "true", "128")]),
    ("SELECT (EUCLIDEAN_DISTANCE(VECTOR(1, 2), '[4, 6]') AS ?a) (DOT_PRODUCT(VECTOR(1, 2), VECTOR(3, 4)) AS ?b) (MANHATTAN_DISTANCE('[1, 1]', '[0, 3]') AS ?c) WHERE { }", [("5", "11", "3")]),
    ("SELECT (STRBEFORE('a-b-c', '-') AS ?a) (STRAFTER('a-b-c', '-') AS ?b) (STRBEFORE('a', 'x') AS ?c) (REPLACE('aXbx', 'x', '_', 'i') AS ?d) (ABS(-2) AS ?e) (CEIL(1.2) AS ?f) (ROUND(2.5) AS ?g) WHERE { }", [("a", "b-c", "", "a_b_", "2", "2", "3")]),
]


def values(rows):
    return [tuple(x.value if x is not None else None for x in r) for r in rows.collect()]


@pytest.mark.parametrize(("text", "want"), SPARQL)
def test_sparql(store, text, want):
    assert values(store.sparql(PREFIX + text)) == want


GRAPHS = [
    ("SELECT ?g ?p WHERE { GRAPH ?g { ?p ex:in ?v } } ORDER BY ?g", [(EX + "g1", EX + "oak"), (EX + "g2", EX + "elm")]),
    ("SELECT ?p ?n WHERE { GRAPH ?g { ?p ex:in ?v . ?v ex:name ?n } }", [(EX + "oak", "Long")]),  # both in one graph
    ("SELECT ?p ?n WHERE { GRAPH ?g { ?p ex:in/ex:name ?n } }", [(EX + "oak", "Long")]),
    ("SELECT ?p WHERE { ?p ex:in ?v }", []),  # the default graph only
    ("SELECT ?n WHERE { GRAPH ex:g2 { ?p ex:in ?v } ?p ex:name ?n }", [("Elm",)]),
    ("SELECT ?n WHERE { GRAPH ?g { ?p ex:name ?n } FILTER(?g = ex:g1) }", [("Long",)]),
    ("SELECT ?g ?n WHERE { ?p ex:name ?n GRAPH ?g { ?p ex:in ?v } } ORDER BY ?n", [(EX + "g2", "Elm"), (EX + "g1", "Oak")]),
]


@pytest.mark.parametrize(("text", "want"), GRAPHS)
def test_named_graphs(graphs, text, want):
    assert values(graphs.sparql(PREFIX + text)) == want


def test_sparql_forms_and_updates(spark, store, graphs, tmp_path):
    assert store.sparql(PREFIX + "ASK { ex:oak ex:feeds ex:elm }").first()[0] is True
    assert store.sparql(PREFIX + "CONSTRUCT { ?b ex:fedBy ?a } WHERE { ?a ex:feeds ?b }").count() == 2
    assert store.sparql(PREFIX + "DESCRIBE ex:elm").count() == 3
    new = store.execute(PREFIX + "DELETE { ?p ex:power ?a } INSERT { ?p ex:watts ?a } WHERE { ?p ex:power ?a }; INSERT DATA { ex:ash ex:name 'Esche'@de }").store
    assert new.triples.count() == 8 and new.sparql(PREFIX + "SELECT ?a WHERE { ?p ex:watts ?a }").count() == 2
    assert new.execute(PREFIX + "DELETE WHERE { ?p ex:watts ?a }").store.triples.count() == 6
    assert new.execute(PREFIX + "DELETE DATA { ex:ash ex:name 'Esche'@de }").store.triples.count() == 7
    assert new.execute(PREFIX + "INSERT DATA { ex:ash ex:name 'Esche'@de }").store.triples.count() == 8
    copied = graphs.execute(PREFIX + "COPY ex:g1 TO ex:h").store
    assert copied.sparql(PREFIX + "SELECT ?n WHERE { GRAPH ex:h { ?s ex:name ?n } }").count() == 1
    assert copied.execute(PREFIX + "CLEAR GRAPH ex:g1").store.triples.count() == 11 and copied.execute("CLEAR ALL").store.triples.count() == 0
    moved = graphs.execute(PREFIX + "DELETE { GRAPH ex:g2 { ?p ex:in ?v } } INSERT { GRAPH ex:g1 { ?p ex:in ?v } } WHERE { GRAPH ex:g2 { ?p ex:in ?v } }").store
    assert values(moved.sparql(PREFIX + "SELECT ?p WHERE { GRAPH ex:g1 { ?p ex:in ?v } } ORDER BY ?p")) == [(EX + "elm",), (EX + "oak",)]
    assert moved.sparql(PREFIX + "SELECT ?p WHERE { GRAPH ex:g2 { ?p ex:in ?v } }").count() == 0
    odd = store.insert(TripleStore.of(spark, [(iri(EX + "q"), iri(EX + "says"), literal('a "quoted"\\ line\nend'))]).triples)
    odd.write_ntriples(str(tmp_path / "nt"))
    back = TripleStore.read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted(map(str, back.triples.collect())) == sorted(map(str, odd.triples.collect()))


def test_a_saved_store_reads_one_folder_a_predicate(spark, graphs, tmp_path):
    graphs.save(str(tmp_path / "t"))
    back = TripleStore.load(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.triples.collect())) == sorted(map(str, graphs.triples.collect()))
    rows = back.sparql(PREFIX + "SELECT ?n WHERE { ex:oak ex:name ?n }")
    assert values(rows) == [("Oak",)] and "PartitionFilters: [isnotnull(predicate" in physical(rows)


def test_graphql_over_triples(spark, store):
    typed = store.execute(PREFIX + "INSERT DATA { ex:oak a ex:Mill . ex:elm a ex:Mill . ex:yew a ex:Mill }").store
    ask = lambda text, **v: sorted(map(tuple, typed.graphql(text, EX, **v).collect()), key=str)
    assert ask("{ mill { name power } }") == [("Eibe", None), ("Elm", "45"), ("Oak", "120")]
    assert ask("query Q($n: String) { mills(name: $n) { id feeds { name } } }", n="Oak") == [(EX + "oak", "Elm")]
    assert ask("{ mill(power_gt: 40, orderBy: {power: DESC}, first: 1) { title: name } }") == [("Oak",)]
    assert ask('{ mill(name_starts_with: "E", power_in: [45, 46]) { name } }') == [("Elm",)]
    with pytest.raises(ParseError):
        typed.graphql("mutation { createMill(name: 3) { name } }", EX)
