import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators.expressions import Expr, fold, relation_rows
from factloom.operators.pattern import Edge, Pattern, Var
from factloom.operators.rules import Contradiction, Rule, Template, delta
from factloom.operators.scopes import ScopeError, Scopes
from factloom.plans import sparql
from factloom.plans.model import kb_of
from factloom.sources import modules, ntriples, reports
from factloom.streaming.incremental import Incremental

FACTS = [("I1", "knows", "I2"), ("I2", "knows", "I3"), ("I1", "age", 30), ("I2", "age", 40), ("I1", "label", ("Ann \"A\"\n", "en")), ("I3", "flag", True)]


def run(kb, text):
    return sorted(tuple(r) for r in sparql.plain(sparql.query(kb, text)).collect())


def test_sparql_forms(spark):
    kb = kb_of(spark, FACTS)
    assert run(kb, "SELECT ?x WHERE { ?x :knows/:knows :I3 }") == [("I1",)]
    assert run(kb, "SELECT ?x WHERE { ?x :flag true }") == [("I3",)]
    assert run(kb, "SELECT ?x ?a WHERE { ?x :knows ?y OPTIONAL { ?y :age ?a } }") == [("I1", "40.0"), ("I2", None)]
    assert run(kb, "SELECT (SUM(?a) AS ?t) (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x :age ?a }") == [("70.0", "2.0")]
    assert run(kb, "SELECT ?y WHERE { :I1 :knows+ ?y }") == [("I2",), ("I3",)]
    assert run(kb, "SELECT ?x WHERE { ?x ^:knows :I1 }") == [("I2",)]
    assert sparql.query(kb, "ASK { ?x :age ?a FILTER (?a > 35) }").first()["answer"] is True
    assert sparql.query(kb, "ASK { ?x :age 99 }").first()["answer"] is False


def test_sparql_errors_and_labels(spark):
    with pytest.raises(sparql.SparqlError, match="line 2"):
        sparql.query(kb_of(spark, FACTS), "SELECT ?x WHERE {\n ?x ~ ?y }")
    assert sparql.checked("SELECT ?x { ?x :R16__has_property ?y }", {"R16": "has property"}).count(":R16 ") == 1
    with pytest.raises(sparql.SparqlError):
        sparql.checked(":R16__wrong", {"R16": "has property"})


def test_sparql_premise_equals_pattern(spark):
    kb = kb_of(spark, FACTS)
    x, y, z = Var("x"), Var("y"), Var("z")
    one = delta(kb, Rule("a", [Pattern([Edge(x, "knows", y), Edge(y, "knows", z)])], [Template(x, "far", z)]))
    two = delta(kb, Rule("a", [], [Template(x, "far", z)], sparql="SELECT ?x ?z WHERE { ?x :knows ?y . ?y :knows ?z }"))
    assert one.select("s", "o").collect() == two.select("s", "o").collect()


def test_ntriples_round_trip(spark, tmp_path):
    kb = kb_of(spark, FACTS)
    ntriples.export(kb, str(tmp_path / "x.nt"), base="a:/b#", statements=True)
    back = ntriples.read(spark, str(tmp_path / "x.nt"))
    assert back.count() == 3 * len(FACTS)
    label = back.where("o_lang = 'en'").first()
    assert label["o"] == 'Ann "A"\n'
    after = ntriples.import_facts(kb_of(spark, [("q", "r", "s")]), back, instance="a:/b#knows")
    assert after.statements.count() == 1 + len(FACTS) and after.entities.where("uri = 'a:/b#I1'").count() == 1
    with pytest.raises(Exception, match="not an N-Triples line"):
        ntriples.parse(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_modules_are_stored_whole(spark, tmp_path):
    store = modules.Store(spark, str(tmp_path / "kb"))
    kb = kb_of(spark, FACTS, mod="one")
    store.save("one", "p", "a:/b", kb)
    assert store.load("one").statements.count() == len(FACTS)
    with pytest.raises(modules.ModuleError):
        store.save("one", "p", "a:/b", kb)
    with pytest.raises(modules.ModuleError):
        store.save("two", "p", "c:/d", kb)
    broken = kb_of(spark, FACTS).but(statements=kb.statements.withColumn("s", F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(Exception, match="no"):
        store.save("three", "t", "e:/f", broken)
    assert sorted(store.modules()) == ["one"]
    assert store.load("one", into=store.load("one")).statements.count() == len(FACTS)


def test_reports(spark):
    kb = kb_of(spark, [*FACTS, ("I2", "label", ("Bo",))])
    x, y = Var("x"), Var("y")
    rows = delta(kb, Rule("r<1>", [Pattern([Edge(x, "knows", y)])], [Template(y, "known_by", x)]))
    page = "".join(reports.rule_report(rows))
    assert "r&lt;1&gt;" in page and page.count("<tr>") == 2
    assert reports.text_report(rows, limit=1).count() == 1
    assert reports.resolved({"a": [":I2"]}, kb) == {"a": [{"uri": "I2", "label": "Bo"}]}
    assert "\\section{T}" in reports.latex_report({"title": "R", "sections": [{"title": "T", "content": ":I2"}]}, kb)
    dots = list(reports.dot(kb.of("knows").selectExpr("s AS source", "p", "o AS target")))
    assert dots[0] == "digraph {" and len(dots) == 4


def test_scopes_and_expressions():
    s = Scopes("I1")
    with s.scope("premise", "PREMISE") as outer:
        s.new_var("x")
        with s.scope("all", "AND"):
            with pytest.raises(ScopeError):
                s.new_rel("a", "b", "c", scope=outer)
            with pytest.raises(ScopeError), s.scope("more", "AND"):
                pass
        s.new_rel("a", "b", "c")
        s.new_rel("a", "b", "d", overwrite=True)
    assert s.statements == [("a", "b", "d", outer)]
    with pytest.raises(ScopeError):
        s.new_var("y")
    a, b = Expr("a"), Expr("b")
    assert (a - b) == a + (-b) and (a / b).args[1].op == "pow" and fold("add", a, b, a).args[0] == a + b
    assert len((a + b * (a + b)).rows()) == 3
    assert relation_rows(a, "!=", b)[0][2] == "strict_inequality"


def test_scalars(spark):
    df = spark.createDataFrame([("pr__R16__has_property__de", "a long-label here", "a:/b#Ia12")], "k string, l string, u string")
    row = df.select(
        scalars.parse_key(F.col("k")).alias("k"), scalars.label_segments(F.col("l"), 7).alias("l"), scalars.key_number(scalars.uri_key(F.col("u"))).alias("n"), scalars.valid_uri(F.col("u")).alias("ok"),
        scalars.is_auto(scalars.uri_key(F.col("u"))).alias("auto"), scalars.inline_latex(F.lit("a $x$ b")).alias("tex"),
    ).first()
    assert tuple(row["k"]) == ("pr", "R16", "has_property", "de")
    assert all(len(x) <= 7 for x in row["l"]) and "".join(row["l"]).replace(" ", "") == "along-labelhere"
    assert (row["n"], row["ok"], row["auto"], row["tex"]) == (12, True, True, r"a \(x\) b")


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    x, y, z = Var("x"), Var("y"), Var("z")
    rule = Rule("t", [Pattern([Edge(x, "r", y), Edge(y, "r", z)])], [Template(x, "r", z)])
    kb = kb_of(spark, [("I1", "r", "I2")])
    more = kb_of(spark, [("I2", "r", "I3"), ("I3", "r", "I4")]).statements.withColumn("stm_id", F.concat(F.lit("n"), "stm_id"))
    more.coalesce(1).write.parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    live = Incremental(kb, [rule], path=state)
    q = spark.readStream.schema(more.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(live.foreach).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert live.kb.of("r").count() == 6
    live.foreach(more, 0)
    assert live.kb.of("r").count() == 6 and live.last == 0
    # another driver goes on where this one ended
    added = []
    again = Incremental(kb, [rule], lambda rows, epoch: added.append((rows.count(), epoch)), path=state)
    assert again.last == 0 and again.kb.of("r").count() == 6
    again.foreach(kb_of(spark, [("I0", "r", "I1"), ("I0", "r", "I1"), ("I1", "r", "I2")]).statements, 1)
    assert again.kb.of("r").count() == 10 and added == [(4, 1)]
    stop = Rule("stop", [Pattern([Edge(x, "r", x)], injective=False)], stop=Contradiction, message="{x}")
    strict = Incremental(kb, [rule, stop], path=str(tmp_path / "strict"))
    with pytest.raises(Contradiction):
        strict.foreach(kb_of(spark, [("I7", "r", "I7")]).statements, 0)
    assert strict.last == -1 and strict.kb.of("r").count() == 1


def test_exists_in_optional_sees_outer_variables(spark):
    kb = kb_of(spark, [("a", "p", "b"), ("a", "n", 1), ("c", "p", "d"), ("c", "n", 5), ("z", "n", 3), ("e", "n", 2)])
    text = "SELECT ?s ?o WHERE { ?s :n ?k OPTIONAL { ?s :p ?o FILTER %s { ?z :n ?j FILTER (?j > ?k) } } }"
    got = lambda word: {r["s"]: r["o"] for r in sparql.query(kb, text % word).collect()}
    assert got("EXISTS") == {"a": "b", "c": None, "z": None, "e": None}
    assert got("NOT EXISTS") == {"a": None, "c": "d", "z": None, "e": None}


def test_blank_nodes(spark):
    kb = kb_of(spark, [("a", "r", "x"), ("x", "q", "y"), ("x", "v", 1), ("b", "r", "w"), ("w", "q", "y")])
    assert [r["s"] for r in sparql.query(kb, "SELECT * WHERE { ?s :r [ :q :y ; :v 1 ] }").collect()] == ["a"]
    assert sorted(r["s"] for r in sparql.query(kb, "SELECT ?s WHERE { ?s :r _:m . _:m :q [] }").collect()) == ["a", "b"]
    assert sparql.query(kb, "SELECT ?s WHERE { [ :v ?k ] . ?s :r [ :v ?k ] }").count() == 1
