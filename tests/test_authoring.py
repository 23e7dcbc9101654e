"""Bulk authoring, module contexts and operator calls on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import authoring, calls, modules, rules
from factloom.operators.pattern import Edge, Pattern, Var
from factloom.operators.rules import Rule, Template
from factloom.plans.model import ENTITY, QUALIFIER, KB, kb_of, statement
from factloom.plans.tables import local

X, Y = Var("x"), Var("y")
ROWS = "subject string, seq long, key string, values array<struct<lex: string, kind: string, lang: string>>, listed boolean"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def base(spark):
    marks = [("x:/b#R1", authoring.PER_LANGUAGE), ("x:/b#R1", authoring.LITERAL_RANGE), ("x:/b#R3", authoring.LITERAL_RANGE), ("x:/b#R4", authoring.FUNCTIONAL)]
    names = {"x:/b#R1": "has label", "x:/b#R3": "has alias", "x:/b#R4": "has size", "x:/c#R4": "has colour", "x:/b#I1": "thing"}
    facts = kb_of(spark, [(s, p, True) for s, p in marks] + [(s, "label", (t,)) for s, t in names.items()] + [("x:/b#I1", "x:/b#R4", 3)])
    entities = local(spark, [(u, u.split("#")[1][0], False, None, u.split("#")[0], False) for u in names], ENTITY)
    return KB(facts.statements, entities, local(spark, [], QUALIFIER))


def written_by(spark, *given):
    return local(spark, [(s, n, k, [{"lex": a, "kind": b, "lang": c} for a, b, c in v], len(v) != 1) for n, (s, k, *v) in enumerate(given)], ROWS)


def prefixes(spark):
    return local(spark, [("b", "x:/b"), ("c", "x:/c")], "prefix string, base string")


def test_keys_of_every_spelling(spark, base):
    keys = local(spark, [(k,) for k in ("R1", "R1__has_label", "b__R1__has_label__de", 'R1["has label"]', "R1__de", "R4", "c__R4", "b__R4__has_size", "zz__R1", "R1__wrong", "R99", "no key", None)], "key string")
    got = {r["key"]: (r["uri"], r["lang"], r["error"]) for r in authoring.resolve_keys(base, keys, prefixes(spark), search=["x:/c", "x:/b"]).collect()}
    one = "x:/b#R1"
    assert got["R1"] == got["R1__has_label"] == got['R1["has label"]'] == (one, None, None)
    assert got["b__R1__has_label__de"] == (one, "de", None) and got["R1__de"][:2] == (one, "de")
    assert got["R4"][0] == "x:/c#R4" and got["c__R4"][0] == "x:/c#R4" and got["b__R4__has_size"] == ("x:/b#R4", None, None)
    assert [got[k][2] for k in ("zz__R1", "R1__wrong", "R99", "no key", None)] == ["unknown prefix", "another label", "unknown key", "not a key", "not a key"]


def test_authored_entities_and_errors(spark, base):
    text = lambda t, lang=None: (t, "str", lang)
    given = written_by(
        spark,
        ("x:/c#I1", "R1", text("one")), ("x:/c#I1", "R1__de", text("eins")), ("x:/c#I1", "R3", text("a"), text("b")), ("x:/c#I1", "b__R4", ("7", "int", None)), ("x:/c#I1", "c__R4", ("x:/b#I1", "E", None)),
        ("x:/c#I2", "R1__de", text("zwei")), ("x:/c#I3", "R1", text("a"), text("b")), ("x:/c#I4", "R1", ("5", "int", None)), ("x:/c#I5", "R1", text("a")), ("x:/c#I5", "R1", text("b")),
        ("x:/c#I6", "R1", text("a")), ("x:/c#I6", "R1__de", text("b", "fr")), ("x:/c#I7", "I1", text("a")), ("x:/b#I1", "R1", text("a")), ("x:/c#I8", "b__R4", ("1", "int", None), ("2", "int", None)),
    )
    done = authoring.author(base, given, prefixes(spark), mod="x:/c", search=["x:/c", "x:/b"])
    assert rows(done.kb.statements.where("s = 'x:/c#I1'"), "p", "o") == [("x:/b#R1", "s:eins@de"), ("x:/b#R1", "s:one@en"), ("x:/b#R3", "s:a@en"), ("x:/b#R3", "s:b@en"), ("x:/b#R4", "n:7.0"), ("x:/c#R4", "x:/b#I1")]
    errors = {r["subject"][-2:]: r["error"] for r in done.errors.where("subject <> 'x:/b#I1'").collect()}
    assert errors == {
        "I2": "the first text is not in the default language", "I3": "a list for a relation with one object for each language", "I4": "not a text", "I5": "several objects",
        "I6": "two languages", "I7": "not a relation", "I8": "a list for a functional relation",
    }
    assert rows(done.errors.where("subject = 'x:/b#I1'"), "error") == [("the URI is used",)]
    assert {r["uri"] for r in done.kb.entities.collect()} - {r["uri"] for r in base.entities.collect()} == {"x:/c#I1"}
    assert done.kb.statements.where("s IN ('x:/c#I5', 'x:/c#I6')").isEmpty()


def test_adding_to_entities(spark, base):
    given = written_by(spark, ("x:/b#I1", "b__R4", ("4", "int", None)), ("x:/b#R3", "R3", ("alias", "str", None)), ("x:/b#I77", "R3", ("x", "str", None)))
    done = authoring.author(base, given, prefixes(spark), mod="x:/b", search=["x:/b"], create=None)
    assert rows(done.errors, "subject", "error") == [("x:/b#I1", "another object is stored"), ("x:/b#I77", "no such entity")]
    assert rows(done.kb.of("x:/b#R3"), "s", "o") == [("x:/b#R3", "s:alias@en")]
    again = authoring.author(done.kb, given.where("subject = 'x:/b#R3'"), prefixes(spark), mod="x:/b", search=["x:/b"], create=None)
    assert again.errors.isEmpty() and again.kb.statements.count() == done.kb.statements.count()


def test_quantified_instances(spark, base):
    kb, made = authoring.quantified_instances(base, local(spark, [("x:/b#I1", "n"), ("x:/b#I1", "n"), ("x:/b#I1", "m")], "cls string, name string"))
    assert made.count() == 2 and rows(kb.of(authoring.UNIVERSAL), "o") == [("n:1.0",)] * 2
    assert authoring.quantified_instances(kb, made.select("cls", "name"))[0].statements.count() == kb.statements.count()


def test_module_contexts(spark):
    work = modules.Workspace(kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I3")]), builtin="x:/b")
    rule = Rule("back", [Pattern([Edge(X, "r", Y)])], [Template(Y, "back", X)])
    with pytest.raises(modules.ModuleError, match="no module"):
        work.apply(rule)
    with work.start("x:/one", "one"):
        work.apply(rule)
        with pytest.raises(modules.ModuleError, match="x:/one is active"), work.start("x:/two"):
            pass
        with work.module("x:/in", "i"), work.search("x:/s"):
            assert work.search_order() == ["x:/s", "x:/in", "x:/one", "x:/b"] and work.prefixes["i"] == "x:/in"
            work.insert(work.kb.of("r").limit(1).select(*statement(F.col("s"), "seen", F.lit("yes"))))
        assert "i" not in work.prefixes and work.active == "x:/one"
        with pytest.raises(modules.ModuleError):
            work.unload("x:/one")
    with pytest.raises(modules.ModuleError, match="registered"), work.start("x:/one"):
        pass
    assert rows(work.kb.statements.where("mod LIKE 'x:/%'"), "mod", "p") == [("x:/in", "seen"), ("x:/one", "back"), ("x:/one", "back")]
    with pytest.raises(rules.Contradiction), work.trial("x:/try"):
        work.apply(rule)
        work.apply(Rule("stop", [Pattern([Edge(X, "back", Y)])], stop=rules.Contradiction, message="{x}"))
    assert len(work.log) == 2
    work.unload("x:/one")
    assert rows(work.kb.statements.where("mod LIKE 'x:/%'"), "mod", "p") == [("x:/in", "seen")] and "one" not in work.prefixes
    work.undo(2)
    assert work.kb.of("seen").isEmpty() and work.kb.of("back").count() == 2


def test_calls_are_made_once(spark):
    kb = kb_of(spark, [("add", "range", "number"), ("add", "range", "sum"), ("I1", "in", "I9")])
    asked = local(spark, [("add", ["I1", "n:2.0"]), ("add", ["I1", "n:2.0"]), ("add", ["n:2.0", "I1"]), ("add", [])], "operator string, args array<string>")
    post = Rule("post", [Pattern([Edge(Var("result"), "has_arguments", X), Edge(X, "has_element", Y), Edge(Y, "in", Var("z"))])], [Template(Var("result"), "in", Var("z"))])
    after, made = calls.call(kb, asked, post=[post])
    assert made.count() == 3 and after.of("instance_of").where("o = 'number'").count() == 3 and after.of("secondary_instance_of").where("o = 'sum'").count() == 3
    assert after.of("in").where("o = 'I9'").count() == 3
    assert rows(after.of("has_element").where("o_kind = 'L'"), "o", "o_type", "o_lex") == [("n:2.0", "float", "2.0")] * 2
    again, twice = calls.call(after, asked, post=[post])
    assert twice.where("made").isEmpty() and again.statements.count() == after.statements.count()
    with pytest.raises(calls.NotCallable, match="sub has no range"):
        calls.call(kb, local(spark, [("sub", ["I1"])], "operator string, args array<string>"))
    with pytest.raises(ValueError, match="no variable result"):
        calls.call(kb, asked, post=[Rule("p", [Pattern([Edge(X, "in", Y)])], [Template(X, "t", Y)])])
