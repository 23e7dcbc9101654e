"""Stored rules, relation variables, branched fixpoints and scopes on micro graphs."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import compiler, fixpoint, rules, scopes
from factloom.operators.pattern import Edge, Ent, Lit, LitVar, Pattern, PatternError, RelVar, Var, first_matches, match
from factloom.operators.rules import Rule, Template
from factloom.operators.scopes import Scopes, Text
from factloom.plans.model import kb_of
from factloom.plans.tables import local

X, Y, Z = Var("x"), Var("y"), Var("z")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def rule(name, variables, premise, assertion, *, external=(), setting=()):
    own = Scopes(name)
    with own.scope("setting"):
        for v in variables.split():
            own.new_var(v)
        own.uses_external(*external)
        for t in setting:
            own.new_rel(*[getattr(own, x[1:]) if isinstance(x, str) and x.startswith("?") else x for x in t])
    for scope, triples in (("premise", premise), ("assertion", assertion)):
        with own.scope(scope):
            for t in triples:
                own.new_rel(*[getattr(own, x[1:]) if isinstance(x, str) and x.startswith("?") else x for x in t])
    return own


def test_compiled_rule_is_its_handwritten_twin(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I3"), ("I3", "size", 4), ("I9", "r", "I1")])
    stored = rule("chain", "x y z", [("?x", "r", "?y"), ("?y", "r", "?z"), ("?z", "size", 4)], [("?x", "t", "?z")]).rule(kb, explanation="{x} over {y}")
    (found,) = compiler.stored_rules(stored)
    assert found.branches == [Pattern([Edge(X, "r", Y), Edge(Y, "r", Z), Edge(Z, "size", Lit("n:4.0"))])]
    assert found.asserts == [Template(X, "t", Z, only_new=False)] and found.explanation == "{x} over {y}"
    assert rows(rules.delta(stored, found), "s", "p", "o") == [("I1", "t", "I3")]


def test_rules_come_in_order_and_by_name(spark):
    kb = kb_of(spark, [("I1", "r", "I2")])
    for name in ("b", "a"):
        kb = rule(name, "x y", [("?x", "r", "?y")], [("?y", name, "?x")]).rule(kb)
    assert sorted(compiler.rule_names(kb)) == ["a", "b"]
    assert [r.name for r in compiler.stored_rules(kb, ["b"])] == ["b"]
    after, deltas, stop = rules.apply_all(kb, compiler.stored_rules(kb))
    assert stop is None and rows(after.statements.where("scope IS NULL AND s = 'I2'"), "p", "o") == [("a", "I1"), ("b", "I1")]


def nested(kb, kinds):
    """A rule whose premise holds (kind, statements, inner) trees."""
    own = Scopes("nested")
    with own.scope("setting"):
        own.new_var("x")

    def write(tree):
        kind, values, inner = tree
        with own.sub(kind):
            for v in values:
                own.new_rel(own.x, "v", v)
            for t in inner:
                write(t)

    with own.scope("premise"):
        own.new_rel(own.x, "v", 0)
        for t in kinds:
            write(t)
    with own.scope("assertion"):
        own.new_rel(own.x, "hit", True)
    return own.rule(kb)


def test_disjunctive_form_of_nested_scopes(spark):
    kb = kb_of(spark, [(f"I{n}", "v", k) for n in range(16) for k in range(5) if k == 0 or n >> (k - 1) & 1])
    # 0 and (1 or (2 and 3)) and (4 or (3 and (1 or 2)))
    trees = [("OR", [1], [("AND", [2, 3], [])]), ("OR", [4], [("AND", [3], [("OR", [1, 2], [])])])]
    (found,) = compiler.stored_rules(nested(kb, trees))
    assert len(found.branches) == 2 * 3
    bits = lambda n: [None, *[bool(n >> k & 1) for k in range(4)]]
    true = [f"I{n}" for n in range(16) for b in [bits(n)] if (b[1] or (b[2] and b[3])) and (b[4] or (b[3] and (b[1] or b[2])))]
    assert sorted({r[0] for r in rows(rules.bindings(nested(kb, trees), found), "x")}) == sorted(true)


def test_compile_errors(spark):
    kb = kb_of(spark, [("I1", "r", "I2")])
    bad = {
        "neither a variable": rule("a", "x", [("?x", "r", "I2")], [("?x", "t", "?x")]),
        "asserts nothing": rule("b", "x y", [("?x", "r", "?y")], []),
        "has no statements": rule("c", "x y", [], [("?x", "t", "?y")]),
    }
    for text, own in bad.items():
        with pytest.raises(compiler.RuleError, match=text):
            compiler.stored_rules(own.rule(kb))
    own = Scopes("d")
    with own.scope("setting"):
        own.new_var("x")
    with pytest.raises(compiler.RuleError, match="no scope ASSERTION, PREMISE"):
        compiler.stored_rules(own.rule(kb))
    with pytest.raises(compiler.RuleError, match="a scope NOT"):
        compiler.stored_rules(nested(kb, [("NOT", [1], [])]))
    two = rule("two", "x y z w", [("?x", "r", "?y"), ("?z", "r", "?w")], [("?x", "t", "?z")])
    with pytest.raises(PatternError):
        rules.delta(kb, compiler.stored_rules(two.rule(kb))[0])


def test_external_entities_are_given_and_bound_by_no_variable(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I3"), ("I3", "r", "I2")])
    own = rule("e", "x y", [("?x", "r", "?y"), ("?y", "r", "I3")], [("?x", "t", "I3")], external=["I3"])
    stored = own.rule(kb)
    assert rows(rules.delta(stored, compiler.stored_rules(stored)[0]), "s", "o") == [("I1", "I3")]


def test_consequences_of_stored_rules(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I1", "bad", "I2"), ("I5", "same", "I6"), ("I6", "q", "I7")])
    stop = Scopes("stop")
    with stop.scope("setting"):
        stop.new_var("x"), stop.new_var("y")
    with stop.scope("premise"):
        stop.add_all([(stop.x, "r", stop.y), (stop.x, "bad", stop.y)])
    with stop.scope("assertion"):
        stop.call("end", "raise_contradiction", Text("{} against {}"), stop.x, stop.y)
    stored = stop.rule(kb)
    with pytest.raises(rules.Contradiction, match="I1 against I2"):
        rules.apply(stored, compiler.stored_rules(stored)[0])
    merge = Scopes("merge")
    with merge.scope("setting"):
        merge.new_var("x"), merge.new_var("y")
    with merge.scope("premise"):
        merge.new_rel(merge.x, "same", merge.y)
    with merge.scope("assertion"):
        merge.call("m", "replace", merge.y, merge.x)
    stored = merge.rule(kb)
    after, _ = rules.apply(stored, compiler.stored_rules(stored)[0])
    assert rows(after.of("q").where("scope IS NULL"), "s", "o") == [("I5", "I7")]
    sparql = Scopes("sparql")
    with sparql.scope("setting"):
        sparql.new_var("x"), sparql.new_var("y")
    with sparql.scope("premise"):
        pass
    with sparql.scope("assertion"):
        sparql.new_rel(sparql.y, "back", sparql.x, mode=scopes.ONLY_NEW)
    stored = sparql.rule(kb, sparql="SELECT ?x ?y WHERE { ?x :r ?y }")
    assert rows(rules.delta(stored, compiler.stored_rules(stored)[0]), "s", "p", "o") == [("I2", "back", "I1")]


def test_new_instance_is_labelled_once_for_each_subject(spark):
    own = Scopes("make")
    with own.scope("setting"):
        own.new_var("x"), own.new_var("y"), own.uses_external("house")
    with own.scope("premise"):
        own.new_rel(own.x, "r", own.y)
    with own.scope("assertion"):
        own.call("new", "new_instance_as_object", own.x, "lives_in", "house", True)
    stored = own.rule(kb_of(spark, [("I1", "r", "I2"), ("I1", "r", "I3"), ("house", "r", "house")]))
    after, made = rules.apply(stored, compiler.stored_rules(stored)[0])
    assert made.where("p = 'lives_in'").count() == 1 and made.where("p = 'is_placeholder'").count() == 1
    assert rules.apply(after, compiler.stored_rules(stored)[0])[1].isEmpty()


def test_relation_variables_are_unified(spark):
    kb = kb_of(spark, [("R1", "opposite", "R2"), ("R2", "opposite", "R1"), ("R3", "opposite", "I8"), ("I1", "R1", "I5"), ("I1", "R2", "I6"), ("I2", "R1", "I5"), ("I2", "R3", "I6"), ("R1", "main", True)])
    other = RelVar("b")
    tied = Pattern([Edge(X, RelVar("a", (("opposite", other),)), Y), Edge(X, other, Z)])
    assert rows(match(kb, tied), "x", "a", "b", "y", "z") == [("I1", "R1", "R2", "I5", "I6"), ("I1", "R2", "R1", "I6", "I5")]
    main = Pattern([Edge(X, RelVar("a", (("opposite", other), ("main", "n:1.0"))), Y)])
    # b stands in no edge: it must be a relation
    assert rows(match(kb, main), "x", "a", "b") == [("I1", "R1", "R2"), ("I2", "R1", "R2")]
    loose = Pattern([Edge(X, RelVar("a", (("opposite", other),)), Y)])
    assert ("I2", "R3", "I8") not in rows(match(kb, loose), "x", "a", "b")


def test_range_class_and_single_edges(spark):
    kb = kb_of(spark, [("R1", "range", "c1"), ("R1", "range", "c2"), ("I1", "R1", "I2"), ("I1", "R1", "I3"), ("I2", "instance_of", "c1"), ("I3", "instance_of", "c2"), ("R1", "main", True), ("R2", "main", True), ("I1", "R2", "I2")])
    rel = RelVar("a", (("main", "n:1.0"),), range_of="range")
    assert rows(match(kb, Pattern([Edge(X, rel, Y)])), "x", "y") == [("I1", "I2")]
    with pytest.raises(PatternError, match="2 relations between I1 and I2"):
        match(kb, Pattern([Edge(X, rel, Y)], strict_single_edge=True))


def test_first_matches_tell_that_they_are_cut(spark):
    found = spark.createDataFrame([(f"I{k}",) for k in (3, 1, 2, 2)], "x string")
    assert rows(first_matches(found, 3), "x", "place", "cut") == [("I1", 1, True), ("I2", 2, True), ("I2", 3, True)]
    assert rows(first_matches(found, 4), "place", "cut") == [(1, False), (2, False), (3, False), (4, False)]


def test_semi_naive_equals_plain_python(spark):
    facts = [(f"I{k}", "r", f"I{k * 3 % 7}") for k in range(7)] + [("I0", "r", "I5"), ("I5", "q", "I2"), ("I2", "q", "I9"), ("I2", "size", 2), ("I9", "size", 2)]
    given = [
        Rule("a", [Pattern([Edge(X, "r", Y), Edge(Y, "r", Z)]), Pattern([Edge(X, "q", Y), Edge(Y, "r", Z)])], [Template(X, "r", Z)]),
        Rule("b", [Pattern([Edge(X, "r", Y), Edge(Y, "q", Z), Edge(Z, "size", LitVar("n"))])], [Template(Z, "q", X), Template(X, "size", LitVar("n"))]),
        Rule("c", [Pattern([Edge(X, "size", Lit("n:2.0")), Edge(Ent("I5"), "q", X)])], [Template(X, "chosen", Ent("I5"))]),
    ]
    got = rules.fixpoint(kb_of(spark, facts), given)[0]
    known = {(s, p, f"n:{o}.0" if p == "size" else o) for s, p, o in facts}
    while True:
        of = lambda q: [(s, o) for s, p, o in known if p == q]  # noqa: B023, E731
        new = {(x, "r", z) for x, y in of("r") + of("q") for v, z in of("r") if v == y and len({x, y, z}) == 3}
        for x, y in of("r"):
            for v, z in of("q"):
                if v == y and len({x, y, z}) == 3 and (z, "size", "n:2.0") in known:
                    new |= {(z, "q", x), (x, "size", "n:2.0")}
        new |= {(x, "chosen", "I5") for x, _ in of("size") if x != "I5" and ("I5", "q", x) in known}
        if new <= known:
            break
        known |= new
    assert rows(got.statements, "s", "p", "o") == sorted(known)


def test_branches_do_not_see_each_other(spark):
    kb = kb_of(spark, [("I1", "near", "I2"), ("I2", "near", "I3"), ("I3", "closed", "red"), ("I2", "has", "green")])
    carry = Rule("carry", [Pattern([Edge(X, "has", Z), Edge(X, "near", Y)])], [Template(Y, "has", Z)])
    clash = Rule("clash", [Pattern([Edge(X, "has", Ent("red")), Edge(X, "has", Ent("blue"))])], stop=rules.Contradiction, message="both at {x}")
    closed = Rule("closed", [Pattern([Edge(X, "has", Z), Edge(X, "closed", Z)])], stop=rules.Contradiction, message="{z} at {x}")
    done = Rule("done", [Pattern([Edge(Ent("I3"), "has", Ent("green")), Edge(X, "has", Ent("blue"))])], stop=rules.GoalReached, message="{x}")
    base = rules.fixpoint(kb, [carry])[0]
    # (branch, subject, object): one is refuted after two rounds, one alone is fine, one pair of statements clashes
    tried = local(spark, [("b1", "I1", "has", "E", "red"), ("b2", "I1", "has", "E", "blue"), ("b3", "I3", "has", "E", "red"), ("b4", "I2", "has", "E", "yellow"), ("b5", "I1", "has", "E", "red"), ("b5", "I1", "has", "E", "blue"), ("b6", "I2", "has", "E", "green")], "branch string, s string, p string, o_kind string, o string")
    got = fixpoint.suppose(base, [carry, clash, closed, done], tried)
    assert rows(got.outcomes, "branch", "outcome", "message") == [("b1", "refuted", "red at I3"), ("b2", "goal", "I1"), ("b3", "refuted", "red at I3"), ("b5", "refuted", "both at I1")]
    assert rows(got.statements.where("branch = 'b4'"), "s", "o") == [("I2", "yellow"), ("I3", "yellow")]
    assert got.statements.where("branch IN ('b1', 'b3', 'b5', 'b6')").isEmpty()


def test_functional_relations_refute(spark):
    kb = kb_of(spark, [("I1", "in", "a"), ("I2", "of", "I1")])
    carry = Rule("carry", [Pattern([Edge(X, "of", Y), Edge(X, "in", Z)])], [Template(Y, "in", Z)])
    tried = local(spark, [("same", "I2", "in", "E", "a"), ("other", "I2", "in", "E", "b"), ("two", "I3", "in", "E", "a"), ("two", "I3", "in", "E", "b")], "branch string, s string, p string, o_kind string, o string")
    got = fixpoint.suppose(kb, [carry], tried, functional=("in",))
    assert rows(got.outcomes, "branch", "message") == [("other", "I1 in a b"), ("two", "I3 in a b")]


def test_smallest_choice_is_taken(spark):
    kb = kb_of(spark, [("I1", "not_in", "a"), ("I2", "not_in", "a"), ("I2", "not_in", "b"), ("b", "shut", "b")])
    relations = local(spark, [("in", "not_in", s, o) for s in ("I1", "I2", "I3") for o in "abc"], "relation string, negative string, s string, o string")
    assert rows(fixpoint.choices(fixpoint.open_candidates(kb, relations)), "s", "o", "place") == [("I1", "b", 0), ("I1", "c", 1)]
    assert {r[0] for r in rows(fixpoint.choices(fixpoint.open_candidates(kb, relations), per="s"), "s")} == {"I1", "I3"}
    shut = Rule("shut", [Pattern([Edge(X, "in", Y), Edge(Y, "shut", Y)], injective=False)], stop=rules.Contradiction, message="{y}")
    assert fixpoint.hypothesis_step(kb, [shut], relations).outcomes.isEmpty()
    assert rows(fixpoint.hypothesis_step(kb, [shut], relations, skip_first=False).outcomes, "outcome", "message") == [("refuted", "b")]


def test_scopes_come_back_from_statements(spark):
    own = Scopes("T1")
    with own.scope("setting"):
        own.new_var("x", cls="matrix", quantifier="univ_quant"), own.new_var("y")
    with own.scope("premise"):
        own.new_equation(own.x, own.y)
        with own.sub("NOT"):
            own.new_rel(own.x, "is", own.y)
        left, right = own.implication()
        with left:
            own.new_rel(own.x, "below", own.y)
        with right:
            own.new_rel(own.y, "above", own.x)
        with pytest.raises(scopes.ScopeError, match="both sides"):
            own.new_equation(own.x, own.x)
    kb = own.stored(kb_of(spark, [("I1", "r", "I2")]))
    assert rows(scopes.scopes_of(kb), "scope", "kind") == [("T1/premise", "PREMISE"), ("T1/premise/NOT0", "NOT"), ("T1/premise/antecedent0", "ANTECEDENT"), ("T1/premise/consequent0", "CONSEQUENT"), ("T1/setting", "SETTING")]
    assert rows(scopes.setting_variables(kb).where("scope = 'T1/premise'"), "name", "variable") == [("x", "T1/setting#x"), ("y", "T1/setting#y")]
    assert rows(kb.scoped.where("scope = 'T1/premise/antecedent0'"), "s", "p", "o") == [("T1/setting#x", "below", "T1/setting#y")]
    assert kb.qualifiers.where("p = 'univ_quant'").count() == 1 and kb.qualifiers.where("p = 'defining_scope'").count() == kb.scoped.count()
    assert match(kb, Pattern([Edge(X, "below", Y)])).isEmpty() and own.x == "T1/setting#x"


def test_copied_scopes(spark):
    own = Scopes("T1")
    with own.scope("setting"):
        own.new_var("x")
    with own.scope("premise"):
        m = own.new_var("m")
        own.new_rel(m, "is", own.x)
    target = Scopes("T2")
    with target.scope("setting"):
        pass
    with target.scope("premise"):
        pass
    kb = target.stored(own.stored(kb_of(spark, [("T1/premise#m", "applied_mapping_of", "f"), ("T1/premise#m", "has_argument", "T1/setting#x"), ("T1/premise#m", "has_argument", "outside")])))
    copies = local(spark, [("T1/setting", "T2/setting"), ("T1/premise", "T2/premise")], "source string, target string")
    after, names = scopes.copy_scopes(kb, copies)
    new = {r["old"]: r["new"] for r in names.collect()}
    assert new["T1/setting#x"] == "T2/setting#x" and new["T1/premise#m"].startswith("T2/premise#m")
    m2 = new["T1/premise#m"]
    assert rows(after.of("has_argument").where(F.col("s") == m2), "o") == [("T2/setting#x",), ("outside",)]
    assert rows(after.scoped.where("scope = 'T2/premise'"), "s", "p", "o") == [(m2, "is", "T2/setting#x")]
    assert after.of("has_argument").count() == 4
    loop = kb_of(spark, [("T1/premise#m", "applied_mapping_of", "f"), ("T1/premise#m", "has_argument", "T1/premise#m")])
    with pytest.raises(scopes.ScopeError, match="argument of itself"):
        scopes.copy_scopes(target.stored(own.stored(loop)), copies)


def test_scopes_are_copied_as_rows(spark, monkeypatch):
    """Copies by rows are those by joins, and what is asked of them is not shuffled again."""
    triples, base = [], kb_of(spark, [("T0", "r", "T9")])
    for owner in ("T1", "T2"):
        own = Scopes(owner)
        with own.scope("setting"):
            u, v, a, b, m, none = (own.new_var(n, cls="thing" if n == "u" else None) for n in ("u", "v", "a", "b", "m", "none"))
            own.new_rel(m, "over", u)
            own.new_rel("outside", "over", b)
        base = own.stored(base)
        triples += [(x, "applied_mapping_of", f) for x, f in ((a, "add"), (b, "add"), (m, "mul"), (none, "nothing"))]
        triples += [(x, "has_argument", y) for x, y in ((a, u), (a, v), (b, u), (b, v), (m, a), (m, "outside"), (m, b))]
    for owner in ("T3", "T4", "T5"):
        own = Scopes(owner)
        with own.scope("setting"):
            pass
        base = own.stored(base)
    # seq is the order of arguments: those of a and b are equal
    known = kb_of(spark, triples)
    place = F.when(F.col("p") == "has_argument", F.when(F.col("o").endswith("#v") | F.col("o").isin("outside"), 1).when(F.col("s").endswith("#m") & F.col("o").endswith("#b"), 2).otherwise(0)).otherwise(0).cast("long")
    kb = base.plus(known.statements.withColumn("seq", place), known.entities)
    copies = local(spark, [("T1/setting", "T3/setting"), ("T1/setting", "T4/setting"), ("T2/setting", "T5/setting")], "source string, target string")
    shown = lambda df, *columns: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    told = lambda after, names: (shown(after.statements, "s", "p", "o", "seq"), shown(after.scoped, "s", "p", "o", "scope", "stm_id"), shown(after.entities, "uri", "scope"), shown(after.qualifiers, *after.qualifiers.columns), shown(names, "source", "target", "old", "new"))
    after, names = scopes.copy_scopes(kb, copies)
    for made in (after.statements, after.entities, names):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    by_rows = told(after, names)
    assert names.where("target = 'T3/setting'").count() == 6 and after.entities.where("scope = 'T3/setting' AND mod = 'copies'").count() == 5
    monkeypatch.setattr(scopes, "MOST_INSIDE", 0)
    assert told(*scopes.copy_scopes(kb, copies)) == by_rows
