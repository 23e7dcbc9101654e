"""Micro graphs, one for each rule operator."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import checks, closure, edit, lookup, rules
from factloom.operators.pattern import Edge, Ent, Lit, LitVar, Pattern, PatternError, RelVar, Var, label_less, match, match_any
from factloom.operators.rules import New, Rule, Template
from factloom.plans.model import kb_of

X, Y, Z = Var("x"), Var("y"), Var("z")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_type_match_and_literal_condition(spark):
    kb = kb_of(spark, [("I1", "is_a", "rational"), ("I2", "is_a", "rational"), ("I3", "is_a", "rational"), ("I4", "is_a", "complex"), ("I2", "placeholder", True)])
    assert rows(match(kb, Pattern([Edge(X, "is_a", Ent("rational"))])), "x") == [("I1",), ("I2",), ("I3",)]
    both = Pattern([Edge(X, "is_a", Ent("rational")), Edge(X, "placeholder", Lit("n:1.0"))])
    assert rows(match(kb, both), "x") == [("I2",)]


def test_true_one_and_float_one_are_one_literal(spark):
    kb = kb_of(spark, [("I1", "v", True), ("I2", "v", 1), ("I3", "v", 1.0), ("I4", "v", ("1",))])
    pairs = match(kb, Pattern([Edge(X, "v", LitVar("l")), Edge(Y, "v", LitVar("l"))]))
    assert pairs.count() == 6


def test_matches_are_injective_and_avoid_externals(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I1"), ("I1", "r", "I1"), ("I3", "r", "I1")])
    chain = [Edge(X, "r", Y), Edge(Y, "r", Z)]
    assert rows(match(kb, Pattern(chain)), "x", "y", "z") == [("I3", "I1", "I2")]
    assert match(kb, Pattern(chain, externals=["I2"])).count() == 0
    assert match(kb, Pattern(chain, injective=False)).count() == 7


def test_components_need_to_be_declared(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I3", "q", "I4")])
    edges = [Edge(X, "r", Y), Edge(Z, "q", Var("w"))]
    with pytest.raises(PatternError):
        match(kb, Pattern(edges))
    assert match(kb, Pattern(edges, components=2)).count() == 1


def test_relation_variable_with_properties(spark):
    kb = kb_of(spark, [("R1", "flag", True), ("R2", "flag", False), ("I1", "R1", "I2"), ("I1", "R2", "I2"), ("I1", "R3", "I2"), ("I4", "R1", "I5")])
    found = match(kb, Pattern([Edge(X, RelVar("rel", (("flag", "n:1.0"),)), Y)]))
    assert rows(found, "x", "rel", "y") == [("I1", "R1", "I2"), ("I4", "R1", "I5")]


def test_absence_or_and_label_condition(spark):
    kb = kb_of(spark, [("I1", "v", 0), ("I2", "v", 10), ("I3", "v", 20), ("I4", "v", 20), ("I4", "w", 1), ("I1", "label", ("b",)), ("I2", "label", ("a",)), ("I1", "same", "I2"), ("I2", "same", "I1")])
    assert rows(match(kb, Pattern([Edge(X, "v", LitVar("l"))], absent=[("x", "w")])), "x") == [("I1",), ("I2",), ("I3",)]
    either = match_any(kb, [Pattern([Edge(X, "v", Lit("n:20.0"))]), Pattern([Edge(X, "w", Lit("n:1.0"))])])
    assert rows(either, "x") == [("I3",), ("I4",), ("I4",)]
    a, b = LitVar("a"), LitVar("b")
    less = Pattern([Edge(X, "same", Y), Edge(X, "label", a), Edge(Y, "label", b)], conditions=[lambda df: label_less(F.col("a"), F.col("b"))])
    assert rows(match(kb, less), "x", "y") == [("I2", "I1")]


def test_scoped_statements_and_entities_do_not_match(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I3", "r", "I4", "scope1"), ("I5", "r", "I6")], scoped={"I6": "scope2"})
    assert rows(match(kb, Pattern([Edge(X, "r", Y)])), "x") == [("I1",)]
    assert match(kb, Pattern([Edge(X, "r", Y)], injective=False)).count() == 3


def test_insert_if_new_and_bag(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I3"), ("I1", "r", "I4"), ("I4", "r", "I3"), ("I9", "t", "I9")])
    chain = [Pattern([Edge(X, "r", Y), Edge(Y, "r", Z)])]
    new, delta = rules.apply(kb, Rule("t", chain, [Template(X, "t", Z)]))
    assert rows(delta, "s", "o") == [("I1", "I3")]
    assert rules.apply(new, Rule("t", chain, [Template(X, "t", Z)]))[1].isEmpty()
    assert rules.delta(kb, Rule("t", chain, [Template(X, "t", Z)], only_new=False)).count() == 2


def test_merge_moves_statements_and_leaves_tombstones(spark):
    kb = kb_of(spark, [("I2", "same_as", "I3"), ("I1", "likes", "I3"), ("I3", "label", ("c",)), ("I3", "owns", "I5"), ("I2", "owns", "I5")])
    after = edit.merge_entities(kb, edit.representatives(match(kb, Pattern([Edge(X, "same_as", Y)])).select(F.col("x").alias("a"), F.col("y").alias("b"))))
    assert rows(after.of("likes", "owns"), "s", "p", "o") == [("I1", "likes", "I2"), ("I2", "owns", "I5")]
    assert rows(after.entities.where("unlinked"), "uri") == [("I3",)]


def test_merge_prefers_a_real_value_and_refuses_two(spark):
    facts = [("I1", "house", "I7"), ("I2", "house", "I8"), ("I8", "is_placeholder", True)]
    pairs = spark.createDataFrame([("I2", "I1")], "old string, new string")
    after = edit.merge_entities(kb_of(spark, facts), pairs, functional=("house",))
    assert rows(after.of("house"), "s", "o") == [("I1", "I7")]
    with pytest.raises(edit.FunctionalError):
        edit.merge_entities(kb_of(spark, facts[:2]), pairs, functional=("house",))


def test_functional_insert_is_refused_before_storing(spark):
    kb = kb_of(spark, [("I1", "r", "I2")])
    row = rules.as_statements(spark.createDataFrame([("I1", "r", "E", "I3")], "s string, p string, o_kind string, o string"))
    with pytest.raises(edit.FunctionalError):
        edit.insert(kb, row, functional=("r",))
    assert edit.insert(kb, row).of("r").count() == 2


def test_fixpoint_of_transitive_rule_with_a_cycle(spark):
    kb = kb_of(spark, [("I1", "r", "I2"), ("I2", "r", "I3"), ("I3", "r", "I4"), ("I4", "r", "I2")])
    after, _, stop = rules.fixpoint(kb, [Rule("t", [Pattern([Edge(X, "r", Y), Edge(Y, "r", Z)])], [Template(X, "r", Z)])])
    assert stop is None and after.of("r").count() == 9
    assert closure.transitive_closure(closure.relation_edges(kb, "r")).count() == 12


def test_loops_end_only_when_nothing_is_new(spark):
    # one step of the chain a round: more rounds than the hypothesis loop once had
    chain = [(f"n{k}", "next", f"n{k + 1}") for k in range(12)]
    step = Rule("step", [Pattern([Edge(X, "at", Y), Edge(Y, "next", Z)])], [Template(X, "at", Z)])
    bad = Rule("bad", [Pattern([Edge(X, "at", Ent("n12"))])], stop=rules.Contradiction)
    kb = kb_of(spark, chain)
    assert rules.assume(kb, [step, bad], "I1", "at", ["n11", "n0"])[1] == ["n0"]
    with pytest.raises(closure.RoundLimit):
        rules.fixpoint(kb_of(spark, [*chain, ("I1", "at", "n0")]), [step], max_rounds=3)
    edges = closure.relation_edges(kb, "next").where("a IN ('n0', 'n1', 'n2', 'n3')")
    with pytest.raises(closure.RoundLimit):
        closure.transitive_closure(edges, max_rounds=2)
    assert closure.transitive_closure(edges, max_rounds=3).count() == closure.transitive_closure(edges).count() == 10


def test_new_entities_have_content_ids(spark):
    kb = kb_of(spark, [("I1", "is_a", "house"), ("I2", "is_a", "house")])
    rule = Rule("n", [Pattern([Edge(X, "is_a", Ent("house"))])], [Template(New("d", ("x",)), "in", X)])
    after, first = rules.apply(kb, rule)
    assert first.count() == 2 and rules.apply(after, rule)[1].isEmpty()


def test_exclusion_contradiction_and_goal(spark):
    kb = kb_of(spark, [("I1", "not", "a"), ("I1", "not", "b"), ("I2", "not", "a")])
    classes = spark.createDataFrame([("k", m) for m in "abc"], "cls string, member string")
    assert rows(rules.by_exclusion(kb, "not", "is", classes), "s", "o") == [("I1", "c")]
    with pytest.raises(rules.Contradiction, match="I1 a"):
        rules.apply(kb, Rule("c", [Pattern([Edge(X, "not", Y)])], stop=rules.Contradiction, message="{x} {y}"))
    stop = rules.apply_all(kb, [Rule("c", [Pattern([Edge(X, "not", Y)])], stop=rules.GoalReached, message="done")])[2]
    assert isinstance(stop, rules.GoalReached)


def test_hypothesis_is_refuted_on_its_own_version(spark):
    kb = kb_of(spark, [("b", "banned_for", "I1")])
    bad = Rule("bad", [Pattern([Edge(X, "is", Y), Edge(Y, "banned_for", X)])], stop=rules.Contradiction, message="{x}")
    after, refuted = rules.assume(kb, [bad], "I1", "is", ["a", "b", "c"])
    assert refuted == ["b"] and after.of("is").isEmpty()


def test_bijections_of_five(spark):
    kb = kb_of(spark, [("h0", "not", "d0")])
    s, o = [f"h{k}" for k in range(5)], [f"d{k}" for k in range(5)]
    assert rules.bijections(kb_of(spark, [("a", "b", "c")]), s, o, "not").select("assignment").distinct().count() == 120
    assert rules.bijections(kb, s, o, "not").select("assignment").distinct().count() == 96


def test_symmetric_and_explanation(spark):
    kb = kb_of(spark, [("I1", "next", "I2"), ("I3", "next", "I4"), ("I4", "next", "I3")])
    assert rows(rules.reverse_statements(kb, "next"), "s", "o") == [("I2", "I1")]
    rule = Rule("e", [Pattern([Edge(X, "next", Y)])], [Template(Y, "near", X)], explanation="{y} near {x}")
    assert ("I2 near I1",) in rows(rules.explained(rules.delta(kb, rule), rule), "explanation")


def test_lookups(spark):
    kb = kb_of(spark, [("I1", "label", ("x", "de")), ("I1", "label", ("y",)), ("I1", "v", 3), ("I1", "v", 4), ("I2", "v", 5)])
    assert rows(lookup.first_literals(kb, "I1").where("p = 'v'"), "o") == [("n:3.0",)]
    assert rows(lookup.in_language(kb.of("label"), ["s"], "o_lex", "o_lang", "de"), "o_lex") == [("x",)]
    assert rows(lookup.in_language(kb.of("label"), ["s"], "o_lex", "o_lang", "fr"), "o_lex") == [("y",)]
    assert lookup.resolve("pr__I5__name", {"pr": "a:/b"}, current="c:/d", builtin="e:/f") == "a:/b#I5"
    assert lookup.resolve('I5000["name"]', {}, current="c:/d", builtin="e:/f") == "c:/d#I5000"
    with pytest.raises(lookup.LookupFailed):
        lookup.resolve("x__I5", {}, current="c:/d", builtin="e:/f")


def test_type_checks(spark):
    kb = kb_of(spark, [("m", "instance_of", "matrix"), ("matrix", "subclass_of", "math"), ("c", "instance_of", "cplx")])
    sig = spark.createDataFrame([("det", 0, "math"), ("det", 0, "real")], "operator string, place int, expected string")
    calls = spark.createDataFrame([("a", "det", ["m"]), ("b", "det", ["c"]), ("d", "det", ["n:1.5"]), ("e", "det", ["m", "m"])], "mapping string, operator string, args array<string>")
    assert rows(checks.type_violations(kb, calls, sig), "mapping") == [("b",)]
    assert rows(checks.arity_violations(calls, sig), "mapping") == [("e",)]
    with pytest.raises(checks.SignatureError):
        checks.arities(spark.createDataFrame([("f", 0, "x"), ("f", 2, "x")], "operator string, place int, expected string"))


def test_taxonomy_cycle_is_an_error(spark):
    with pytest.raises(closure.TaxonomyError):
        closure.superclasses(kb_of(spark, [("a", "subclass_of", "b"), ("b", "subclass_of", "a")]))


def test_instances_inherit_signature_and_methods(spark):
    from factloom.operators.instances import Methods, NotAClass, new_instances

    kb = kb_of(spark, [("op", "subclass_of", "meta"), ("op", "range", "real"), ("op", "domain_1", "a"), ("op", "domain_1", "b")])
    wanted = spark.createDataFrame([("op", "sine"), ("op", "sine")], "cls string, name string")
    after = new_instances(kb, wanted, strict=True)
    again = new_instances(after, wanted)
    assert rows(again.of("range").where("s <> 'op'"), "o") == [("real",)] and again.of("domain_1").count() == 2
    assert again.statements.count() == after.statements.count() and again.entities.count() == after.entities.count()
    with pytest.raises(NotAClass):
        new_instances(kb, spark.createDataFrame([("real", "x")], "cls string, name string"), strict=True)
    methods = Methods()
    methods.add("meta", "f", lambda: "meta")
    made = after.of("label").first()["s"]
    assert methods.resolve(after, made, "f")() == "meta"
    methods.add("op", "f", lambda: "op")
    assert methods.resolve(after, made, "f")() == "op"


def test_admissible_bijections_by_case(spark):
    excluded = spark.createDataFrame([("a", "h0", "d0"), ("a", "h0", "d0"), ("b", "h0", "d0"), ("b", "h1", "d2"), ("c", "h9", "d0"), *[("d", "h3", f"d{k}") for k in range(5)]], "case string, s string, o string")
    s, o = [f"h{k}" for k in range(5)], [f"d{k}" for k in range(5)]
    assert rows(rules.admissible(excluded, s, o), "case", "n") == [("a", 96), ("b", 78), ("c", 120), ("d", 0)]
    eight = [str(k) for k in range(8)]
    assert rows(rules.admissible(spark.createDataFrame([("a", "7", "7")], "case string, s string, o string"), eight, eight), "n") == [(35280,)]
    with pytest.raises(ValueError):
        rules.admissible(excluded, s, o[:4])


def test_long_tuples_are_indexed_across_tasks(spark):
    members = spark.range(1000).selectExpr("if(id % 10 = 0, 'small', 'large') AS tuple", "concat('I', lpad(id, 4, '0')) AS o").repartition(7)
    placed = edit.indexed(members)
    for name, k in (("small", 100), ("large", 900)):
        got = placed.where(F.col("tuple") == name).orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(k)) and [r["o"] for r in got] == sorted(r["o"] for r in got)
    kb = edit.close_class(kb_of(spark, [(f"I{k}", "instance_of", "house") for k in (3, 1, 2)]), "house")
    assert rows(lookup.tuple_elements(kb), "place", "argument") == [(0, "I3"), (1, "I1"), (2, "I2")]
    assert rows(kb.of("has_closed_tuple"), "s", "o") == [("house", "tuple:house")] and rows(kb.of("has_length"), "o") == [("n:3.0",)]


def test_expressions_and_ranges_on_columns(spark):
    from factloom.operators import calls, expressions, scopes

    a, b = expressions._leaf("a"), expressions._leaf("b")
    kb = kb_of(spark, [("add", "range", "number"), ("mul", "range", "number")])
    inputs = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "y")], "a string, b string")
    after, found = calls.evaluate(kb, (a + b) * (a + b) + a, inputs)
    assert after.of("applied_mapping_of").groupBy("o").count().orderBy("o").collect() == [("add", 4), ("mul", 2)]
    assert found.count() == 3 and found.select("result").distinct().count() == 2
    with pytest.raises(scopes.ScopeError):
        scopes.integer_ranges(spark.createDataFrame([(1, 2, 0)], "start long, stop long, step long"))
    up = scopes.integer_ranges(spark.createDataFrame([("a", 1, 5, 2), ("b", 5, 1, -3), ("c", 5, 1, 1), ("d", 2, 2, -1)], "k string, start long, stop long, step long"))
    assert rows(up, "k", "value") == [("a", 1), ("a", 3), ("a", 5), ("b", 2), ("b", 5), ("d", 2)]
    sides = spark.createDataFrame([("a", "<", "b"), ("a", "<", "b")], "lhs string, sign string, rhs string")
    assert rows(expressions.related(sides), "p") == [("has_lhs",), ("has_rhs",), ("instance_of",), ("is_related:<",)]
    with pytest.raises(ValueError):
        expressions.related(sides.withColumn("rhs", F.lit("a")))
