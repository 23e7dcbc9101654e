"""The well-known puzzle of five houses: stored rules over its hints, end to end with relation variables, closed classes and hypotheses."""

import pytest

from factloom.operators import compiler, edit, rules
from factloom.operators.pattern import Edge, Lit, Pattern, Var
from factloom.operators.scopes import ONLY_NEW, Scopes
from factloom.plans.model import kb_of

# The persons and things of the puzzle and its hints; p1 to p12 stand for persons that a hint does not name.
CLASSES = {
    "human": "Englishman Norwegian Ukrainian Spaniard Japanese".split(),
    "beverage": "water tea milk coffee juice".split(),
    "colour": "yellow red blue ivory green".split(),
    "brand": "Kools Chesterfield OldGold LuckyStrike Parliaments".split(),
    "number": "house1 house2 house3 house4 house5".split(),
    "pet": "fox horse snails dog zebra".split(),
}
ACTIVITIES = ["drinks", "has_colour", "smokes", "lives_in", "owns"]
HINTS = """
Englishman has_colour red; Spaniard owns dog; p1 drinks coffee; p1 has_colour green; Ukrainian drinks tea; p2 has_colour green; p3 has_colour ivory; p2 Rright p3;
p4 smokes OldGold; p4 owns snails; p5 smokes Kools; p5 has_colour yellow; p6 drinks milk; p6 lives_in house3; Norwegian lives_in house1; p7 smokes Chesterfield;
p8 owns fox; p7 Rnext p8; p9 smokes Kools; p10 owns horse; p9 Rnext p10; p11 smokes LuckyStrike; p11 drinks juice; Japanese smokes Parliaments; p12 has_colour blue; Norwegian Rnext p12
"""
FACTS = [tuple(h.split()) for h in HINTS.split(";")]


@pytest.fixture(scope="module")
def puzzle(spark):
    facts = [(m, "instance_of", c) for c, members in CLASSES.items() for m in members] + FACTS
    facts += [(m, "is_placeholder", False) for members in CLASSES.values() for m in members]
    facts += [(f"p{k}", "instance_of", "human") for k in range(1, 13)] + [(f"p{k}", "is_placeholder", True) for k in range(1, 13)]
    facts += [(a, "is_functional_activity", True) for a in ACTIVITIES] + [(f"Rnot_{a}", "opposite_of", a) for a in ACTIVITIES]
    facts += [("Rnext", "is_symmetrical", True), ("Rright", "subproperty_of", "Rnext"), ("Rleft", "inverse_of", "Rright")]
    kb = kb_of(spark, facts)
    real = kb.of("instance_of").join(kb.of("is_placeholder").where("o = 'n:0.0'").select("s"), "s", "left_semi").select(*kb.statements.columns)
    for c in CLASSES:
        kb = kb.but(statements=kb.statements.unionByName(edit.close_class(kb.but(statements=real), c).statements.where("p IN ('has_closed_tuple', 'has_element')").select(*kb.statements.columns)))
    return kb.stored()


def rule(kb, name, variables, relations, assertion, *, premise=(), external=(), sparql=None):
    own = Scopes(name)
    name_of = lambda x: getattr(own, x[1:]) if isinstance(x, str) and x.startswith("?") else x
    with own.scope("setting"):
        for v in variables:
            own.new_var(v)
        for v in relations:
            own.new_rel_var(v)
        own.uses_external(*external)
    for scope, triples in (("premise", premise), ("assertion", assertion)):
        with own.scope(scope):
            for s, p, o in triples:
                proxy = name_of(p) if p.startswith("?") else None
                own.new_rel(name_of(s), "" if proxy else p, name_of(o), proxy=proxy, mode=ONLY_NEW if scope == "assertion" else None)
    stored = own.rule(kb, sparql=sparql)
    return stored, compiler.stored_rules(stored, [name])[0]


def facts_of(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


def test_persons_are_different(puzzle):
    given = [(f"?{v}", "instance_of", "human") for v in "ab"] + [(f"?{v}", "is_placeholder", False) for v in "ab"]
    stored, found = rule(puzzle, "different", "ab", [], [("?a", "differs_from", "?b"), ("?b", "differs_from", "?a")], premise=given, external=["human"])
    found.branches[0].components = 2
    # the persons are tied by nothing but their class, which is given: two components
    made = facts_of(rules.delta(stored, found))
    assert len(made) == 20 and made == {(a, "differs_from", b) for a in CLASSES["human"] for b in CLASSES["human"] if a != b}


def test_what_one_has_others_of_its_class_are_not(puzzle):
    sparql = """SELECT ?p ?no ?b WHERE { ?rel :is_functional_activity true . ?no :opposite_of ?rel . ?p ?rel ?a . ?a :instance_of ?c . ?c :has_closed_tuple ?t . ?t :has_element ?b .
        ?a :is_placeholder false . ?b :is_placeholder false FILTER (?a != ?b) }"""
    stored, found = rule(puzzle, "negative", "pb", ["no"], [("?p", "?no", "?b")], sparql=sparql)
    made = facts_of(rules.delta(stored, found))
    assert len(made) == 88
    cls = {m: members for members in CLASSES.values() for m in members}
    assert made == {(s, f"Rnot_{p}", other) for s, p, o in FACTS if p in ACTIVITIES for other in cls[o] if other != o}


def neighbours():
    """Who lives beside whom after hints, subproperty and symmetry."""
    pairs = {(s, o) for s, p, o in FACTS if p in ("Rnext", "Rright")}
    return pairs | {(b, a) for a, b in pairs}


def test_relations_and_neighbours_in_a_fixpoint(puzzle):
    kb, given = puzzle, []
    for name, variables, relations, premise, assertion in (
        ("sub", "xy", ["a", "b"], [("?a", "subproperty_of", "?b"), ("?x", "?a", "?y")], [("?x", "?b", "?y")]),
        ("symmetric", "xy", ["a"], [("?a", "is_symmetrical", True), ("?x", "?a", "?y")], [("?y", "?a", "?x")]),
        ("inverse", "xy", ["a", "b"], [("?b", "inverse_of", "?a"), ("?x", "?a", "?y")], [("?y", "?b", "?x")]),
        ("beside", "xyz", ["a", "no"], [("?x", "Rnext", "?y"), ("?a", "is_functional_activity", True), ("?no", "opposite_of", "?a"), ("?x", "?a", "?z")], [("?y", "?no", "?z")]),
    ):
        kb, found = rule(kb, name, variables, relations, assertion, premise=premise)
        given.append(found)
    after, _, stop = rules.fixpoint(kb.stored(), given)
    unscoped = facts_of(after.statements.where("scope IS NULL"))
    assert stop is None and {(s, o) for s, p, o in unscoped if p == "Rnext"} == neighbours() and ("p3", "Rleft", "p2") in unscoped
    assert {x for x in unscoped if x[1].startswith("Rnot_")} == {(b, f"Rnot_{p}", o) for a, b in neighbours() for s, p, o in FACTS if s == a and p in ACTIVITIES}


def test_bijections_that_the_hints_leave(puzzle):
    cls = {"drinks": "beverage", "has_colour": "colour", "smokes": "brand", "lives_in": "number", "owns": "pet"}
    persons = CLASSES["human"]
    known = {(s, p): o for s, p, o in FACTS if s in persons and p in ACTIVITIES}
    excluded = [(p, s, other) for (s, p), o in known.items() for other in CLASSES[cls[p]] if other != o]
    rows = puzzle.spark.createDataFrame(excluded, "case string, s string, o string")
    # one person's thing is known of each activity, of none two: four are left for four
    assert sorted(tuple(r) for r in rules.admissible(rows.where("case = 'drinks'"), persons, CLASSES["beverage"]).collect()) == [("drinks", 24)]
    assert {r["case"]: r["n"] for r in rules.admissible(rows.where("case = 'owns' OR case = 'smokes'"), persons, CLASSES["pet"]).collect()}["owns"] == 24


def test_a_hypothesis_about_a_house_is_refuted(puzzle):
    x, y, z = Var("x"), Var("y"), Var("z")
    kb = puzzle.only("lives_in", "has_colour", "Rnext", "is_placeholder")
    # two different persons cannot have one colour, and a person has one colour only
    one = rules.Rule("one", [Pattern([Edge(x, "has_colour", z), Edge(y, "has_colour", z), Edge(x, "is_placeholder", Lit("n:0.0")), Edge(y, "is_placeholder", Lit("n:0.0"))])], stop=rules.Contradiction, message="{z}")
    assert rules.assume(kb, [one], "Norwegian", "has_colour", ["yellow", "red", "blue", "green"])[1] == ["red"]
    assert rules.assume(kb, [one], "Englishman", "has_colour", ["red", "blue"], functional=("has_colour",))[1] == ["blue"]
