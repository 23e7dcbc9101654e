"""Plans that grow no faster than their input and results: joins on all that is shared, hubs in slices, rows without ids that nobody asks for."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import pattern, rules
from factloom.operators.pattern import Edge, LitVar, Pattern, RelVar, Var, match
from factloom.plans import sparql
from factloom.plans.model import content_id, kb_of

PEOPLE = [(f"C{k}", f"N{k % 2}", f"g{k % 3}") for k in range(24)]


def _people(spark):
    kb = kb_of(spark, [(c, "part_of", n) for c, n, _ in PEOPLE] + [(c, "segment", (g,)) for c, _, g in PEOPLE])
    kb.single = frozenset({"part_of", "segment"})
    return kb


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _joins(df):
    return [line for line in _plan(df).splitlines() if "Join" in line]


def _bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_pairs_meet_by_all_they_share(spark):
    """two subjects of one nation and one segment meet by both at once, not by the nation first."""
    a, b, n, g = Var("a"), Var("b"), Var("n"), LitVar("g")
    found = match(_people(spark), Pattern([Edge(a, "part_of", n), Edge(b, "part_of", n), Edge(a, "segment", g), Edge(b, "segment", g)]))
    assert any("(n#" in j and "(g#" in j for j in _joins(found))
    assert _bag(found, "a", "b") == Counter((x[0], y[0]) for x in PEOPLE for y in PEOPLE if x[1:] == y[1:] and x != y)


def _spread(df):
    return df.groupBy(F.spark_partition_id()).count().count()


@pytest.mark.parametrize("on", [["k"], []])
def test_one_value_is_dealt_to_many_tasks(spark, monkeypatch, on):
    """F2, F8: pairs of one value, or all pairs of two small tables, are no single task; none is lost or repeated."""
    monkeypatch.setattr(pattern, "SLICE", 4)
    left = spark.range(30).coalesce(1).select((F.col("id") % 20 == 0).cast("int").alias("k"), F.col("id").alias("x"))
    right = spark.range(50).coalesce(1).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.col("id").alias("y"))
    if not on:
        left, right = left.drop("k"), right.drop("k")
    out = pattern.sliced_join(left, right, on)
    assert _bag(out, "x", "y") == _bag(left.join(right, on) if on else left.crossJoin(right), "x", "y")
    assert _spread(out) > 1


def test_components_are_combined_by_many_tasks(spark, monkeypatch):
    """F8: a pattern of two components."""
    monkeypatch.setattr(pattern, "SLICE", 2)
    kb = kb_of(spark, [(c, "segment", (g,)) for c, _, g in PEOPLE])
    found = match(kb, Pattern([Edge(Var("a"), "segment", pattern.Lit("s:g0")), Edge(Var("b"), "segment", pattern.Lit("s:g1"))], components=2))
    assert _spread(found) > 1
    assert found.count() == 64


def test_a_path_is_closed_before_it_fans_out(spark):
    """what a supplier is part of joins its offers before they meet the orders."""
    rows = [(f"O{k}", "placed_by", f"C{k % 4}") for k in range(8)] + [(f"O{k}", "contains", f"P{(k + j) % 5}") for k in range(8) for j in range(2)]
    rows += [(f"P{k}", "supplied_by", f"S{(k + j) % 6}") for k in range(5) for j in range(3)] + [(f"C{k}", "part_of", f"N{k % 3}") for k in range(4)] + [(f"S{k}", "part_of", f"N{k % 3}") for k in range(6)]
    kb = kb_of(spark, rows)
    kb.single = frozenset({"part_of", "placed_by"})
    o, p, s, c, n = (Var(x) for x in "opscn")
    found = match(kb, Pattern([Edge(o, "contains", p), Edge(p, "supplied_by", s), Edge(s, "part_of", n), Edge(c, "part_of", n), Edge(o, "placed_by", c)]))
    assert any("(n#" in j and "(p#" in j for j in _joins(found))
    of = lambda r: [(x, y) for x, q, y in rows if q == r]
    nation, placed = dict(of("part_of")), dict(of("placed_by"))
    assert _bag(found, "o", "p", "s") == Counter((x, y, z) for x, y in of("contains") for w, z in of("supplied_by") if w == y and nation[z] == nation[placed[x]])


def test_sparql_pairs_meet_after_their_classes(spark):
    """in a block, too, what a subject has one of joins it before it is paired."""
    rows = [(f"S{k}", "instance_of", "supplier") for k in range(6)] + [(f"C{k}", "instance_of", "customer") for k in range(30)]
    rows += [(f"S{k}", "part_of", f"N{k % 2}") for k in range(6)] + [(f"C{k}", "part_of", f"N{k % 2}") for k in range(30)]
    kb = kb_of(spark, rows)
    kb.single = frozenset({"instance_of", "part_of"})
    found = sparql.plain(sparql.query(kb, "SELECT ?a ?b WHERE { ?a :instance_of :supplier . ?b :instance_of :supplier . ?a :part_of ?n . ?b :part_of ?n . FILTER (?a != ?b) }"))
    assert _bag(found, "a", "b") == Counter((f"S{x}", f"S{y}") for x in range(6) for y in range(6) if x != y and x % 2 == y % 2)
    assert any("__slice#" in j and "(n#" in j for j in _joins(found))


def test_relation_variables_limit_the_next_edge(spark):
    """the bindings of one relation variable limit the other's edge, and the matches are not grouped again."""
    rows = [(f"O{k}", "placed_by", f"C{k}") for k in range(4)] + [(f"O{k}", "contains", f"P{j}") for k in range(4) for j in range(3)]
    kb = kb_of(spark, [*rows, ("placed_by", "opposite_of", "contains"), ("placed_by", "checked", "yes")])
    other = RelVar("other")
    found = match(kb, Pattern([Edge(Var("x"), RelVar("one", (("opposite_of", other), ("checked", "yes"))), Var("y")), Edge(Var("x"), other, Var("z"))]))
    assert not _plan(found).startswith("Aggregate")
    assert any("(x#" in j and "(other#" in j for j in _joins(found))
    assert _bag(found, "x", "y", "z") == Counter((f"O{k}", f"C{k}", f"P{j}") for k in range(4) for j in range(3))


def test_scopes_are_lowered_without_what_is_not_asked(spark):
    """a predicate of scopes is read without the others' rows and without making ids; repeated rows give one."""
    from factloom.operators import scopes
    from factloom.plans.tables import local

    frames = local(spark, [("a/setting", "SETTING", "a", "setting")] * 2 + [("a/premise", "PREMISE", "a", "premise")], scopes.SCOPES)
    variables = local(spark, [("a/setting#x", "x", "thing", "a/setting", None, "univ_quant")] * 2, scopes.VARIABLES)
    statements = local(spark, [("a/setting#x", "likes", "E", "C1", "a/premise", 0, None, 3)] * 2 + [("a/setting#x", "likes", "E", "C1", "a/premise", 1, None, None)], scopes.STATEMENTS)
    kb = scopes.add(kb_of(spark, [("C1", "part_of", "N1")]), frames.repartition(2), variables.repartition(2), statements.repartition(2))
    rows, qualifiers = kb.statements.collect(), kb.qualifiers.collect()
    assert len({r["stm_id"] for r in rows}) == len(rows) == 1 + 2 * 3 + 3 + 2
    assert Counter(q["p"] for q in qualifiers) == {"defining_scope": 3, "graph_mode": 1, "univ_quant": 1}
    assert {q["stm_id"] for q in qualifiers} <= {r["stm_id"] for r in rows}
    plan = _plan(kb.of("scope_type").select("s", "o_lex"))
    assert "sha2" not in plan and plan.count("Aggregate") == 1
    assert _bag(scopes.excess(kb, {"PREMISE": 0, "SETTING": 1}), "parent", "kind", "n") == Counter([("a", "PREMISE", 1)])


def test_equal_calls_are_found_by_their_arguments(spark):
    """calls are made distinct before they are named."""
    from factloom.operators.expressions import evaluated

    calls = spark.createDataFrame([(["P1", "S1"],), (["P1", "S1"],), (["P1", "S2"],)], "args array<string>")
    made = evaluated(calls, "op")
    aggregate = next(line for line in _plan(made).splitlines() if "Aggregate" in line)
    assert "sha2" not in aggregate.split("],")[0]
    assert _bag(made.select("args", "mapping").select(F.array_join("args", ",").alias("a")), "a") == Counter([("P1,S1",), ("P1,S2",)])



def test_a_call_is_stored_as_one_row(spark):
    """statements about calls are made of the calls' rows, and those of one result are joined where they lie."""
    from factloom.operators import calls

    kb = kb_of(spark, [("add", "range", "number"), ("add", "range", "sum"), ("add", "range", "number")])
    asked = spark.createDataFrame([("add", [f"I{k % 9}", "n:2.0"]) for k in range(20)], "operator string, args array<string>")
    after, made = calls.call(kb, asked)
    of = lambda p: after.of(p).select(F.col("s").alias("result"), F.col("o").alias(p))
    both = of("applied_mapping_of").hint("merge").join(of("has_arguments"), "result").join(of("instance_of").hint("merge"), "result")
    assert "Exchange hashpartitioning(result" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == made.count() == 9 and {r["instance_of"] for r in both.collect()} == {"number"}
    again, twice = calls.call(after, asked)
    assert twice.count() == 9 and twice.where("made").isEmpty() and again.of("secondary_instance_of").count() == 9


def _paths(edges):
    """{(a, b): hops} by plain Python."""
    found, new, hops = {}, {(a, b) for a, b in edges}, 1
    while new:
        found |= dict.fromkeys(new, hops)
        hops += 1
        new = {(a, d) for a, b in new for c, d in edges if b == c} - set(found)
    return found


TREE = [(f"P{k}", f"P{k // 2}") for k in range(1, 40)]
GRAPHS = {"up": TREE, "down": [(b, a) for a, b in TREE], "ring": [*TREE, ("P0", "P9")], "both ways": [*TREE, ("P30", "P2"), ("P1", "P1")]}


@pytest.mark.parametrize(("name", "reflexive"), [("up", False), ("down", True), ("ring", True), ("both ways", False)])
def test_paths_are_doubled(spark, monkeypatch, name, reflexive):
    """as many rounds as the depth has binary digits where each node has one way on, and no joins that go through the driver."""
    from factloom.operators import closure

    tables, written = [], closure.written
    monkeypatch.setattr(closure, "written", lambda df, table: (tables.append((table, df._jdf.queryExecution().executedPlan().toString())), written(df, table))[1])
    edges = spark.createDataFrame(GRAPHS[name], "a string, b string")
    found = closure.transitive_closure(edges, reflexive=reflexive)
    want = _paths(GRAPHS[name])
    if reflexive:
        want = {k: n for k, n in want.items() if k[0] != k[1]} | {(x, x): 0 for e in GRAPHS[name] for x in e}
    assert _bag(found, "a", "b", "hops") == Counter((a, b, n) for (a, b), n in want.items())
    assert not any("Broadcast" in plan for _, plan in tables)
    assert name not in ("up", "down") or sum(t == "closure" for t, _ in tables) <= 5


@pytest.mark.parametrize(("name", "injective"), [("down", True), ("ring", False), ("both ways", True)])
def test_a_transitive_rule_finds_a_pair_once(spark, monkeypatch, name, injective):
    """the rule's pairs are joined by the node half-way, not by every node between; another rule goes on from them."""
    from factloom.operators import fixpoint

    x, y, z = Var("x"), Var("y"), Var("z")
    tables, written = [], fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda df, table: (tables.append(table), written(df, table))[1])
    given = rules.Rule("t", [Pattern([Edge(y, "r", z), Edge(x, "r", y)], injective=injective)], [rules.Template(x, "r", z)])
    back = rules.Rule("back", [Pattern([Edge(x, "r", y)])], [rules.Template(y, "above", x)])
    rows, rounds, stop = fixpoint.derived(kb_of(spark, [(a, "r", b) for a, b in GRAPHS[name]]) if injective else _void(spark, GRAPHS[name]), [given, back])
    want = set(_paths([(a, b) for a, b in GRAPHS[name] if not injective or a != b]))
    want = {(a, b) for a, b in want if not injective or a != b}
    assert _bag(rows, "s", "p", "o") == Counter([(a, "r", b) for a, b in want - set(GRAPHS[name])] + [(b, "above", a) for a, b in want if a != b])
    assert stop is None and (name == "both ways" or tables.count("round") <= 2)


def _void(spark, edges):
    """A knowledge base that cannot have scopes, as the star schema is."""
    kb = kb_of(spark, [(a, "r", b) for a, b in edges])
    return kb.but(entities=kb.entities.drop("scope").withColumn("scope", F.lit(None)), parts=None)


def test_qualifiers_are_moved_once(spark):
    """A statement's qualifiers meet by a short id, and are not sorted and grouped before they are moved."""
    from factloom.operators import lookup
    from factloom.plans.model import QUALIFIER, content_id
    from factloom.plans.tables import local

    rows = [("a", "a2", 2, "quantity", "L", "n:2.0", "float", "2.0", None), ("a", "a1", 1, "quantity", "L", "n:1.0", "float", "1.0", None), ("b", "b1", 5, "quantity", "L", "n:5.0", "float", "5.0", None)]
    kb = kb_of(spark, [("I1", "r", "I2")])
    first = lookup.first_qualifiers(kb.but(qualifiers=local(spark, rows, QUALIFIER).repartition(3)), "quantity")
    assert _bag(first, "stm_id", "o") == Counter([("a", "n:1.0"), ("b", "n:5.0")])
    plan = first._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = lambda text: max(k for k, line in enumerate(plan) if text in line)
    assert at("Exchange hashpartitioning(stm_id") > at("partial_min_by")
    ids = spark.range(3).select(content_id(F.col("id"), F.when(F.col("id") > 0, "x")).alias("id"))
    assert {len(r["id"]) for r in ids.collect()} == {32} and ids.distinct().count() == 3


def test_content_ids_are_computed_once_for_a_join(spark):
    """a null filter of the join would compute the hash of each row a second time."""
    rows = spark.range(20).selectExpr("id", "nullif(id % 3, 0) AS k")
    left, right = (rows.select(content_id(F.col("id"), F.lit("p"), F.col("k")).alias("stm_id"), F.col("id").alias(c)) for c in "ab")
    found = left.join(right, "stm_id")
    assert _plan(found).count("sha2(") == 2
    assert sorted(tuple(r) for r in found.select("a", "b").collect()) == [(k, k) for k in range(20)]
    assert {len(r[0]) for r in found.select("stm_id").collect()} == {32}


def test_elements_of_calls_are_not_moved_by_statement(spark):
    """What is read back of calls is put together by tuple; no statement is moved by its id to find an element's place."""
    import __spark_entry__

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()["operator_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("(stm_id" in line for line in dealt)
