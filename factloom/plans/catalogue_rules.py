"""Queries of stored rules, relation variables, hypotheses and scopes over the star schema, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import authoring, calls, checks, compiler, fixpoint, modules, rules, scopes
from ..operators.pattern import Edge, Ent, LitVar, Pattern, RelVar, Var, first_matches, match
from .catalogue import ORACLE_SQL, QUERIES, _q, _s
from .model import KB, constants, statement
from .tables import local, written

_UNCONNECTED = "part_of supplied_by placed_by contains parent".split()


def _facts(kb: KB, rows: list[tuple[str, str, str]], *, relations: tuple[str, ...] = ()) -> KB:
    """``kb`` with a few statements between entities, and entities of some relations."""
    spark = kb.spark
    facts = constants(spark, rows, ["s", "p", "o"])
    parts = None
    for p in dict.fromkeys(r[1] for r in rows):
        some = facts.where(F.col("p") == p).select(*statement(F.col("s"), p, F.col("o")))
        parts = some if parts is None else parts.unionByName(some)
    entities = local(spark, [(r, "R", False, None, "star", False) for r in relations], "uri string, etype string, is_auto boolean, scope string, mod string, unlinked boolean") if relations else None
    return kb.plus(parts, entities, bag=False)


def _derived(kb: KB, author: scopes.Scopes, **more) -> DataFrame:
    """What the one stored rule of an author asserts."""
    stored = author.rule(kb, **more)
    (rule,) = compiler.stored_rules(stored)
    return rules.delta(stored, rule)


# rules from the store


@_q("SELECT 'O'||o_orderkey AS s, 'goes_to' AS p, 'N'||c_nationkey AS o FROM orders JOIN customer ON c_custkey = o_custkey")
def stored_rule_single(kb):
    own = scopes.Scopes("rule_goes_to")
    with own.scope("setting"):
        own.new_var("order"), own.new_var("customer"), own.new_var("nation")
    with own.scope("premise"):
        own.add_all([(own.order, "placed_by", own.customer), (own.customer, "part_of", own.nation)])
    with own.scope("assertion"):
        own.new_rel(own.order, "goes_to", own.nation, mode=scopes.ONLY_NEW)
    return _derived(kb, own).select("s", "p", "o")


@_q("SELECT 'C'||c_custkey AS s, 'N'||c_nationkey AS o FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'C'||c_custkey, 'N'||c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'S'||s_suppkey, 'N'||s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
def stored_rule_or(kb):
    """Each alternative of an OR scope is a branch; what satisfies two comes twice. One alternative needs a variable of its own entity."""
    own = scopes.Scopes("rule_targets")
    with own.scope("setting"):
        own.new_var("customer"), own.new_var("nation")
        own.uses_external("R2")
        own.new_rel(own.customer, "part_of", own.nation)
    with own.scope("premise"), own.scope("OR"):
        own.new_rel(own.customer, "segment", scopes.Text("BUILDING"))
        own.new_rel(own.nation, "part_of", "R2")
    with own.scope("assertion"):
        own.new_rel(own.customer, "targeted_in", own.nation)
    return _derived(kb, own).select("s", "o")


@_q(
    "WITH l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT 'P'||p_partkey AS s, 'S'||l_suppkey AS o FROM part JOIN l ON l_partkey = p_partkey WHERE p_size = 7 "
    "UNION ALL SELECT 'P'||p_partkey, 'S'||l_suppkey FROM part JOIN l ON l_partkey = p_partkey WHERE p_brand = 'Brand#13' AND p_size = 9 "
    "UNION ALL SELECT 'P'||p_partkey, 'S'||l_suppkey FROM part JOIN l ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand = 'Brand#13' AND s_nationkey = 3"
)
def stored_rule_and_in_or(kb):
    """OR of a statement and of two AND scopes, the second of which has an OR with one alternative below it."""
    own = scopes.Scopes("rule_offers")
    with own.scope("setting"):
        own.new_var("part"), own.new_var("supplier")
        own.uses_external("N3")
    with own.scope("premise"):
        own.new_rel(own.part, "supplied_by", own.supplier)
        with own.scope("OR"):
            own.new_rel(own.part, "size", 7)
            with own.sub("AND"):
                own.add_all([(own.part, "brand", scopes.Text("Brand#13")), (own.part, "size", 9)])
            with own.sub("AND"):
                own.new_rel(own.part, "brand", scopes.Text("Brand#13"))
                with own.sub("OR"):
                    own.new_rel(own.supplier, "part_of", "N3")
    with own.scope("assertion"):
        own.new_rel(own.part, "offered_by", own.supplier)
    return _derived(kb, own).select("s", "o")


@_q("SELECT 'C'||c_custkey AS s, 'R'||r_regionkey AS o FROM customer, region WHERE c_nationkey = 7 UNION ALL SELECT 'S'||s_suppkey, 'R'||r_regionkey FROM supplier, region WHERE s_nationkey = 7")
def stored_rule_two_components(kb):
    own = scopes.Scopes("rule_may_ship")
    with own.scope("setting"):
        own.new_var("customer"), own.new_var("somewhere")
        own.uses_external("N7", "region")
    with own.scope("premise"):
        own.add_all([(own.customer, "part_of", "N7"), (own.somewhere, "instance_of", "region")])
    with own.scope("assertion"):
        own.new_rel(own.customer, "may_ship_to", own.somewhere)
    return _derived(kb, own, components=2).select("s", "o")


@_q("SELECT 'P'||a.p_partkey AS s, 'P'||b.p_partkey AS o, 'P'||a.p_partkey||' is smaller than P'||b.p_partkey AS explanation FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey > 0 AND a.p_size < b.p_size")
def stored_rule_condition(kb):
    """Literal variables, a condition called by the premise, and the explanation of each derived statement."""
    own = scopes.Scopes("rule_smaller")
    with own.scope("setting"):
        own.new_var("part"), own.new_var("above"), own.new_literal_var("a"), own.new_literal_var("b")
    with own.scope("premise"):
        own.add_all([(own.part, "parent", own.above), (own.part, "size", own.a), (own.above, "size", own.b)])
        own.call("test", "less", own.a, own.b, condition=True)
    with own.scope("assertion"):
        own.new_rel(own.part, "smaller_than", own.above)
    stored = own.rule(kb, explanation="{part} is smaller than {above}")
    (rule,) = compiler.stored_rules(stored)
    return rules.explained(rules.delta(stored, rule), rule).select("s", "o", "explanation")


@_q("SELECT 'C'||c_custkey AS s, 'account' AS cls FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'S'||s_suppkey, 'account' FROM supplier WHERE s_nationkey = 4")
def stored_rule_new_entity(kb):
    """An entity made for each match is the object of one asserted statement and the subject of another."""
    own = scopes.Scopes("rule_account")
    with own.scope("setting"):
        own.new_var("customer")
        own.uses_external("N4", "account")
    with own.scope("premise"):
        own.new_rel(own.customer, "part_of", "N4")
    with own.scope("assertion"):
        own.call("account", "new_entity", own.customer)
        own.new_rel(own.customer, "has_account", own.account)
        own.new_rel(own.account, "instance_of", "account")
    stored = own.rule(kb)
    after, made = rules.apply(stored, compiler.stored_rules(stored)[0])
    links = made.where("p = 'has_account'").select("s", F.col("o").alias("made"))
    return links.join(after.of("instance_of").select(F.col("s").alias("made"), F.col("o").alias("cls")), "made").select("s", "cls")


@_q(
    "SELECT 'P'||a.p_partkey AS s, 'P'||c.p_partkey AS o FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 JOIN part c ON c.p_partkey = b.p_partkey // 2 WHERE a.p_partkey > 1 AND a.p_size = c.p_size"
)
def stored_rules_chain(kb):
    """Two stored rules in a fixpoint: the second one's premise is what the first asserts."""
    first, second = scopes.Scopes("rule_grand"), scopes.Scopes("rule_alike")
    with first.scope("setting"):
        first.new_var("a"), first.new_var("b"), first.new_var("c")
    with first.scope("premise"):
        first.add_all([(first.a, "parent", first.b), (first.b, "parent", first.c)])
    with first.scope("assertion"):
        first.new_rel(first.a, "grand", first.c, mode=scopes.ONLY_NEW)
    with second.scope("setting"):
        second.new_var("a"), second.new_var("c"), second.new_literal_var("size")
    with second.scope("premise"):
        second.add_all([(second.a, "grand", second.c), (second.a, "size", second.size), (second.c, "size", second.size)])
    with second.scope("assertion"):
        second.new_rel(second.a, "alike", second.c, mode=scopes.ONLY_NEW)
    stored = second.rule(first.rule(kb.only("parent", "size")))
    after, _, _ = rules.fixpoint(stored, compiler.stored_rules(stored))
    return after.of("alike").where("scope IS NULL").select("s", "o")  # the rule's own template lies in its scope


# relation variables


@_q("SELECT 'C'||o_custkey AS s, 'ordered' AS p, 'O'||o_orderkey AS o FROM orders UNION ALL SELECT DISTINCT 'S'||l_suppkey, 'supplies', 'P'||l_partkey FROM lineitem")
def stored_rule_inverse_relations(kb):
    """A relation variable whose property is another one: each statement of a relation with an inverse, the other way round."""
    own = scopes.Scopes("rule_inverse")
    with own.scope("setting"):
        own.new_var("x"), own.new_var("y"), own.new_rel_var("forth"), own.new_rel_var("back")
        own.new_rel(own.forth, "inverse_of", own.back)
    with own.scope("premise"):
        own.new_rel(own.x, "", own.y, proxy=own.forth)
    with own.scope("assertion"):
        own.new_rel(own.y, "", own.x, proxy=own.back, mode=scopes.ONLY_NEW)
    known = _facts(kb, [("placed_by", "inverse_of", "ordered"), ("supplied_by", "inverse_of", "supplies"), ("contains", "inverse_of", "C7")], relations=("ordered", "supplies"))
    return _derived(known, own).select("s", "p", "o")


@_q("SELECT DISTINCT 'O'||o_orderkey AS x, 'C'||o_custkey AS y, 'P'||l_partkey AS z, 'placed_by' AS one, 'contains' AS other FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def pattern_opposite_relations(kb):
    """Two relation variables, tied to each other by a property, over two edges of one subject."""
    other = RelVar("other")
    one = RelVar("one", (("opposite_of", other), ("checked", "yes")))
    known = _facts(kb, [("placed_by", "opposite_of", "contains"), ("contains", "opposite_of", "placed_by"), ("parent", "opposite_of", "part_of"), ("placed_by", "checked", "yes"), ("parent", "checked", "yes")])
    return match(known, Pattern([Edge(Var("x"), one, Var("y")), Edge(Var("x"), other, Var("z"))]))


@_q("SELECT 'C'||c_custkey AS x, 'part_of' AS rel, 'N'||c_nationkey AS y FROM customer UNION ALL SELECT 'S'||s_suppkey, 'part_of', 'N'||s_nationkey FROM supplier UNION ALL SELECT 'O'||o_orderkey, 'placed_by', 'C'||o_custkey FROM orders")
def pattern_range_class(kb):
    """A relation variable whose edges' objects must be of the relation's range: what a nation is part of is left out."""
    known = _facts(kb, [("part_of", "range", "nation"), ("placed_by", "range", "customer"), ("parent", "range", "customer"), *((r, "is_checked", "yes") for r in ("part_of", "placed_by", "parent"))])
    rel = RelVar("rel", (("is_checked", "yes"),), range_of="range")
    return match(known, Pattern([Edge(Var("x"), rel, Var("y"))], strict_single_edge=True))


@_q("SELECT x, y, place, cut FROM (SELECT 'C'||c_custkey AS x, 'N'||c_nationkey AS y, row_number() OVER (ORDER BY '{\"x\":\"C'||c_custkey||'\",\"y\":\"N'||c_nationkey||'\"}') AS place, count(*) OVER () > 40 AS cut FROM customer WHERE c_mktsegment = 'BUILDING') WHERE place <= 40")
def pattern_first_matches(kb):
    """The first forty matches in a stable order, and whether there are more."""
    found = match(kb, Pattern([Edge(Var("x"), "part_of", Var("y")), Edge(Var("x"), "segment", LitVar("z"))], conditions=[lambda df: F.col("z") == "s:BUILDING"]))
    return first_matches(found.select("x", "y"), 40)


# hypotheses

_SEGMENTS = "(SELECT DISTINCT c_mktsegment AS g FROM customer)"
_HYPOTHESES = f"""
WITH few AS (SELECT n_nationkey AS n, g FROM nation, {_SEGMENTS} WHERE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = g) < 8),
open_ AS (
    SELECT 'wants' AS relation, c_custkey AS c, 'G_'||g AS o FROM customer, {_SEGMENTS} WHERE g <> c_mktsegment AND NOT (c_custkey % 3 = 0 AND g > 'B')
    UNION ALL SELECT 'pays', c_custkey, o FROM customer, (VALUES ('cash'), ('credit')) t(o) WHERE NOT (c_custkey % 5 = 0 AND o = 'cash')),
sized AS (SELECT relation, c, count(*) AS n FROM open_ GROUP BY ALL HAVING count(*) > 1),
chosen AS (SELECT c, arg_min(relation, (n, relation)) AS relation FROM sized GROUP BY c),
tried AS (SELECT * FROM (SELECT relation, c, o, row_number() OVER (PARTITION BY relation, c ORDER BY o) AS k FROM open_ JOIN chosen USING (relation, c)) WHERE k > 1),
facts AS (SELECT relation, 'C'||c AS s, o, c_nationkey AS n, c FROM tried JOIN customer ON c_custkey = c)
"""


@_q(
    _HYPOTHESES + "SELECT s, relation, o, 'N'||facts.n||' lacks '||o AS message FROM facts JOIN few ON few.n = facts.n AND o = 'G_'||g WHERE relation = 'wants' "
    "UNION ALL SELECT s, relation, o, 'N'||facts.n||' has no '||o FROM facts WHERE relation = 'pays' AND n % 2 = 0 AND o = 'credit'"
)
def hypothesis_refuted(kb):
    """For each customer its smallest open choice; every object but the first is a branch of one fixpoint, and these end in a contradiction.

    A customer may want each segment but its own, a third of them fewer ones, and pay cash or on credit, a fifth of them not cash.
    Two rules carry what is supposed to the customer's nation; two others find the nations that cannot serve it.
    """
    spark = kb.spark
    segments = kb.of("segment").select(F.concat(F.lit("G_"), "o_lex").alias("o")).distinct()
    customers = kb.of("segment").select("s", F.expr("cast(substring(s, 2) as long)").alias("c"), F.concat(F.lit("G_"), "o_lex").alias("own"))
    ways = constants(spark, [("cash",), ("credit",)], ["o"])
    wants = customers.select("s").crossJoin(F.broadcast(segments)).select(F.lit("wants").alias("relation"), F.lit("wants_not").alias("negative"), "s", "o")  # a few segments each
    pays = customers.select("s").crossJoin(F.broadcast(ways)).select(F.lit("pays").alias("relation"), F.lit("pays_not").alias("negative"), "s", "o")
    third = customers.where("c % 3 = 0").select("s").crossJoin(F.broadcast(segments.where("o > 'G_B'")))
    negative = customers.select("s", F.col("own").alias("o")).unionByName(third).distinct().select(*statement(F.col("s"), "wants_not", F.col("o")))
    negative = negative.unionByName(customers.where("c % 5 = 0").select(*statement(F.col("s"), "pays_not", F.lit("cash"))))
    located = kb.of("part_of").where("s LIKE 'C%'").select("s", F.col("o").alias("n"))
    served = customers.join(located, "s").groupBy("n", F.col("own").alias("g")).count().where("count >= 8").select("n", "g")
    nations = kb.of("instance_of").where("o = 'nation'").select(F.col("s").alias("n"))
    lacks = nations.crossJoin(F.broadcast(segments.withColumnRenamed("o", "g"))).join(served, ["n", "g"], "left_anti").select(*statement(F.col("n"), "lacks", F.col("g")))
    cashless = nations.where("cast(substring(n, 2) as long) % 2 = 0").select(*statement(F.col("n"), "lacks", F.lit("credit")))
    base = kb.only("part_of").plus(negative.unionByName(lacks).unionByName(cashless), bag=False)
    x, n, g = Var("x"), Var("n"), Var("g")
    carry = [rules.Rule(f"carry_{p}", [Pattern([Edge(x, p, g), Edge(x, "part_of", n)])], [rules.Template(n, f"asked_{p}", g)]) for p in ("wants", "pays")]
    ends = [rules.Rule(f"no_{p}", [Pattern([Edge(n, f"asked_{p}", g), Edge(n, "lacks", g)])], stop=rules.Contradiction, message=text) for p, text in (("wants", "{n} lacks {g}"), ("pays", "{n} has no {g}"))]
    tried = fixpoint.choices(fixpoint.open_candidates(base, wants.unionByName(pays)), per="s").where("place > 0")
    branch = F.concat_ws(" ", "s", "relation", "o")
    found = fixpoint.suppose(base, [*carry, *ends], tried.select(branch.alias("branch"), "s", F.col("relation").alias("p"), F.lit("E").alias("o_kind"), "o"))
    named = F.split("branch", " ")
    return found.outcomes.where("outcome = 'refuted'").select(named[0].alias("s"), named[1].alias("relation"), named[2].alias("o"), "message")


# scopes


def _order_scopes(kb: KB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A statement about each order in words: of a setting with two variables, a premise and an assertion."""
    orders = kb.of("placed_by").select(F.col("s").alias("owner"), F.col("o").alias("customer"))
    at = lambda name: F.concat("owner", F.lit(f"/{name}"))
    var = lambda name: F.concat("owner", F.lit(f"/setting#{name}"))
    frames = [orders.select(at(k).alias("scope"), F.lit(k.upper()).alias("kind"), F.col("owner").alias("parent"), F.lit(k).alias("name")) for k in ("setting", "premise", "assertion")]
    variables = [orders.select(var(n).alias("variable"), F.lit(n).alias("name"), F.lit(cls).alias("cls"), at("setting").alias("scope"), F.lit(None).cast("int").alias("mode"), F.lit("univ_quant").alias("quantifier")) for n, cls in (("order", "document"), ("buyer", "party"))]
    null = F.lit(None)
    row = lambda s, p, o, scope: orders.select(s.alias("s"), F.lit(p).alias("p"), F.lit("E").alias("o_kind"), o.alias("o"), at(scope).alias("scope"), F.lit(0).cast("long").alias("seq"), null.cast("string").alias("proxy"), null.cast("int").alias("mode"))
    statements = [row(var("order"), "placed_by", var("buyer"), "premise"), row(var("buyer"), "same_as", F.col("customer"), "premise"), row(var("order"), "owed_by", var("buyer"), "assertion")]
    union = lambda frames: frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0].unionByName(frames[1]).unionByName(frames[2])
    return union(frames), union(variables), union(statements)


@_q(
    "SELECT 'O'||o_orderkey AS owner, 'PREMISE' AS kind, 'order' AS subject, 'placed_by' AS p, 'buyer' AS object FROM orders UNION ALL SELECT 'O'||o_orderkey, 'PREMISE', 'buyer', 'same_as', 'C'||o_custkey FROM orders "
    "UNION ALL SELECT 'O'||o_orderkey, 'ASSERTION', 'order', 'owed_by', 'buyer' FROM orders UNION ALL SELECT 'O'||o_orderkey, 'SETTING', 'order', 'instance_of', 'document' FROM orders UNION ALL SELECT 'O'||o_orderkey, 'SETTING', 'buyer', 'instance_of', 'party' FROM orders"
)
def scope_statements(kb):
    """Scopes of every order lowered to statements, and read back: each statement of a scope with its variables by name."""
    stored = scopes.add(kb.only("nothing"), *_order_scopes(kb))
    names = scopes.variables_of(stored).select("variable", "name")
    inside = stored.scoped.join(scopes.scopes_of(stored).select("scope", "kind", F.col("parent").alias("owner")), "scope")
    named = inside.join(names.select(F.col("variable").alias("s"), F.col("name").alias("subject")), "s").join(names.select(F.col("variable").alias("o"), F.col("name").alias("object")), "o", "left")
    return named.select("owner", "kind", "subject", "p", F.coalesce("object", "o").alias("object"))


@_q("SELECT 'O'||o_orderkey AS owner, kind, name, 2 AS quantified FROM orders, (VALUES ('PREMISE'), ('ASSERTION'), ('SETTING')) k(kind), (VALUES ('order'), ('buyer')) v(name)")
def scope_setting_variables(kb):
    """What the variables of the setting beside it are for each scope, and how many of the owner's class statements are quantified."""
    stored = scopes.add(kb.only("nothing"), *_order_scopes(kb))
    owners = scopes.scopes_of(stored).select("scope", "kind", F.col("parent").alias("owner"))
    quantified = stored.qualifiers.where("p = 'univ_quant'").join(stored.of("instance_of").select("stm_id", "scope"), "stm_id").join(owners, "scope").groupBy("owner").agg(F.count(F.lit(1)).cast("int").alias("quantified"))
    return scopes.setting_variables(stored).join(owners, "scope").join(quantified, "owner").select("owner", "kind", "name", "quantified")


@_q("SELECT 'P'||p_partkey AS part, 'neg(mul(add(u,v),u))' AS expression, 'u heavier v' AS fact, 3 AS mappings FROM part UNION ALL SELECT 'P'||p_partkey||'B', 'neg(mul(add(u,v),u))', 'u heavier v', 3 FROM part")
def scope_copy_expression(kb):
    """A setting with an expression of depth three in each part's scope, copied twice: two copies with fresh ids, and equal mappings only once.

    In the source add(u, v) is there twice under two names; a copy has it once.
    """
    parts = kb.of("size").select(F.col("s").alias("part"))
    source, variable = F.concat("part", F.lit("/setting")), lambda name: F.concat("part", F.lit(f"/setting#{name}"))
    null, text = F.lit(None), "string"
    owners = parts.select("part", source.alias("scope")).unionByName(parts.select(F.concat("part", F.lit("B")).alias("part"), F.concat("part", F.lit("B/setting")).alias("scope")))
    sources = parts.select(F.concat("part", F.lit("S/setting")).alias("scope"), F.concat("part", F.lit("S")).alias("part"))
    frames = owners.select("part", "scope").unionByName(sources.select("part", "scope")).select("scope", F.lit("SETTING").alias("kind"), F.col("part").alias("parent"), F.lit("setting").alias("name"))
    own = parts.select(F.concat("part", F.lit("S")).alias("part"))
    names = ("u", "v", "sum", "again", "product", "minus")
    variables = own.select(source.alias("scope"), F.explode(F.array(*[F.struct(variable(n).alias("variable"), F.lit(n).alias("name")) for n in names])).alias("x")).select("x.variable", "x.name", null.cast(text).alias("cls"), "scope", null.cast("int").alias("mode"), null.cast(text).alias("quantifier"))
    triples = [("sum", "applied_mapping_of", F.lit("add"), 0), ("sum", "has_argument", variable("u"), 0), ("sum", "has_argument", variable("v"), 1), ("again", "applied_mapping_of", F.lit("add"), 0), ("again", "has_argument", variable("u"), 0), ("again", "has_argument", variable("v"), 1)]
    triples += [("product", "applied_mapping_of", F.lit("mul"), 0), ("product", "has_argument", variable("sum"), 0), ("product", "has_argument", variable("u"), 1), ("minus", "applied_mapping_of", F.lit("neg"), 0), ("minus", "has_argument", variable("product"), 0)]
    rows = own.select(source.alias("scope"), F.explode(F.array(*[F.struct(variable(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).cast("long").alias("seq"), F.lit(False).alias("inside")) for s, p, o, k in triples], F.struct(variable("u").alias("s"), F.lit("heavier").alias("p"), variable("v").alias("o"), F.lit(9).cast("long").alias("seq"), F.lit(True).alias("inside")))).alias("x"))
    statements = rows.select("x.s", "x.p", F.lit("E").alias("o_kind"), "x.o", F.when(F.col("x.inside"), F.col("scope")).alias("scope"), "x.seq", null.cast(text).alias("proxy"), null.cast("int").alias("mode"))
    stored = scopes.add(kb.only("nothing"), frames, variables, statements).stored()
    copies = parts.select(F.concat("part", F.lit("S/setting")).alias("source"), F.explode(F.array(source, F.concat("part", F.lit("B/setting")))).alias("target"))
    after = scopes.copy_scopes(stored, copies)[0]
    # read the copies back: the text of each mapping from those of its arguments, from the innermost outwards
    ours = lambda p: after.of(p).where("mod = 'copies'")
    made = after.entities.where("mod = 'copies'").select(F.col("uri").alias("node"), F.col("scope").alias("target"))
    operators = written(made.join(ours("applied_mapping_of").select(F.col("s").alias("node"), F.col("o").alias("operator")), "node"), "operators", compression="zstd")
    leaves = made.join(scopes.variables_of(after).where("name IN ('u', 'v')").select(F.col("variable").alias("node"), "name"), "node").select("node", "target", F.col("name").alias("text"))
    leaves = written(leaves, "leaves", compression="zstd")
    arguments = ours("has_argument").select(F.col("s").alias("node"), "seq", "o").join(operators, "node")
    texts = leaves.select("node", "text")
    for _ in range(3):
        listed = arguments.join(texts.select(F.col("node").alias("o"), "text"), "o").groupBy("node", "target", "operator").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ",").alias("inner"))
        outer = listed.select("node", "target", F.concat("operator", F.lit("("), "inner", F.lit(")")).alias("text"))
        texts = leaves.select("node", "text").unionByName(outer.select("node", "text"))
    whole = outer.where("text LIKE 'neg%'").select("target", F.col("text").alias("expression"))
    counted = operators.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("mappings"))
    named = lambda node, name: leaves.select(F.col("node").alias(node), F.col("text").alias(name))
    facts = ours("heavier").join(named("s", "a"), "s").join(named("o", "b"), "o").select(F.col("scope").alias("target"), F.concat_ws(" ", "a", F.lit("heavier"), "b").alias("fact"))
    return whole.join(counted, "target").join(facts, "target").select(F.expr("substring_index(target, '/', 1)").alias("part"), "expression", "fact", "mappings")



# modules and authoring

_BASE, _CURRENT = "x:/base", "x:/parts"


def _authoring_base(kb: KB) -> KB:
    """Relations and entities of two modules: R1 to R4 of the base, and R4 and a colour of the current one."""
    spark = kb.spark
    relations = [(f"{_BASE}#R1", "has label"), (f"{_BASE}#R2", "has description"), (f"{_BASE}#R3", "has alias"), (f"{_BASE}#R4", "is instance of"), (f"{_CURRENT}#R4", "has size")]
    entities = local(spark, [(u, "R", False, None, u.split("#")[0], False) for u, _ in relations] + [(f"{_BASE}#I9", "I", False, None, _BASE, False)], "uri string, etype string, is_auto boolean, scope string, mod string, unlinked boolean")
    rows = None
    literal = {"kind": "L"}
    marks = [(f"{_BASE}#R1", authoring.PER_LANGUAGE), (f"{_BASE}#R1", authoring.LITERAL_RANGE), (f"{_BASE}#R2", authoring.LITERAL_RANGE), (f"{_BASE}#R3", authoring.LITERAL_RANGE), (f"{_CURRENT}#R4", authoring.FUNCTIONAL)]
    for df, p, o_type in ((constants(spark, relations, ["s", "o"]), "label", "str"), *((constants(spark, [(s, "1")], ["s", "o"]), m, "int") for s, m in marks)):
        some = df.select(*statement(F.col("s"), p, F.col("o"), o_type=o_type, **literal))
        rows = some if rows is None else rows.unionByName(some)
    return KB(rows, entities, local(spark, [], "stm_id string, q_stm_id string, seq long, p string, o_kind string, o string, o_type string, o_lex string, o_lang string"))


def _authored_rows(source: DataFrame, subject, fields: list[tuple]) -> DataFrame:
    """Rows of (key, [(text, kind, language)], listed) for each row of ``source``."""
    out = None
    for n, (key, values, listed) in enumerate(fields):
        cells = F.array(*[F.struct(lex.cast("string").alias("lex"), F.lit(kind).alias("kind"), (F.lit(lang) if lang is None or isinstance(lang, str) else lang).cast("string").alias("lang")) for lex, kind, lang in values])
        some = source.select(subject.alias("subject"), F.lit(n).cast("long").alias("seq"), F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), cells.alias("values"), F.lit(listed).alias("listed"))
        out = some if out is None else out.unionByName(some)
    return out


def _part_rows(kb: KB) -> DataFrame:
    """What an author writes about each part, with mistakes in some: in several spellings, languages and lists."""
    parts = kb.of("label").where("s LIKE 'P%'").select("s", F.expr("cast(substring(s, 2) as long)").alias("k"), "o_lex").join(kb.of("size").select("s", F.col("o_lex").alias("size")), "s")
    german = F.concat(F.lit("Teil "), F.col("k").cast("string"))
    size_key = F.when(F.col("k") % 5 == 0, "R4__has_size").when(F.col("k") % 5 == 1, 'R4["has size"]').when(F.col("k") % 5 == 2, "pt__R4__has_size").when(F.col("k") % 5 == 3, "R4").otherwise(F.when(F.col("k") % 2 == 0, "R4__has_colour").otherwise("zz__R4"))
    first = F.when(F.col("k") % 7 == 0, "R1__has_label__de").otherwise("R1__has_label")
    second = F.when(F.col("k") % 7 == 0, "R1__has_label").otherwise("R1__has_label__de")
    fields = [(first, [(F.col("o_lex"), "str", None)], False), (second, [(german, "str", None)], False), ("R3", [(F.concat(F.lit("a"), F.col("k").cast("string")), "str", None), (F.concat(F.lit("b"), F.col("k").cast("string")), "str", None)], True), (size_key, [(F.col("size"), "int", None)], False)]
    return _authored_rows(parts, F.concat(F.lit(f"{_CURRENT}#I1"), F.col("k").cast("string")), fields)


_PART_ERRORS = """
WITH errors AS (
    SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'R4__has_colour' ELSE 'zz__R4' END AS key, CASE WHEN p_partkey % 2 = 0 THEN 'another label' ELSE 'unknown prefix' END AS error FROM part WHERE p_partkey % 5 = 4
    UNION ALL SELECT p_partkey, 'R1__has_label__de', 'the first text is not in the default language' FROM part WHERE p_partkey % 7 = 0)
"""


@_q(_PART_ERRORS + "SELECT 'x:/parts#I1'||k AS subject, key, error FROM errors")
def authoring_errors(kb):
    """Mistakes in what is written about every part, found before anything is stored."""
    prefixes = constants(kb.spark, [("pt", _CURRENT)], ["prefix", "base"])
    return authoring.author(_authoring_base(kb), _part_rows(kb), prefixes, mod=_CURRENT, search=[_CURRENT, _BASE]).errors


@_q(
    _PART_ERRORS + ", good AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT k FROM errors)) SELECT 'x:/parts#I1'||p_partkey AS s, 'x:/base#R1' AS p, p_name AS o_lex, 'en' AS o_lang FROM good "
    "UNION ALL SELECT 'x:/parts#I1'||p_partkey, 'x:/base#R1', 'Teil '||p_partkey, 'de' FROM good UNION ALL SELECT 'x:/parts#I1'||p_partkey, 'x:/base#R3', x||p_partkey, 'en' FROM good, (VALUES ('a'), ('b')) t(x) "
    "UNION ALL SELECT 'x:/parts#I1'||p_partkey, 'x:/parts#R4', p_size::VARCHAR, NULL FROM good"
)
def authoring_statements(kb):
    """What is stored of it: keys of the current module come before those of the base, and texts have languages."""
    prefixes = constants(kb.spark, [("pt", _CURRENT)], ["prefix", "base"])
    done = authoring.author(_authoring_base(kb), _part_rows(kb), prefixes, mod=_CURRENT, search=[_CURRENT, _BASE])
    return done.kb.statements.where(F.col("s").startswith(f"{_CURRENT}#I")).select("s", "p", "o_lex", "o_lang")


@_q(
    "SELECT doc_id, CASE WHEN lang IS NULL OR lang = 'en' THEN source END AS en, CASE WHEN lang IN ('de', 'fr', 'es') THEN source END AS other, (lang IS NOT NULL AND lang NOT IN ('en', 'de', 'fr', 'es')) AS refused "
    "FROM (SELECT doc_id, source, lang FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL)",
    tables=True,
)
def authoring_documents(spark, sf_dir):
    """A description of every document in its own language, added to entities that are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", "lang").dropDuplicates(["doc_id"])
    from .model import star

    base = _authoring_base(star(spark, sf_dir))
    uri = F.concat(F.lit(f"{_BASE}#I7"), F.col("doc_id").cast("string"))
    entities = docs.select(uri.alias("uri"), F.lit("I").alias("etype"), F.lit(False).alias("is_auto"), F.lit(None).cast("string").alias("scope"), F.lit(_BASE).alias("mod"), F.lit(False).alias("unlinked"))
    key = F.when(F.col("lang").isin("en", "de", "fr", "es"), F.concat(F.lit("R2__has_description__"), "lang")).when(F.col("lang").isNull(), "R2").otherwise(F.concat(F.lit("R2__has_description__"), "lang", F.lit("__")))
    rows = _authored_rows(docs, uri, [(key, [(F.col("source"), "str", None)], False)])
    prefixes = constants(spark, [("b", _BASE)], ["prefix", "base"])
    known = base.plus(base.statements.limit(0), entities)
    done = authoring.author(known, rows, prefixes, mod=_BASE, create=None)
    said = done.kb.of(f"{_BASE}#R2").groupBy("s").agg(F.max(F.when(F.col("o_lang") == "en", F.col("o_lex"))).alias("en"), F.max(F.when(F.col("o_lang") != "en", F.col("o_lex"))).alias("other"))
    out = docs.withColumn("s", uri).join(said, "s", "left").join(done.errors.select(F.col("subject").alias("s"), F.lit(True).alias("bad")).distinct(), "s", "left")
    return out.select("doc_id", "en", "other", F.coalesce("bad", F.lit(False)).alias("refused"))


@_q(
    "SELECT 'x:/base#I'||c_custkey AS uri, c_custkey % 4 AS spelling FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'x:/parts#I'||c_custkey, c_custkey % 4 FROM customer WHERE c_custkey % 4 IN (1, 2) "
    "UNION ALL SELECT NULL, 3 FROM customer WHERE c_custkey % 4 = 3"
)
def key_to_uri(kb):
    """Keys of all customers in several spellings, resolved by joins: a prefix wins, then the searched module, then the active one."""
    customers = kb.of("segment").select(F.expr("cast(substring(s, 2) as long)").alias("k"))
    at = lambda base, rest: customers.where(rest).select(F.concat(F.lit(f"{base}#I"), F.col("k").cast("string")).alias("uri"), F.lit("I").alias("etype"), F.lit(False).alias("is_auto"), F.lit(None).cast("string").alias("scope"), F.lit(base).alias("mod"), F.lit(False).alias("unlinked"))
    known = kb.only("nothing").but(entities=at(_BASE, "k % 4 <> 3").unionByName(at(_CURRENT, "k % 4 IN (1, 2)")), parts=None, statements=kb.only("nothing").statements)
    k = F.col("k").cast("string")
    key = F.when(F.col("k") % 4 == 0, F.concat(F.lit("b__I"), k)).when(F.col("k") % 4 == 1, F.concat(F.lit("I"), k)).when(F.col("k") % 4 == 2, F.concat(F.lit("pt__I"), k)).otherwise(F.concat(F.lit("I"), k))
    work = modules.Workspace(known, prefixes={"b": _BASE, "pt": _CURRENT})
    with work.module(_BASE), work.search(_CURRENT):
        found = work.resolve(customers.select(key.alias("key")))
    keys = customers.select(key.alias("key"), (F.col("k") % 4).cast("int").alias("spelling"))
    return keys.join(found.select("key", "uri"), "key", "left").select("uri", "spelling")


@_q(
    "SELECT 'derived' AS step, 'x:/trial' AS mod, count(*) AS n FROM orders UNION ALL SELECT 'derived', 'x:/kept', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'unloaded', 'x:/kept', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' "
    "UNION ALL SELECT 'log', 'x:/kept', 1 UNION ALL SELECT 'log', 'x:/trial', 2"
)
def module_contexts(kb):
    """A rule's results land in the active module, one module inside another; one of them is taken back, the other stays."""
    ship = rules.Rule("ship", [Pattern([Edge(Var("o"), "placed_by", Var("c")), Edge(Var("c"), "part_of", Var("n"))])], [rules.Template(Var("o"), "goes_to", Var("n"))])
    work = modules.Workspace(kb.only("placed_by", "part_of"))
    wanted = kb.of("segment").where("o_lex = 'BUILDING'").select(*statement(F.col("s"), "is_wanted", F.lit(1), kind="L", o_type="int"))
    with work.start("x:/trial", "t"):
        work.apply(ship)
        with work.module("x:/kept"):
            work.insert(wanted, only_new=True)
    made = lambda step: work.kb.statements.where("mod LIKE 'x:/%'").groupBy("mod").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "mod", "n")
    derived = made("derived")
    work.unload("x:/trial")
    log = local(kb.spark, [("log", m, sum(x[0] == m for x in work.log)) for m in ("x:/kept", "x:/trial")], "step string, mod string, n long")
    return derived.unionByName(made("unloaded")).unionByName(log)


# calls


@_q(
    "WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT 'offer' AS operator, 'P'||p AS a, 'S'||s AS b, 'contract' AS cls, 'priced' AS other, 'S'||s AS held_by FROM l "
    "UNION ALL SELECT 'size_of', 'P'||p_partkey, NULL, 'number', NULL, NULL FROM part"
)
def operator_calls(kb):
    """Two operators applied to columns: results of their range's classes, arguments read back, and a rule that runs on new results alone."""
    facts = _facts(kb, [("offer", "range", "contract"), ("size_of", "range", "number")])
    second = kb.spark.range(1).select(*statement(F.lit("offer"), "range", F.lit("priced"))).withColumn("seq", F.lit(9).cast("long"))
    known = facts.only("range").plus(second, bag=False)
    offers = kb.of("supplied_by").select(F.lit("offer").alias("operator"), F.array("s", "o").alias("args"))
    asked = offers.unionByName(offers).unionByName(kb.of("size").select(F.lit("size_of").alias("operator"), F.array("s").alias("args")))
    result, tuple_, b = Var("result"), Var("t"), Var("b")
    # matched as SPARQL does: the element of place 1 is known by its index, so the rule asks the tuple's supplier through its class
    held = rules.Rule("held", [Pattern([Edge(result, "applied_mapping_of", Ent("offer")), Edge(result, "has_arguments", tuple_), Edge(tuple_, "has_element", b), Edge(b, "is_supplier", Ent("yes"))])], [rules.Template(result, "held_by", b)])
    suppliers = written(kb.of("part_of").where("s LIKE 'S%'").select("s"), "suppliers")  # a thousandth of the offers: its size is known once it is written
    known = known.with_parts({"is_supplier": lambda: suppliers.select(*statement(F.col("s"), "is_supplier", F.lit("yes")))})
    known.single = known.single | {"is_supplier"}  # suppliers join the tuples' elements before these meet their results
    after, made = calls.call(known, asked, post=[held])
    again, twice = calls.call(after, offers, post=[held])  # nothing of it is new
    stored = again.of("has_arguments").select(F.col("s").alias("result"), F.col("o").alias("tuple"))
    # a tuple's elements come from one row, so they are put together before they are moved
    elements = again.of("has_element").groupBy(F.col("s").alias("tuple")).agg(F.max(F.when(F.col("seq") == 0, F.col("o"))).alias("a"), F.max(F.when(F.col("seq") == 1, F.col("o"))).alias("b"))
    one = lambda p, name: again.of(p).select(F.col("s").alias("result"), F.col("o").alias(name))
    # what is stored by result is joined first: that moves nothing
    out = made.select("result", "operator").join(stored, "result").join(one("instance_of", "cls"), "result").join(one("secondary_instance_of", "other"), "result", "left").join(one("held_by", "held_by"), "result", "left")
    out = out.join(twice.where("made").select("result"), "result", "left_anti")
    return out.join(elements, "tuple").select("operator", "a", "b", "cls", "other", "held_by")



# SPARQL

_s(
    "sparql_exists_in_optional",
    "SELECT 'P'||a.p_partkey AS p, CASE WHEN EXISTS (SELECT 1 FROM part x WHERE x.p_partkey = a.p_partkey // 2 AND x.p_size < a.p_size) THEN 'P'||b.p_partkey END AS q FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey > 0",
    "SELECT ?p ?q WHERE { ?p :parent ?up . ?p :size ?k OPTIONAL { ?p :parent ?q FILTER EXISTS { ?up :size ?j FILTER (?j < ?k) } } }",
)
_s(
    "sparql_blank_nodes",
    "SELECT 'O'||o_orderkey AS o, 'N'||c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "SELECT ?o ?n WHERE { ?o :placed_by [ :part_of ?n ] . ?n :part_of _:somewhere . _:somewhere :label \"AMERICA\" }",
)



# limits and types


@_q("SELECT 'O'||l_orderkey||'/premise' AS parent, 'AND' AS kind, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 3")
def scope_limits(kb):
    """An AND scope for each part of an order, all in its premise, where three are allowed."""
    lines = kb.of("contains").select(F.concat("s", F.lit("/premise")).alias("premise"), F.col("s").alias("order"), F.col("o").alias("part"))
    frames = lines.select(F.concat_ws("/", "premise", "part").alias("scope"), F.lit("AND").alias("kind"), F.col("premise").alias("parent"), F.col("part").alias("name"))
    frames = frames.unionByName(lines.select(F.col("premise").alias("scope"), F.lit("PREMISE").alias("kind"), F.col("order").alias("parent"), F.lit("premise").alias("name")).distinct())
    none = [local(kb.spark, [], schema) for schema in (scopes.VARIABLES, scopes.STATEMENTS)]
    return scopes.excess(scopes.add(kb.only("nothing"), frames, *none), {"AND": 3, "OR": 1})


@_q("SELECT 'P'||p_partkey AS mapping, 0 AS place, 'P'||p_partkey AS argument, 'expression' AS expected FROM part WHERE p_partkey % 3 = 2")
def type_check_expression(kb):
    """An operator that takes an expression also takes what is a complex number, by its class or a class above; products it does not."""
    k = F.expr("cast(substring(s, 2) as long) % 3")
    classed = kb.of("size").select(*statement(F.col("s"), "instance_of", F.when(k == 0, "complex").when(k == 1, "real").otherwise("product")))
    above = constants(kb.spark, [("real", "complex"), ("product", "thing")], ["s", "o"]).select(*statement(F.col("s"), "subclass_of", F.col("o")))
    applied = kb.of("size").select(F.col("s").alias("mapping"), F.lit("op").alias("operator"), F.array("s").alias("args"))
    return checks.type_violations(kb.only("nothing").plus(classed.unionByName(above), bag=False), applied, local(kb.spark, [("op", 0, "expression")], "operator string, place int, expected string"))



@_q("SELECT 'P'||p_partkey AS entity, 'oversized' AS rule, 1 AS items FROM part WHERE p_size > 45")
def violation_links(kb):
    """Items for parts above a size, recorded twice: each is there once, and is found from the part and from the rule."""
    size = LitVar("size")
    rule = rules.Rule("oversized", [Pattern([Edge(Var("part"), "size", size)], conditions=[lambda df: F.expr("cast(substring(size, 3) as double) > 45")])])
    once, _ = rules.record_violations(kb.only("size"), rule, "part")
    twice, _ = rules.record_violations(once, rule, "part")
    links = twice.of("has_constraint_violation").select(F.col("s").alias("entity"), F.col("o").alias("item"))
    named = twice.of("violates_rule").select(F.col("s").alias("item"), F.col("o").alias("rule"))
    back = twice.of("has_violating_entity").select(F.col("s").alias("item"), F.col("o").alias("entity"))
    items = links.join(named, "item").join(back, ["item", "entity"]).join(twice.of("instance_of").where("o = 'constraint_violation'").select(F.col("s").alias("item")), "item")
    return items.groupBy("entity", "rule").agg(F.count(F.lit(1)).cast("int").alias("items"))


__all__ = ["ORACLE_SQL", "QUERIES"]
