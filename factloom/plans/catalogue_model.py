"""Queries of lookups, scalar functions, edits, scopes, rules and reports over the star schema, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calls, checks, closure, edit, expressions, instances, lookup, rules, scopes
from ..operators.pattern import Edge, Ent, LitVar, Pattern, Var, match
from ..sources import modules, ntriples, reports
from . import sparql
from .catalogue import _SUBSTAR, _TYPED, ORACLE_SQL, QUERIES, _q, _s
from .model import constants, statement

C, N, R, P, O = Var("c"), Var("n"), Var("r"), Var("p"), Var("o")  # noqa: E741
_CUSTOMERS = "SELECT 'C'||c_custkey AS s"


def _flag(kb, rows, p: str):
    """Statements that a relation is true of ``rows`` (s)."""
    return rows.select(*statement(F.col("s"), p, F.lit(1), kind="L", o_type="int"))


# lookups


@_q("SELECT 'C7' AS uri FROM customer WHERE c_custkey = 7")
def entity_by_uri(kb):
    return lookup.entity(kb, "C7").select("uri")


@_q("SELECT 'part_of' AS p, 'N'||c_nationkey AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'segment', 's:'||c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'label', 's:'||c_name FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'instance_of', 'customer'")
def statements_of_entity(kb):
    return lookup.statements_of(kb, "C7").select("p", "o")


@_q("SELECT CASE p_partkey % 3 WHEN 0 THEN 'ex' END AS prefix, 'I'||p_partkey AS key, CASE p_partkey % 3 WHEN 2 THEN p_name ELSE replace(replace(p_name, ' ', '_'), '-', '_') END AS label, CASE p_partkey % 3 WHEN 0 THEN 'de' END AS lang FROM part")
def key_parsing(kb):
    """Three spellings: prefix, name and language; name; label in brackets."""
    number, name = F.expr("substring(s, 2)"), scalars.underscored(F.col("o_lex"))
    kind = F.expr("cast(substring(s, 2) as long) % 3")
    text = F.when(kind == 0, F.concat(F.lit("ex__I"), number, F.lit("__"), name, F.lit("__de"))).when(kind == 1, F.concat(F.lit("I"), number, F.lit("__"), name)).otherwise(F.concat(F.lit("I"), number, F.lit('["'), "o_lex", F.lit('"]')))
    return kb.of("label").where("s LIKE 'P%'").select(scalars.parse_key(text).alias("k")).select("k.*")


@_q("SELECT 'C'||c_custkey AS s, c_nationkey = 3 AS holds FROM customer")
def truth_of_statements(kb):
    rows = kb.of("segment").select("s", F.lit("part_of").alias("p"), F.lit("N3").alias("o"))
    return lookup.truths(kb.only("part_of"), rows).select("s", "holds")


@_q(f"{_CUSTOMERS}, c_custkey % 2 = 1 AS auto, CASE WHEN c_custkey % 2 = 1 THEN 'gray' ELSE 'black' END AS colour, c_custkey::BIGINT AS number, 'I' AS kind FROM customer")
def generic_instances(kb):
    n = F.expr("cast(substring(s, 2) as int)")
    key = F.concat(F.when(n % 2 == 1, "Ia").otherwise("I"), n.cast("string"))
    return kb.of("label").where("s LIKE 'C%'").select("s", scalars.is_auto(key).alias("auto"), scalars.colour_of_item(key).alias("colour"), scalars.key_number(key).alias("number"), scalars.key_kind(key).alias("kind"))


@_q("SELECT 'label' AS p, 's:'||p_name AS o FROM part WHERE p_partkey = 7 UNION ALL SELECT 'size', 'n:'||p_size::DOUBLE FROM part WHERE p_partkey = 7 UNION ALL SELECT 'brand', 's:'||p_brand FROM part WHERE p_partkey = 7")
def literals_of_item(kb):
    return lookup.first_literals(kb, "P7")


@_q("SELECT 'O'||o_orderkey||'-q' AS stm_id, true AS qualifier FROM orders UNION ALL SELECT 'O'||o_orderkey, false FROM orders")
def qualifier_test(kb):
    null = F.lit(None).cast("string")
    own = kb.of("placed_by").select(F.col("s").alias("stm_id"), F.concat("s", F.lit("-q")).alias("q_stm_id"), F.lit(0).cast("long").alias("seq"), F.lit("since").alias("p"), F.lit("L").alias("o_kind"), F.lit("s:x").alias("o"), null.alias("o_type"), null.alias("o_lex"), null.alias("o_lang"))
    ids = own.select("stm_id").unionByName(own.select(F.col("q_stm_id").alias("stm_id")))
    return lookup.is_qualifier(kb.but(qualifiers=own), ids)


@_q("SELECT 'O'||o_orderkey AS stm_id, 'C'||o_custkey AS o FROM orders")
def proxy_items(kb):
    null = F.lit(None).cast("string")
    own = kb.of("placed_by").select(F.col("s").alias("stm_id"), F.concat("s", F.lit("-x")).alias("q_stm_id"), F.lit(0).cast("long").alias("seq"), F.lit("has_proxy").alias("p"), F.lit("E").alias("o_kind"), "o", null.alias("o_type"), null.alias("o_lex"), null.alias("o_lang"))
    return lookup.proxies(kb.but(qualifiers=own))


@_q("SELECT 'M'||o AS mapping, row_number() OVER (PARTITION BY o ORDER BY 'P'||p) - 1 AS place, 'P'||p AS argument FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)")
def mapping_arguments(kb):
    """A mapping for each order, its argument tuple the order's parts."""
    listed = kb.of("contains").groupBy(F.concat(F.lit("T"), "s").alias("tuple")).agg(F.array_sort(F.collect_set("o")).alias("elements"))  # at most as many as an order has lines
    rows, qualifiers = edit.tuple_rows(listed)
    links = listed.select(F.expr("substring(tuple, 3)").alias("k"), "tuple").select(*statement(F.concat(F.lit("M"), "k"), "has_arguments", F.col("tuple")))
    return lookup.arguments(kb.but(statements=rows.unionByName(links), qualifiers=qualifiers))


@_q("SELECT row_number() OVER (ORDER BY 'S'||s_suppkey) - 1 AS place, 'S'||s_suppkey AS argument FROM supplier QUALIFY s_nationkey <> 2")
def tuple_difference(kb):
    """All suppliers as one tuple, less that of a nation: an element a row, numbered by counts of the tasks before."""
    suppliers = kb.of("part_of").where("s LIKE 'S%'").select(F.col("s").alias("o"), F.col("o").alias("nation"))
    members = edit.indexed(suppliers.select(F.lit("t1").alias("tuple"), "o").unionByName(suppliers.where("nation = 'N2'").select(F.lit("t2").alias("tuple"), "o")))
    rows, qualifiers = edit.element_rows(members)
    return lookup.tuple_difference(kb.but(statements=rows, qualifiers=qualifiers), "t1", "t2")


@_q("SELECT 'T'||o AS tuple, k AS place FROM (SELECT l_orderkey AS o, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), range(8) t(k) WHERE k >= n")
def unused_places(kb):
    """Of eight places, those that an order's parts leave free."""
    listed = kb.of("contains").groupBy(F.expr("'T' || substring(s, 2)").alias("tuple")).agg(F.array_sort(F.collect_set("o")).alias("elements"))
    rows, qualifiers = edit.tuple_rows(listed)
    return lookup.unused_places(kb.but(statements=rows, qualifiers=qualifiers), listed, 8)


@_q("SELECT 'C'||c_custkey AS s FROM customer WHERE c_nationkey <> 4")
def scope_free_entities(kb):
    inner = kb.of("part_of").where("s LIKE 'C%' AND o = 'N4'").select(F.col("s").alias("uri"), F.lit("x").alias("in"))
    entities = kb.entities.where("uri LIKE 'C%'").join(inner, "uri", "left").withColumn("scope", F.col("in")).drop("in")
    return lookup.scope_free(kb.but(entities=entities)).select(F.col("uri").alias("s"))


@_q("SELECT 'O'||o_orderkey AS s FROM orders WHERE o_orderstatus = 'F'")
def statements_in_scope(kb):
    closed = kb.of("status").where("o_lex = 'F'").select("s")
    rows = kb.of("placed_by").join(closed, "s", "left_semi").withColumn("scope", F.lit("done"))
    return lookup.scope_members(kb.but(statements=kb.of("placed_by").unionByName(rows.select(*kb.of("placed_by").columns))), "done")[0].select("s")


@_q("SELECT 'C'||c_custkey AS scope, 'N1' AS owner FROM customer WHERE c_nationkey = 1")
def subscopes_of_owner(kb):
    links = kb.of("part_of").where("s LIKE 'C%'").select(*statement(F.col("s"), "is_scope_of", F.col("o")))
    more = kb.but(statements=links.unionByName(kb.of("label")))
    name = kb.of("label").join(kb.of("part_of").where("o = 'N1' AND s LIKE 'C%'").select("s"), "s").orderBy("s").first()
    assert lookup.subscope_named(more, "N1", name["o_lex"]) == name["s"]
    return lookup.subscopes(more, "N1").withColumn("owner", F.lit("N1"))


@_q("SELECT 'C'||c_custkey AS node, CASE WHEN c_nationkey = 2 THEN 'removed' ELSE 'entity' END AS kind FROM customer UNION ALL SELECT c_name, 'literal' FROM customer")
def node_resolution(kb):
    gone = kb.of("part_of").where("s LIKE 'C%' AND o = 'N2'").select(F.col("s").alias("uri"))
    after = edit.delete_entities(kb.only("part_of"), gone)
    customers = kb.of("label").where("s LIKE 'C%'")
    return lookup.with_tombstones(after, customers.select(F.col("s").alias("node")).unionByName(customers.select(F.col("o_lex").alias("node"))))


@_q("SELECT 'P'||p_partkey AS uri FROM part WHERE p_partkey % 3 = 0")
def label_mismatches(kb):
    wrong = F.when(F.expr("cast(substring(s, 2) as long) % 3 = 0"), "other").otherwise(F.upper(F.translate("o_lex", " ", "-")))
    return lookup.label_mismatches(kb, kb.of("label").where("s LIKE 'P%'").select(F.col("s").alias("uri"), wrong.alias("label"))).select("uri")


# classes and walks


@_q("SELECT 'C'||c_custkey AS s FROM customer WHERE c_custkey % 2 = 0")
def direct_instances_filtered(kb):
    return closure.direct_instances(kb, "customer", keep=F.expr("cast(substring(s, 2) as long) % 2 = 0"))


@_q(f"{_SUBSTAR}, x AS (SELECT s, c FROM {_TYPED} UNION ALL SELECT s, b FROM {_TYPED} JOIN (SELECT DISTINCT a, b FROM t) ON a = c) SELECT c AS cls, count(DISTINCT s) AS n FROM x GROUP BY 1")
def class_counts(kb):
    return closure.class_counts(kb)


@_q(f"{_SUBSTAR} SELECT a.c AS cls, b.c AS above, EXISTS (SELECT 1 FROM t WHERE t.a = a.c AND t.b = b.c) AS holds FROM (VALUES ('customer'), ('place'), ('thing')) a(c), (VALUES ('party'), ('thing'), ('meta')) b(c)")
def subclass_test(kb):
    pairs = constants(kb.spark, [(a, b) for a in ("customer", "place", "thing") for b in ("party", "thing", "meta")], ["cls", "above"])
    return closure.subclass_pairs(kb, pairs)


@_q(f"{_SUBSTAR} SELECT DISTINCT a, b FROM t UNION SELECT a, a FROM (SELECT a FROM t UNION SELECT b FROM t)")
def subproperty_test(kb):
    return closure.is_subproperty(kb, relation="subclass_of")


@_q("WITH RECURSIVE w AS (SELECT 777 AS k, 0 AS hops UNION ALL SELECT k // 2, hops + 1 FROM w WHERE k > 0) SELECT 'P'||k AS node, hops FROM w")
def functional_walk(kb):
    return closure.walk(kb, "P777", "parent")


@_q("SELECT 'P'||p_partkey AS node, 'P'||(p_partkey // 8 * 8) AS component FROM part")
def linked_components(kb):
    """Chains of eight parts each, and the least node of a chain by its number: seven levels deep, as many chains as an eighth of the parts."""
    k = F.expr("cast(substring(s, 2) as long)")
    edges = kb.of("size").where(k % 8 != 0).select(F.col("s").alias("a"), F.concat(F.lit("P"), (k - 1).cast("string")).alias("b"))
    parts = kb.of("size").select(F.col("s").alias("a"), F.col("s").alias("b"))
    found = closure.components(edges.unionByName(parts))
    first = found.where("cast(substring(node, 2) as long) % 8 = 0").select("component", F.col("node").alias("name"))
    return found.join(first, "component").select("node", F.col("name").alias("component"))


# edits


@_q("SELECT 'C'||c_custkey AS s, 'N'||c_nationkey AS o FROM customer UNION ALL SELECT 'C'||c_custkey, 'N25' FROM customer WHERE c_custkey % 5 = 0")
def insert_statements(kb):
    rows = kb.of("segment").where("cast(substring(s, 2) as long) % 5 = 0").select(*statement(F.col("s"), "part_of", F.lit("N25")))
    customers = kb.but(statements=kb.of("part_of").where("s LIKE 'C%'"))
    return edit.insert(edit.insert(customers, rows, only_new=True), rows, only_new=True).statements.select("s", "o")


@_q("SELECT 'C'||c_custkey AS s FROM customer WHERE c_custkey % 5 = 0")
def insert_validated(kb):
    """A validator sees the rows that would be stored; those that it lets pass are."""
    rows = kb.of("segment").where("cast(substring(s, 2) as long) % 5 = 0").select(*statement(F.col("s"), "visits", F.lit("N3")))
    known = lambda after, new: new.join(after.of("label").select("s"), "s", "left_anti")
    return edit.insert(kb.only("label"), rows, validators=(known,)).of("visits").select("s")


@_q("SELECT 'C'||c_custkey AS s, 'R'||r_regionkey AS o FROM customer, region")
def insert_many_for_many(kb):
    return edit.for_pairs(kb.of("part_of").where("s LIKE 'C%'").select("s"), "trades_in", kb.of("part_of").where("o LIKE 'R%'").select("o")).select("s", "o")


@_q("SELECT 'O'||l_orderkey AS s, 'P'||l_partkey AS o, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL")
def delete_statements_cascade(kb):
    odd = kb.of("contains").where("cast(substring(o, 2) as long) % 2 = 1").select("stm_id")
    after = edit.delete_statements(kb.only("contains"), odd)
    return after.statements.select("stm_id", "s", "o").join(after.qualifiers.groupBy("stm_id").agg(F.count("*").alias("n")), "stm_id").select("s", "o", "n")


@_q("SELECT p, count(*) AS n FROM (SELECT 'part_of' AS p FROM customer WHERE c_nationkey % 2 = 1) GROUP BY 1")
def unload_module(kb):
    even = F.expr("cast(substring(o, 2) as int) % 2 = 0")
    rows = kb.of("part_of").where("s LIKE 'C%'").withColumn("mod", F.when(even, "even").otherwise("odd"))
    after = edit.unload(kb.but(statements=rows), "even")
    assert edit.leftovers(after, "even").isEmpty()
    return after.statements.groupBy("p").agg(F.count("*").alias("n"))


@_q("SELECT 'statement' AS kind, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0")
def module_leftovers(kb):
    even = F.expr("cast(substring(o, 2) as int) % 2 = 0")
    rows = kb.of("part_of").where("s LIKE 'C%'").withColumn("mod", F.when(even, "even").otherwise("odd"))
    return edit.leftovers(kb.but(statements=rows), "even").groupBy("kind").agg(F.count("*").alias("n"))


@_q("SELECT row_number() OVER (ORDER BY 'C'||c_custkey) - 1 AS place, 'C'||c_custkey AS argument FROM customer")
def closed_class(kb):
    """All customers as the closed tuple of their class."""
    after = edit.close_class(kb.only("instance_of"), "customer")
    return lookup.tuple_elements(after).where("tuple = 'tuple:customer'").select("place", "argument")


@_q("SELECT c_name AS label, 'customer' AS cls, 'party' AS dom, 'n:5.0' AS rng FROM customer")
def instances_with_signature(kb):
    signs = constants(kb.spark, [("customer",)], ["s"])
    own = signs.select(*statement(F.col("s"), "domain_1", F.lit("party"))).unionByName(signs.select(*statement(F.col("s"), "range", F.lit(5), kind="L", o_type="int")))
    rows = kb.of("label").where("s LIKE 'C%'").select(F.lit("customer").alias("cls"), F.col("o_lex").alias("name"))
    after = instances.new_instances(kb.but(statements=own), rows.unionByName(rows))
    of = lambda p, name: after.of(p).select("s", F.col("o").alias(name))
    made = after.of("label").select("s", F.col("o_lex").alias("label")).join(of("instance_of", "cls"), "s").join(of("domain_1", "dom"), "s")
    return made.join(after.of("range").where("o_kind = 'L'").select("s", F.col("o").alias("rng")), "s").select("label", "cls", "dom", "rng")


# scalar functions


@_q(f"{_CUSTOMERS}, replace(c_name, ' ', '_') AS plain, 'x:/a' AS base, 'I'||c_custkey AS key, 'x:/a/STATEMENTS#I'||c_custkey AS named, true AS valid, false AS broken FROM customer")
def uri_functions(kb):
    uri = scalars.make_uri(F.lit("x:/a"), F.expr("'I' || substring(s, 2)"))
    rows = kb.of("label").where("s LIKE 'C%'").select("s", "o_lex", uri.alias("uri"))
    u = F.col("uri")
    return rows.select("s", scalars.underscored(F.col("o_lex")).alias("plain"), scalars.uri_base(u).alias("base"), scalars.uri_key(u).alias("key"), scalars.sub_uri(u, "STATEMENTS").alias("named"), scalars.valid_uri(u).alias("valid"), scalars.valid_uri(F.concat(u, F.lit("#x"))).alias("broken"))


@_q("SELECT doc_id, coalesce(lang, 'en') AS lang, '\\('||doc_id||'\\) of '||coalesce(lang, 'none') AS tex FROM documents", tables=True)
def literal_functions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("$"), F.col("doc_id").cast("string"), F.lit("$ of "), F.coalesce("lang", F.lit("none")))
    return docs.select("doc_id", scalars.ensure_language(F.col("lang")).alias("lang"), scalars.inline_latex(text).alias("tex"))


@_q("SELECT 'P'||p_partkey AS s, 'n:'||p_size::DOUBLE AS graph, 'int:'||p_size AS exact, ['blue','orange','green','red','purple','brown','pink','gray','olive','cyan'][(p_size + 9) % 10 + 1] AS colour FROM part")
def literal_keys(kb):
    lex = F.col("o_lex")
    none = F.lit(None).cast("string")
    return kb.of("size").select("s", scalars.literal_key(F.col("o_type"), lex, none).alias("graph"), scalars.literal_key(F.col("o_type"), lex, none, graph=False).alias("exact"), scalars.colour_of_number(lex.cast("long")).alias("colour"))


@_q("SELECT 'C'||c_custkey AS s, p, CASE p WHEN 'part_of' THEN 'entity' WHEN 'segment' THEN 'string' END AS kind, 'C'||c_custkey||' -> '||CASE p WHEN 'part_of' THEN 'N'||c_nationkey ELSE 's:'||c_mktsegment END AS text FROM customer, (VALUES ('part_of'), ('segment')) t(p)")
def node_kinds(kb):
    rows = kb.of("part_of", "segment").where("s LIKE 'C%'")
    return rows.select("s", "p", scalars.node_kind(F.col("o_kind"), F.col("o_type")).alias("kind"), scalars.render(F.lit("{a} -> {b}"), {"a": F.col("s"), "b": F.col("o")}).alias("text"))


@_q(f"{_CUSTOMERS}, '<a href=\"/e/C'||c_custkey||'\">C'||c_custkey||' [&quot;'||c_name||' &amp; &lt;co&gt;&quot;]</a>' AS link, '<span class=\"literal\">&quot;'||c_name||' &amp; &lt;co&gt;&quot;</span>' AS text FROM customer")
def html_formats(kb):
    """Labels with characters that HTML gives a meaning."""
    name = F.concat("o_lex", F.lit(" & <co>"))
    return kb.of("label").where("s LIKE 'C%'").select("s", scalars.entity_html(name, F.col("s"), F.col("s")).alias("link"), scalars.literal_html(name).alias("text"))


@_q("SELECT 'C'||c_custkey||'[\"'||c_name||'\"]' AS value FROM customer UNION SELECT 'C'||c_custkey||'__'||replace(replace(c_name, ' ', '_'), '-', '_') FROM customer")
def spellings(kb):
    return modules.completions(kb.but(entities=kb.entities.where("uri LIKE 'C%'")))


@_q("SELECT 'N'||n_nationkey AS s, 'part_of' AS p FROM nation WHERE n_regionkey = 1")
def module_subset(kb):
    keys = kb.of("part_of").where("o = 'R1'").select(F.col("s").alias("uri"))
    return modules.subset(kb.only("part_of"), keys).statements.select("s", "p")


# expressions and checks


@_q("SELECT * FROM (VALUES ('add', 2, 3), ('mul', 2, 3), ('pow', 2, 2)) t(op, arity, each_part) JOIN (SELECT count(*) AS parts, count(DISTINCT p_size) AS sizes FROM part) ON true")
def expression_calls(kb):
    """An expression over each part and its size, evaluated on columns: its calls by operator for each part; what only depends on the size is made once a size."""
    part, size = expressions._leaf("part"), expressions._leaf("size")
    tree = (part + size) * 2 - size / size**2 + (part + size)  # part + size is one call; minus, division and power by add, mul and pow
    inputs = kb.of("size").select(F.col("s").alias("part"), F.col("o").alias("size"))
    ranges = constants(kb.spark, [(op, "number") for op in ("add", "mul", "pow")], ["s", "o"]).select(*statement(F.col("s"), "range", F.col("o")))
    after, found = calls.evaluate(kb.but(statements=ranges, parts=None), tree, inputs)
    made = after.of("applied_mapping_of").select(F.col("s").alias("result"), F.col("o").alias("op"))
    arities = after.of("has_arguments").select(F.col("s").alias("result"), F.col("o").alias("s")).join(after.of("has_length").select("s", F.col("o_lex").cast("int").alias("arity")), "s")
    counted = made.join(arities, "result").groupBy("op").agg(F.max("arity").alias("arity"), F.count(F.lit(1)).alias("n"))
    totals = found.agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("size").alias("sizes"))  # one row
    of_size = F.when(F.col("op") == "pow", 2).when(F.col("op") == "mul", 2).otherwise(0)  # calls that only name the size
    whole = (F.col("n") - of_size * F.col("sizes")) / F.col("parts")
    return counted.crossJoin(totals).select("op", "arity", (whole + of_size).cast("int").alias("each_part"), "parts", "sizes")


@_q(
    "WITH r AS (SELECT 'P'||p_partkey AS l, 'n:'||p_size::DOUBLE AS x, CASE p_partkey % 3 WHEN 0 THEN '==' WHEN 1 THEN '!=' ELSE '<=' END AS sign FROM part) SELECT l, p, o FROM r, LATERAL (SELECT * FROM (VALUES "
    "('instance_of', CASE sign WHEN '==' THEN 'equation' WHEN '!=' THEN 'strict_inequality' ELSE 'inequality' END), ('has_lhs', l), ('has_rhs', x), ('is_related:'||sign, x)) t(p, o))"
)
def relations_of_expressions(kb):
    """A mathematical relation between each part and its size, with the item that stands for it."""
    k = F.expr("cast(substring(s, 2) as long) % 3")
    sides = kb.of("size").select(F.col("s").alias("lhs"), F.when(k == 0, "==").when(k == 1, "!=").otherwise("<=").alias("sign"), F.col("o").alias("rhs"))
    rows = expressions.related(sides)
    item = rows.where("p = 'has_lhs'").select("s", F.col("o").alias("l"))
    return rows.join(item, "s", "left").select(F.coalesce("l", "s").alias("l"), "p", "o")


@_q("SELECT 'P'||p_partkey AS mapping, 1 AS n, 2 AS arity FROM part WHERE p_partkey % 3 = 0")
def arity_violations(kb):
    args = F.when(F.expr("cast(substring(s, 2) as long) % 3 = 0"), F.array("s")).otherwise(F.array("s", "o"))
    calls = kb.of("size").select(F.col("s").alias("mapping"), F.lit("op").alias("operator"), args.alias("args"))
    signature = kb.spark.createDataFrame([("op", 0, "product"), ("op", 1, "integer"), ("op", 1, "real")], "operator string, place int, expected string")
    return checks.arity_violations(calls, signature).select("mapping", "n", "arity")


@_q("SELECT 'P'||l_partkey AS o, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def inverse_functional_violations(kb):
    return checks.inverse_functional_violations(kb, ["contains"]).select("o", "n")


@_q("SELECT 'C'||c_custkey AS s FROM customer WHERE c_custkey % 4 = 0")
def missing_required(kb):
    given = kb.of("segment").where("cast(substring(s, 2) as long) % 4 <> 0")
    return checks.missing_required(kb.but(statements=given.unionByName(kb.of("instance_of"))), "customer", "segment")


# rules and reports


@_q("SELECT 'C'||c_custkey AS s, 'N'||(CASE WHEN c_nationkey = 2 THEN 1 ELSE c_nationkey END) AS o FROM customer")
def rule_replace(kb):
    same = constants(kb.spark, [("N2", "N1")], ["a", "b"]).select(*statement(F.col("a"), "same_as", F.col("b")))
    a, b = Var("a"), Var("b")
    after, _ = rules.apply(kb.but(statements=kb.of("part_of").unionByName(same)), rules.Rule("merge", [Pattern([Edge(a, "same_as", b)])], merge=("a", "b")))
    return after.of("part_of").where("s LIKE 'C%'").select("s", "o")


@_q("SELECT max('C'||c_custkey||' in N'||c_nationkey) AS message FROM customer WHERE c_custkey = 7")
def rule_contradiction_raised(kb):
    rule = rules.Rule("stop", [Pattern([Edge(Ent("C7"), "part_of", N)])], stop=rules.Contradiction, message="C7 in {n}")
    _, _, stop = rules.apply_all(kb.only("part_of"), [rule])
    return constants(kb.spark, [(str(stop),)], ["message"])


@_q("SELECT 'small' AS rule, 'P'||p_partkey AS p FROM part WHERE p_size = 1")
def constraint_violations(kb):
    v = LitVar("v")
    found = rules.violations(kb, rules.Rule("small", [Pattern([Edge(P, "size", v)], conditions=[lambda df: F.col("v") == "n:1.0"])]))
    return found.select("rule", F.col("bindings")["p"].alias("p"))


@_q("SELECT count(*) + (SELECT count(*) FROM nation) AS n FROM orders")
def report_count(kb):
    return rules.report_counts(kb.of("placed_by").select("s"), kb.of("part_of").where("s LIKE 'N%'").select("s"))


@_q("SELECT '[N'||n_nationkey||' | in | R'||n_regionkey||']' AS line FROM nation")
def rule_text_report(kb):
    rule = rules.Rule("in", [Pattern([Edge(N, "part_of", R), Edge(N, "instance_of", Ent("nation"))])], [rules.Template(N, "in", R)])
    return reports.text_report(rules.delta(kb, rule))


@_q(
    "WITH few AS (SELECT p_brand AS b, p_type AS t FROM part GROUP BY ALL HAVING sum(p_size) % 3 = 0), b AS (SELECT DISTINCT p_brand AS b FROM part ORDER BY 1 LIMIT 4), t AS (SELECT DISTINCT p_type AS t FROM part ORDER BY 1 LIMIT 4), "
    "x AS (SELECT list(b ORDER BY b) AS bs FROM b), y AS (SELECT list(t ORDER BY t) AS ts FROM t), "
    "perms AS (SELECT a, b, c, d FROM range(1, 5) a(a), range(1, 5) b(b), range(1, 5) c(c), range(1, 5) d(d) WHERE len(list_distinct([a, b, c, d])) = 4), "
    "n AS (SELECT 'sold' AS relation, count(*) AS n FROM perms, x, y WHERE NOT EXISTS (SELECT 1 FROM few WHERE (few.b = bs[1] AND few.t = ts[a]) OR (few.b = bs[2] AND few.t = ts[perms.b]) OR (few.b = bs[3] AND few.t = ts[c]) OR (few.b = bs[4] AND few.t = ts[d])) "
    "UNION ALL SELECT 'kept', count(*) FROM perms) SELECT relation, n::INT AS n, (SELECT sum(n) FROM n)::INT AS total, (SELECT product(n) FROM n)::INT AS product FROM n"
)
def bijection_report(kb):
    """One-to-one pairs of four brands and four types: for one relation those whose parts' sizes sum up to a multiple of three are excluded, for the other none."""
    types = kb.of("instance_of").where("s LIKE 'P%'").select("s", F.col("o").alias("t"))
    sums = kb.of("brand").select("s", F.col("o").alias("b")).join(types, "s").join(kb.of("size").select("s", F.col("o_lex").cast("long").alias("size")), "s").groupBy("b", "t").agg(F.sum("size").alias("n"))
    bad = sums.where("n % 3 = 0").select(*statement(F.col("b"), "not_sold", F.col("t")))
    first = lambda c: [r[c] for r in sums.select(c).distinct().orderBy(c).limit(4).collect()]
    b, t = first("b"), first("t")
    out = rules.bijection_report(kb.but(statements=bad, parts=None), {"not_sold": (b, t), "not_kept": (b, t)})
    return out.select(F.expr("substring(relation, 5)").alias("relation"), F.col("n").cast("int").alias("n"), F.col("total").cast("int").alias("total"), F.col("product").cast("int").alias("product"))


@_q("SELECT 'C'||c_custkey AS s, 'ordered' AS p FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'C'||c_custkey, 'rated' FROM customer WHERE c_custkey % 2 = 1")
def open_pairs(kb):
    ordered = kb.of("placed_by").select(*statement(F.col("o"), "ordered", F.col("s")))
    rated = kb.of("segment").where("cast(substring(s, 2) as long) % 2 = 0").select(*statement(F.col("s"), "rated", F.lit("x")))
    return rules.open_pairs(kb.of("segment"), constants(kb.spark, [("ordered",), ("rated",)], ["p"]), kb.but(statements=ordered.unionByName(rated)))


@_q("SELECT 'C'||c_custkey AS c, 'O'||o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 1 AND c_nationkey = 3")
def condition_function(kb):
    p = Pattern([Edge(O, "placed_by", C), Edge(C, "part_of", Ent("N3"))], conditions=[lambda df: F.expr("cast(substring(c, 2) as long) % 2 = 1")])
    return match(kb, p).select("c", "o")


# scopes


@_q("SELECT 'O'||o_orderkey AS s, 'C'||o_custkey AS o, 'I1/premise' AS scope FROM orders")
def scoped_statements(kb):
    own = scopes.Scopes("I1")
    with own.scope("premise", "PREMISE") as uri:
        own.new_var("x")
    return kb.of("placed_by").withColumn("scope", F.lit(uri)).select("s", "o", "scope")


@_q("SELECT 'P'||p_partkey AS s, unnest(range(2, p_size + 1, 3))::BIGINT AS value FROM part UNION ALL SELECT 'P'||p_partkey||'-', unnest(range(p_size, 0, -7))::BIGINT FROM part")
def integer_range(kb):
    """A range for each part from its size, upwards and downwards; some are empty."""
    sizes = kb.of("size").select("s", F.col("o_lex").cast("long").alias("size"))
    up = scopes.integer_ranges(sizes.select("s", F.lit(2).cast("long").alias("start"), F.col("size").alias("stop"), F.lit(3).cast("long").alias("step")))
    down = scopes.integer_ranges(sizes.select(F.concat("s", F.lit("-")).alias("s"), F.col("size").alias("start"), F.lit(1).cast("long").alias("stop"), F.lit(-7).cast("long").alias("step")))
    return up.unionByName(down).select("s", "value")


# N-Triples


@_q("SELECT 'C'||c_custkey AS s, 'N'||c_nationkey AS o FROM customer")
def ntriples_facts_import(kb):
    some = kb.but(statements=kb.of("part_of").where("s LIKE 'C%'"))
    read = ntriples.parse(ntriples.lines(ntriples.projection(some, base="x:/m#", statements=True)))
    back = ntriples.import_facts(kb.only("nothing"), read, instance="x:/m#instance_of")
    twice = ntriples.import_facts(back, read, instance="x:/m#instance_of")  # what is there is not added again
    return twice.statements.select(scalars.uri_key(F.col("s")).alias("s"), scalars.uri_key(F.col("o")).alias("o"))


@_q("SELECT 'O'||l_orderkey||'|P'||l_partkey AS triple, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY 1")
def qualifier_rows(kb):
    out = ntriples.projection(kb.only("contains"), base="x:/m#", qualifiers=True).where("p LIKE '%/QUALIFIERS#%'").groupBy("s").agg(F.count("*").alias("n"))
    names = kb.of("contains").select(F.concat(F.lit("x:/m#"), "stm_id").alias("s"), F.concat_ws("|", "s", "o").alias("triple"))
    return out.join(names, "s").select("triple", "n")


# SPARQL

_s("sparql_path_alternative_star", f"{_SUBSTAR} SELECT 'customer' AS c UNION SELECT b FROM t WHERE a = 'customer' UNION SELECT 'C7'", "SELECT ?c WHERE { :C7 (:instance_of|:subclass_of)* ?c }")
_s("sparql_boolean_literal", "SELECT 'P'||p_partkey AS p FROM part WHERE p_size = 1", "SELECT ?p WHERE { ?p :size 1 FILTER (true) }")
_s("sparql_in", "SELECT 'P'||p_partkey AS p FROM part WHERE p_size IN (3, 5) AND p_brand NOT IN ('Brand#13')", 'SELECT ?p WHERE { ?p :size ?z . ?p :brand ?b FILTER (?z IN (3, 5)) FILTER (?b NOT IN ("Brand#13")) }')
_s("sparql_negated_set", "SELECT 'label' AS kind, c_name AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'label', c_mktsegment FROM customer WHERE c_custkey = 7", 'SELECT ("label" AS ?kind) ?o WHERE { :C7 !(:part_of|:instance_of) ?o }')
_s("sparql_optional_filter_outer", "SELECT 'N'||a.n_nationkey AS n, 'N'||b.n_nationkey AS m FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey", "SELECT ?n ?m WHERE { ?n :instance_of :nation . ?n :part_of ?r OPTIONAL { ?m :part_of ?r . ?m :instance_of :nation FILTER (?m != ?n) } }")
_s("sparql_not_exists_filter_outer", "SELECT 'N'||n_nationkey AS n FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_name < a.n_name)", "SELECT ?n WHERE { ?n :instance_of :nation . ?n :part_of ?r . ?n :label ?x FILTER NOT EXISTS { ?m :part_of ?r . ?m :label ?y FILTER (?y < ?x) } }")
_s("sparql_minus_unbound", "SELECT 'N'||n_nationkey AS n FROM nation WHERE n_regionkey NOT IN (1, 2)", "SELECT ?n WHERE { ?n :instance_of :nation OPTIONAL { ?n :part_of ?r FILTER (?r = :R1) } MINUS { { ?n :part_of :R1 } UNION { ?n :part_of :R2 } } }")
_s("sparql_leading_optional", "SELECT 'N'||n_nationkey AS n FROM nation WHERE n_regionkey = 1", "SELECT ?n WHERE { OPTIONAL { ?n :part_of :R1 . ?n :instance_of :nation } }")
_s("sparql_distinct_order_limit", "SELECT DISTINCT 'R'||n_regionkey AS r FROM nation ORDER BY 1 DESC LIMIT 3", "SELECT DISTINCT ?r WHERE { ?n :part_of ?r . ?n :instance_of :nation } ORDER BY DESC(?r) LIMIT 3")
_s("sparql_ask", "SELECT count(*) > 0 AS answer FROM customer WHERE c_nationkey = 3", "ASK { ?c :part_of :N3 . ?c :instance_of :customer }")


@_q("SELECT 'C'||c_custkey AS c, 'R'||r_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey OR n_regionkey <> 1 WHERE c_custkey % 100 = 0")
def sparql_join_after_optional(kb):
    """A variable that OPTIONAL leaves unbound joins with every value."""
    marks = _flag(kb, kb.of("segment").where("cast(substring(s, 2) as long) % 100 = 0"), "hundredth")
    return sparql.plain(sparql.query(kb.plus(marks), "SELECT ?c ?r WHERE { ?c :hundredth 1 . ?c :part_of ?n OPTIONAL { ?n :part_of ?r FILTER (?r = :R1) } ?r :instance_of :region }"))


__all__ = ["ORACLE_SQL", "QUERIES"]
