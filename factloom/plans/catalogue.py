"""Queries of the knowledge-graph engine over the star schema, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import closure, edit, lookup, rules
from ..operators.pattern import Edge, Ent, Lit, LitVar, Pattern, RelVar, Var, label_less, match, match_any
from . import sparql
from .model import constants, star, statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(sql: str | None = None, *, tables: bool = False):
    """Registers a query of a knowledge base, or, with ``tables``, of (spark, sf_dir)."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = f if tables else lambda spark, sf_dir: f(star(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


C, N, R, S, P, O = Var("c"), Var("n"), Var("r"), Var("s"), Var("p"), Var("o")  # noqa: E741
_PART_OF = "(SELECT 'N'||n_nationkey AS s, 'R'||n_regionkey AS o FROM nation UNION ALL SELECT 'C'||c_custkey, 'N'||c_nationkey FROM customer UNION ALL SELECT 'S'||s_suppkey, 'N'||s_nationkey FROM supplier)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment over two steps, asserted by a transitive rule if it is new."""
    return QUERIES["rule_transitive_once"](spark, sf_dir)


# lookups


@_q("SELECT 'N'||c_nationkey AS o FROM customer WHERE c_custkey = 7")
def stm_by_subject_pred(kb):
    return lookup.statements_of(kb, "C7", "part_of").select("o")


@_q("SELECT 'C'||c_custkey AS subject, 'part_of' AS p FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'S'||s_suppkey, 'part_of' FROM supplier WHERE s_nationkey = 3")
def inverse_statements(kb):
    return lookup.inverse_statements(kb, "N3")


@_q(
    "SELECT 'P'||l_partkey AS s, CAST(NULL AS VARCHAR) AS one, string_agg(o, ',' ORDER BY o) AS many FROM (SELECT DISTINCT l_partkey, 'S'||l_suppkey AS o FROM lineitem) GROUP BY 1 "
    "UNION ALL SELECT 'P'||p_partkey, 's:'||p_brand, NULL FROM part"
)
def attr_cardinality_shape(kb):
    out = lookup.shaped(kb.only("supplied_by", "brand"), ["brand"])
    return out.select("s", "one", F.array_join(F.array_sort("many"), ",").alias("many"))


@_q("SELECT min('C'||c_custkey) AS s FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 11)")
def label_lookup_first(kb):
    return lookup.by_label(kb, kb.of("label").where("s = 'C11'").first()["o_lex"])


@_q(
    "SELECT g, min(lex) AS lex FROM (SELECT doc_id % 50 AS g, source AS lex, CASE WHEN lang = 'de' THEN 0 WHEN doc_id % 7 = 0 THEN 1 END AS k, doc_id FROM documents) d "
    "JOIN (SELECT doc_id % 50 AS g, min(CASE WHEN lang = 'de' THEN 0 WHEN doc_id % 7 = 0 THEN 1 END) AS k FROM documents GROUP BY 1) b USING (g, k) GROUP BY 1",
    tables=True,
)
def language_choice(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tag = F.when(F.col("lang") == "de", "de").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.coalesce("lang", F.lit("xx")))
    return lookup.in_language(docs.select((F.col("doc_id") % 50).alias("g"), F.col("source").alias("lex"), tag.alias("tag")), ["g"], "lex", "tag", "de")


@_q("SELECT 'C'||c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def subjects_for_relation_filtered(kb):
    return lookup.subjects(kb, "segment", "s:BUILDING")


@_q("SELECT 'P'||p_partkey AS s FROM part WHERE p_size % 2 = 0")
def relevant_items(kb):
    flagged = kb.of("size").where("cast(o_lex as int) % 2 = 1").select(*statement(F.col("s"), "is_placeholder", F.lit(1), kind="L", o_type="int"))
    return lookup.relevant(kb.plus(flagged), kb.of("size").select("s"))


@_q(
    "SELECT s, o, quantity FROM (SELECT 'O'||l_orderkey AS s, 'P'||l_partkey AS o, CAST(round(l_quantity) AS BIGINT) AS quantity, "
    "row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1"
)
def first_qualifier(kb):
    first = lookup.first_qualifiers(kb, "quantity").withColumnRenamed("o", "quantity")
    return kb.of("contains").select("stm_id", "s", "o").join(first, "stm_id").select("s", "o", F.round(F.expr("cast(substring(quantity, 3) as double)")).cast("long").alias("quantity"))


@_q("SELECT * FROM (VALUES ('segment', 'is_activity,is_literal'), ('part_of', 'is_transitive')) t(relation, properties)")
def relation_property_list(kb):
    rows = [("is_activity", "is_relation_property"), ("is_literal", "is_relation_property"), ("is_transitive", "is_relation_property"), ("segment", "is_activity"), ("segment", "is_literal"), ("part_of", "is_transitive")]
    extra = None
    for s, p in rows:
        one = kb.spark.range(1).select(*statement(F.lit(s), p, F.lit(1), kind="L", o_type="int"))
        extra = one if extra is None else extra.unionByName(one)
    return lookup.relation_properties(kb.plus(extra)).where("relation IN ('segment', 'part_of')").select("relation", F.array_join("properties", ",").alias("properties"))


@_q("SELECT 'T'||l_orderkey AS tuple, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1 AS place, 'P'||p AS argument FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem)")
def tuple_elements_ordered(kb):
    parts = kb.of("contains").select(F.concat(F.lit("T"), F.expr("substring(s, 2)")).alias("tuple"), F.expr("try_cast(substring(o, 2) as long)").alias("k"))
    listed = parts.groupBy("tuple").agg(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.concat(F.lit("P"), k.cast("string"))).alias("elements"))
    rows, qualifiers = edit.tuple_rows(listed)
    return lookup.tuple_elements(kb.plus(rows, qualifiers=qualifiers))


# patterns


@_q("SELECT 'C'||c_custkey AS c, 'N'||n_nationkey AS n, 'R'||n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pattern_two_hop(kb):
    return match(kb, Pattern([Edge(C, "part_of", N), Edge(N, "part_of", R), Edge(C, "segment", LitVar("seg"))])).select("c", "n", "r")


@_q("SELECT 'C'||a.c_custkey AS a, 'C'||b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey")
def pattern_injective_pairs(kb):
    a, b = Var("a"), Var("b")
    return match(kb, Pattern([Edge(a, "part_of", N), Edge(b, "part_of", N), Edge(a, "segment", LitVar("g")), Edge(b, "segment", LitVar("g"))])).select("a", "b")


@_q()
def pattern_triangle(kb):
    found = match(kb, Pattern([Edge(O, "contains", P), Edge(P, "supplied_by", S), Edge(S, "part_of", N), Edge(C, "part_of", N), Edge(O, "placed_by", C)])).select("o", "p", "s")
    return found.distinct()


ORACLE_SQL["pattern_triangle"] = (
    "SELECT DISTINCT 'O'||l.l_orderkey AS o, 'P'||l.l_partkey AS p, 'S'||s_suppkey AS s FROM lineitem l JOIN orders ON l.l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) x ON pk = l.l_partkey JOIN supplier ON s_suppkey = sk AND s_nationkey = c_nationkey"
)


@_q("SELECT 'C'||c_custkey AS c, 'N'||c_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND n_nationkey <> 12")
def pattern_external_anchor(kb):
    return match(kb, Pattern([Edge(C, "part_of", N), Edge(N, "part_of", Ent("R2")), Edge(C, "instance_of", Ent("customer"))], externals=["N12"])).select("c", "n")


@_q("SELECT 'P'||p_partkey AS p FROM part WHERE p_size = 15")
def pattern_literal_constant(kb):
    return match(kb, Pattern([Edge(P, "size", Lit("n:15.0"))]))


@_q("SELECT 'P'||a.p_partkey AS a, 'P'||b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_size = 7")
def pattern_literal_variable(kb):
    a, b, z, v = Var("a"), Var("b"), LitVar("z"), LitVar("v")
    found = match(kb, Pattern([Edge(a, "size", z), Edge(b, "size", z), Edge(a, "brand", v), Edge(b, "brand", v)], conditions=[lambda df: F.col("z") == "n:7.0"]))
    return found.select("a", "b")


@_q("SELECT 'C'||c_custkey AS x, 'part_of' AS rel, 'N'||c_nationkey AS y FROM customer UNION ALL SELECT 'N'||n_nationkey, 'part_of', 'R'||n_regionkey FROM nation UNION ALL SELECT 'S'||s_suppkey, 'part_of', 'N'||s_nationkey FROM supplier UNION ALL SELECT 'O'||o_orderkey, 'placed_by', 'C'||o_custkey FROM orders")
def pattern_wildcard_relation(kb):
    marks = constants(kb.spark, [("part_of",), ("placed_by",)], ["s"]).select(*statement(F.col("s"), "is_functional", F.lit(1), kind="L", o_type="int"))
    return match(kb.plus(marks), Pattern([Edge(Var("x"), RelVar("rel", (("is_functional", "n:1.0"),)), Var("y"))]))


@_q("SELECT 'P'||a.p_partkey AS a, 'P'||b.p_partkey AS b FROM part a, part b WHERE a.p_size = 49 AND b.p_size = 50 AND a.p_partkey <> b.p_partkey")
def pattern_cross_components(kb):
    a, b = Var("a"), Var("b")
    return match(kb, Pattern([Edge(a, "size", Lit("n:49.0")), Edge(b, "size", Lit("n:50.0"))], components=2))


@_q("SELECT 'C'||c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def pattern_absence(kb):
    pending = kb.of("status").where("o_lex = 'P'").select("s")
    placed = kb.of("placed_by").join(pending, "s", "left_semi").select(F.col("o").alias("s")).distinct().select(*statement(F.col("s"), "has_pending_order", F.lit(1), kind="L", o_type="int"))
    return match(kb.plus(placed, bag=False), Pattern([Edge(C, "instance_of", Ent("customer"))], absent=[("c", "has_pending_order")]))


@_q("SELECT 'P'||p_partkey AS p FROM part WHERE p_size = 10 UNION ALL SELECT 'P'||p_partkey FROM part WHERE p_brand = 'Brand#13'")
def pattern_or_branches_bag(kb):
    return match_any(kb, [Pattern([Edge(P, "size", Lit("n:10.0"))]), Pattern([Edge(P, "brand", Lit("s:Brand#13"))])])


@_q("SELECT 'N'||a.n_nationkey AS a, 'N'||b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name AND a.n_nationkey <> b.n_nationkey")
def condition_label_less(kb):
    a, b, x, y = Var("a"), Var("b"), LitVar("x"), LitVar("y")
    p = Pattern([Edge(a, "part_of", R), Edge(b, "part_of", R), Edge(a, "label", x), Edge(b, "label", y), Edge(a, "instance_of", Ent("nation")), Edge(b, "instance_of", Ent("nation"))], conditions=[lambda df: label_less(F.col("x"), F.col("y"))])
    return match(kb, p).select("a", "b")


# SPARQL


def _s(name: str, sql: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: sparql.plain(sparql.query(star(spark, sf_dir), text))
    ORACLE_SQL[name] = sql


_s("sparql_bgp_filter_ne", "SELECT 'S'||a.s_suppkey AS a, 'S'||b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey", "SELECT ?a ?b WHERE { ?a :instance_of :supplier . ?b :instance_of :supplier . ?a :part_of ?n . ?b :part_of ?n . FILTER (?a != ?b) }")
_s("sparql_minus", "SELECT 'C'||c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'", 'SELECT ?c WHERE { ?c :instance_of :customer . MINUS { ?c :segment "BUILDING" } }')
_s("sparql_optional", "SELECT 'P'||p_partkey AS p, 'S'||x.l_suppkey AS s FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 5) x ON l_partkey = p_partkey WHERE p_size < 3", "SELECT ?p ?s WHERE { ?p :size ?z . OPTIONAL { ?p :supplied_by ?s . FILTER (?s = :S5) } FILTER (?z < 3) }")
_s("sparql_union", "SELECT 'P'||p_partkey AS p FROM part WHERE p_size = 4 UNION ALL SELECT 'P'||p_partkey FROM part WHERE p_size = 5", "SELECT ?p WHERE { { ?p :size 4 } UNION { ?p :size 5 } }")
_s("sparql_group", "SELECT 'N'||c_nationkey AS n, count(*)::DOUBLE::VARCHAR AS k FROM customer GROUP BY 1 HAVING count(*) > 3", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c :part_of ?n . ?c :instance_of :customer } GROUP BY ?n HAVING (COUNT(?c) > 3)")
_s("sparql_order_limit", "SELECT 'P'||p_partkey AS p FROM part ORDER BY p_size DESC, 'P'||p_partkey LIMIT 10 OFFSET 5", "SELECT ?p WHERE { ?p :size ?z } ORDER BY DESC(?z) ?p LIMIT 10 OFFSET 5")
_s("sparql_path_star", "WITH RECURSIVE e AS (SELECT 'P'||p_partkey AS a, 'P'||(p_partkey // 2) AS b FROM part WHERE p_partkey > 0), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT b FROM t WHERE a = 'P777' UNION SELECT 'P777'", "SELECT ?b WHERE { :P777 :parent* ?b }")
_s("sparql_unbound_var", "SELECT 'R'||r_regionkey AS s, CAST(NULL AS VARCHAR) AS o FROM region", "SELECT ?s ?o WHERE { ?s :instance_of :region }")
_s("sparql_predicate_variable", "SELECT 'part_of' AS p, 'N'||c_nationkey AS o FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'instance_of', 'customer' UNION ALL SELECT 'label', c_name FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_custkey = 3", "SELECT ?p ?o WHERE { :C3 ?p ?o }  # all of one subject")
_s("sparql_exists", "SELECT 'C'||c_custkey AS c FROM customer WHERE c_nationkey = 4 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "SELECT ?c WHERE { ?c :part_of :N4 . ?c :instance_of :customer FILTER EXISTS { ?o :placed_by ?c } }")
_s("sparql_values_bind", "SELECT 'N'||n_nationkey AS n, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'two' END AS name FROM nation WHERE n_regionkey IN (1, 2)", 'SELECT ?n ?name WHERE { VALUES ?r { :R1 :R2 } ?n :part_of ?r . BIND (IF(?r = :R1, "one", "two") AS ?name) }')
_s("sparql_subselect", "SELECT 'N'||n_nationkey AS n, 'R'||n_regionkey AS r FROM nation JOIN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 5) ON c_nationkey = n_nationkey", "SELECT ?n ?r WHERE { { SELECT ?n WHERE { ?c :instance_of :customer . ?c :part_of ?n } GROUP BY ?n HAVING (COUNT(*) > 5) } ?n :part_of ?r }")
_s("sparql_construct", "SELECT 'R'||n_regionkey AS s, 'has_part' AS p, 'N'||n_nationkey AS o FROM nation", "CONSTRUCT { ?r :has_part ?n } WHERE { ?n :part_of ?r . ?n :instance_of :nation }")
_s("sparql_path_sequence", "SELECT 'O'||o_orderkey AS o, 'R'||n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "SELECT ?o ?r WHERE { ?o :placed_by/:part_of/:part_of ?r }")


# rules


@_q(f"SELECT DISTINCT a.s, 'part_of' AS p, b.o FROM {_PART_OF} a JOIN {_PART_OF} b ON a.o = b.s")
def rule_transitive_once(kb):
    x, y, z = Var("x"), Var("y"), Var("z")
    rule = rules.Rule("transitive", [Pattern([Edge(x, "part_of", y), Edge(y, "part_of", z)])], [rules.Template(x, "part_of", z)])
    return rules.delta(kb, rule).select("s", "p", "o")


@_q("WITH RECURSIVE e AS (SELECT 'P'||p_partkey AS a, 'P'||(p_partkey // 2) AS b FROM part WHERE p_partkey > 0), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
def rule_transitive_fixpoint(kb):
    x, y, z = Var("x"), Var("y"), Var("z")
    # a part may be its own ancestor, so the pattern is not injective
    rule = rules.Rule("transitive", [Pattern([Edge(x, "parent", y), Edge(y, "parent", z)], injective=False)], [rules.Template(x, "parent", z)])
    done, _, _ = rules.fixpoint(kb.only("parent"), [rule])
    return done.statements.select(F.col("s").alias("a"), F.col("o").alias("b"))


@_q("WITH RECURSIVE e AS (SELECT 'P'||p_partkey AS a, 'P'||(p_partkey // 2) AS b FROM part WHERE p_partkey > 0), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
def closure_by_hops(kb):
    return closure.transitive_closure(closure.relation_edges(kb, "parent")).select("a", "b")


@_q("SELECT 'R'||n_regionkey AS s, 'part_of' AS p, 'N'||n_nationkey AS o FROM nation UNION ALL SELECT 'N'||c_nationkey, 'part_of', 'C'||c_custkey FROM customer UNION ALL SELECT 'N'||s_nationkey, 'part_of', 'S'||s_suppkey FROM supplier")
def rule_symmetric(kb):
    return rules.reverse_statements(kb, "part_of").select("s", "p", "o")


@_q("SELECT 'C'||o_custkey AS s, 'has_placed' AS p, 'O'||o_orderkey AS o FROM orders")
def rule_inverse(kb):
    return rules.reverse_statements(kb, "placed_by", inverse="has_placed").select("s", "p", "o")


@_q("SELECT DISTINCT 'P'||l_partkey AS s, 'related_to' AS p, 'S'||l_suppkey AS o FROM lineitem")
def rule_subproperty_copy(kb):
    return rules.copy_statements(kb, "supplied_by", "related_to").select("s", "p", "o")


@_q("SELECT DISTINCT 'O'||o_orderkey AS s, 'lies_in' AS p, 'N'||c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def assert_insert_if_new(kb):
    return rules.delta(kb, rules.Rule("lies_in", [Pattern([Edge(O, "placed_by", C), Edge(C, "part_of", N)])], [rules.Template(O, "lies_in", N)])).select("s", "p", "o")


@_q("SELECT 'N'||c_nationkey AS s, 'N'||s_nationkey AS o, count(*) AS copies FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) ON pk = l_partkey JOIN supplier ON sk = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2")
def assert_bag(kb):
    other = Var("m")
    p = Pattern([Edge(O, "placed_by", C), Edge(C, "part_of", N), Edge(O, "contains", P), Edge(P, "supplied_by", S), Edge(S, "part_of", other)])
    rows = rules.delta(kb, rules.Rule("trade", [p], [rules.Template(N, "trades_with", other)], only_new=False))
    return rows.groupBy("s", "o").agg(F.count("*").alias("copies"))  # a statement for each match


@_q("SELECT 'N'||n_nationkey AS o, 'Ia' AS prefix, 1 AS same, (SELECT count(*) FROM nation) AS made FROM nation")
def rule_new_instance_skolem(kb):
    rule = rules.Rule("depot", [Pattern([Edge(N, "instance_of", Ent("nation"))])], [rules.Template(rules.New("d", ("n",)), "located_in", N)])
    rows = rules.delta(kb, rule).unionByName(rules.delta(kb, rule))  # made twice, the same both times
    made = rows.agg(F.countDistinct("s").alias("made"))
    return rows.groupBy("o").agg(F.substring(F.min("s"), 1, 2).alias("prefix"), F.countDistinct("s").cast("int").alias("same")).crossJoin(made)  # one row


_SEGMENTS = "(SELECT DISTINCT c_mktsegment AS m FROM customer)"


@_q(f"SELECT 'C'||c_custkey AS s, 'wants' AS p, c_mktsegment AS o FROM customer WHERE (SELECT count(*) FROM {_SEGMENTS}) > 1")
def rule_exclusion_one_left(kb):
    segments = kb.of("segment").select(F.col("o_lex").alias("member")).distinct().withColumn("cls", F.lit("segment"))
    negative = kb.of("segment").select("s", "o_lex").join(segments, F.col("o_lex") != F.col("member")).select(*statement(F.col("s"), "dislikes", F.col("member")))
    return rules.by_exclusion(kb.plus(negative), "dislikes", "wants", segments).select("s", "p", "o")


@_q("SELECT 'O'||l_orderkey AS s, 'contains' AS p, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) = 4")
def rule_four_negatives(kb):
    return rules.groups_of_size(kb, "contains", "n = 4")


@_q("SELECT 'O'||l_orderkey AS s, 'contains' AS p, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 6")
def rule_contradiction_rows(kb):
    return rules.groups_of_size(kb, "contains", "n > 6")


@_q("SELECT count(*) = (SELECT count(*) FROM customer) AS solved FROM customer")
def goal_reached_flag(kb):
    n = kb.entities.where("uri LIKE 'C%'").count()
    return rules.goal_reached(kb, ["segment"], n)


@_q("SELECT p, count(*) AS n FROM (SELECT DISTINCT 'lies_in' AS p, o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'holds', n_regionkey, n_nationkey FROM nation) GROUP BY 1")
def rel_map_counts(kb):
    one = rules.Rule("lies_in", [Pattern([Edge(O, "placed_by", C), Edge(C, "part_of", N)])], [rules.Template(O, "lies_in", N)])
    two = rules.Rule("holds", [Pattern([Edge(N, "part_of", R), Edge(N, "instance_of", Ent("nation"))])], [rules.Template(R, "holds", N)])
    return rules.relation_counts(rules.delta(kb, one).unionByName(rules.delta(kb, two)))


@_q("SELECT p, ['blue','orange','green','red','purple','brown','pink','gray','olive','cyan'][k] AS colour FROM (SELECT p, row_number() OVER (ORDER BY n DESC, p) AS k FROM (SELECT 'part_of' AS p, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'placed_by', (SELECT count(*) FROM orders) UNION ALL SELECT 'parent', (SELECT count(*) FROM part WHERE p_partkey > 0)))")
def edge_rank_palette(kb):
    from ..sources.reports import edge_colours

    return edge_colours(kb.of("part_of", "placed_by", "parent"))


@_q(f"SELECT 'segment' AS relation, 'C'||c_custkey AS s, (SELECT count(*) FROM {_SEGMENTS}) - 1 AS n, (SELECT string_agg('s:'||m, ',' ORDER BY m) FROM {_SEGMENTS} WHERE m <> c_mktsegment) AS objects FROM customer")
def candidate_report(kb):
    every = kb.of("segment").select("s").crossJoin(F.broadcast(kb.of("segment").select("o").distinct())).withColumn("relation", F.lit("segment"))  # five segments
    return rules.candidates(kb, "segment", every).select("relation", "s", "n", F.array_join("objects", ",").alias("objects"))


@_q(
    "WITH bad AS (SELECT DISTINCT o_custkey AS c, c_mktsegment AS s, o_orderpriority AS o FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS g FROM customer), p AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS p FROM orders), "
    "perms AS (SELECT a, b, c, d, e FROM range(1, 6) a(a), range(1, 6) b(b), range(1, 6) c(c), range(1, 6) d(d), range(1, 6) e(e) WHERE len(list_distinct([a, b, c, d, e])) = 5), "
    "used AS (SELECT c, list(struct_pack(s := list_position(g, s), o := list_position(p, o))) AS bad FROM bad, g, p GROUP BY c) "
    "SELECT 'C'||used.c AS s, count(*) AS n FROM used, perms WHERE len(list_filter(bad, lambda x: [perms.a, perms.b, perms.c, perms.d, perms.e][x.s] = x.o)) = 0 GROUP BY 1",
    tables=True,
)
def permutation_count(spark, sf_dir):
    """For each customer that ordered: in how many ways segments and priorities go together one to one, if its own segment has none of the priorities of its orders."""
    segments = star(spark, sf_dir).of("segment").select("s", F.col("o").alias("segment"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ordered = orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("s"), F.col("o_orderpriority").alias("priority")).distinct()
    bad = ordered.join(segments, "s").select(F.col("s").alias("case"), F.col("segment").alias("s"), F.col("priority").alias("o")).distinct()
    names = lambda df, c: sorted(r[c] for r in df.select(c).distinct().limit(9).collect())  # noqa: E731  a closed class of up to eight
    return rules.admissible(bad, names(segments, "segment"), names(ordered, "priority")).where("n > 0").select(F.col("case").alias("s"), "n")


# closures and graphs

_SUB = "(SELECT * FROM (VALUES ('region','place'),('nation','place'),('customer','party'),('supplier','party'),('order','document'),('user','party'),('place','thing'),('party','thing'),('document','thing'),('product','thing'),('thing','meta')) t(a, b) UNION ALL SELECT DISTINCT 'T_'||p_type, 'product' FROM part)"
_SUBSTAR = f"WITH RECURSIVE e AS {_SUB}, t AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT t.a, e.b, hops + 1 FROM t JOIN e ON t.b = e.a)"


_TYPED = "(SELECT 'R'||r_regionkey AS s, 'region' AS c FROM region UNION ALL SELECT 'N'||n_nationkey, 'nation' FROM nation UNION ALL SELECT 'C'||c_custkey, 'customer' FROM customer UNION ALL SELECT 'S'||s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'P'||p_partkey, 'T_'||p_type FROM part UNION ALL SELECT 'O'||o_orderkey, 'order' FROM orders UNION ALL SELECT DISTINCT 'U'||user_id, 'user' FROM events)"


@_q(f"{_SUBSTAR} SELECT s AS entity, 1 AS step, 'instance_of' AS via, c AS cls FROM {_TYPED} UNION ALL SELECT s, hops + 1, 'subclass_of', b FROM {_TYPED} JOIN t ON t.a = c")
def taxonomy_path(kb):
    return closure.taxonomy_paths(kb)


@_q(f"{_SUBSTAR} SELECT DISTINCT a AS cls FROM t WHERE b = 'thing'")
def all_subclasses(kb):
    return closure.subclasses_of(kb, "thing")


@_q("SELECT 'C'||c_custkey AS s FROM customer UNION ALL SELECT 'S'||s_suppkey FROM supplier UNION ALL SELECT DISTINCT 'U'||user_id FROM events")
def all_instances(kb):
    return closure.instances_of(kb, "party")


@_q("SELECT 'C'||c_custkey AS entity, k AS cls, k IN ('party', 'customer') AS holds FROM customer, (VALUES ('party'), ('place'), ('customer')) t(k)")
def instance_test(kb):
    some = kb.of("segment").select(F.col("s").alias("entity"), F.explode(F.array(*map(F.lit, ("party", "place", "customer")))).alias("cls"))
    return closure.is_instance(kb, some)


@_q(f"{_SUBSTAR} SELECT DISTINCT a AS cls FROM t WHERE b = 'meta'")
def class_test(kb):
    return closure.is_class(kb)


@_q("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), one AS (SELECT 21 AS n, 0 AS h UNION SELECT b, 1 FROM u WHERE a = 21), two AS (SELECT n, h FROM one UNION SELECT b, 2 FROM u JOIN one ON a = n WHERE h = 1) SELECT 'P'||n AS node, min(h) AS hops FROM two GROUP BY 1")
def ego_radius2(kb):
    return closure.ego_graph(kb.only("parent"), "P21", 2)


@_q("SELECT * FROM (SELECT 'Ia'||c_custkey AS source, 'part_of' AS p, 'N5' AS target FROM customer WHERE c_nationkey = 5 ORDER BY 1 LIMIT 3) UNION ALL SELECT 'S'||s_suppkey, 'part_of', 'N5' FROM supplier WHERE s_nationkey = 5 UNION ALL SELECT 'N5', 'part_of', 'R'||n_regionkey FROM nation WHERE n_nationkey = 5")
def neighbourhood_capped(kb):
    """Of the customers of a nation, under names of made entities, three are shown; suppliers all."""
    made = kb.of("part_of").withColumn("s", F.when(F.col("s").startswith("C"), F.concat(F.lit("Ia"), F.expr("substring(s, 2)"))).otherwise(F.col("s")))
    return closure.neighbourhood(kb.but(statements=made), "N5").select("source", "p", "target")


@_q("SELECT DISTINCT 'P'||l_partkey AS source, 'S'||l_suppkey AS target FROM lineitem UNION SELECT 'O'||o_orderkey, 'C'||o_custkey FROM orders")
def complete_graph_edges(kb):
    return closure.complete_graph(kb.only("supplied_by", "placed_by", "label"))


@_q("SELECT (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_custkey) FROM orders) AS nodes")
def simple_graph_counts(kb):
    nodes, edges = closure.simple_graph(kb.only("placed_by"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(nodes.agg(F.count("*").alias("nodes")))  # one row each


# edits and checks


@_q("SELECT 'P'||l_partkey AS s, 'supplied_by' AS p, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def functional_violations(kb):
    return edit.functional_violations(kb, ["supplied_by"])


@_q("SELECT 'D'||(doc_id % 100) AS s, 'title' AS p, lang AS o_lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1", tables=True)
def lang_functional_violations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = F.concat(F.lit("D"), (F.col("doc_id") % 100).cast("string"))
    kb = star(spark, sf_dir)
    return edit.language_violations(kb.plus(docs.select(*statement(s, "title", F.col("source"), kind="L", o_type="str", lang=F.col("lang")))), ["title"])


@_q("SELECT 'C'||c_custkey AS s, CASE WHEN c_custkey % 10 = 0 THEN 's:RETIRED' ELSE 's:'||c_mktsegment END AS o FROM customer")
def overwrite_merge(kb):
    rows = kb.of("segment").where("try_cast(substring(s, 2) as long) % 10 = 0").select(*statement(F.col("s"), "segment", F.lit("RETIRED"), kind="L", o_type="str"))
    return edit.overwrite(kb.only("segment"), rows).statements.select("s", "o")


@_q("SELECT p, count(*) AS n FROM (SELECT 'part_of' AS p FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'part_of' FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'part_of' FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'segment' FROM customer) GROUP BY 1")
def delete_entity_cascade(kb):
    gone = kb.entities.where("uri = 'N3'").select("uri")
    return edit.delete_entities(kb.only("part_of", "segment"), gone).statements.groupBy("p").agg(F.count("*").alias("n"))


@_q("SELECT 'C'||c_custkey AS s, 'N'||(CASE WHEN c_nationkey IN (1, 2, 3) THEN 1 ELSE c_nationkey END) AS o FROM customer")
def entity_merge(kb):
    same = constants(kb.spark, [("N1", "N2"), ("N2", "N3")], ["a", "b"])
    return edit.merge_entities(kb.only("part_of"), edit.representatives(same)).statements.where("s LIKE 'C%'").select("s", "o")


@_q("SELECT a, b, 1 AS ids, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS mappings FROM (SELECT DISTINCT 'P'||l_partkey AS a, 'S'||l_suppkey AS b FROM lineitem)")
def evaluated_mapping_dedupe(kb):
    from ..operators.expressions import evaluated

    pairs = kb.of("supplied_by").select(F.array("s", "o").alias("args"))
    made = evaluated(pairs.unionByName(pairs), "op")
    ids = made.groupBy("args").agg(F.countDistinct("mapping").cast("int").alias("ids")).select(F.get("args", 0).alias("a"), F.get("args", 1).alias("b"), "ids")
    return ids.crossJoin(made.agg(F.countDistinct(F.unhex("mapping")).alias("mappings")))  # one row


@_q("SELECT 'P'||l_partkey||'-S'||l_suppkey AS mapping, 1 AS place, 'S'||l_suppkey AS argument, 'place' AS expected FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def type_check_violations(kb):
    from ..operators.checks import type_violations

    calls = kb.of("supplied_by").select(F.concat("s", F.lit("-"), "o").alias("mapping"), F.lit("op").alias("operator"), F.array("s", "o").alias("args"))
    signature = constants(kb.spark, [("op", "0", "product"), ("op", "1", "place")], ["operator", "place", "expected"]).withColumn("place", F.col("place").cast("int"))
    return type_violations(kb, calls, signature)


@_q("SELECT 'P'||p_partkey AS node, 4 AS hops FROM part WHERE p_partkey // 4 * 4 + 3 <= (SELECT max(p_partkey) FROM part)")
def taxonomy_cycles(kb):
    """Classes in circles of four: each is above itself after four steps. Those of an incomplete circle are not."""
    k = F.expr("cast(substring(s, 2) as long)")
    above = F.when(k % 4 == 3, k - 3).otherwise(k + 1)
    edges = kb.of("size").select(F.col("s").alias("a"), F.concat(F.lit("P"), above.cast("string")).alias("b"))
    return closure.transitive_closure(edges).where("a = b").select(F.col("a").alias("node"), "hops")


@_q("SELECT kind, count(*) AS n FROM (SELECT 'direct' AS kind FROM orders UNION ALL SELECT 'subject' FROM orders UNION ALL SELECT 'object' FROM orders) GROUP BY 1")
def rdf_projection_reified(kb):
    from ..sources.ntriples import projection

    out = projection(kb.only("placed_by"), base="x:/m#", statements=True)
    kind = F.when(F.col("p").contains("/STATEMENTS#"), "subject").when(F.col("p").contains("/PREDICATES#"), "object").otherwise("direct")
    return out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@_q("SELECT 'C'||c_custkey AS s, 'label' AS p, c_name AS o FROM customer UNION ALL SELECT 'C'||c_custkey, 'part_of', 'N'||c_nationkey FROM customer")
def nt_roundtrip(kb):
    from ..sources import ntriples

    some = kb.but(statements=kb.of("label", "part_of").where("s LIKE 'C%'"))
    lines = ntriples.lines(ntriples.projection(some, base="x:/m#"))
    back = ntriples.parse(lines)
    return back.select(scalars.uri_key(F.col("s")).alias("s"), scalars.uri_key(F.col("p")).alias("p"), F.when(F.col("o_is_uri"), scalars.uri_key(F.col("o"))).otherwise(F.col("o")).alias("o"))


@_q("SELECT 'x:/a#C'||c_custkey AS s FROM customer")
def module_filter(kb):
    from ..sources.ntriples import projection

    at = F.when(F.col("s").startswith("C"), "x:/a#").otherwise("x:/b#")
    some = kb.of("label").where("s LIKE 'C%' OR s LIKE 'S%'").withColumn("s", F.concat(at, "s"))
    return projection(kb.but(statements=some), modules="x:/a").select("s")


@_q("SELECT 'N'||n_nationkey AS s, 'because N'||n_nationkey||' is in R'||n_regionkey AS explanation FROM nation")
def explanations(kb):
    rule = rules.Rule("in", [Pattern([Edge(N, "part_of", R), Edge(N, "instance_of", Ent("nation"))])], [rules.Template(N, "in", R)], explanation="because {n} is in {r}")
    return rules.explained(rules.delta(kb, rule), rule).select("s", "explanation")


@_q()
def label_segments(kb):
    return kb.of("label").where("s LIKE 'P%'").select("s", F.array_join(scalars.label_segments(F.col("o_lex"), 12), "|").alias("segments"))


@_q("SELECT 'O'||o_orderkey AS s, 'x'||'.'||'c' AS o FROM orders")
def scope_copy_rename(kb):
    from ..operators.scopes import copy_scope

    rows = kb.of("placed_by").withColumn("scope", F.lit("x")).withColumn("o", F.lit("c"))
    names = constants(kb.spark, [("c", "x.c")], ["old", "new"])
    return copy_scope(rows, names, "y").select("s", "o")
