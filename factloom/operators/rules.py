"""Forward rules: premises are patterns, consequences are new statements, new entities, merges or a stop.

A rule is matched on one version of the knowledge base, set at a time; its delta is computed, checked and stored as a
whole. Insert-if-new rules give distinct triples that are not there; others keep one statement for each match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import map_of, render
from ..plans.model import COLUMNS, KB, constants, content_id, statement
from ..plans.tables import local, written
from .closure import RoundLimit
from .edit import FunctionalError, functional_violations, insert, merge_entities, new_id, representatives
from .pattern import Ent, Lit, LitVar, Pattern, RelVar, Var, match_any


class RuleStop(Exception):
    """A rule ended the reasoning."""


class Contradiction(RuleStop):
    pass


class GoalReached(RuleStop):
    pass


@dataclass(frozen=True)
class New:
    """An entity made for each match, named by the rule and the given variables."""

    name: str
    of: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    s: Var | Ent | New
    p: str | RelVar
    o: Var | LitVar | Ent | Lit | New
    #: Whether only new triples are asserted; None leaves it to the rule.
    only_new: bool | None = None


@dataclass
class Rule:
    name: str
    branches: list[Pattern] = field(default_factory=list)
    asserts: list[Template] = field(default_factory=list)
    only_new: bool = True
    #: A SPARQL premise instead of branches: its variables are the result's columns.
    sparql: str | None = None
    #: Pairs of variables whose entities are merged, the first into the second.
    merge: tuple[str, str] | None = None
    #: A function of (kb) giving statement-like (s, p, o_kind, o) rows, for consequences that no template can say.
    consequent: Callable[[KB], DataFrame] | None = None
    #: A match raises this, with the message rendered from the bindings.
    stop: type[RuleStop] | None = None
    message: str = ""
    explanation: str = ""

    def is_new(self, t: Template) -> bool:
        return self.only_new if t.only_new is None else t.only_new


def bindings(kb: KB, rule: Rule) -> DataFrame:
    if rule.sparql is not None:
        from ..plans.sparql import query

        if rule.branches:
            raise ValueError("a rule has either a SPARQL premise or patterns")
        return query(kb, rule.sparql)
    return match_any(kb, rule.branches)


def _term(rule: Rule, t) -> Column:
    if isinstance(t, Var | LitVar | RelVar):
        return F.col(t.name)
    if isinstance(t, New):
        return new_id("Ia", F.lit(rule.name), F.lit(t.name), *[F.col(v) for v in t.of])
    return F.lit(t.uri if isinstance(t, Ent) else t.key if isinstance(t, Lit) else t)


def template_rows(rule: Rule, found: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """s, p, o_kind, o, only_new, rule, bindings of a rule's templates for each of its matches ``found``, and the columns ``keep``."""
    bound = map_of({c: F.col(c) for c in found.columns if c not in keep})
    kind = lambda t: "L" if isinstance(t, Lit | LitVar) else "E"
    parts = [
        found.select(*keep, _term(rule, t.s).alias("s"), _term(rule, t.p).alias("p"), F.lit(kind(t.o)).alias("o_kind"), _term(rule, t.o).alias("o"), F.lit(rule.is_new(t)).alias("only_new"), F.lit(rule.name).alias("rule"), bound.alias("bindings"))
        for t in rule.asserts
    ]
    return reduce(DataFrame.unionByName, parts)


def unscoped(kb: KB, rows: DataFrame) -> DataFrame:
    """``rows`` (s, o and others) without those about entities of a scope: rules don't touch them."""
    if kb.entities.schema["scope"].dataType.simpleString() == "void":
        return rows
    scoped = kb.entities.where("scope IS NOT NULL").select("uri")
    return rows.join(scoped.select(F.col("uri").alias("s")), "s", "left_anti").join(scoped.select(F.col("uri").alias("o")), "o", "left_anti")


def delta(kb: KB, rule: Rule, found: DataFrame | None = None) -> DataFrame:
    """s, p, o_kind, o, rule, bindings of what the rule asserts; nothing about entities of a scope."""
    if rule.consequent is not None:
        rows = rule.consequent(kb).select("s", "p", "o_kind", "o", F.lit(rule.only_new).alias("only_new"), F.lit(rule.name).alias("rule"), map_of({}).alias("bindings"))
    else:
        rows = template_rows(rule, bindings(kb, rule) if found is None else found)
    rows = unscoped(kb, rows)
    kinds = {rule.only_new} if rule.consequent is not None else {rule.is_new(t) for t in rule.asserts}
    columns = ["s", "p", "o_kind", "o", "rule", "bindings"]
    if kinds == {False}:
        return rows.select(*columns)
    relations = [t.p for t in rule.asserts] if rule.consequent is None else [None]
    there = kb.of(*dict.fromkeys(relations)) if all(isinstance(p, str) for p in relations) else kb.statements
    new = rows.where("only_new").dropDuplicates(["s", "p", "o"]).join(there.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*columns)
    return new if kinds == {True} else new.unionByName(rows.where("NOT only_new").select(*columns))


def as_statements(rows: DataFrame, *, mod: str = "derived") -> DataFrame:
    """Statements of (s, p, o_kind, o) rows; a literal's text is taken from its key."""
    null = F.lit(None).cast("string")
    number = F.col("o").startswith("n:")
    text = F.when(F.col("o_kind") == "L", F.substring("o", F.lit(3), F.length("o")))
    return rows.select(
        content_id(F.lit(mod), F.col("s"), F.col("p"), F.col("o")).alias("stm_id"), F.lit(mod).alias("mod"), F.lit(1).cast("long").alias("seq"), "s", "p", "o_kind", "o",
        F.when(F.col("o_kind") == "L", F.when(number, "float").otherwise("str")).alias("o_type"), text.alias("o_lex"), null.alias("o_lang"), null.alias("scope"), F.lit(False).alias("free"),
    )


def apply(kb: KB, rule: Rule, *, functional: tuple[str, ...] = (), mod: str = "derived") -> tuple[KB, DataFrame]:
    """(new knowledge base, delta with provenance). Raises the rule's stop if it has one and its premise matches."""
    if rule.stop is not None or rule.merge is not None:
        found = written(bindings(kb, rule), "matches")
        if rule.stop is not None:
            first = found.select(render(F.lit(rule.message), {c: F.col(c) for c in found.columns}).alias("text")).orderBy("text").limit(1).collect()
            if first:
                raise rule.stop(first[0]["text"])
            return kb, found
        pairs = found.select(F.col(rule.merge[0]).alias("a"), F.col(rule.merge[1]).alias("b"))
        return merge_entities(kb, representatives(pairs), functional=functional), found
    rows = written(delta(kb, rule), "delta")
    return insert(kb, as_statements(rows, mod=mod), functional=functional), rows


def apply_all(kb: KB, rules: list[Rule], **more) -> tuple[KB, list[DataFrame], RuleStop | None]:
    """Rules one after the other; the first stop ends it and is returned."""
    out = []
    for rule in rules:
        try:
            kb, rows = apply(kb, rule, **more)
        except RuleStop as stop:
            return kb, out, stop
        out.append(rows)
    return kb, out, None


def fixpoint(kb: KB, rules: list[Rule], *, max_rounds: int | None = None, functional: tuple[str, ...] = (), mod: str = "derived") -> tuple[KB, int, RuleStop | None]:
    """Rounds of all rules until one gives no new statement: (new knowledge base, rounds, stop).

    Rules of patterns and templates are evaluated semi-naively, see ``fixpoint.derived``: a round sees what the rounds before it
    found. Where a rule merges entities, has a SPARQL premise or asks for the absence or properties that another asserts, all rules are matched on the
    whole base in each round, one after the other. Raises ``RoundLimit`` if ``max_rounds`` is given and so many rounds leave it open whether
    another finds more. Rules that keep a statement for each match have no fixpoint and are refused.
    """
    from .fixpoint import derived, semi_naive_fits

    if any(r.stop is None and r.merge is None and any(not r.is_new(t) for t in r.asserts) or r.consequent is not None and not r.only_new for r in rules):
        raise ValueError("a rule that asserts what is there already never comes to an end")
    if semi_naive_fits(rules):
        rows, n, stop = derived(kb, rules, max_rounds=max_rounds)
        after = kb.plus(as_statements(rows, mod=mod), bag=False)
        if functional:
            touched = rows.where(F.col("p").isin(*functional)).select("s", "p").distinct()
            bad = functional_violations(after, list(functional)).join(touched, ["s", "p"], "left_semi").limit(1).collect()
            if bad:
                raise FunctionalError(f"{bad[0]['s']} {bad[0]['p']}: {bad[0]['n']} objects")
        return after, n, stop
    for n in count():
        if n == max_rounds:
            raise RoundLimit(f"statements were new until round {max_rounds}")
        kb, deltas, stop = apply_all(kb, rules, functional=functional, mod=mod)
        if stop is not None or all(d.isEmpty() for d in deltas):
            return kb, n + 1, stop
        kb = kb.but(statements=written(kb.statements, "statements"))


def copy_statements(kb: KB, old: str, new: str) -> DataFrame:
    """(s, new, o) for each (s, old, o) that is not there yet."""
    rows = kb.of(old).select("s", F.lit(new).alias("p"), "o_kind", "o").distinct()
    return rows.join(kb.of(new).select("s", "o"), ["s", "o"], "left_anti").select("s", "p", "o_kind", "o")


def reverse_statements(kb: KB, p: str, *, inverse: str | None = None) -> DataFrame:
    """(o, p, s) for each (s, p, o), or with the inverse relation, that is not there yet; nothing from inside scopes."""
    to = inverse or p
    rows = kb.edges(p).where("o_kind = 'E'").select(F.col("o").alias("s"), F.lit(to).alias("p"), "o_kind", F.col("s").alias("o")).distinct()
    return rows.join(kb.of(to).select("s", "o"), ["s", "o"], "left_anti").select("s", "p", "o_kind", "o")


def by_exclusion(kb: KB, negative: str, positive: str, classes: DataFrame) -> DataFrame:
    """(s, positive, o): the one member of a closed class (cls, member) that a subject's negative statements leave.

    A subject is judged on a class if it has a negative statement about one of its members.
    """
    negatives = kb.of(negative).select("s", F.col("o").alias("member")).distinct().join(classes, "member")
    left = negatives.groupBy("s", "cls").agg(F.count("*").alias("n")).join(classes.groupBy("cls").agg(F.count("*").alias("size")), "cls").where("n = size - 1").select("s", "cls")
    rest = left.join(classes, "cls").join(negatives.select("s", "member"), ["s", "member"], "left_anti")
    return rest.select("s", F.lit(positive).alias("p"), F.lit("E").alias("o_kind"), F.col("member").alias("o"))


def groups_of_size(kb: KB, relation: str, condition: str) -> DataFrame:
    """(s, p, n) of a relation's subjects whose number of objects meets a SQL condition on ``n``."""
    return kb.of(relation).groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where(condition)


def goal_reached(kb: KB, relations: list[str], wanted: int) -> DataFrame:
    """(solved): whether so many pairs of subject and relation have exactly one object."""
    single = kb.of(*relations).groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n = 1")
    return single.agg((F.count("*") == wanted).alias("solved"))


def bijections(kb: KB, subjects: list[str], objects: list[str], negative: str) -> DataFrame:
    """(assignment, s, o) of all bijections that contradict no negative statement. For closed classes of up to eight."""
    if len(subjects) != len(objects) or len(objects) > 8:
        raise ValueError("bijections are listed between classes of one size, up to eight")
    listed = [(str(n), s, o) for n, p in enumerate(permutations(objects)) for s, o in zip(subjects, p, strict=True)]
    rows = kb.spark.createDataFrame(listed, "assignment string, s string, o string")
    bad = rows.join(kb.of(negative).select("s", "o").distinct(), ["s", "o"], "left_semi").select("assignment").distinct()
    return rows.join(bad, "assignment", "left_anti")


def admissible(excluded: DataFrame, subjects: list[str], objects: list[str]) -> DataFrame:
    """(case, n): for each case of ``excluded`` (case, s, o) the bijections between two closed classes, of one size up to eight, that hold none of its pairs."""
    if len(subjects) != len(objects) or len(objects) > 8:
        raise ValueError("bijections are counted between classes of one size, up to eight")
    names = lambda values: F.array(*map(F.lit, values))
    bits = (F.array_position(names(subjects), F.col("s")) - 1) * len(objects) + F.array_position(names(objects), F.col("o")) - 1
    known = excluded.where(F.col("s").isin(subjects) & F.col("o").isin(objects))
    masks = excluded.select("case").distinct().join(known.groupBy("case").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))).alias("mask")), "case", "left")
    signed = lambda m: m - (1 << 64) if m >> 63 else m  # noqa: E731  a pair a bit, 64 at most
    every = [signed(sum(1 << (k * len(objects) + o) for k, o in enumerate(p))) for p in permutations(range(len(objects)))]
    counts = masks.select(F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).distinct()
    tried = counts.crossJoin(F.broadcast(local(excluded.sparkSession, [(m,) for m in every], "assignment long")))  # at most 8! assignments
    n = tried.groupBy("mask").agg(F.count(F.when(F.col("mask").bitwiseAND(F.col("assignment")) == 0, 1)).alias("n"))
    return masks.withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).join(n, "mask").select("case", "n")


def candidates(kb: KB, negative: str, relations: DataFrame) -> DataFrame:
    """(relation, s, n, objects): what ``relations`` (relation, s, o) leaves open after the negative statements, fewest first."""
    left = relations.join(kb.of(negative).select("s", "o").distinct(), ["s", "o"], "left_anti")
    return left.groupBy("relation", "s").agg(F.countDistinct("o").alias("n"), F.array_sort(F.collect_set("o")).alias("objects")).orderBy("n", "relation", "s")


def assume(kb: KB, rules: list[Rule], s: str, p: str, objects: list[str], *, max_rounds: int | None = None, functional: tuple[str, ...] = ()) -> tuple[KB, list[str]]:
    """Tests each object but the first as a hypothesis, all in one fixpoint with a branch for each; (kb, refuted objects).

    The base is closed under the rules first. If that already ends in a contradiction, so does every hypothesis.
    """
    from .fixpoint import suppose

    closed, _, stop = fixpoint(kb, rules, max_rounds=max_rounds, functional=functional)
    if isinstance(stop, Contradiction):
        return kb, objects[1:]
    rows = constants(kb.spark, [(o, s, p, "E", o) for o in objects[1:]], ["branch", "s", "p", "o_kind", "o"])
    outcomes = suppose(closed, rules, rows, functional=functional, max_rounds=max_rounds).outcomes
    refuted = {r["branch"] for r in outcomes.where("outcome = 'refuted'").collect()}  # at most as many as ``objects``
    return kb, [o for o in objects[1:] if o in refuted]


def relation_counts(rows: DataFrame) -> DataFrame:
    """(p, n): what deltas assert, by relation."""
    return rows.groupBy("p").agg(F.count("*").alias("n"))


def report_counts(*deltas: DataFrame) -> DataFrame:
    """(n): statements of all partial results together."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")) for d in deltas]).agg(F.sum("n").alias("n"))


def bijection_report(kb: KB, classes: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(relation, n, total, product): admissible bijections for each negative relation of closed classes, their sum and product."""
    found = [bijections(kb, s, o, p).agg(F.lit(p).alias("relation"), F.countDistinct("assignment").alias("n")) for p, (s, o) in classes.items()]
    counts = reduce(DataFrame.unionByName, found)  # a row a relation
    both = counts.agg(F.sum("n").alias("total"), F.aggregate(F.collect_list("n"), F.lit(1).cast("long"), lambda x, y: x * y).alias("product"))
    return counts.crossJoin(both)


def open_pairs(subjects: DataFrame, relations: DataFrame, kb: KB) -> DataFrame:
    """(s, p) for each subject (s) and relation (p) without a statement; as many rows as subjects and a few relations make."""
    every = subjects.select("s").distinct().crossJoin(relations.select("p").distinct())
    named = [r["p"] for r in relations.select("p").distinct().collect()]  # the vocabulary's relations
    return every.join(kb.of(*named).select("s", "p").distinct(), ["s", "p"], "left_anti")


def violations(kb: KB, rule: Rule) -> DataFrame:
    """(violation, rule, bindings): an item for each match of a constraint rule's premise."""
    found = bindings(kb, rule)
    return found.select(new_id("Ia", F.lit(rule.name), *[F.col(c) for c in sorted(found.columns)]).alias("violation"), F.lit(rule.name).alias("rule"), map_of({c: F.col(c) for c in found.columns}).alias("bindings"))


def record_violations(kb: KB, rule: Rule, about: str, *, mod: str = "violations") -> tuple[KB, DataFrame]:
    """(``kb`` with an item for each match of a constraint rule's premise, (violation, entity)).

    The item is an instance of ``constraint_violation`` and says which rule and which entity (the variable ``about``) it is about; the entity
    has a statement to it. The same match gives the same item, so recording again adds nothing. The rest of the match is in
    ``violations``.
    """
    found = bindings(kb, rule)
    made = found.select(new_id("Ia", F.lit(rule.name), *[F.col(c) for c in sorted(found.columns)]).alias("violation"), F.col(about).alias("entity"))
    made = written(made.distinct(), "violations")
    null = F.lit(None).cast("string")
    facts = [("violation", "instance_of", F.lit("constraint_violation")), ("violation", "violates_rule", F.lit(rule.name)), ("violation", "has_violating_entity", F.col("entity")), ("entity", "has_constraint_violation", F.col("violation"))]
    rows = reduce(DataFrame.unionByName, [made.select(*statement(F.col(s), p, o, mod=mod)) for s, p, o in facts])
    rows = rows.join(kb.of(*[p for _, p, _ in facts]).select("stm_id"), "stm_id", "left_anti").select(*COLUMNS)
    entities = made.select(F.col("violation").alias("uri"), F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), null.alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    return kb.plus(rows, entities.join(kb.entities.select("uri"), "uri", "left_anti")), made


def explained(rows: DataFrame, rule: Rule) -> DataFrame:
    """``rows`` (a delta) with the rule's explanation rendered, or the bindings listed."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("bindings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    if not rule.explanation:
        return rows.withColumn("explanation", pairs)
    text = F.aggregate(F.map_entries("bindings"), F.lit(rule.explanation), lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return rows.withColumn("explanation", text)
