"""Semi-naive fixpoints of rules, and many hypotheses in one of them.

A round joins what the last round found, at one edge of a premise at a time, with everything known at the other edges.
So a round costs what it is about, not the whole base again. A round's result is a table in the shared folder.

In a branched fixpoint every derived statement belongs to a branch, a hypothesis with its consequences. The base belongs to
all: at each join a row of branch b meets the base's rows and those of b, by one equality on (variables, branch). All
branches run in one loop; a branch that reaches a contradiction or a goal is dropped from the next round, set at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import render
from ..plans.model import KB, content_id
from ..plans.tables import written
from .closure import RoundLimit, doubled, one_way
from .pattern import Edge, Pattern, RelVar, Var, _Scans, bound_rows, check, edge_variables, finished, match_any, next_edge
from .rules import Contradiction, Rule, RuleStop, as_statements, template_rows, unscoped

#: Tables of earlier rounds that are read one by one; then they become one.
MOST_PARTS = 6


def asserted_relations(rules: list[Rule]) -> set[str] | None:
    """The relations that the rules assert; None if a variable stands for one."""
    templates = [t for r in rules for t in r.asserts]
    return None if any(not isinstance(t.p, str) for t in templates) else {t.p for t in templates}


def semi_naive_fits(rules: list[Rule]) -> bool:
    """Whether the rules are patterns and templates, and nothing they ask once for all changes by what they assert."""
    asserted = asserted_relations(rules)
    asked: set[str] = set()
    for r in rules:
        if r.sparql is not None or r.merge is not None or r.consequent is not None or not (r.asserts or r.stop) or (r.asserts and any(not r.is_new(t) for t in r.asserts)):
            return False
        for b in r.branches:
            asked |= {relation for _, relation in b.absent}
            for v in b.relation_variables().values():
                asked |= {p for p, _ in v.properties} | ({v.range_of, "instance_of"} if v.range_of else set())
    return not asked if asserted is None else not asked & asserted


def match_delta(kb: KB, known: DataFrame, delta: DataFrame, pattern: Pattern, at: int, *, branched: bool) -> DataFrame:
    """Matches of a pattern whose edge ``at`` is in ``delta`` and whose others are in ``kb`` or ``known``.

    ``known`` and ``delta`` are (s, p, o_kind, o), with ``branch`` if branched; nothing in them is in ``kb``.
    """
    check(pattern)
    keep = ("branch",) if branched else ()
    scan, first = _Scans(kb, pattern), pattern.edges[at]
    out, bound = bound_rows(delta, first, distinct=False, keep=keep), edge_variables(first)
    todo: list[Edge] = [e for k, e in enumerate(pattern.edges) if k != at]
    while todo:
        e, linked = next_edge(todo, bound, {})
        todo.remove(e)
        own = edge_variables(e)
        base, more = scan(e), bound_rows(known, e, distinct=True, keep=keep)
        if branched:
            rows = base.withColumn("__of", F.lit("")).unionByName(more.withColumnRenamed("branch", "__of"))
            out = out.withColumn("__of", F.explode(F.array(F.lit(""), F.col("branch"))))
            out = out.join(rows, [*sorted(own & bound), "__of"]).drop("__of", "__there")
        elif not own:
            out = out.join(F.broadcast(base.unionByName(more).limit(1)), F.lit(True), "left_semi")
        elif linked:
            out = out.join(base.unionByName(more), sorted(own & bound))
        else:
            out = out.crossJoin(base.unionByName(more))
        bound |= own
    for table in scan.tables:
        out = out.join(table, sorted(set(table.columns) & bound))
        bound |= set(table.columns)
    return finished(kb, pattern, out, keep=keep)


def _new_matches(kb: KB, rule: Rule, known: DataFrame, delta: DataFrame, branched: bool) -> DataFrame:
    """Matches of a rule that need a row of ``delta``; one with several of them may come several times."""
    found = [match_delta(kb, known, delta, b, at, branched=branched) for b in rule.branches for at in range(len(b.edges))]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)


def _message(rule: Rule, found: DataFrame) -> Column:
    return render(F.lit(rule.message), {c: F.col(c) for c in found.columns})


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _unknown(kb: KB, rules: list[Rule], rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``rows`` without repetitions and without what ``kb`` or the tables ``parts`` have."""
    asserted = asserted_relations(rules)
    there = kb.statements if asserted is None else kb.of(*sorted(asserted))
    on = [c for c in ("branch", "s", "p", "o") if c in rows.columns]
    rows = unscoped(kb, rows).dropDuplicates(on).join(there.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return rows.join(_union([p.select(*on) for p in parts]), on, "left_anti") if parts else rows


def chained(rule: Rule) -> str | None:
    """The relation that a rule makes transitive, if that is all it does."""
    if rule.stop is not None or len(rule.branches) != 1 or len(rule.asserts) != 1 or len(rule.branches[0].edges) != 2:
        return None
    pattern, t = rule.branches[0], rule.asserts[0]
    e, f = pattern.edges if pattern.edges[0].o == pattern.edges[1].s else reversed(pattern.edges)
    ends = (e.s, e.o, f.o)
    plain = not (pattern.externals or pattern.conditions or pattern.absent or pattern.relations or pattern.strict_single_edge)
    named = all(isinstance(v, Var) for v in ends) and len(set(ends)) == 3 and isinstance(t.p, str)
    return t.p if plain and named and e.o == f.s and e.p == f.p == t.p and (t.s, t.o) == (e.s, f.o) else None


def _chains(kb: KB, rule: Rule, p: str) -> tuple[DataFrame, int] | None:
    """(what a rule of ``chained`` derives, rounds) by doubling steps; None where subjects and objects have several edges.

    Matches that are injective have no edge from a node to itself, and their closure gives none.
    """
    pattern = rule.branches[0]
    if not pattern.injective and kb.entities.schema["scope"].dataType.simpleString() != "void":
        return None
    rows = kb.edges(p, graph=pattern.injective).where("o_kind = 'E'").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    edges = written(rows.where("a <> b") if pattern.injective else rows, "edges")
    way = one_way(edges)
    if way is None:
        return None
    found = doubled(edges, way)
    depth = found.agg(F.max("hops").alias("n")).first()["n"] or 1
    new = found.where("hops > 1 AND a <> b" if pattern.injective else "hops > 1").select(F.col("a").alias("s"), F.lit(p).alias("p"), F.lit("E").alias("o_kind"), F.col("b").alias("o"))
    there = kb.of(p).where("scope IS NOT NULL").select("s", "p", "o")
    return new.join(there, ["s", "p", "o"], "left_anti").select("s", "p", "o_kind", "o"), (depth - 1).bit_length() + 1


def derived(kb: KB, rules: list[Rule], *, delta: DataFrame | None = None, max_rounds: int | None = None) -> tuple[DataFrame, int, RuleStop | None]:
    """(statements (s, p, o_kind, o) beyond ``kb``, rounds, stop) of the rules' fixpoint.

    With ``delta`` (s, p, o_kind, o; none of them in ``kb``) the base is taken for closed and the loop starts from these rows,
    which are part of the result. Raises ``RoundLimit`` if it is open after ``max_rounds`` whether another finds more.
    """
    columns = ["s", "p", "o_kind", "o"]
    makers, stops = [r for r in rules if r.stop is None], [r for r in rules if r.stop is not None]
    if delta is None and max_rounds is None and not stops:
        for r in rules:
            p, rest = chained(r), [x for x in rules if x is not r]
            others = asserted_relations(rest)
            # no other rule asserts the relation: it is closed before they begin, and stays so
            done = _chains(kb, r, p) if p is not None and others is not None and p not in others else None
            if done is not None and not rest:
                return *done, None
            if done is not None:
                more, n, _ = derived(kb.plus(as_statements(done[0]), bag=False), rest)
                return done[0].unionByName(more), done[1] + n, None
    parts = [] if delta is None else [delta]
    for n in count():
        if n == max_rounds:
            raise RoundLimit(f"statements were new until round {max_rounds}")
        first = n == 0 and delta is None
        known = _union(parts) if parts else None
        found = lambda r: match_any(kb, r.branches) if first else _new_matches(kb, r, known, delta, False)  # noqa: B023, E731
        for r in stops:
            rows = found(r)
            message = rows.select(_message(r, rows).alias("text")).orderBy("text").limit(1).collect()
            if message:
                return _union(parts) if parts else kb.statements.select(*columns).limit(0), n + 1, r.stop(message[0]["text"])
        made = [template_rows(r, found(r)).select(*columns) for r in makers]
        if not made:
            return _union(parts) if parts else kb.statements.select(*columns).limit(0), n + 1, None
        delta = written(_unknown(kb, makers, _union(made), parts), "round")
        if delta.isEmpty():
            return _union([*parts, delta]), n + 1, None
        parts.append(delta)
        if len(parts) > MOST_PARTS:
            parts = [written(_union(parts), "rounds")]


@dataclass
class Supposed:
    """``outcomes``: (branch, outcome, message) of the branches that ended in a contradiction or a goal; ``statements``:
    (branch, s, p, o_kind, o) of the branches that did not end in a contradiction; ``rounds``."""

    outcomes: DataFrame
    statements: DataFrame
    rounds: int


def suppose(kb: KB, rules: list[Rule], hypotheses: DataFrame, *, functional: tuple[str, ...] = (), max_rounds: int | None = None) -> Supposed:
    """Consequences of all ``hypotheses`` (branch, s, p, o_kind, o) at once, each branch on its own version of ``kb``.

    ``kb`` is taken for closed under the rules. A branch in which a rule raises a contradiction, or a functional relation gets two
    objects, is refuted; one that reaches a goal is done. A branch may have several statements; a statement of ``kb`` adds nothing.
    """
    if not semi_naive_fits(rules):
        raise ValueError("hypotheses are tested by rules of patterns and templates, none of which changes what another one asks of relations or absence")
    columns = ["branch", "s", "p", "o_kind", "o"]
    delta = written(hypotheses.select(*columns).dropDuplicates(["branch", "s", "p", "o"]).join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*columns), "hypotheses")
    makers, stops = [r for r in rules if r.stop is None], [r for r in rules if r.stop is not None]
    parts, ended = [delta], []
    for n in count():
        if delta.isEmpty():
            break
        if n == max_rounds:
            raise RoundLimit(f"statements were new until round {max_rounds}")
        known = _union(parts)
        ends = []
        for r in stops:
            rows = _new_matches(kb, r, known, delta, True)
            kind = "refuted" if issubclass(r.stop, Contradiction) else "goal"
            ends.append(rows.select("branch", F.lit(kind).alias("outcome"), _message(r, rows).alias("message")))
        if functional:
            own = delta.where(F.col("p").isin(*functional))
            for other in (kb.of(*functional).where("NOT free").select("s", "p", F.col("o").alias("__o")), known.select("branch", "s", "p", F.col("o").alias("__o"))):
                on = [c for c in ("branch", "s", "p") if c in other.columns]
                clash = own.join(other, on).where("o <> __o")
                ends.append(clash.select("branch", F.lit("refuted").alias("outcome"), F.concat_ws(" ", "s", "p", F.least("o", "__o"), F.greatest("o", "__o")).alias("message")))
        if ends:
            # a contradiction outweighs a goal of the same round; of several messages the first
            end = _union(ends).groupBy("branch").agg(F.max("outcome").alias("outcome"), F.min_by("message", F.struct(F.when(F.col("outcome") == "refuted", 0).otherwise(1), "message")).alias("message"))
            end = written(end, "ended")
            ended.append(end)
            delta = delta.join(end, "branch", "left_anti")
        if not makers:
            break
        made = [template_rows(r, _new_matches(kb, r, known, delta, True), keep=("branch",)).select(*columns) for r in makers]
        delta = written(_unknown(kb, makers, _union(made), parts).select(*columns), "round")
        parts.append(delta)
        if len(parts) > MOST_PARTS:
            parts = [written(_union(parts), "rounds")]
    outcomes = _union(ended) if ended else hypotheses.select("branch", F.lit("").alias("outcome"), F.lit("").alias("message")).limit(0)
    return Supposed(outcomes, _union(parts).join(outcomes.where("outcome = 'refuted'"), "branch", "left_anti").select(*columns), n + 1)


def open_candidates(kb: KB, relations: DataFrame) -> DataFrame:
    """(relation, s, o): what ``relations`` (relation, negative, s, o) leaves open, without the objects that a statement of the negative relation excludes."""
    named = [r["negative"] for r in relations.select("negative").distinct().collect()]  # the vocabulary's relations
    excluded = kb.of(*named).select("s", F.col("p").alias("negative"), "o").distinct()
    return relations.join(excluded, ["s", "negative", "o"], "left_anti").select("relation", "s", "o")


def choices(candidates: DataFrame, *, per: str | None = None) -> DataFrame:
    """(relation, s, o, place) of the smallest open choice, its objects in order: of all, or for each value of ``per``.

    A choice with one object is decided and not taken; of equally small ones the first by relation and subject is.
    """
    sizes = candidates.groupBy("relation", "s", *([per] if per and per not in ("relation", "s") else [])).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if per is None:
        chosen = sizes.orderBy("n", "relation", "s").limit(1)
    else:
        chosen = sizes.groupBy(per).agg(F.min(F.struct("n", "relation", "s")).alias("least")).select("least.relation", "least.s")
    place = F.row_number().over(Window.partitionBy("relation", "s").orderBy("o")) - 1
    return candidates.join(chosen.select("relation", "s"), ["relation", "s"], "left_semi").select("relation", "s", "o", place.alias("place"))


def hypothesis_step(kb: KB, rules: list[Rule], relations: DataFrame, *, per: str | None = None, skip_first: bool = True, functional: tuple[str, ...] = (), max_rounds: int | None = None) -> Supposed:
    """Takes the smallest open choice (for each ``per``) and supposes its objects, all but the first, in branches named by content.

    ``relations`` (relation, negative, s, o) lists every possible statement beside the relation that excludes it.
    """
    open_ = choices(open_candidates(kb, relations), per=per)
    branch = content_id(F.col("s"), F.col("relation"), F.col("o"))
    rows = open_.where("place > 0") if skip_first else open_
    return suppose(kb, rules, rows.select(branch.alias("branch"), "s", F.col("relation").alias("p"), F.lit("E").alias("o_kind"), "o"), functional=functional, max_rounds=max_rounds)


__all__ = ["RelVar", "Supposed", "choices", "derived", "hypothesis_step", "match_delta", "open_candidates", "semi_naive_fits", "suppose"]
