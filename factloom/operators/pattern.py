"""Graph patterns lowered to joins.

A pattern is a list of edges over variables and constants. Each edge is a filtered scan of the triples; scans are
joined through shared variables, those with constants first, and never by a cross product unless the pattern says how
many separate components it has. In graph mode a match is injective: two variables of one kind never bind the same
node, nor a constant of the pattern. In SPARQL mode matches are homomorphisms and keep their multiplicity.

Relation variables with properties are unified first, over the statements about relations alone: that gives a table with a
column for each variable, as small as the vocabulary. It limits the data scans to the relations it names and is joined like
an edge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import KB
from ..plans.tables import local


class PatternError(ValueError):
    """A pattern that cannot be matched as it stands."""


@dataclass(frozen=True)
class Var:
    """A variable for entities."""

    name: str


@dataclass(frozen=True)
class LitVar:
    """A variable for literals; in several edges it joins on the value."""

    name: str


@dataclass(frozen=True)
class AnyVar:
    """A variable for entities and literals alike (SPARQL)."""

    name: str


@dataclass(frozen=True)
class RelVar:
    """A variable for relations, limited to those with all of its properties: (property, object) pairs.

    An object is a key, or another relation variable, whose binding then is the property's value: a relation.
    With ``range_of`` (a relation from relations to classes) the object of each edge is an instance of the first
    class that the bound relation has by it.
    """

    name: str
    properties: tuple[tuple[str, str | RelVar], ...] = ()
    range_of: str | None = None


@dataclass(frozen=True)
class Ent:
    """A given entity."""

    uri: str


@dataclass(frozen=True)
class Lit:
    """A given literal, by its key."""

    key: str


@dataclass(frozen=True)
class Edge:
    s: Var | AnyVar | Ent
    p: str | RelVar
    o: Var | LitVar | AnyVar | Ent | Lit


@dataclass
class Pattern:
    edges: list[Edge]
    #: Entities that no variable may bind even if no edge holds them.
    externals: list[str] = field(default_factory=list)
    #: Separate components that may be combined by a cross product.
    components: int = 1
    injective: bool = True
    #: Conditions over the bound variables' columns.
    conditions: list[Callable[[DataFrame], Column]] = field(default_factory=list)
    #: (variable, relation): matches only without such a statement.
    absent: list[tuple[str, str]] = field(default_factory=list)
    #: Relation variables that stand in no edge, but whose properties tie them to those that do.
    relations: list[RelVar] = field(default_factory=list)
    #: A relation variable may be bound between two nodes only if theirs is the only relation; otherwise it is an error.
    strict_single_edge: bool = False

    def variables(self) -> list[str]:
        own = [t.name for e in self.edges for t in (e.s, e.p, e.o) if isinstance(t, Var | LitVar | AnyVar | RelVar)]
        return list(dict.fromkeys([*own, *self.relation_variables()]))

    def relation_variables(self) -> dict[str, RelVar]:
        """Each relation variable by name, with the properties that it has anywhere in the pattern."""
        out: dict[str, RelVar] = {}
        todo = [*(e.p for e in self.edges if isinstance(e.p, RelVar)), *self.relations]
        while todo:
            v = todo.pop(0)
            was = out.get(v.name, RelVar(v.name))
            out[v.name] = RelVar(v.name, tuple(dict.fromkeys([*was.properties, *v.properties])), v.range_of or was.range_of)
            todo += [value for _, value in v.properties if isinstance(value, RelVar)]
        return out


def edge_variables(e: Edge) -> set[str]:
    return {t.name for t in (e.s, e.p, e.o) if isinstance(t, Var | LitVar | AnyVar | RelVar)}


#: Bindings of relation variables up to which scans name their relations; beyond, the table is joined alone.
MOST_RELATIONS = 10_000


def count_components(edges: list[Edge]) -> int:
    """Components of nodes: a relation variable between others joins them, too."""
    groups: list[set[str]] = []
    for e in edges:
        own = edge_variables(e)
        rest = [g for g in groups if not g & own]
        groups = [*rest, own.union(*[g for g in groups if g & own])]
    return len([g for g in groups if g])


def unified_relations(kb: KB, pattern: Pattern) -> list[DataFrame]:
    """Tables of the bindings that the properties of relation variables allow, one for each group of variables they tie together."""
    variables = pattern.relation_variables()
    in_edges = {e.p.name for e in pattern.edges if isinstance(e.p, RelVar)}
    parts: list[DataFrame] = []
    for v in variables.values():
        for prop, value in v.properties:
            rows = kb.of(prop)
            if not isinstance(value, RelVar):
                parts.append(rows.where(F.col("o") == value).select(F.col("s").alias(v.name)).distinct())
            elif value.name == v.name:
                parts.append(rows.where("s = o").select(F.col("s").alias(v.name)).distinct())
            else:
                parts.append(rows.where("o_kind = 'E'").select(F.col("s").alias(v.name), F.col("o").alias(value.name)).distinct())
    for name in variables.keys() - in_edges:  # bound by properties alone: it must be a relation
        parts.append(kb.entities.where("etype = 'R'").select(F.col("uri").alias(name)).distinct())
    tables: list[DataFrame] = []
    for part in parts:
        tied = [t for t in tables if set(t.columns) & set(part.columns)]
        tables = [t for t in tables if all(t is not x for x in tied)]
        tables.append(reduce(lambda x, y: x.join(y, sorted(set(x.columns) & set(y.columns))), [part, *tied]))
    return tables


class _Scans:
    """The rows of a pattern's edges: of the knowledge base, and of relations that its relation variables can be."""

    def __init__(self, kb: KB, pattern: Pattern):
        self.kb, self.graph = kb, pattern.injective
        self.tables, self.named = [], {}
        for table in unified_relations(kb, pattern):
            rows = table.limit(MOST_RELATIONS + 1).collect()
            if len(rows) <= MOST_RELATIONS:
                for name in table.columns:
                    self.named[name] = sorted({r[name] for r in rows})
                table = local(kb.spark, rows, table.schema)
            self.tables.append(table)

    def edges(self, e: Edge) -> DataFrame:
        if isinstance(e.p, str):
            return self.kb.edges(e.p, graph=self.graph)
        if e.p.name not in self.named:
            return self.kb.edges(None, graph=self.graph)
        return self.kb.only(*self.named[e.p.name]).edges(None, graph=self.graph)

    def __call__(self, e: Edge) -> DataFrame:
        return bound_rows(self.edges(e), e, distinct=self.kb.bag)


def bound_rows(df: DataFrame, e: Edge, *, distinct: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """What an edge binds in the triples ``df`` (s, p, o_kind, o, and the columns ``keep``)."""
    if isinstance(e.p, str):
        df = df.where(F.col("p") == e.p)
    if isinstance(e.s, Ent):
        df = df.where(F.col("s") == e.s.uri)
    if isinstance(e.o, Ent):
        df = df.where((F.col("o_kind") == "E") & (F.col("o") == e.o.uri))
    elif isinstance(e.o, Lit):
        df = df.where((F.col("o_kind") == "L") & (F.col("o") == e.o.key))
    elif isinstance(e.o, Var):
        df = df.where("o_kind = 'E'")
    elif isinstance(e.o, LitVar):
        df = df.where("o_kind = 'L'")
    names: dict[str, str] = {}
    columns = []
    for column, term in (("s", e.s), ("p", e.p), ("o", e.o)):
        if isinstance(term, str | Ent | Lit):
            continue
        if term.name in names:  # the same variable twice in an edge
            df = df.where(F.col(names[term.name]) == F.col(column))
            continue
        names[term.name] = column
        columns.append(F.col(column).alias(term.name))
    out = df.select(*columns, *keep) if columns else df.select(F.lit(1).alias("__there"), *keep)
    return out.distinct() if distinct or not columns else out


def _cost(e: Edge, sizes: dict[str, int]) -> tuple[int, int]:
    constants = isinstance(e.s, Ent) + isinstance(e.o, Ent | Lit)
    return (-constants, sizes.get(e.p, 0) if isinstance(e.p, str) else max(sizes.values(), default=0))


def next_edge(todo: list[Edge], bound: set[str], sizes: dict[str, int], single: frozenset[str] = frozenset()) -> tuple[Edge, bool]:
    """The edge to join next, and whether it shares a variable with what is bound."""
    linked = [e for e in todo if edge_variables(e) & bound]
    # most bound variables first: such an edge filters; then one that is followed from its subject to its one object, then from its subject: these fan out least
    e = min(linked or todo, key=lambda e: (-len(edge_variables(e) & bound), not follows(e, bound, single), getattr(e.s, "name", None) not in bound, *_cost(e, sizes)))
    return e, bool(linked)


def follows(e: Edge, bound: set[str], single: frozenset[str]) -> bool:
    """Whether joining the edge makes no more rows than there are: its subject is bound and has one object."""
    return e.p in single and getattr(e.s, "name", None) in bound


def attached(own: set[str], bound: set[str], todo: list[Edge], single: frozenset[str]) -> list[Edge]:
    """Edges, taken out of ``todo``, that follow from the variables ``own`` which are not bound yet. They join an edge that fans out
    before it is joined itself: they cost a pass over its rows then, instead of one over all pairs, and it may share more variables."""
    out: list[Edge] = []
    while found := [e for e in todo if follows(e, own - bound, single)]:
        todo.remove(found[0])
        out.append(found[0])
        own = own | edge_variables(found[0])
    return out


#: Rows of one side that meet in one task's slice of a key.
SLICE = 1000


def sliced_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two sides of which both repeat values of ``on`` (none: all pairs), dealt by value and slice of the right side.

    A value with more than ``SLICE`` rows on the right has so many slices; rows of the left are repeated for each, which is little beside the pairs
    that they make. So neither a few values nor few input files bound the number of tasks.
    """
    sizes = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SLICE).select(*on, F.ceil(F.col("__n") / SLICE).cast("int").alias("__slices"))
    dealt = lambda df: df.join(F.broadcast(sizes), on, "left") if on else df.join(F.broadcast(sizes), F.lit(True), "left")
    slices = F.coalesce("__slices", F.lit(1))
    # a task's pairs are many where its bytes are few: with a number given, Spark doesn't put its partitions together by bytes
    by, tasks = [*on, "__slice"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = dealt(left).withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("__slices").repartition(tasks, *by)
    right = dealt(right).withColumn("__slice", F.pmod(F.xxhash64(*right.columns), slices).cast("int")).drop("__slices").repartition(tasks, *by)
    return left.join(right, by).drop("__slice")


def check(pattern: Pattern) -> None:
    if not pattern.edges:
        raise PatternError("a pattern needs an edge")
    if count_components(pattern.edges) > pattern.components:
        raise PatternError(f"{count_components(pattern.edges)} components, {pattern.components} declared")


def match(kb: KB, pattern: Pattern, *, sizes: dict[str, int] | None = None) -> DataFrame:
    """One row for each match, a column for each variable.

    ``sizes`` (statements by relation) orders the joins; without it constants alone do. Graph-mode matches are
    distinct mappings of nodes and relations.
    """
    check(pattern)
    sizes, scan = sizes or {}, _Scans(kb, pattern)
    todo = sorted(pattern.edges, key=lambda e: _cost(e, sizes))
    first = todo.pop(0)
    out, bound = scan(first), edge_variables(first)
    relations = list(scan.tables)
    key = getattr(first.s, "name", None) if first.p in kb.single else None  # a variable that has each value in one row, if one is known
    while todo:
        # what is known of the bound relations' properties says which others there can be
        for table in [t for t in relations if set(t.columns) & bound]:
            out = out.join(table, sorted(set(table.columns) & bound))
            bound |= set(table.columns)
            relations = [t for t in relations if t is not table]
        e, linked = next_edge(todo, bound, sizes, kb.single)
        todo.remove(e)
        rows, own = scan(e), edge_variables(e)
        if not own:
            out = out.join(F.broadcast(rows.limit(1)), F.lit(True), "left_semi")  # a fact to be there: one row
            continue
        subjects = {e.s.name} if isinstance(e.s, Var | AnyVar) else set()
        if not follows(e, bound, kb.single) and own - bound:
            for more in attached(own, bound, todo, kb.single):
                rows = rows.join(scan(more), sorted(edge_variables(more) & own))
                own |= edge_variables(more)
        shared = sorted(own & bound)
        # two subjects of one object, or all pairs: both sides repeat what they share
        pairs = not subjects & bound and bool(own - bound) and key not in shared
        out = sliced_join(out, rows, shared) if pairs else out.join(rows, shared)
        if not follows(e, bound, kb.single):
            key = next(iter(subjects), None) if e.p in kb.single and key in shared else None
        bound |= own
    for table in relations:
        out = out.join(table, sorted(set(table.columns) & bound))
        bound |= set(table.columns)
    return finished(kb, pattern, out, distinct=False)


def finished(kb: KB, pattern: Pattern, out: DataFrame, *, keep: tuple[str, ...] = (), distinct: bool = True) -> DataFrame:
    """``out`` (all edges joined) without the matches that the pattern's other parts exclude; ``keep`` are columns to be kept.

    Without ``distinct`` the edges' rows are sets, so no match can come twice.
    """
    if pattern.injective:
        kinds: dict[type, list[str]] = {Var: [], LitVar: []}
        given: dict[type, list[str]] = {Var: list(pattern.externals), LitVar: []}
        for e in pattern.edges:
            for t in (e.s, e.o):
                if isinstance(t, Var | LitVar) and t.name not in kinds[type(t)]:
                    kinds[type(t)].append(t.name)
                elif isinstance(t, Ent):
                    given[Var].append(t.uri)
                elif isinstance(t, Lit):
                    given[LitVar].append(t.key)
        for kind, names in kinds.items():
            for a, b in combinations(names, 2):
                out = out.where(F.col(a) != F.col(b))
            if given[kind]:
                for a in names:
                    out = out.where(~F.col(a).isin(*dict.fromkeys(given[kind])))
    for name, relation in pattern.absent:
        out = out.join(kb.of(relation).select(F.col("s").alias(name)).distinct(), name, "left_anti")
    for condition in pattern.conditions:
        out = out.where(condition(out))
    for v in pattern.relation_variables().values():
        if v.range_of:
            first = kb.of(v.range_of).groupBy(F.col("s").alias(v.name)).agg(F.min_by("o", F.struct("seq", "stm_id")).alias("__range"))
            for e in pattern.edges:
                if e.p is not None and isinstance(e.p, RelVar) and e.p.name == v.name and isinstance(e.o, Var):
                    out = out.join(first, v.name).join(kb.of("instance_of").select(F.col("s").alias(e.o.name), F.col("o").alias("__range")), [e.o.name, "__range"], "left_semi").drop("__range")
    out = out.select(*pattern.variables(), *keep)
    if pattern.strict_single_edge:
        for e in pattern.edges:
            if isinstance(e.p, RelVar):
                _single_edges(kb, e, out)
    return out.distinct() if distinct and pattern.injective and pattern.relation_variables() else out


def _single_edges(kb: KB, e: Edge, out: DataFrame) -> None:
    """Raises if two matched nodes have more than one relation."""
    end = lambda t: F.lit(t.uri) if isinstance(t, Ent) else F.lit(t.key) if isinstance(t, Lit) else F.col(t.name)
    pairs = out.select(end(e.s).alias("s"), end(e.o).alias("o")).distinct()
    several = kb.edges().join(pairs, ["s", "o"], "left_semi").groupBy("s", "o").agg(F.countDistinct("p").alias("n")).where("n > 1").limit(1).collect()
    if several:
        raise PatternError(f"{several[0]['n']} relations between {several[0]['s']} and {several[0]['o']}, and {e.p.name} stands for one")


def first_matches(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of ``found`` in the order of their bindings as JSON text, with ``place`` from 1 and ``cut``: whether there are more.

    Equal matches have one text; they keep places of their own. No task holds more than ``limit`` + 1 rows.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(found.columns)]))
    some = found.withColumn("__text", text).orderBy("__text").limit(limit + 1)
    counted = some.withColumn("place", F.row_number().over(Window.orderBy("__text")).cast("long")).withColumn("cut", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return counted.where(F.col("place") <= limit).drop("__text")


def match_any(kb: KB, branches: list[Pattern], **more) -> DataFrame:
    """Union of alternatives that keeps each branch's matches: what satisfies two branches comes twice."""
    out = None
    for branch in branches:
        found = match(kb, branch, **more)
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def predicate_sizes(kb: KB) -> dict[str, int]:
    """Statements by relation: as many rows as the vocabulary has relations."""
    return {r["p"]: r["n"] for r in kb.statements.groupBy("p").agg(F.count("*").alias("n")).collect()}


def label_less(left: Column, right: Column) -> Column:
    """Order of labels: without a right label true, without a left one false."""
    return F.when(right.isNull(), True).when(left.isNull(), False).otherwise(left < right)
