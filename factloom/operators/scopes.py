"""Scopes as statements: named containers of variables and statements, lowered to rows of a knowledge base.

A scope is an entity with statements about its owner, kind and name. A variable is an entity of the scope: its class statement
lies in the scope, and two more say where it is defined and how it is called there. A statement of a scope has the scope in its
column and in a qualifier. Patterns and rules don't see what lies in scopes.

Scopes come as three tables, (scope, kind, parent, name), (variable, name, cls, scope, mode, quantifier) and
(s, p, o_kind, o, scope, seq, proxy, mode), for any number of owners at once. ``Scopes`` writes those of one owner with context managers.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import KB, content_id
from ..plans.tables import local, written

KINDS = ("SETTING", "PREMISE", "ASSERTION", "AND", "OR", "NOT", "UNIV_QUANT", "EXIS_QUANT", "ANTECEDENT", "CONSEQUENT")
BOOLEAN = ("AND", "OR", "NOT")

SCOPE_OF, SCOPE_TYPE, LABEL, INSTANCE = "is_scope_of", "scope_type", "label", "instance_of"
DEFINED_IN, NAME_IN_SCOPE, PROXY, MODE, ARGUMENT, CALLS = "defining_scope", "name_in_scope", "has_proxy", "graph_mode", "has_argument", "calls"
EXTERNAL, COMPONENTS, SPARQL_SOURCE, EXPLANATION = "uses_external", "component_count", "sparql_source", "explanation"
#: The relation of a statement whose own relation is a variable, and what such variables are instances of.
WILDCARD, GENERAL_RELATION = "wildcard", "general_relation"
#: A variable that stands for literals; its mode is 3.
VARIABLE_LITERAL = "variable_literal"
ANCHOR, RULE = "anchor_item", "semantic_rule"
#: Modes of a statement of an assertion: an argument of a function alone; asserted only where it is new.
ARGUMENT_ONLY, ONLY_NEW = 4, 5

SCOPES = "scope string, kind string, parent string, name string"
VARIABLES = "variable string, name string, cls string, scope string, mode int, quantifier string"
STATEMENTS = "s string, p string, o_kind string, o string, scope string, seq long, proxy string, mode int"


class ScopeError(ValueError):
    """A scope that is opened, nested or written to in a way it must not be."""


def literal_key(value: object) -> str:
    """The key of a literal given as text, number or truth value."""
    return f"s:{value}" if isinstance(value, str) else f"n:{float(value)}"  # type: ignore[arg-type]


@dataclass(frozen=True)
class Text:
    """A literal's text; a plain str is an entity's URI."""

    text: str


@dataclass
class Scopes:
    """Builder of the scopes of one owner. Names that it does not know are looked up among its variables."""

    owner: str
    scopes: list[tuple[str, str, str | None, str]] = field(default_factory=list)
    variables: dict[str, tuple[str, str]] = field(default_factory=dict)
    defined: list[tuple] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    stack: list[tuple[str, str]] = field(default_factory=list)

    def __getattr__(self, name: str) -> str:
        try:
            return self.__dict__["variables"][name][0]
        except KeyError:
            raise AttributeError(name) from None

    @contextmanager
    def scope(self, name: str, kind: str | None = None):
        """Opens a scope, of the kind that its name says if none is given; boolean kinds do not stand directly in one of their own kind."""
        kind = kind or name.upper()
        if kind not in KINDS:
            raise ScopeError(f"no kind {kind}")
        parent = self.stack[-1] if self.stack else None
        if parent and parent[1] == kind and kind in BOOLEAN:
            raise ScopeError(f"{kind} directly in {kind}")
        uri = f"{parent[0] if parent else self.owner}/{name}"
        if any(s[0] == uri for s in self.scopes):
            raise ScopeError(f"a second scope {name}")
        self.scopes.append((uri, kind, parent[0] if parent else self.owner, name))
        self.stack.append((uri, kind))
        try:
            yield uri
        finally:
            self.stack.pop()

    def sub(self, kind: str):
        """Opens the next subscope of a kind: AND0, AND1, and so on."""
        n = sum(s[2] == self._active(None) and s[1] == kind for s in self.scopes)
        return self.scope(f"{kind}{n}", kind)

    @property
    def statements(self) -> list[tuple[str, str, str, str]]:
        """(s, p, o, scope) of what has been written, literals by their keys."""
        return [(s, p, o, scope) for s, p, _, o, scope, *_ in self.rows]

    def _active(self, scope: str | None) -> str:
        if not self.stack:
            raise ScopeError("no scope is open")
        if scope is not None and scope != self.stack[-1][0]:
            raise ScopeError(f"{scope} is not the innermost open scope")
        return self.stack[-1][0]

    def new_var(self, name: str, scope: str | None = None, *, cls: str | None = None, mode: int | None = None, quantifier: str | None = None) -> str:
        active = self._active(scope)
        if name in self.variables:
            raise ScopeError(f"a second variable {name}")
        self.variables[name] = (f"{active}#{name}", active)
        self.defined.append((f"{active}#{name}", name, cls, active, mode, quantifier))
        return self.variables[name][0]

    def new_rel_var(self, name: str) -> str:
        """A variable for relations."""
        return self.new_var(name, cls=GENERAL_RELATION)

    def new_literal_var(self, name: str) -> str:
        return self.new_var(name, cls=VARIABLE_LITERAL, mode=3)

    def new_rel(self, s: str, p: str, o, *, scope: str | None = None, overwrite: bool = False, proxy: str | None = None, mode: int | None = None) -> None:
        """A statement of the innermost scope; with ``proxy``, a relation variable, its relation is what that is bound to."""
        active = self._active(scope)
        if overwrite:
            self.rows = [x for x in self.rows if (x[0], x[1], x[4]) != (s, p, active)]
        kind, key = ("E", o) if isinstance(o, str) else ("L", literal_key(o.text if isinstance(o, Text) else o))
        self.rows.append((s, WILDCARD if proxy else p, kind, key, active, len(self.rows), proxy, mode))

    def add_all(self, triples: list[tuple[str, str, object]]) -> None:
        for s, p, o in triples:
            self.new_rel(s, p, o)

    def uses_external(self, *uris: str) -> None:
        """Entities outside that the owner's scopes name."""
        for uri in uris:
            self.new_rel(self._active(None), EXTERNAL, uri)

    def new_equation(self, left: str, right: str) -> str:
        return self.new_math_relation(left, "==", right)

    def new_math_relation(self, left: str, sign: str, right: str) -> str:
        """An item for a relation of two sides, which must not be one and the same."""
        if left == right:
            raise ScopeError(f"both sides are {left}")
        relation = self.new_var(f"relation{len(self.defined)}", cls="equation" if sign == "==" else "mathematical_relation")
        for p, o in (("has_left_side", left), ("has_sign", Text(sign)), ("has_right_side", right)):
            self.new_rel(relation, p, o)
        return relation

    def call(self, name: str, function: str, *args, condition: bool = False) -> str:
        """A call of a registered function in the innermost scope, with its arguments in order.

        In an assertion the variable stands for the entity that the call makes, if it makes one.
        """
        made = self.new_var(name, cls=ANCHOR if condition else None, mode=1 if condition else None)
        self.new_rel(made, CALLS, Text(function), mode=ARGUMENT_ONLY)
        for arg in args:
            self.new_rel(made, ARGUMENT, arg, mode=ARGUMENT_ONLY)
        return made

    def implication(self):
        """Two paired scopes below the innermost one, for the antecedent and the consequent; each is entered with ``with``."""
        active = self._active(None)
        n = sum(s[1] == "ANTECEDENT" and s[2] == active for s in self.scopes)
        return self.scope(f"antecedent{n}", "ANTECEDENT"), self.scope(f"consequent{n}", "CONSEQUENT")

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        return local(spark, self.scopes, SCOPES), local(spark, self.defined, VARIABLES), local(spark, self.rows, STATEMENTS)

    def stored(self, kb: KB, *, about: list[tuple[str, str, object]] = (), mod: str = "scopes") -> KB:
        """``kb`` with the owner's scopes, and statements ``about`` the owner or its scopes that lie in none."""
        spark = kb.spark
        rows = [(s, p, "E", o, None, n, None, None) if isinstance(o, str) else (s, p, "L", literal_key(o.text if isinstance(o, Text) else o), None, n, None, None) for n, (s, p, o) in enumerate(about)]
        scopes, variables, statements = self.tables(spark)
        lowered = lower(scopes, variables, statements.unionByName(local(spark, rows, STATEMENTS)), mod=mod)
        # what one author writes is small: as local relations it costs later plans nothing
        return kb.plus(*[local(spark, df.collect(), df.schema) for df in lowered], bag=False)

    def rule(self, kb: KB, *, components: int | None = None, explanation: str | None = None, sparql: str | None = None, mod: str = "rules") -> KB:
        """``kb`` with the scopes of the owner stored as those of a rule."""
        about: list[tuple[str, str, object]] = [(self.owner, INSTANCE, RULE)]
        about += [(self.owner, COMPONENTS, components)] if components else []
        about += [(self.owner, EXPLANATION, Text(explanation))] if explanation else []
        about += [(f"{self.owner}/premise", SPARQL_SOURCE, Text(sparql))] if sparql else []
        return self.stored(kb, about=about, mod=mod)


def _rows(df: DataFrame, *, s: Column, p: Column, o: Column, kind: Column, scope: Column, seq: Column, mod: str, extra: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    text = F.when(kind == "L", F.substring(o, F.lit(3), F.length(o)))
    number = o.startswith("n:")
    return df.select(
        content_id(F.lit("scoped"), scope, s, p, o, *([extra] if extra is not None else [])).alias("stm_id"), F.lit(mod).alias("mod"), seq.cast("long").alias("seq"), s.alias("s"), p.alias("p"), kind.alias("o_kind"), o.alias("o"),
        F.when(kind == "L", F.when(number, "float").otherwise("str")).alias("o_type"), text.alias("o_lex"), null.alias("o_lang"), scope.cast("string").alias("scope"), F.lit(False).alias("free"),
    )


def lower(scopes: DataFrame, variables: DataFrame, statements: DataFrame, *, mod: str = "scopes") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, entities, qualifiers) of scopes, variables and statements, all owners at once.

    A variable without a class has no class statement. Repeated rows give one: each kind of row is made distinct by what it is made of,
    before its ids, so that asking for a predicate makes only its rows and ids only where they are read.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0)
    text = lambda c: F.concat(F.lit("s:"), c)
    entity, literal = F.lit("E"), F.lit("L")
    make = lambda df, s, p, o, kind, scope=none, seq=zero, extra=None: _rows(df, s=s, p=p, o=o, kind=kind, scope=scope, seq=seq, mod=mod, extra=extra)
    scope, variable = F.col("scope"), F.col("variable")
    each = lambda df, by, *more: df.select(by, *more).repartition(by).distinct()  # noqa: E731  few rows a scope or variable: readers join by it
    out = make(each(scopes, "scope", "parent"), scope, F.lit(SCOPE_OF), F.col("parent"), entity)
    out = out.unionByName(make(each(scopes, "scope", "kind"), scope, F.lit(SCOPE_TYPE), text(F.col("kind")), literal)).unionByName(make(each(scopes, "scope", "name"), scope, F.lit(LABEL), text(F.concat(F.lit("scp__"), "name")), literal))
    classed = variables.where("cls IS NOT NULL")
    classes = make(each(classed, "variable", "cls", "scope"), variable, F.lit(INSTANCE), F.col("cls"), entity, scope)
    out = out.unionByName(classes).unionByName(make(each(variables, "variable", "scope"), variable, F.lit(DEFINED_IN), scope, entity)).unionByName(make(each(variables, "variable", "name"), variable, F.lit(NAME_IN_SCOPE), text(F.col("name")), literal))
    key = lambda c: F.concat(F.lit("n:"), F.col(c).cast("double").cast("string"))
    out = out.unionByName(make(each(variables.where("mode IS NOT NULL"), "variable", "mode"), variable, F.lit(MODE), key("mode"), literal))
    extra = F.concat_ws("|", "proxy", F.col("seq").cast("string"))
    single = statements.groupBy("scope", "s", "p", "o", extra.alias("__extra")).agg(F.max(F.col("o_kind") == "E").alias("__entity"), F.min("seq").alias("seq"))
    out = out.unionByName(make(single, F.col("s"), F.col("p"), F.col("o"), F.when(F.col("__entity"), "E").otherwise("L"), scope, F.col("seq"), F.col("__extra")))

    entities = scopes.select(scope.alias("uri"), none.alias("scope")).unionByName(variables.select(variable.alias("uri"), "scope")).dropDuplicates(["uri"])
    entities = entities.select("uri", F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), "scope", F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))

    def qualified(df: DataFrame, stm_id: Column, p: str, o: Column, kind: str) -> DataFrame:
        lex = F.substring(o, F.lit(3), F.length(o)) if kind == "L" else none
        return df.select(stm_id.alias("stm_id"), content_id(stm_id, F.lit(p), o).alias("q_stm_id"), F.lit(0).cast("long").alias("seq"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.alias("o"), F.lit("float" if kind == "L" else None).cast("string").alias("o_type"), lex.alias("o_lex"), none.alias("o_lang"))

    own = content_id(F.lit("scoped"), scope, F.col("s"), F.col("p"), F.col("o"), F.col("__extra"))
    of_class = content_id(F.lit("scoped"), scope, variable, F.lit(INSTANCE), F.col("cls"))
    said = lambda where, *more: statements.where(where).select("scope", "s", "p", "o", extra.alias("__extra"), *more).distinct()
    of = lambda rows: rows.select("variable", "cls", "scope").distinct()
    qualifiers = qualified(said("scope IS NOT NULL"), own, DEFINED_IN, scope, "E").unionByName(qualified(of(classed), of_class, DEFINED_IN, scope, "E"))
    qualifiers = qualifiers.unionByName(qualified(said("proxy IS NOT NULL", "proxy"), own, PROXY, F.col("proxy"), "E")).unionByName(qualified(said("mode IS NOT NULL", "mode"), own, MODE, key("mode"), "L"))
    for quantifier in ("univ_quant", "exis_quant"):
        qualifiers = qualifiers.unionByName(qualified(of(classed.where(F.col("quantifier") == quantifier)), of_class, quantifier, F.lit("n:1.0"), "L"))
    return out, entities, qualifiers


def add(kb: KB, scopes: DataFrame, variables: DataFrame, statements: DataFrame, *, mod: str = "scopes") -> KB:
    """``kb`` with scopes, variables and statements lowered."""
    rows, entities, qualifiers = lower(scopes, variables, statements, mod=mod)
    return kb.plus(rows, entities, qualifiers)


def scopes_of(kb: KB) -> DataFrame:
    """(scope, kind, parent, name) of all scopes, read back from the statements."""
    kinds = kb.of(SCOPE_TYPE).select(F.col("s").alias("scope"), F.col("o_lex").alias("kind"))
    names = kb.of(LABEL).where(F.col("o_lex").startswith("scp__")).select(F.col("s").alias("scope"), F.expr("substring(o_lex, 6)").alias("name"))
    return kb.of(SCOPE_OF).select(F.col("s").alias("scope"), F.col("o").alias("parent")).join(kinds, "scope").join(names, "scope").select("scope", "kind", "parent", "name")


def variables_of(kb: KB) -> DataFrame:
    """(variable, name, cls, scope) of all variables; the class is null where there is none."""
    defined = kb.of(DEFINED_IN).select(F.col("s").alias("variable"), F.col("o").alias("scope"))
    names = kb.of(NAME_IN_SCOPE).select(F.col("s").alias("variable"), F.col("o_lex").alias("name"))
    classes = kb.of(INSTANCE).where("scope IS NOT NULL").select(F.col("s").alias("variable"), F.col("o").alias("cls"), "scope")
    return defined.join(names, "variable").join(classes, ["variable", "scope"], "left").select("variable", "name", "cls", "scope")


def setting_variables(kb: KB) -> DataFrame:
    """(scope, name, variable): for each scope the variables of the setting beside it, by name."""
    scopes = scopes_of(kb)
    settings = scopes.where("kind = 'SETTING'").select(F.col("scope").alias("setting"), "parent")
    return scopes.select("scope", "parent").join(settings, "parent").join(variables_of(kb).withColumnRenamed("scope", "setting"), "setting").select("scope", "name", "variable")


def excess(kb: KB, limits: dict[str, int]) -> DataFrame:
    """(parent, kind, n): scopes with more subscopes of a kind than its limit allows."""
    kinds = kb.of(SCOPE_TYPE).where(F.col("o_lex").isin(*limits)).select(F.col("s").alias("scope"), F.col("o_lex").alias("kind"))
    counted = kb.of(SCOPE_OF).select(F.col("s").alias("scope"), F.col("o").alias("parent")).join(kinds, "scope").groupBy("parent", "kind").agg(F.count(F.lit(1)).alias("n"))
    most = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("kind"))
    return counted.where(F.col("n") > most).select("parent", "kind", "n")


def copy_scope(rows: DataFrame, names: DataFrame, scope: str) -> DataFrame:
    """Statements ``rows`` for another scope, with subjects and objects renamed by ``names`` (old, new)."""
    by_s, by_o = names.select(F.col("old").alias("s"), F.col("new").alias("__s")), names.select(F.col("old").alias("o"), F.col("new").alias("__o"))
    out = rows.join(by_s, "s", "left").join(by_o, "o", "left")
    out = out.withColumn("s", F.coalesce("__s", "s")).withColumn("o", F.coalesce("__o", "o")).withColumn("scope", F.lit(scope))
    return out.withColumn("stm_id", content_id(F.col("stm_id"), F.lit(scope))).select(*rows.columns)


def names_beside(kb: KB, names: DataFrame, copies: DataFrame) -> DataFrame:
    """(target, old, new): what a copied setting's variables became, for the scopes beside its copy, in which they can be named."""
    parents = scopes_of(kb).select(F.col("scope").alias("target"), "parent", "kind")
    settings = names.join(parents.where("kind = 'SETTING'").select("target", "parent"), "target").select("old", "new", "parent")
    targets = copies.select("target").distinct().join(parents.where("kind <> 'SETTING'").select("target", "parent"), "target")
    return targets.join(settings, "parent").select("target", "old", "new").dropDuplicates(["target", "old"])


def mapping_name(target: Column, operator: Column, arguments: Column) -> Column:
    """What a copied mapping is called in its target."""
    return F.concat(target, F.lit("#m"), F.substring(content_id(target, operator, F.to_json(arguments)), 1, 32))


def copied_names(kb: KB, copies: DataFrame, *, operator: str = "applied_mapping_of", argument: str = ARGUMENT) -> DataFrame:
    """(source, target, old, new): what each variable of a copied scope becomes; ``copies`` has (source, target), one row a copy.

    A plain variable is named by target and name. An applied mapping is named by its operator and its copied arguments in order, so equal
    expressions of a target become one; a mapping whose arguments are mappings waits for theirs, a round for each level of depth.
    An argument from outside the source stays what it is, unless the setting beside the target has a copy of it.
    """
    pairs = copies.select("source", "target").distinct()
    variables = variables_of(kb).join(pairs, F.col("scope") == F.col("source"))
    applied = kb.of(operator).select(F.col("s").alias("variable"), F.col("o").alias("operator"))
    mappings = written(variables.join(applied, "variable").select("source", "target", "variable", "operator"), "mappings")
    plain = variables.join(applied, "variable", "left_anti").select("source", "target", F.col("variable").alias("old"), F.concat("target", F.lit("#"), "name").alias("new"))
    beside = names_beside(kb, plain, pairs).select("target", F.col("old").alias("argument"), F.col("new").alias("beside"))
    arguments = kb.of(argument).select(F.col("s").alias("variable"), F.col("seq").alias("place"), F.col("stm_id").alias("by"), F.col("o").alias("argument"), F.col("o_kind").alias("kind"))
    inner = variables.select("source", "target", F.col("variable").alias("argument")).withColumn("own", F.lit(True))
    calls = written(mappings.join(arguments, "variable", "left").join(inner, ["source", "target", "argument"], "left").join(beside, ["target", "argument"], "left"), "calls")
    names = written(plain, "names")
    left = mappings
    while True:
        known = names.select("source", "target", F.col("old").alias("argument"), F.col("new").alias("named"))
        rows = calls.join(left.select("source", "target", "variable"), ["source", "target", "variable"], "left_semi").join(known, ["source", "target", "argument"], "left")
        named = F.when(F.col("own"), F.col("named")).otherwise(F.coalesce("beside", "argument"))
        listed = F.array_sort(F.collect_list(F.when(F.col("argument").isNotNull(), F.struct("place", "by", named.alias("value")))))
        ready = rows.groupBy("source", "target", "variable", "operator").agg(F.count(F.when(F.col("own") & F.col("named").isNull(), 1)).alias("waiting"), listed.alias("listed")).where("waiting = 0")
        made = mapping_name(F.col("target"), F.col("operator"), F.transform("listed", lambda x: x["value"]))
        new = written(ready.select("source", "target", F.col("variable").alias("old"), made.alias("new")), "names")
        if new.isEmpty():
            break
        names = written(names.unionByName(new), "names")
        left = written(left.join(new.select("source", "target", F.col("old").alias("variable")), ["source", "target", "variable"], "left_anti"), "mappings")
    if not left.isEmpty():
        raise ScopeError("an applied mapping is an argument of itself")
    return names


#: Statements of a scope or variable, and variables of a scope, up to which a scope is copied as one row; beyond, its copy is made by joins.
MOST_INSIDE, MOST_VARIABLES = 1000, 64


def _joined(kb: KB, copies: DataFrame) -> bool:
    """Whether copies have to be made by joins: a target has two sources or a copied setting beside it, or a scope is large."""
    pairs = copies.select("source", "target").distinct()
    if not pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return True
    key = lambda df, what, by: df.select(F.lit(what).alias("what"), F.col(by).alias("key"))
    each = key(kb.scoped, "inside", "scope").unionByName(key(kb.of(DEFINED_IN), "variables", "o")).unionByName(key(kb.of(ARGUMENT), "about", "s"))
    most = F.when(F.col("what") == "variables", MOST_VARIABLES).otherwise(MOST_INSIDE)
    if not each.groupBy("what", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty():
        return True
    kinds = kb.of(SCOPE_TYPE).select(F.col("s").alias("target"), (F.col("o_lex") == "SETTING").alias("setting"))
    targets = pairs.select("target").join(kinds, "target")
    if targets.where("NOT setting").isEmpty():
        return False
    parents = targets.join(kb.of(SCOPE_OF).select(F.col("s").alias("target"), F.col("o").alias("parent")), "target")
    return not parents.groupBy("parent").agg(F.max("setting").alias("a"), F.min("setting").alias("b")).where("a AND NOT b").isEmpty()


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once for a row however often a lambda in it asks for it."""
    return F.get(F.transform(F.array(value), use), 0)


def _placed(kb: KB, copies: DataFrame, *, operator: str) -> DataFrame | None:
    """(source, target, names, rows): the contents of each scope gathered once, then named anew and made distinct for each target without another shuffle.

    None if a variable has several names, operators or definitions in a scope: their combinations are made by joins.
    """
    columns = ("seq", "stm_id", "scope", "s", "p", "o_kind", "o", "o_type", "o_lex", "o_lang", "free")
    about = kb.of(NAME_IN_SCOPE, DEFINED_IN, MODE, operator, ARGUMENT).groupBy(F.col("s").alias("variable")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    listed = lambda p, c: F.transform(F.filter("rows", lambda x: x["p"] == p), lambda x: x[c])
    about = about.select("variable", "rows", listed(DEFINED_IN, "o").alias("scopes"), listed(NAME_IN_SCOPE, "o_lex").alias("names"), listed(operator, "o").alias("operators")).where("size(scopes) > 0 AND size(names) > 0")
    odd = (F.size("names") > 1) | (F.size("operators") > 1) | (F.size("scopes") > F.size(F.array_distinct("scopes")))
    arguments = F.transform(F.array_sort(F.filter("rows", lambda x: x["p"] == ARGUMENT)), lambda x: x["o"])  # by place, then by id
    one = F.struct("variable", F.get("names", 0).alias("name"), F.get("operators", 0).alias("operator"), arguments.alias("arguments"), F.filter("rows", lambda x: x["scope"].isNull()).alias("rows"), odd.alias("odd"))
    variables = about.select("scopes", one.alias("variable")).select(F.explode(F.array_distinct("scopes")).alias("source"), "variable")
    inside = kb.scoped.select(F.col("scope").alias("source"), F.struct(*columns).alias("row"))
    # naming takes time where bytes are few: with a number given, Spark doesn't put these partitions together by bytes
    tasks = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contents = variables.unionByName(inside, allowMissingColumns=True).repartition(tasks, "source").groupBy("source").agg(F.collect_list("variable").alias("variables"), F.collect_list("row").alias("inside"))
    found = lambda names, x: F.get(F.filter(names, lambda n: n["old"] == x), 0)["new"]
    target, pair = F.col("target"), lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    own = lambda x: F.exists("variables", lambda v: v["variable"] == x)

    def a_round(names: Column) -> Column:
        """The names and those of the mappings of which all arguments have one."""
        waits = lambda v: F.exists(v["arguments"], lambda a: own(a) & found(names, a).isNull())
        ready = F.filter("variables", lambda v: v["operator"].isNotNull() & found(names, v["variable"]).isNull() & ~waits(v))
        values = lambda v: F.transform(v["arguments"], lambda a: F.coalesce(found(names, a), a))
        return F.concat(names, F.transform(ready, lambda v: pair(v["variable"], mapping_name(target, v["operator"], values(v)))))

    plain = F.transform(F.filter("variables", lambda v: v["operator"].isNull()), lambda v: pair(v["variable"], F.concat(target, F.lit("#"), v["name"])))
    count = F.size("variables")
    rounds = F.sequence(F.lit(0), F.size(F.filter("variables", lambda v: v["operator"].isNotNull())))
    names = F.aggregate(rounds, plain, lambda names, _: F.when(F.size(names) < count, a_round(names)).otherwise(names))
    renamed = lambda names, x: F.coalesce(found(names, x), x)
    o = lambda names, r: F.when(r["p"] == DEFINED_IN, target).otherwise(renamed(names, r["o"]))
    row = lambda names, r: F.struct(F.struct(renamed(names, r["s"]).alias("s"), r["p"].alias("p"), o(names, r).alias("o"), r["scope"].isNotNull().alias("inside"), r["seq"].alias("seq")).alias("key"), *[r[c].alias(c) for c in ("stm_id", "o_kind", "o_type", "o_lex", "o_lang", "free")])
    rows = F.concat("inside", F.flatten(F.transform("variables", lambda v: v["rows"])))
    # of equal mappings that became one, each statement stays once
    first = lambda rows: F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["key"] != r["key"]))
    copied = lambda names: F.struct(names.alias("names"), _let(F.array_sort(F.transform(rows, lambda r: row(names, r))), first).alias("rows"))
    pairs = copies.select("source", "target").distinct()
    odd = F.exists("variables", lambda v: v["odd"])
    made = contents.join(pairs, "source").select("source", "target", count.alias("n"), odd.alias("odd"), _let(names, copied).alias("copied"))
    made = written(made.select("source", "target", "n", "odd", "copied.names", "copied.rows"), "placed", compression="zstd")
    wrong = made.where("odd OR size(names) < n").agg(F.max("odd").alias("odd")).collect()[0]["odd"]
    if wrong is False:
        raise ScopeError("an applied mapping is an argument of itself")
    return None if wrong else made.select("source", "target", "names", "rows")


def _copied_rows(kb: KB, placed: DataFrame, *, mod: str) -> tuple[KB, DataFrame]:
    """``copy_scopes`` of what ``_placed`` has written: statements, entities and qualifiers are made of that where they are asked for."""
    names = placed.select("source", "target", F.explode("names").alias("x")).select("source", "target", "x.old", "x.new")
    rows = placed.select("target", F.explode("rows").alias("x")).select("target", "x.key.*", "x.stm_id", "x.o_kind", "x.o_type", "x.o_lex", "x.o_lang", "x.free")
    copied_id = lambda: content_id(F.lit("copied"), F.col("target"), F.col("stm_id"))
    statements = rows.withColumn("scope", F.when(F.col("inside"), F.col("target"))).withColumn("stm_id", copied_id()).withColumn("mod", F.lit(mod)).select(*kb.statements.columns)
    by_q = names.select("target", F.col("old").alias("o"), F.col("new").alias("__o"))
    qualifiers = kb.qualifiers.join(rows.select("stm_id", "target").distinct(), "stm_id").join(by_q, ["target", "o"], "left")
    qualifiers = qualifiers.withColumn("o", F.when(F.col("p") == DEFINED_IN, F.col("target")).otherwise(F.coalesce("__o", "o")))
    qualifiers = qualifiers.withColumn("q_stm_id", content_id(F.lit("copied"), F.col("target"), F.col("q_stm_id"))).withColumn("stm_id", copied_id()).select(*kb.qualifiers.columns)
    uris = placed.select("target", F.explode(F.array_distinct(F.transform("names", lambda n: n["new"]))).alias("uri"))
    entities = uris.select("uri", F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), F.col("target").alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    return kb.plus(statements, entities, qualifiers), names


def copy_scopes(kb: KB, copies: DataFrame, *, mod: str = "copies", operator: str = "applied_mapping_of") -> tuple[KB, DataFrame]:
    """(``kb`` with the contents of each source in its target scope, names): variables, applied mappings, statements and their qualifiers.

    Targets are scopes that are there. Everything has content ids, so a copy made twice is there once. Proxies of relation
    variables and other qualifiers that name a copied variable name its copy.
    """
    placed = None if _joined(kb, copies) else _placed(kb, copies, operator=operator)
    if placed is not None:
        return _copied_rows(kb, placed, mod=mod)
    names = copied_names(kb, copies, operator=operator)
    own = names.select("target", "old", "new")
    old_new = written(own.unionByName(names_beside(kb, names, copies).join(own.select("target", "old"), ["target", "old"], "left_anti")), "renamed")
    sources = copies.select(F.col("source").alias("scope"), "target").distinct()
    inside = kb.scoped.join(sources, "scope")
    # statements about variables that lie outside of any scope: where they are defined, what they apply and to what
    about = kb.of(NAME_IN_SCOPE, DEFINED_IN, MODE, operator, ARGUMENT).where("scope IS NULL").join(names.select(F.col("old").alias("s"), "source", "target"), "s").drop("source")
    rows = inside.drop("scope").withColumn("scope", F.col("target")).unionByName(about)
    by_s, by_o = old_new.select("target", F.col("old").alias("s"), F.col("new").alias("__s")), old_new.select("target", F.col("old").alias("o"), F.col("new").alias("__o"))
    rows = rows.join(by_s, ["target", "s"], "left").join(by_o, ["target", "o"], "left")
    rows = rows.withColumn("s", F.coalesce("__s", "s")).withColumn("o", F.when(F.col("p") == DEFINED_IN, F.col("target")).otherwise(F.coalesce("__o", "o")))
    copied_id = lambda: content_id(F.lit("copied"), F.col("target"), F.col("stm_id"))
    statements = rows.withColumn("stm_id", copied_id()).withColumn("mod", F.lit(mod)).select(*kb.statements.columns)
    # of equal mappings that became one, each statement stays once
    statements = statements.dropDuplicates(["s", "p", "o", "scope", "seq"])
    by_q = old_new.select("target", F.col("old").alias("o"), F.col("new").alias("__o"))
    ids = rows.select("stm_id", "target").distinct()
    qualifiers = kb.qualifiers.join(ids, "stm_id").join(by_q, ["target", "o"], "left")
    qualifiers = qualifiers.withColumn("o", F.when(F.col("p") == DEFINED_IN, F.col("target")).otherwise(F.coalesce("__o", "o")))
    qualifiers = qualifiers.withColumn("q_stm_id", content_id(F.lit("copied"), F.col("target"), F.col("q_stm_id"))).withColumn("stm_id", copied_id()).select(*kb.qualifiers.columns)
    qualifiers = qualifiers.join(statements.select("stm_id"), "stm_id", "left_semi").select(*kb.qualifiers.columns)
    entities = names.select(F.col("new").alias("uri"), F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), F.col("target").alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked")).dropDuplicates(["uri"])
    return kb.plus(statements, entities, qualifiers), names


def integer_range(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    """(value) of a concrete integer range, its end included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("value"))


def integer_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (start, stop, step and others) with ``value``: a row for each number from start towards stop, both ends included.

    A range that leads away from its end is empty. A step of 0 or null, or a null end, is an error, found before anything is made.
    """
    bad = rows.where("coalesce(step, 0) = 0 OR start IS NULL OR stop IS NULL").limit(1).collect()
    if bad:
        raise ScopeError(f"no range: {bad[0].asDict()}")
    towards = F.signum(F.col("step")) * (F.col("stop") - F.col("start")) >= 0
    return rows.where(towards).withColumn("value", F.explode(F.sequence("start", "stop", "step")))
