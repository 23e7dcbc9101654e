"""Lookups, projections and predicates over statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.model import KB


class LookupFailed(KeyError):
    """Nothing, or more than one thing, where one was asked for."""


def entity(kb: KB, uri: str, *, strict: bool = True) -> DataFrame:
    out = kb.entities.where((F.col("uri") == uri) & ~F.col("unlinked"))
    if strict and out.isEmpty():
        raise LookupFailed(uri)
    return out


def resolve(text: str, prefixes: dict[str, str], *, current: str, builtin: str) -> str:
    """URI of a key in any spelling: an explicit prefix wins, then the current module, then the built-ins for R and I keys below 1000."""
    import re

    found = re.fullmatch(r'(?:([A-Za-z]\w*?)__)?([IR]a?\d+)(?:__\w+)?(?:\["[^"]*"\])?', text)
    if not found:
        raise LookupFailed(text)
    prefix, key = found.groups()
    if prefix:
        if prefix not in prefixes:
            raise LookupFailed(prefix)
        return f"{prefixes[prefix]}#{key}"
    return f"{builtin if int(re.sub(r'[^0-9]', '', key)) < 1000 else current}#{key}"


def by_label(kb: KB, label: str, *, relation: str = "label") -> DataFrame:
    """The first entity with a label, in order of insertion."""
    return kb.of(relation).where(F.col("o_lex") == label).groupBy("o_lex").agg(F.min_by("s", F.struct("seq", "s")).alias("s")).select("s")


def statements_of(kb: KB, s: str, p: str | None = None) -> DataFrame:
    return (kb.statements if p is None else kb.of(p)).where(F.col("s") == s)


def inverse_statements(kb: KB, o: str) -> DataFrame:
    """(subject, p): statements and qualifiers whose object is an entity."""
    own = kb.statements.where((F.col("o_kind") == "E") & (F.col("o") == o)).select(F.col("s").alias("subject"), "p")
    return own.unionByName(kb.qualifiers.where((F.col("o_kind") == "E") & (F.col("o") == o)).select(F.col("stm_id").alias("subject"), "p"))


def shaped(kb: KB, functional: list[str]) -> DataFrame:
    """s, p, one, many: a functional relation gives one object, any other the list in order of insertion."""
    many = F.transform(F.array_sort(F.collect_list(F.struct("seq", "o"))), lambda x: x["o"])
    out = kb.statements.groupBy("s", "p").agg(many.alias("many"))
    single = F.col("p").isin(*functional) if functional else F.lit(False)
    return out.select("s", "p", F.when(single, F.get("many", 0)).alias("one"), F.when(~single, F.col("many")).alias("many"))


def in_language(rows: DataFrame, keys: list[str], text: str, lang: str, wanted: str) -> DataFrame:
    """keys and the text in the wanted language, else without a language; one with neither is left out."""
    priority = F.when(F.col(lang) == wanted, 0).when(F.col(lang).isNull(), 1)
    ranked = rows.withColumn("__priority", priority).where("__priority IS NOT NULL")
    return ranked.groupBy(*keys).agg(F.min_by(text, F.struct("__priority", text)).alias(text))


def subjects(kb: KB, p: str, o: str | None = None) -> DataFrame:
    """Subjects of a relation outside of scopes, repeated as often as they are stated."""
    out = kb.of(p)
    if o is not None:
        out = out.where(F.col("o") == o)
    scoped = kb.entities.where("scope IS NOT NULL").select(F.col("uri").alias("s"))
    return out.select("s").join(scoped, "s", "left_anti")


def relevant(kb: KB, entities: DataFrame, *, placeholder: str = "is_placeholder") -> DataFrame:
    """``entities`` (s) that are no placeholders and lie in no scope."""
    out = entities.join(kb.of(placeholder).where("o = 'n:1.0'").select("s"), "s", "left_anti")
    return out.join(kb.entities.where("scope IS NOT NULL").select(F.col("uri").alias("s")), "s", "left_anti")


def is_true(kb: KB, s: str, p: str, o: str) -> bool:
    """Whether the statement is there; without any the answer is False."""
    return not kb.of(p).where((F.col("s") == s) & (F.col("o") == o)).isEmpty()


def first_literals(kb: KB, s: str) -> DataFrame:
    """(p, o): the first literal of each relation of an entity; of those inserted together the least."""
    return statements_of(kb, s).where("o_kind = 'L'").groupBy("p").agg(F.min_by("o", F.struct("seq", "o")).alias("o"))


def first_qualifiers(kb: KB, relation: str) -> DataFrame:
    """(stm_id, o): each statement's first qualifier of a relation."""
    # few statements have several: rows are moved once before they are sorted and grouped, not grouped in each task first
    return kb.qualifiers.where(F.col("p") == relation).repartition("stm_id").groupBy("stm_id").agg(F.min_by("o", F.struct("seq", "q_stm_id")).alias("o"))


def proxies(kb: KB, *, relation: str = "has_proxy") -> DataFrame:
    """(stm_id, o) of statements with exactly one proxy; more than one is an error."""
    counted = kb.qualifiers.where(F.col("p") == relation).groupBy("stm_id").agg(F.count("*").alias("n"), F.first("o").alias("o"))
    if not counted.where("n > 1").isEmpty():
        raise LookupFailed("a statement has several proxies")
    return counted.select("stm_id", "o")


def relation_properties(kb: KB, *, marker: str = "is_relation_property") -> DataFrame:
    """(relation, properties): for each relation the sorted properties that are true of it."""
    names = kb.of(marker).where("o = 'n:1.0'").select(F.col("s").alias("p"))
    true = kb.statements.where("o = 'n:1.0'").join(names, "p", "left_semi")
    return true.groupBy(F.col("s").alias("relation")).agg(F.array_sort(F.collect_set("p")).alias("properties"))


def arguments(kb: KB, *, tuple_relation: str = "has_arguments", element: str = "has_element", index: str = "has_index") -> DataFrame:
    """(mapping, place, argument): ordered elements of the argument tuple of each mapping."""
    tuples = kb.of(tuple_relation).select(F.col("s").alias("mapping"), F.col("o").alias("tuple"))
    return tuples.join(tuple_elements(kb, element=element, index=index), "tuple").select("mapping", "place", "argument")


def tuple_elements(kb: KB, *, element: str = "has_element", index: str = "has_index") -> DataFrame:
    """(tuple, place, argument) by the index qualifiers of the element statements."""
    places = kb.qualifiers.where(F.col("p") == index).select("stm_id", F.col("o_lex").cast("long").alias("place"))
    return kb.of(element).join(places, "stm_id").select(F.col("s").alias("tuple"), "place", F.col("o").alias("argument"))


def scope_members(kb: KB, scope: str) -> tuple[DataFrame, DataFrame]:
    """(statements, entities) of a scope."""
    return kb.statements.where(F.col("scope") == scope), kb.entities.where(F.col("scope") == scope)


def subscopes(kb: KB, owner: str, *, relation: str = "is_scope_of") -> DataFrame:
    return kb.of(relation).where(F.col("o") == owner).select(F.col("s").alias("scope"))


def subscope_named(kb: KB, owner: str, name: str, *, relation: str = "is_scope_of", label: str = "label") -> str:
    """The one subscope labelled ``name`` or ``scp__name``."""
    found = subscopes(kb, owner, relation=relation).join(kb.of(label).where(F.col("o_lex").isin(name, f"scp__{name}")).select(F.col("s").alias("scope")), "scope").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupFailed(f"{len(found)} subscopes {name}")
    return found[0]["scope"]


def label_mismatches(kb: KB, keys: DataFrame, *, relation: str = "label") -> DataFrame:
    """``keys`` (uri, label) whose label differs from the entity's, but for case, spaces and dashes."""
    plain: Column = F.lower(scalars.underscored(F.col("o_lex")))
    labels = kb.of(relation).groupBy(F.col("s").alias("uri")).agg(F.collect_set(plain).alias("labels"))
    return keys.join(labels, "uri", "left").where(~F.coalesce(F.array_contains("labels", F.lower(scalars.underscored(F.col("label")))), F.lit(False))).select("uri", "label")


def with_tombstones(kb: KB, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node) with what they are: live entity, removed entity, or literal."""
    out = nodes.join(kb.entities.select(F.col("uri").alias("node"), "unlinked"), "node", "left")
    return out.select("node", F.when(F.col("unlinked").isNull(), "literal").when(F.col("unlinked"), "removed").otherwise("entity").alias("kind"))


def truths(kb: KB, rows: DataFrame) -> DataFrame:
    """``rows`` (s, p, o) with ``holds``: whether the statement is there."""
    true = kb.statements.select("s", "p", "o").distinct().withColumn("yes", F.lit(True))
    return rows.join(true, ["s", "p", "o"], "left").select("s", "p", "o", F.coalesce("yes", F.lit(False)).alias("holds"))


def tuple_difference(kb: KB, first: str, second: str, **more) -> DataFrame:
    """(place, argument): elements of one tuple that the other has not, in the first's order of places."""
    elements = tuple_elements(kb, **more)
    one = elements.where(F.col("tuple") == first).select("place", "argument")
    return one.join(elements.where(F.col("tuple") == second).select("argument"), "argument", "left_anti").select("place", "argument")


def unused_places(kb: KB, tuples: DataFrame, size: int, **more) -> DataFrame:
    """(tuple, place): the places from 0 to ``size`` - 1 that a tuple has no element at."""
    every = tuples.select("tuple").distinct().withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return every.join(tuple_elements(kb, **more).select("tuple", "place"), ["tuple", "place"], "left_anti")


def scope_free(kb: KB) -> DataFrame:
    """(uri) of the entities that lie in no scope: the nodes of the graph that rules see."""
    return kb.entities.where("scope IS NULL AND NOT unlinked").select("uri")


def is_qualifier(kb: KB, ids: DataFrame) -> DataFrame:
    """``ids`` (stm_id) with ``qualifier``: whether it is a statement about a statement."""
    own = kb.qualifiers.select(F.col("q_stm_id").alias("stm_id")).distinct().withColumn("yes", F.lit(True))
    return ids.join(own, "stm_id", "left").select("stm_id", F.coalesce("yes", F.lit(False)).alias("qualifier"))
