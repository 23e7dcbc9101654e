"""Edits: each takes a knowledge base and gives a new one. What breaks a constraint is found before it is stored."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import KB, content_id, statement
from ..plans.tables import written
from .closure import components


class FunctionalError(ValueError):
    """Two statements where the relation allows one."""


Validator = Callable[[KB, DataFrame], DataFrame]


def functional_violations(kb: KB, functional: list[str]) -> DataFrame:
    """(s, p, n): more than one statement of a functional relation, exempt ones not counted."""
    return kb.of(*functional).where("NOT free").groupBy("s", "p").agg(F.count("*").alias("n")).where("n > 1")


def language_violations(kb: KB, functional: list[str]) -> DataFrame:
    """(s, p, o_lang, n): more than one statement of a language for relations that allow one for each."""
    return kb.of(*functional).where("NOT free").groupBy("s", "p", "o_lang").agg(F.count("*").alias("n")).where("n > 1")


def insert(kb: KB, rows: DataFrame, *, functional: tuple[str, ...] = (), only_new: bool = False, validators: tuple[Validator, ...] = ()) -> KB:
    """``kb`` with the statements ``rows``; ``only_new`` leaves out triples that are there, and repeated ones.

    Raises before anything is stored if a functional relation would get two objects or a validator gives a row.
    """
    if only_new:
        rows = rows.dropDuplicates(["s", "p", "o"]).join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*kb.statements.columns)
    after = kb.plus(rows)
    if functional:
        touched = rows.where(F.col("p").isin(*functional)).select("s", "p").distinct()
        bad = functional_violations(after, list(functional)).join(touched, ["s", "p"], "left_semi").limit(1).collect()
        if bad:
            raise FunctionalError(f"{bad[0]['s']} {bad[0]['p']}: {bad[0]['n']} objects")
    for validator in validators:
        bad = validator(after, rows).limit(1).collect()
        if bad:
            raise ValueError(str(bad[0].asDict()))
    return after


def for_pairs(subjects: DataFrame, p: str, objects: DataFrame, *, mod: str = "m") -> DataFrame:
    """A statement for each subject (s) and each of the few objects (o) of a relation: several of either at once."""
    every = subjects.select("s").distinct().crossJoin(objects.select("o").distinct())
    return every.select(*statement(F.col("s"), p, F.col("o"), mod=mod))


def leftovers(kb: KB, mod: str) -> DataFrame:
    """(kind, name): entities and statements that a module has, to be none once it is unloaded."""
    entities = kb.entities.where(F.col("mod") == mod).select(F.lit("entity").alias("kind"), F.col("uri").alias("name"))
    return entities.unionByName(kb.statements.where(F.col("mod") == mod).select(F.lit("statement").alias("kind"), F.col("stm_id").alias("name")))


def overwrite(kb: KB, rows: DataFrame) -> KB:
    """Replaces, for each (s, p) of ``rows``, the one statement there is; none, several or a qualified one is an error."""
    keys = rows.select("s", "p").distinct()
    old = kb.statements.join(keys, ["s", "p"], "left_semi")
    n = keys.join(old.groupBy("s", "p").agg(F.count("*").alias("n")), ["s", "p"], "left").where("coalesce(n, 0) <> 1").limit(1).collect()
    if n:
        raise FunctionalError(f"{n[0]['s']} {n[0]['p']}: {n[0]['n'] or 0} statements to overwrite")
    if not old.join(kb.qualifiers.select("stm_id"), "stm_id", "left_semi").isEmpty():
        raise FunctionalError("a qualified statement is not overwritten")
    return kb.but(statements=kb.statements.join(keys, ["s", "p"], "left_anti").select(*kb.statements.columns).unionByName(rows))


def delete_statements(kb: KB, ids: DataFrame) -> KB:
    """Without the statements ``ids`` (stm_id) and their qualifiers."""
    return kb.but(statements=kb.statements.join(ids, "stm_id", "left_anti").select(*kb.statements.columns), qualifiers=kb.qualifiers.join(ids, "stm_id", "left_anti").select(*kb.qualifiers.columns))


def delete_entities(kb: KB, uris: DataFrame) -> KB:
    """Without the entities ``uris`` (uri) and every statement that touches one; the entities stay as tombstones."""
    gone = uris.select("uri").distinct()
    touched = kb.statements.join(gone.select(F.col("uri").alias("s")), "s", "left_semi").select("stm_id").unionByName(
        kb.statements.where("o_kind = 'E'").join(gone.select(F.col("uri").alias("o")), "o", "left_semi").select("stm_id")
    )
    out = delete_statements(kb, touched.distinct())
    marked = kb.entities.join(gone.withColumn("gone", F.lit(True)), "uri", "left").withColumn("unlinked", F.col("unlinked") | F.coalesce("gone", F.lit(False)))
    return out.but(entities=marked.select(*kb.entities.columns))


def unload(kb: KB, mod: str) -> KB:
    """Without a module's entities and statements, and the statements of others that touch its entities."""
    own = kb.entities.where(F.col("mod") == mod).select("uri")
    out = delete_entities(kb, own)
    return out.but(statements=out.statements.where(F.col("mod") != mod), entities=out.entities.where(F.col("mod") != mod))


def representatives(same: DataFrame) -> DataFrame:
    """(old, new) from pairs (a, b) of entities to be merged: all of a component become its least."""
    return components(same).where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))


def merge_entities(kb: KB, replacements: DataFrame, *, keep: tuple[str, ...] = ("label", "description", "instance_of", "is_placeholder"), functional: tuple[str, ...] = (), placeholder: str = "is_placeholder") -> KB:
    """Redirects statements of ``old`` to ``new`` for all pairs, drops duplicates and those of ``keep``, removes ``old``.

    Where a functional relation then has two objects, a placeholder gives way to the other one; two others are an error.
    """
    pairs = replacements.select("old", "new").distinct()
    by_s = pairs.select(F.col("old").alias("s"), F.col("new").alias("new_s"))
    by_o = pairs.select(F.col("old").alias("o"), F.col("new").alias("new_o"))
    moved = kb.statements.join(by_s, "s", "left").join(by_o, "o", "left")
    moved = moved.where(F.col("new_s").isNull() | ~F.col("p").isin(*keep))
    moved = moved.withColumn("s", F.coalesce("new_s", "s")).withColumn("o", F.coalesce("new_o", "o")).withColumn("__moved", F.col("new_s").isNotNull() | F.col("new_o").isNotNull())
    first = moved.groupBy("s", "p", "o").agg(F.min(F.struct("__moved", "seq", "stm_id")).alias("kept"))
    # statements that were not redirected all stay; redirected ones only if they say something new
    same = moved.join(first, ["s", "p", "o"]).where("NOT __moved OR stm_id = kept.stm_id").select(*kb.statements.columns)
    if functional:
        placeholders = kb.of(placeholder).where("o = 'n:1.0'").select(F.col("s").alias("o")).withColumn("weak", F.lit(True))
        crowded = same.where(F.col("p").isin(*functional) & ~F.col("free")).groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1").select("s", "p")
        weak = same.join(crowded, ["s", "p"], "left_semi").join(placeholders, "o", "left_semi").select("stm_id")
        same = same.join(weak, "stm_id", "left_anti").select(*kb.statements.columns)
    out = delete_entities(kb.but(statements=same), pairs.select(F.col("old").alias("uri")))
    if functional:
        bad = out.of(*functional).where("NOT free").groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1").limit(1).collect()
        if bad:
            raise FunctionalError(f"{bad[0]['s']} {bad[0]['p']}: {bad[0]['n']} objects after the merge")
    return out.but(bag=True)


def indexed(members: DataFrame, *, order: str = "o") -> DataFrame:
    """``members`` (tuple, o) with ``place``: from 0 in each tuple by the elements' order. No tuple is held in one task.

    Rows are sorted by range and written; a row's place is its place in its task less that of its tuple's first, plus the rows of the tuple in the tasks before.
    """
    spot = F.monotonically_increasing_id()
    sorted_ = members.orderBy("tuple", order).withColumn("part", F.shiftright(spot, 33)).withColumn("spot", spot.bitwiseAND(F.lit((1 << 33) - 1)))
    sorted_ = written(sorted_, "sorted")
    runs = sorted_.groupBy("tuple", "part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each tuple and task that has some of it
    before = F.sum("n").over(Window.partitionBy("tuple").orderBy("part")) - F.col("n")
    return sorted_.join(runs.withColumn("before", before), ["tuple", "part"]).select("tuple", "o", (F.col("spot") - F.col("first") + F.col("before")).alias("place"))


def element_rows(members: DataFrame, *, mod: str = "m", element: str = "has_element", index: str = "has_index", length: str = "has_length") -> tuple[DataFrame, DataFrame]:
    """(statements, qualifiers) of tuples as ``members`` (tuple, o, place): an indexed element each, and a length a tuple."""
    null = F.lit(None).cast("string")
    stm_id = content_id(F.col("tuple"), F.lit(element), F.col("place"))
    common = [F.lit(mod).alias("mod"), F.col("place").cast("long").alias("seq"), F.col("tuple").alias("s")]
    elements = members.select(stm_id.alias("stm_id"), *common, F.lit(element).alias("p"), F.lit("E").alias("o_kind"), "o", null.alias("o_type"), null.alias("o_lex"), null.alias("o_lang"), null.alias("scope"), F.lit(False).alias("free"))
    sizes = members.groupBy("tuple").agg(F.count(F.lit(1)).alias("n"))
    place = F.col("place").cast("string")
    qualifiers = members.select(
        stm_id.alias("stm_id"), F.concat(stm_id, F.lit("q")).alias("q_stm_id"), F.lit(0).cast("long").alias("seq"), F.lit(index).alias("p"), F.lit("L").alias("o_kind"),
        F.concat(F.lit("n:"), F.col("place").cast("double").cast("string")).alias("o"), F.lit("int").alias("o_type"), place.alias("o_lex"), null.alias("o_lang"),
    )
    return elements.unionByName(_lengths(sizes, F.col("n"), mod, length)), qualifiers


def _lengths(rows: DataFrame, size: Column, mod: str, length: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        content_id(F.col("tuple"), F.lit(length)).alias("stm_id"), F.lit(mod).alias("mod"), F.lit(0).cast("long").alias("seq"), F.col("tuple").alias("s"), F.lit(length).alias("p"), F.lit("L").alias("o_kind"),
        F.concat(F.lit("n:"), size.cast("double").cast("string")).alias("o"), F.lit("int").alias("o_type"), size.cast("string").alias("o_lex"), null.alias("o_lang"), null.alias("scope"), F.lit(False).alias("free"),
    )


def tuple_rows(tuples: DataFrame, *, mod: str = "m", element: str = "has_element", index: str = "has_index", length: str = "has_length") -> tuple[DataFrame, DataFrame]:
    """(statements, qualifiers) of ``tuples`` (tuple, elements array of URIs): a length and an indexed element each, also of empty ones."""
    each = tuples.select("tuple", F.posexplode("elements").alias("place", "o"))
    rows, qualifiers = element_rows(each, mod=mod, element=element, index=index, length=length)
    return rows.where(F.col("p") == element).unionByName(_lengths(tuples, F.size("elements"), mod, length)), qualifiers


def close_class(kb: KB, cls: str, *, instance: str = "instance_of", closed: str = "has_closed_tuple") -> KB:
    """Stores the class's direct instances, in order of insertion, as its closed tuple; however many there are."""
    own = kb.of(instance).where(F.col("o") == cls).select(F.lit(f"tuple:{cls}").alias("tuple"), F.col("s").alias("o"), F.struct("seq", "s").alias("at"))
    rows, qualifiers = element_rows(indexed(own, order="at"))
    link = kb.spark.range(1).select(*statement(F.lit(cls), closed, F.lit(f"tuple:{cls}"), mod="m"))
    return kb.plus(rows.unionByName(link), qualifiers=qualifiers)


def new_id(prefix: str, *parts: Column) -> Column:
    """Id of a made entity from what made it: the same however often it is made."""
    return F.concat(F.lit(prefix), F.substring(content_id(*parts), 1, 32))
