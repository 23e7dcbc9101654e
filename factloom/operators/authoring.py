"""Bulk authoring: rows of (subject, spelled key, values) become statements, set at a time, with one table of errors.

Keys are spelled as people write them: ``R4``, ``R4__is_instance_of``, ``pr__R4``, ``R1__has_label__de``, ``R1["has label"]``. They are
resolved by joins with the registry of entities and of prefixes, never one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..plans.model import COLUMNS, KB, content_id, statement
from ..plans.tables import written
from .edit import new_id

LABEL, FUNCTIONAL, PER_LANGUAGE, LITERAL_RANGE = "label", "is_functional", "is_functional_per_language", "has_literal_range"
UNIVERSAL = "is_universally_quantified"


def resolve_keys(kb: KB, keys: DataFrame, prefixes: DataFrame, *, search: list[str], label: str = LABEL) -> DataFrame:
    """``keys`` (key) with uri, etype, lang and error: each spelling once.

    A prefix (``prefixes`` has prefix, base) names the module; without one the modules of ``search`` are asked in their order and
    the first that has the key wins. A label in the spelling must be the entity's, but for case, spaces and dashes.
    """
    spelled = keys.select("key").distinct().select("key", scalars.parse_key(F.col("key")).alias("k")).select("key", F.col("k.prefix").alias("prefix"), F.col("k.key").alias("short"), F.col("k.label").alias("label"), F.col("k.lang").alias("lang"))
    order = F.posexplode(F.array(*map(F.lit, search)))
    bases = spelled.where("prefix IS NULL AND short IS NOT NULL").select("key", "short", order.alias("place", "base"))
    given = spelled.where("prefix IS NOT NULL").join(F.broadcast(prefixes.select("prefix", "base")), "prefix").select("key", "short", F.lit(0).alias("place"), "base")  # prefixes: a row a module
    asked = bases.unionByName(given).select("key", "place", F.concat("base", F.lit("#"), "short").alias("uri"))
    there = kb.entities.where("NOT unlinked").select("uri", "etype")
    found = asked.join(there, "uri").groupBy("key").agg(F.min_by(F.struct("uri", "etype"), "place").alias("e")).select("key", "e.uri", "e.etype")
    names = kb.of(label).select(F.col("s").alias("uri"), F.lower(scalars.underscored(F.col("o_lex"))).alias("name"))
    right = spelled.where("label IS NOT NULL").select("key", F.lower(scalars.underscored(F.col("label"))).alias("name")).join(found.select("key", "uri"), "key").join(names, ["uri", "name"]).select("key").distinct().withColumn("named", F.lit(True))
    known = prefixes.select("prefix", F.lit(True).alias("known"))
    out = spelled.join(found, "key", "left").join(right, "key", "left").join(F.broadcast(known), "prefix", "left")
    error = (
        F.when(F.col("short").isNull(), "not a key").when(F.col("prefix").isNotNull() & F.col("known").isNull(), "unknown prefix").when(F.col("uri").isNull(), "unknown key")
        .when(F.col("label").isNotNull() & F.col("named").isNull(), "another label")
    )
    return out.select("key", "uri", "etype", "lang", error.alias("error"))


@dataclass
class Authored:
    """The new knowledge base, and (subject, key, error) of what was refused; a subject with an error is left out whole."""

    kb: KB
    errors: DataFrame


def normalised(kb: KB, rows: DataFrame, prefixes: DataFrame, *, search: list[str], default_language: str = scalars.DEFAULT_LANGUAGE) -> tuple[DataFrame, DataFrame]:
    """(statements to be (subject, p, o_kind, lex, o_type, lang, seq), errors (subject, key, error)) of authored rows.

    ``rows`` are (subject, seq, key, values array of (lex, kind, lang), listed): several values only where ``listed``; kind is E for an
    entity's URI, else the literal's type. For relations of literal range text gets the language of the key or the default. A
    relation with one object for each language takes its first value in the default language and no lists.
    """
    keys = written(resolve_keys(kb, rows, prefixes, search=search), "keys")
    marks = kb.of(FUNCTIONAL, PER_LANGUAGE, LITERAL_RANGE).where("o = 'n:1.0'").groupBy(F.col("s").alias("uri")).agg(*[F.max(F.col("p") == m).alias(m) for m in (FUNCTIONAL, PER_LANGUAGE, LITERAL_RANGE)])
    out = rows.join(keys.withColumnRenamed("lang", "key_lang"), "key").join(marks, "uri", "left").fillna(False, [FUNCTIONAL, PER_LANGUAGE, LITERAL_RANGE])
    listed = F.when(F.col("etype") != "R", "not a relation").when(F.col("listed") & F.col(FUNCTIONAL), "a list for a functional relation").when(F.col("listed") & F.col(PER_LANGUAGE), "a list for a relation with one object for each language")
    out = out.withColumn("error", F.coalesce("error", listed, F.when(~F.col("listed") & (F.size("values") != 1), "not one value")))
    each = out.where("error IS NULL").select("subject", "seq", "key", F.col("uri").alias("p"), "key_lang", FUNCTIONAL, PER_LANGUAGE, LITERAL_RANGE, F.posexplode("values").alias("place", "value"))
    each = each.select("*", F.col("value.lex").alias("lex"), F.col("value.kind").alias("kind"), F.col("value.lang").alias("value_lang"))
    ordered = Window.partitionBy("subject", "p").orderBy("seq", "place")
    first = F.row_number().over(ordered) == 1  # a subject's values of one relation: as many as one author wrote
    default = F.lit(default_language)
    foreign = lambda c: c.isNotNull() & (c != default)
    text_error = (
        F.when(F.col(LITERAL_RANGE) & (F.col("kind") != "str"), "not a text")
        .when(F.col(PER_LANGUAGE) & F.col("first") & foreign(F.coalesce("key_lang", "value_lang")), "the first text is not in the default language")
        .when(F.col("key_lang").isNotNull() & F.col("value_lang").isNotNull() & (F.col("key_lang") != F.col("value_lang")), "two languages")
    )
    each = each.withColumn("first", first).withColumn("error", text_error)
    lang = F.when(F.col("kind") == "str", F.coalesce("value_lang", "key_lang", F.when(F.col(LITERAL_RANGE) | F.col(PER_LANGUAGE), default)))
    good = each.where("error IS NULL").select("subject", "key", "p", F.when(F.col("kind") == "E", "E").otherwise("L").alias("o_kind"), "lex", F.when(F.col("kind") != "E", F.col("kind")).alias("o_type"), lang.alias("lang"), "seq", "place", FUNCTIONAL, PER_LANGUAGE)
    single = good.where(F.col(FUNCTIONAL) | F.col(PER_LANGUAGE)).groupBy("subject", "p", F.when(F.col(PER_LANGUAGE), F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key")).where("n > 1")
    errors = [out.where("error IS NOT NULL").select("subject", "key", "error"), each.where("error IS NOT NULL").select("subject", "key", "error"), single.select("subject", "key", F.lit("several objects").alias("error"))]
    return good.drop(FUNCTIONAL, PER_LANGUAGE), reduce(DataFrame.unionByName, errors).distinct()


def _keyed(kind: Column, o_type: Column, lex: Column, lang: Column) -> Column:
    return F.when(kind == "E", lex).otherwise(scalars.literal_key(o_type, lex, lang))


def as_rows(good: DataFrame, mod: str) -> DataFrame:
    """Statements of normalised rows."""
    o = _keyed(F.col("o_kind"), F.col("o_type"), F.col("lex"), F.col("lang"))
    columns = {
        "stm_id": content_id(F.col("subject"), F.col("p"), o), "mod": F.lit(mod), "seq": F.col("seq") * 1000 + F.col("place"), "s": F.col("subject"), "p": F.col("p"), "o_kind": F.col("o_kind"), "o": o,
        "o_type": F.col("o_type"), "o_lex": F.when(F.col("o_kind") == "L", F.col("lex")), "o_lang": F.col("lang"), "scope": F.lit(None).cast("string"), "free": F.lit(False),
    }
    return good.select(*[columns[c].alias(c) for c in COLUMNS]).dropDuplicates(["stm_id"])


def author(kb: KB, rows: DataFrame, prefixes: DataFrame, *, mod: str, search: list[str] | None = None, create: str | None = "I", default_language: str = scalars.DEFAULT_LANGUAGE) -> Authored:
    """Creates the subjects of ``rows`` as entities of a kind (I or R), or, without one, adds to subjects that are there.

    See ``normalised`` for the rows. A subject to be created must be new, one to be added to must be there, and a functional
    relation must not get a second object beside one that is stored. Subjects without an error are stored together.
    """
    subjects = rows.select("subject").distinct()
    good, errors = normalised(kb, rows, prefixes, search=search or [mod], default_language=default_language)
    good = written(good, "authored")
    there = kb.entities.where("NOT unlinked").select(F.col("uri").alias("subject"))
    null = F.lit(None).cast("string")
    if create:
        wrong = subjects.join(there, "subject", "left_semi").select("subject", null.alias("key"), F.lit("the URI is used").alias("error"))
    else:
        wrong = subjects.join(there, "subject", "left_anti").select("subject", null.alias("key"), F.lit("no such entity").alias("error"))
        single = kb.of(FUNCTIONAL).where("o = 'n:1.0'").select(F.col("s").alias("p"))
        stored = kb.statements.join(single, "p", "left_semi").select(F.col("s").alias("subject"), "p", F.col("o").alias("old"))
        new = good.withColumn("o", _keyed(F.col("o_kind"), F.col("o_type"), F.col("lex"), F.col("lang")))
        clash = new.join(stored, ["subject", "p"]).where("o <> old").select("subject", "key", F.lit("another object is stored").alias("error"))
        wrong = wrong.unionByName(clash)
    errors = written(errors.unionByName(wrong).distinct(), "errors")
    bad = errors.select("subject").distinct()
    stored_rows = as_rows(good.join(bad, "subject", "left_anti"), mod)
    if create:
        entities = subjects.join(bad, "subject", "left_anti").select(F.col("subject").alias("uri"), F.lit(create).alias("etype"), scalars.is_auto(scalars.uri_key(F.col("subject"))).alias("is_auto"), null.alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
        return Authored(kb.plus(stored_rows, entities), errors)
    # what is stored already is not stored twice
    return Authored(kb.plus(stored_rows.join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS)), errors)


def quantified_instances(kb: KB, rows: DataFrame, *, instance: str = "instance_of", mod: str = "derived") -> tuple[KB, DataFrame]:
    """(``kb`` with an entity for each (cls, name) that stands for every instance of the class, (uri, cls, name))."""
    made = rows.select(new_id("Ia", F.lit("every"), F.col("cls"), F.col("name")).alias("uri"), "cls", "name").distinct()
    parts = [statement(F.col("uri"), instance, F.col("cls"), mod=mod), statement(F.col("uri"), LABEL, F.col("name"), kind="L", o_type="str", mod=mod), statement(F.col("uri"), UNIVERSAL, F.lit(1), kind="L", o_type="bool", mod=mod)]
    facts = reduce(DataFrame.unionByName, [made.select(*p) for p in parts])
    entities = made.select("uri", F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), F.lit(None).cast("string").alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    return kb.plus(facts.join(kb.of(instance, LABEL, UNIVERSAL).select("stm_id"), "stm_id", "left_anti").select(*COLUMNS), entities.join(kb.entities.select("uri"), "uri", "left_anti")), made
