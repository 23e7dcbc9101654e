"""N-Triples: the RDF projection of a knowledge base, its text, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sub_uri, uri_base
from ..plans.model import KB, content_id

_XSD = "http://www.w3.org/2001/XMLSchema#"
_TYPES = {"int": "integer", "bool": "boolean", "float": "double"}
_LINE = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*#(\w+)>)?)\s*\.\s*$'


def projection(kb: KB, *, base: str = "", statements: bool = False, qualifiers: bool = False, modules: list[str] | None = None) -> DataFrame:
    """Distinct (s, p, o, o_is_uri, o_type, o_lang) of the statements.

    ``statements`` adds for each the triples that name it: subject to statement in the sub-namespace STATEMENTS,
    statement to object in PREDICATES; ``qualifiers`` adds theirs in QUALIFIERS. ``modules`` keeps subjects of those bases.
    """
    uri = lambda c: F.concat(F.lit(base), c)
    o = F.when(F.col("o_kind") == "E", uri(F.col("o"))).otherwise(F.col("o_lex"))
    rest = [(F.col("o_kind") == "E").alias("o_is_uri"), "o_type", "o_lang"]
    null = F.lit(None).cast("string")
    out = kb.statements.select(uri(F.col("s")).alias("s"), uri(F.col("p")).alias("p"), o.alias("o"), *rest)
    if statements:
        name = uri(F.col("stm_id"))
        out = out.unionByName(kb.statements.select(uri(F.col("s")).alias("s"), sub_uri(uri(F.col("p")), "STATEMENTS").alias("p"), name.alias("o"), F.lit(True).alias("o_is_uri"), null.alias("o_type"), null.alias("o_lang")))
        out = out.unionByName(kb.statements.select(name.alias("s"), sub_uri(uri(F.col("p")), "PREDICATES").alias("p"), o.alias("o"), *rest))
    if qualifiers:
        out = out.unionByName(kb.qualifiers.select(uri(F.col("stm_id")).alias("s"), sub_uri(uri(F.col("p")), "QUALIFIERS").alias("p"), o.alias("o"), *rest))
    if modules is not None:
        out = out.where(uri_base(F.col("s")).isin(*([modules] if isinstance(modules, str) else modules)))
    return out.distinct()


def _escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _unescaped(text: Column) -> Column:
    # a backslash pair is set aside first, so that what follows it is not read as an escape
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lines(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    kind: Column = F.lit("")
    for ours, theirs in _TYPES.items():
        kind = F.when(F.col("o_type") == ours, f"^^<{_XSD}{theirs}>").otherwise(kind)
    tag = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(kind)
    o = F.when(F.col("o_is_uri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tag))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def export(kb: KB, path: str, **more) -> None:
    lines(projection(kb, **more)).write.text(path)


def parse(text: DataFrame) -> DataFrame:
    """(s, p, o, o_is_uri, o_type, o_lang) of lines (value); blank lines and comments are left out, anything else is an error."""
    rows = text.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    get = lambda k: F.nullif(F.regexp_extract("value", _LINE, k), F.lit(""))
    ok = F.when(~F.col("value").rlike(_LINE), F.raise_error(F.concat(F.lit("not an N-Triples line: "), "value")).cast("string")).otherwise(get(1))
    kind: Column = F.lit("str")
    for ours, theirs in _TYPES.items():
        kind = F.when(get(6) == theirs, ours).otherwise(kind)
    is_uri = get(3).isNotNull()
    literal = _unescaped(F.regexp_extract("value", _LINE, 4))
    return rows.select(ok.alias("s"), get(2).alias("p"), F.coalesce(get(3), literal).alias("o"), is_uri.alias("o_is_uri"), F.when(~is_uri, kind).alias("o_type"), get(5).alias("o_lang"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def import_facts(kb: KB, triples: DataFrame, *, instance: str, functional: tuple[str, ...] = (), mod: str = "imported") -> KB:
    """Adds the direct triples: unknown subjects of ``instance`` become entities, functional relations are overwritten.

    Triples in the sub-namespaces of named statements are left out; what is there already is not added again.
    """
    direct = triples.where(~F.col("p").rlike("/(STATEMENTS|PREDICATES|QUALIFIERS)#"))
    number = F.when(F.lower("o") == "true", 1.0).when(F.lower("o") == "false", 0.0).otherwise(F.col("o").try_cast("double"))
    key = F.when(F.col("o_is_uri"), F.col("o")).when(F.col("o_type").isin("int", "float", "bool"), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat_ws("", F.lit("s:"), "o", F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang"))))
    null = F.lit(None).cast("string")
    rows = direct.select(
        content_id(F.lit(mod), F.col("s"), F.col("p"), key).alias("stm_id"), F.lit(mod).alias("mod"), F.lit(0).cast("long").alias("seq"), "s", "p", F.when(F.col("o_is_uri"), "E").otherwise("L").alias("o_kind"), key.alias("o"),
        "o_type", F.when(~F.col("o_is_uri"), F.col("o")).alias("o_lex"), "o_lang", null.alias("scope"), F.lit(False).alias("free"),
    )
    rows = rows.join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*kb.statements.columns)
    old = kb.statements
    if functional:
        old = old.join(rows.where(F.col("p").isin(*functional)).select("s", "p").distinct(), ["s", "p"], "left_anti").select(*kb.statements.columns)
    new = direct.where(F.col("p") == instance).select(F.col("s").alias("uri")).distinct().join(kb.entities.select("uri"), "uri", "left_anti")
    new = new.select("uri", F.lit("I").alias("etype"), F.lit(False).alias("is_auto"), null.alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    return kb.but(statements=old, bag=True).plus(rows, entities=new)
