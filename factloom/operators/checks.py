"""Consistency checks: arity and argument types of applied operators, by joins with the class closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import KB
from .closure import superclasses

#: Classes of plain numbers, by the type of the literal; a bool counts as an integer.
LITERAL_CLASSES = {"int": "integer", "bool": "integer", "float": "real", "complex": "complex"}


#: (class, expected): what is of the class also fits a place that expects the other, though that is not above it.
STANDS_FOR = (("complex", "expression"),)


class SignatureError(ValueError):
    """Argument places of an operator that leave a gap."""


def arities(signature: DataFrame) -> DataFrame:
    """(operator, arity) from ``signature`` (operator, place, expected); places must start at 0 without a gap."""
    out = signature.groupBy("operator").agg((F.max("place") + 1).alias("arity"), F.countDistinct("place").alias("n"))
    bad = out.where("arity <> n").limit(1).collect()
    if bad:
        raise SignatureError(f"{bad[0]['operator']} has a gap in its argument places")
    return out.select("operator", "arity")


def arity_violations(calls: DataFrame, signature: DataFrame) -> DataFrame:
    """(mapping, operator, n, arity) of ``calls`` (mapping, operator, args) with another number of arguments."""
    return calls.join(arities(signature), "operator").where(F.size("args") != F.col("arity")).select("mapping", "operator", F.size("args").alias("n"), "arity")


def type_violations(kb: KB, calls: DataFrame, signature: DataFrame, *, instance: str = "instance_of", secondary: str | None = None) -> DataFrame:
    """(mapping, place, argument, expected): arguments that are of none of the classes their place expects.

    A place may expect several classes; any of them will do. An argument is of its class, of the classes above it
    and, with ``secondary``, of the objects of that relation. Numbers given as literal keys are of LITERAL_CLASSES; what is of a
    class of STANDS_FOR, by itself or from above, fits the class beside it.
    """
    args = calls.select("mapping", "operator", F.posexplode("args").alias("place", "argument"))
    wanted = args.join(signature, ["operator", "place"])
    own = kb.of(instance, *([secondary] if secondary else [])).select(F.col("s").alias("argument"), F.col("o").alias("own"))
    literals = args.where("argument LIKE 'n:%'").select("argument", F.when(F.col("argument").rlike(r"\.0$"), LITERAL_CLASSES["int"]).otherwise(LITERAL_CLASSES["float"]).alias("own")).distinct()
    own = own.unionByName(literals)
    above = superclasses(kb).select(F.col("cls").alias("own"), F.col("above").alias("expected"))
    fits = own.select("argument", F.col("own").alias("expected")).unionByName(own.join(above, "own").select("argument", "expected")).distinct()
    for cls, other in STANDS_FOR:
        fits = fits.unionByName(fits.where(F.col("expected") == cls).select("argument", F.lit(other).alias("expected")))
    good = wanted.join(fits, ["argument", "expected"], "left_semi").select("mapping", "place").distinct()
    bad = wanted.join(good, ["mapping", "place"], "left_anti")
    return bad.groupBy("mapping", "place", "argument").agg(F.array_join(F.array_sort(F.collect_set("expected")), ",").alias("expected"))


def inverse_functional_violations(kb: KB, relations: list[str]) -> DataFrame:
    """(o, p, n): objects with several subjects for relations that allow one."""
    return kb.of(*relations).groupBy("o", "p").agg(F.countDistinct("s").alias("n")).where("n > 1")


def missing_required(kb: KB, cls: str, relation: str, *, instance: str = "instance_of") -> DataFrame:
    """(s) of a class's direct instances without a statement of a relation that they need."""
    return kb.of(instance).where(F.col("o") == cls).select("s").distinct().join(kb.of(relation).select("s"), "s", "left_anti")
