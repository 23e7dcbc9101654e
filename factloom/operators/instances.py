"""New instances of classes: ids by content, signatures and methods inherited from the class."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import KB, content_id, statement
from .closure import is_class, superclasses
from .edit import insert, new_id

#: Relations whose statements about an operator's class hold for its instances: domains of three places and the range.
SIGNATURE = ("domain_1", "domain_2", "domain_3", "range")
_OBJECT = ("o_kind", "o", "o_type", "o_lex", "o_lang")


class NotAClass(ValueError):
    """An instance of something that cannot have any."""


def new_instances(kb: KB, rows: DataFrame, *, instance: str = "instance_of", label: str = "label", strict: bool = False, mod: str = "derived") -> KB:
    """``kb`` with an entity for each (cls, name) of ``rows``: its class, its label, its class's signature.

    The same class and name give the same entity, so making it again adds nothing. ``strict`` refuses what is no class.
    """
    if strict:
        bad = rows.select("cls").distinct().join(is_class(kb), "cls", "left_anti").limit(1).collect()
        if bad:
            raise NotAClass(bad[0]["cls"])
    made = rows.select(new_id("Ia", F.col("cls"), F.col("name")).alias("uri"), "cls", "name").distinct()
    null = F.lit(None).cast("string")
    facts = made.select(*statement(F.col("uri"), instance, F.col("cls"), mod=mod)).unionByName(made.select(*statement(F.col("uri"), label, F.col("name"), kind="L", o_type="str", mod=mod)))
    entities = made.select("uri", F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), null.alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    out = insert(kb, facts.unionByName(inherited_signature(kb, made, mod=mod)), only_new=True)
    return out.but(entities=kb.entities.withColumn("scope", F.col("scope").cast("string")).unionByName(entities.join(kb.entities.select("uri"), "uri", "left_anti")))


def inherited_signature(kb: KB, made: DataFrame, *, mod: str = "derived") -> DataFrame:
    """Statements that the entities of ``made`` (uri, cls) take over from their class; only relations with one object."""
    own = kb.of(*SIGNATURE).select(F.col("s").alias("cls"), "p", *_OBJECT)
    single = own.groupBy("cls", "p").agg(F.count("*").alias("n"), F.first(F.struct(*_OBJECT)).alias("one")).where("n = 1")
    taken = made.select("uri", "cls").join(single, "cls").select("uri", "p", "one.*")
    null = F.lit(None).cast("string")
    return taken.select(
        content_id(F.col("uri"), F.col("p"), F.col("o")).alias("stm_id"), F.lit(mod).alias("mod"), F.lit(0).cast("long").alias("seq"), F.col("uri").alias("s"), "p", *_OBJECT, null.alias("scope"), F.lit(False).alias("free")
    )


@dataclass
class Methods:
    """Python functions of classes. An entity has those of its class and of the classes above, the nearest first."""

    own: dict[str, dict[str, Callable]] = field(default_factory=dict)

    def add(self, cls: str, name: str, function: Callable) -> None:
        self.own.setdefault(cls, {})[name] = function

    def resolve(self, kb: KB, entity: str, name: str, *, instance: str = "instance_of") -> Callable:
        direct = kb.of(instance).where(F.col("s") == entity).select(F.col("o").alias("cls"))
        above = direct.join(superclasses(kb), "cls").select(F.col("above").alias("cls"), "hops").unionByName(direct.withColumn("hops", F.lit(0)))
        found = above.where(F.col("cls").isin(*[c for c, m in self.own.items() if name in m])).orderBy("hops", "cls").limit(1).collect()
        if not found:
            raise AttributeError(f"{entity} has no method {name}")
        return self.own[found[0]["cls"]][name]
