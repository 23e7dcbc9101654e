"""Modules on disk: one folder for each, written aside and moved into place, with a registry of prefixes."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LANGUAGES
from ..operators.edit import unload
from ..plans.model import ENTITY, KB, QUALIFIER, STATEMENT

_TABLES = {"statements": STATEMENT, "entities": ENTITY, "qualifiers": QUALIFIER}


class ModuleError(ValueError):
    """A module that is there already, is missing, or takes a prefix or base of another."""


class Store:
    """Modules under one root in any file system that Spark writes to. Parquet partitions by relation, so scans prune."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def modules(self) -> dict[str, dict]:
        """Name to {prefix, base}."""
        if not self._exists(f"{self.root}"):
            return {}
        out = {}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if not name.startswith((".", "_")):
                out[name] = json.loads(self.spark.read.text(f"{self.root}/{name}/module").first()["value"])
        return out

    def save(self, name: str, prefix: str, base: str, kb: KB, *, replace: bool = False) -> None:
        """Stores a module as a whole or not at all: a failure leaves what was there before."""
        known = self.modules()
        if name in known and not replace:
            raise ModuleError(f"{name} is there already")
        for other, info in known.items():
            if other != name and (info["prefix"] == prefix or info["base"] == base):
                raise ModuleError(f"{other} has this prefix or base")
        aside = f"{self.root}/.{name}"
        self._fs.delete(self._path(aside), True)
        try:
            for table in _TABLES:
                df = getattr(kb, table)
                for column, kind in df.dtypes:
                    if kind == "void":
                        df = df.withColumn(column, F.col(column).cast("string"))
                writer = df.write
                if table == "statements":
                    writer = writer.partitionBy("p")
                writer.parquet(f"{aside}/{table}")
            self.spark.createDataFrame([(json.dumps({"prefix": prefix, "base": base}),)], "value string").coalesce(1).write.text(f"{aside}/module")
        except Exception:
            self._fs.delete(self._path(aside), True)
            raise
        old = f"{self.root}/.{name}-old"
        self._fs.delete(self._path(old), True)
        if self._exists(f"{self.root}/{name}"):
            self._fs.rename(self._path(f"{self.root}/{name}"), self._path(old))
        self._fs.rename(self._path(aside), self._path(f"{self.root}/{name}"))
        self._fs.delete(self._path(old), True)

    def load(self, name: str, *, into: KB | None = None, reuse: bool = True) -> KB:
        """A module, alone or added to a knowledge base; one that is in it already is kept (``reuse``) or put anew."""
        if name not in self.modules():
            raise ModuleError(f"no module {name}")
        tables = {t: self._table(name, t, schema) for t, schema in _TABLES.items()}
        own = KB(tables["statements"], tables["entities"], tables["qualifiers"])
        if into is None:
            return own
        if not into.entities.where(F.col("mod") == name).isEmpty():
            if reuse:
                return into
            into = unload(into, name)
        return into.plus(own.statements, entities=own.entities, qualifiers=own.qualifiers)

    def _table(self, name: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{table}").select(*[c.split()[0] for c in schema.split(", ")])


def load_package(store: Store, toml_text: str) -> KB:
    """The main module of a package description (keys main_module, main_module_prefix)."""
    conf = tomllib.loads(toml_text)
    return store.load(conf["main_module"])


def completions(kb: KB, *, label: str = "label") -> DataFrame:
    """(value): two spellings of every entity that was not made automatically: key["label"] and key__label."""
    rows = kb.entities.where("NOT is_auto").join(kb.of(label).where(F.col("o_lang").isNull() | (F.col("o_lang") == LANGUAGES[0])).select(F.col("s").alias("uri"), "o_lex"), "uri")
    key = F.substring_index("uri", "#", -1)
    return rows.select(F.explode(F.array(F.concat(key, F.lit('["'), "o_lex", F.lit('"]')), F.concat(key, F.lit("__"), F.translate("o_lex", " -", "__")))).alias("value")).distinct()


def subset(kb: KB, keys: DataFrame) -> KB:
    """The statements and entities of chosen subjects (uri) alone."""
    wanted = keys.select(F.col("uri").alias("s")).distinct()
    return kb.but(statements=kb.statements.join(wanted, "s", "left_semi").select(*kb.statements.columns), entities=kb.entities.join(wanted.withColumnRenamed("s", "uri"), "uri", "left_semi").select(*kb.entities.columns))
