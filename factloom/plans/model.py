"""Knowledge bases: entities, statements and qualifiers as DataFrames, and the star schema as one.

A statement is (stm_id, mod, seq, s, p, o_kind, o, o_type, o_lex, o_lang, scope, free): ``o`` is the object's URI if
``o_kind`` is E, else the literal's key (see ``literal_key``), so equal objects have equal ``o``. ``free`` exempts from
functional checks. Inverse statements are not stored: they are a filter on ``o``. A knowledge base never changes; edits give a
new one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import local, written

STATEMENT = "stm_id string, mod string, seq long, s string, p string, o_kind string, o string, o_type string, o_lex string, o_lang string, scope string, free boolean"
ENTITY = "uri string, etype string, is_auto boolean, scope string, mod string, unlinked boolean"
QUALIFIER = "stm_id string, q_stm_id string, seq long, p string, o_kind string, o string, o_type string, o_lex string, o_lang string"
Table = DataFrame | Callable[[], DataFrame]
COLUMNS = [c.split()[0] for c in STATEMENT.split(", ")]


class KB:
    """One version of a knowledge base. Its tables are built when they are first asked for.

    ``parts`` has the statements of each predicate as a function that builds them: a query that names its
    predicates then plans and reads those alone; the statements of scopes are never among them. ``bag`` tells whether equal triples can occur (then patterns make
    them distinct). ``single`` names predicates with one object a subject as a rule: they order joins, results don't rest on them.
    """

    def __init__(self, statements: Table | None, entities: Table, qualifiers: Table, *, bag: bool = True, parts: dict[str, list[Callable[[], DataFrame]]] | None = None, single: frozenset[str] = frozenset()):
        self._tables = {"statements": statements, "entities": entities, "qualifiers": qualifiers}
        self.parts, self.bag, self.single = parts, bag, single

    def _get(self, name: str) -> DataFrame:
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    @property
    def statements(self) -> DataFrame:
        if self.parts is None:
            return self._get("statements")
        return self.of(*self.parts, rest=True)

    @property
    def scoped(self) -> DataFrame:
        """Statements that lie in a scope."""
        if self.parts is None or self._tables["statements"] is not None:
            return self._get("statements").where("scope IS NOT NULL")
        return local(self.spark, [], STATEMENT)

    @property
    def entities(self) -> DataFrame:
        return self._get("entities")

    @property
    def qualifiers(self) -> DataFrame:
        return self._get("qualifiers")

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def of(self, *predicates: str, rest: bool = False) -> DataFrame:
        """Statements of some predicates (``rest``: and all statements outside of the parts)."""
        if self.parts is None:
            return self.statements.where(F.col("p").isin(*predicates))
        out = [f() for p in predicates for f in self.parts.get(p, [])]
        if self._tables["statements"] is not None:
            more = self._get("statements")
            out.append(more if rest else more.where(F.col("p").isin(*predicates)))
        return reduce(DataFrame.unionByName, out) if out else local(self.spark, [], STATEMENT)

    def edges(self, p: str | None = None, *, graph: bool = True) -> DataFrame:
        """s, p, o_kind, o; in graph mode without statements of a scope or about entities of one."""
        out = self.statements if p is None else self.of(p)
        if graph:
            out = out.where("scope IS NULL")
            if not _never(self.entities, "scope"):
                scoped = self.entities.where("scope IS NOT NULL").select("uri")
                out = out.join(scoped.select(F.col("uri").alias("s")), "s", "left_anti").join(scoped.select(F.col("uri").alias("o")), "o", "left_anti")
        return out.select("s", "p", "o_kind", "o")

    def but(self, **changes) -> KB:
        """This version with other tables; new ``statements`` are all statements."""
        tables = self._tables | {k: v for k, v in changes.items() if k in self._tables}
        return KB(**tables, bag=changes.get("bag", self.bag), parts=None if "statements" in changes else changes.get("parts", self.parts), single=self.single)

    def only(self, *predicates: str) -> KB:
        """This version with the statements of some predicates alone."""
        return self.but(statements=lambda: self.of(*predicates))

    def stored(self) -> KB:
        """This version with its three tables written to the shared folder: what is asked of it next doesn't compute them again."""
        table = lambda df, name: written(df, name, compression="zstd")  # noqa: E731  half of the bytes of ids are taken by it
        return KB(table(self.statements, "statements"), table(self.entities, "entities"), table(self.qualifiers, "qualifiers"), bag=self.bag, single=self.single)

    def plus(self, statements: DataFrame, entities: DataFrame | None = None, qualifiers: DataFrame | None = None, *, bag: bool = True) -> KB:
        """This version with more rows; ``bag=False`` says that they repeat no triple, of their own or of this version."""
        own = self._get("statements") if self._tables["statements"] is not None else None
        out = KB(statements if own is None else own.unionByName(statements), self._tables["entities"], self._tables["qualifiers"], bag=bag or self.bag, parts=self.parts, single=self.single)
        if entities is not None:
            out._tables["entities"] = self.entities.unionByName(entities)
        if qualifiers is not None:
            out._tables["qualifiers"] = self.qualifiers.unionByName(qualifiers)
        return out


    def with_parts(self, parts: dict[str, Callable[[], DataFrame]], entities: DataFrame | None = None, qualifiers: DataFrame | None = None) -> KB:
        """This version with more statements of some predicates, built when they are asked for; they repeat no triple and lie in no scope."""
        mine = dict(self.parts or {})
        for p, rows in parts.items():
            mine[p] = [*mine.get(p, []), rows]
        out = KB(**self._tables, bag=self.bag, parts=mine, single=self.single)
        if entities is not None:
            out._tables["entities"] = self.entities.unionByName(entities)
        if qualifiers is not None:
            out._tables["qualifiers"] = self.qualifiers.unionByName(qualifiers)
        return out


def _never(df: DataFrame, column: str) -> bool:
    """True if the schema says that a column is void: tables without scopes need no anti-joins."""
    return df.schema[column].dataType.simpleString() == "void"


def statement(s: Column, p: str, o: Column, *, kind: str = "E", o_type: str | None = None, lang: Column | None = None, stm_id: Column | None = None, mod: str = "star") -> list[Column]:
    """The columns of a statement with a constant predicate; for a literal ``o`` is its text."""
    null = F.lit(None).cast("string")
    lex = null if kind == "E" else o.cast("string")
    if kind == "E":
        key = o
    elif o_type in ("int", "float", "bool"):
        key = F.concat(F.lit("n:"), o.cast("double").cast("string"))
    else:
        key = F.concat_ws("", F.lit("s:"), lex, *([F.concat(F.lit("@"), lang)] if lang is not None else []))
    return [
        (content_id(s, F.lit(p), key) if stm_id is None else stm_id).alias("stm_id"), F.lit(mod).alias("mod"), F.lit(0).cast("long").alias("seq"), s.alias("s"), F.lit(p).alias("p"),
        F.lit(kind).alias("o_kind"), key.alias("o"), F.lit(o_type).cast("string").alias("o_type"), lex.alias("o_lex"), (lang if lang is not None else null).alias("o_lang"), null.alias("scope"), F.lit(False).alias("free"),
    ]


def content_id(*parts: Column) -> Column:
    """128 bits, in 32 hex digits, of the SHA-256 of the parts as a JSON array: different parts, nulls among them, never have one text.

    It is never null, which ``coalesce`` tells the optimiser: a join by it would else compute it once more for each row read, to filter nulls.
    """
    return F.coalesce(F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32), F.lit(""))


#: Predicates of the star schema that come from a column of a keyed table.
SINGLE = frozenset("label instance_of part_of placed_by segment status size brand parent".split())
#: Fixed part of the taxonomy over the star schema.
SUBCLASSES = [("region", "place"), ("nation", "place"), ("customer", "party"), ("supplier", "party"), ("order", "document"), ("user", "party"), ("place", "thing"), ("party", "thing"), ("document", "thing"), ("product", "thing"), ("thing", "meta")]


def constants(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of strings, as a plan of literals."""
    listed = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


_schemas: dict[str, object] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose schema is inferred once for each path."""
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def star(spark: SparkSession, sf_dir: str) -> KB:
    """The star schema as statements, each predicate a part of its own: no query reads a table that it does not name."""
    t = lambda name: read(spark, f"{sf_dir}/{name}.parquet")
    uri = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    keyed = [("region", "R", "r_regionkey", "region", "r_name"), ("nation", "N", "n_nationkey", "nation", "n_name"), ("customer", "C", "c_custkey", "customer", "c_name"), ("supplier", "S", "s_suppkey", "supplier", "s_name"), ("part", "P", "p_partkey", None, "p_name")]
    text = {"kind": "L", "o_type": "str"}
    parts: dict[str, list[Callable[[], DataFrame]]] = {}

    def part(predicate: str, rows: Callable[[], DataFrame], s: Column, o: Column, **more) -> None:
        parts.setdefault(predicate, []).append(lambda: rows().select(*statement(s, predicate, o, **more)))

    for table, letter, key, cls, name in keyed:
        rows = lambda table=table: t(table)
        part("label", rows, uri(letter, key), F.col(name), **text)
        part("instance_of", rows, uri(letter, key), F.lit(cls) if cls else F.concat(F.lit("T_"), "p_type"))
    part("instance_of", lambda: t("orders"), uri("O", "o_orderkey"), F.lit("order"))
    part("instance_of", lambda: t("events").select("user_id").distinct(), uri("U", "user_id"), F.lit("user"))
    part("part_of", lambda: t("nation"), uri("N", "n_nationkey"), uri("R", "n_regionkey"))
    part("part_of", lambda: t("customer"), uri("C", "c_custkey"), uri("N", "c_nationkey"))
    part("part_of", lambda: t("supplier"), uri("S", "s_suppkey"), uri("N", "s_nationkey"))
    part("placed_by", lambda: t("orders"), uri("O", "o_orderkey"), uri("C", "o_custkey"))
    part("contains", lambda: t("lineitem").select("l_orderkey", "l_partkey").distinct(), uri("O", "l_orderkey"), uri("P", "l_partkey"))
    part("supplied_by", lambda: t("lineitem").select("l_partkey", "l_suppkey").distinct(), uri("P", "l_partkey"), uri("S", "l_suppkey"))
    part("segment", lambda: t("customer"), uri("C", "c_custkey"), F.col("c_mktsegment"), **text)
    part("status", lambda: t("orders"), uri("O", "o_orderkey"), F.col("o_orderstatus"), **text)
    part("size", lambda: t("part"), uri("P", "p_partkey"), F.col("p_size"), kind="L", o_type="int")
    part("brand", lambda: t("part"), uri("P", "p_partkey"), F.col("p_brand"), **text)
    part("parent", lambda: t("part").where("p_partkey > 0"), uri("P", "p_partkey"), F.concat(F.lit("P"), F.expr("cast(p_partkey div 2 as string)")))
    part("subclass_of", lambda: constants(spark, SUBCLASSES, ["c", "d"]), F.col("c"), F.col("d"))
    part("subclass_of", lambda: t("part").select("p_type").distinct(), F.concat(F.lit("T_"), "p_type"), F.lit("product"))
    part("did", lambda: t("events").select("user_id", "event_type").distinct(), uri("U", "user_id"), F.col("event_type"), **text)

    def entities() -> DataFrame:
        uris = [t(table).select(uri(letter, key).alias("uri")) for table, letter, key, _, _ in keyed] + [t("orders").select(uri("O", "o_orderkey").alias("uri"))]
        return reduce(DataFrame.unionByName, uris).select("uri", F.lit("I").alias("etype"), F.lit(False).alias("is_auto"), F.lit(None).alias("scope"), F.lit("star").alias("mod"), F.lit(False).alias("unlinked"))

    def qualifiers() -> DataFrame:
        line = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        quantity = F.col("l_quantity").cast("string")
        stm_id = content_id(uri("O", "l_orderkey"), F.lit("contains"), uri("P", "l_partkey"))
        return t("lineitem").select(
            stm_id.alias("stm_id"), line.alias("q_stm_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit("quantity").alias("p"), F.lit("L").alias("o_kind"), F.concat(F.lit("n:"), quantity).alias("o"),
            F.lit("float").alias("o_type"), quantity.alias("o_lex"), F.lit(None).cast("string").alias("o_lang"),
        )

    return KB(None, entities, qualifiers, bag=False, parts=parts, single=SINGLE)


def kb_of(spark: SparkSession, triples: list[tuple], *, scoped: dict[str, str] | None = None, mod: str = "m") -> KB:
    """A small knowledge base from (s, p, o) or (s, p, o, scope) tuples, for authoring and tests.

    A str object is an entity's URI; literals are given as ("text", "lang") tuples, bool, int or float.
    """
    rows, seen = [], set()
    for n, t in enumerate(triples):
        s, p, o = t[:3]
        scope = t[3] if len(t) > 3 else None
        seen.add(s)
        if isinstance(o, str):
            seen.add(o)
            rows.append((f"S{n}", mod, n, s, p, "E", o, None, None, None, scope, False))
        else:
            kind, lex, lang = ("str", o[0], o[1] if len(o) > 1 else None) if isinstance(o, tuple) else (type(o).__name__, str(o).lower() if isinstance(o, bool) else str(o), None)
            key = f"n:{float(o)}" if kind != "str" else f"s:{lex}" + (f"@{lang}" if lang else "")
            rows.append((f"S{n}", mod, n, s, p, "L", key, kind, lex, lang, scope, False))
    entities = [(u, "R" if u.startswith("R") else "I", u[1:2] == "a", (scoped or {}).get(u), mod, False) for u in sorted(seen)]
    return KB(local(spark, rows, STATEMENT), local(spark, entities, ENTITY), local(spark, [], QUALIFIER))
