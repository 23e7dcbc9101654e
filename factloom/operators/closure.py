"""Closures, taxonomy and neighbourhoods: semi-naive loops over edge tables.

Each round joins only what the last round found and keeps what is new; a round's result is a table in the shared
folder, so plans stay small and a lost executor costs one round. The loops end when a round finds nothing.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import KB
from ..plans.tables import written


class RoundLimit(RuntimeError):
    """A loop found something new beyond the number of rounds it was allowed."""


class TaxonomyError(ValueError):
    """A cycle, or both kinds of edges above one entity."""


def transitive_closure(edges: DataFrame, *, reflexive: bool = False, max_rounds: int | None = None) -> DataFrame:
    """(a, b, hops) for each path of ``edges`` (a, b); ``hops`` is the least number. Cycles end like anything else.

    ``reflexive`` adds (x, x, 0) for each node. The new pairs of a round are extended by single edges, or where no node has two
    edges from it (or none has two to it) by as many steps as are known. A path of more than ``max_rounds`` + 1 hops, if given, raises ``RoundLimit``.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    if way := one_way(edges):
        found = doubled(edges, way, max_rounds=max_rounds)
        return _with_loops(found, edges) if reflexive else found
    found = edges.withColumn("hops", F.lit(1))
    if reflexive:
        found = _with_loops(found, edges)
    found = written(found, "closure")
    new = found.where("hops = 1")
    parts = [found]
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for hop in count(2):
        more = _shuffled(new).join(_shuffled(step), "b").select("a", F.col("c").alias("b")).distinct()
        more = more.join(_shuffled(_union(parts).select("a", "b")), ["a", "b"], "left_anti")
        new = written(more.withColumn("hops", F.lit(hop)), "closure")
        if new.isEmpty():
            break
        if max_rounds is not None and hop > max_rounds + 1:
            raise RoundLimit(f"pairs are left after {max_rounds} rounds")
        parts.append(new)
        if len(parts) > 6:  # a bounded number of tables
            parts = [written(_union(parts), "closure")]
    return _union(parts)


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in a loop: a broadcast in each round would add up in the driver."""
    return df.hint("merge")


def _with_loops(found: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    return nodes.select("a", F.col("a").alias("b"), F.lit(0).alias("hops")).unionByName(found.where("a <> b"))


def one_way(edges: DataFrame) -> tuple[str, str] | None:
    """(from, to), the columns of ``edges`` (a, b; distinct) in an order in which each node has one edge on; None if there is none."""
    for a, b in (("a", "b"), ("b", "a")):
        if edges.groupBy(a).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return a, b
    return None


def doubled(edges: DataFrame, way: tuple[str, str], *, max_rounds: int | None = None) -> DataFrame:
    """(a, b, hops) for each path of ``edges`` (a, b), of which each node has one on in the direction ``way``; see ``one_way``.

    A round joins the nodes that are 1, 2, 4, ... steps on with all pairs of at most so many hops: a pair is found once, by
    the node half-way, and there are as many rounds as the longest shortest path has binary digits.
    """
    ways = edges.select(F.col(way[0]).alias("a"), F.col(way[1]).alias("b"))
    leap, size = ways, 1
    parts = [written(ways.withColumn("hops", F.lit(1)), "closure")]
    while True:
        known = _union(parts)
        beyond = _shuffled(leap.select("a", F.col("b").alias("mid"))).join(_shuffled(known.select(F.col("a").alias("mid"), "b", "hops")), "mid").select("a", "b", (F.col("hops") + size).alias("hops"))
        # on a cycle a walk comes to nodes it knows
        new = written(beyond.join(_shuffled(known.select("a", "b")), ["a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            break
        parts.append(new)
        if max_rounds is not None and 2 * size > max_rounds + 1 and not new.where(F.col("hops") > max_rounds + 1).isEmpty():
            raise RoundLimit(f"pairs are left after {max_rounds} rounds")
        far = _shuffled(leap.select("a", F.col("b").alias("mid"))).join(_shuffled(leap.select(F.col("a").alias("mid"), "b")), "mid").select("a", "b")
        leap, size = written(far, "leaps"), 2 * size
    return _union(parts).select(F.col(way[0]).alias("a"), F.col(way[1]).alias("b"), "hops")


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """(node): what can be reached over (a, b) from one node, itself included; only that part of the graph is visited."""
    new = found = edges.sparkSession.range(1).select(F.lit(start).alias("node"))
    while True:
        step = edges.join(new, edges["a"] == new["node"]).select(edges["b"].alias("node")).distinct().join(found, "node", "left_anti")
        new = written(step, "reach")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "reach")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relation_edges(kb: KB, *relations: str) -> DataFrame:
    return kb.of(*relations).where("o_kind = 'E'").select(F.col("s").alias("a"), F.col("o").alias("b"))


def path_star(kb: KB, *relations: str) -> DataFrame:
    """Pairs (a, b) of the property path (r1|r2|...)*, with zero hops for every node of those relations."""
    return transitive_closure(relation_edges(kb, *relations), reflexive=True).select("a", "b")


def superclasses(kb: KB, *, subclass: str = "subclass_of") -> DataFrame:
    """(cls, above, hops) of the subclass relation; raises on a cycle."""
    out = transitive_closure(relation_edges(kb, subclass))
    loop = out.where("a = b").limit(1).collect()
    if loop:
        raise TaxonomyError(f"{loop[0]['a']} is above itself")
    return out.select(F.col("a").alias("cls"), F.col("b").alias("above"), "hops")


def subclasses_of(kb: KB, cls: str, *, subclass: str = "subclass_of") -> DataFrame:
    """All classes below one, found downwards from it: only its own part of the taxonomy is visited."""
    edges = relation_edges(kb, subclass).distinct()
    new = kb.spark.range(1).select(F.lit(cls).alias("cls"))
    found = written(new.where("false"), "below")
    while True:
        new = written(edges.join(new, edges["b"] == new["cls"]).select(edges["a"].alias("cls")).distinct().join(found, "cls", "left_anti"), "below")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "below")


def instances_of(kb: KB, cls: str, *, instance: str = "instance_of", subclass: str = "subclass_of") -> DataFrame:
    """Direct instances of a class and of all classes below it."""
    classes = subclasses_of(kb, cls, subclass=subclass).unionByName(kb.spark.range(1).select(F.lit(cls).alias("cls"))).distinct()
    return kb.of(instance).select("s", F.col("o").alias("cls")).join(classes, "cls", "left_semi").select("s").distinct()


def taxonomy_paths(kb: KB, *, instance: str = "instance_of", subclass: str = "subclass_of") -> DataFrame:
    """(entity, step, via, cls): the chain above each entity, by its class, then by subclass edges.

    An entity with both a class and a superclass is an error.
    """
    both = kb.of(instance, subclass).groupBy("s").agg(F.countDistinct("p").alias("n")).where("n > 1").limit(1).collect()
    if both:
        raise TaxonomyError(f"{both[0]['s']} is an instance and a subclass")
    above = superclasses(kb, subclass=subclass)
    direct = kb.of(instance).select(F.col("s").alias("entity"), F.col("o").alias("cls"))
    first = direct.select("entity", F.lit(1).alias("step"), F.lit(instance).alias("via"), "cls")
    return first.unionByName(direct.join(above, "cls").select("entity", (F.col("hops") + 1).alias("step"), F.lit(subclass).alias("via"), F.col("above").alias("cls")))


def is_instance(kb: KB, pairs: DataFrame, *, instance: str = "instance_of", subclass: str = "subclass_of", secondary: str | None = None) -> DataFrame:
    """``pairs`` (entity, cls) with ``holds``: the class is the entity's own or above it (``secondary`` classes too)."""
    own = kb.of(instance, *([secondary] if secondary else [])).select(F.col("s").alias("entity"), F.col("o").alias("own"))
    above = superclasses(kb, subclass=subclass).select(F.col("cls").alias("own"), F.col("above").alias("cls"))
    true = own.select("entity", F.col("own").alias("cls")).unionByName(own.join(above, "own").select("entity", "cls")).distinct().withColumn("yes", F.lit(True))
    return pairs.join(true, ["entity", "cls"], "left").select("entity", "cls", F.coalesce("yes", F.lit(False)).alias("holds"))


def is_class(kb: KB, *, meta: str = "meta", instance: str = "instance_of", subclass: str = "subclass_of") -> DataFrame:
    """Entities that can have instances: below ``meta`` by subclass edges alone, and no instances themselves."""
    above = superclasses(kb, subclass=subclass).where(F.col("above") == meta).select("cls")
    return above.join(kb.of(instance).select(F.col("s").alias("cls")), "cls", "left_anti").distinct()


def is_subproperty(kb: KB, *, relation: str = "subproperty_of") -> DataFrame:
    """(a, b) for all subproperties, over any number of steps and including each property itself."""
    return path_star(kb, relation)


def neighbourhood(kb: KB, uri: str, *, hidden: tuple[str, ...] = ("label", "description"), cap: int = 3) -> DataFrame:
    """source, p, target, auto: edges of one entity both ways; at most ``cap`` automatic neighbours for each relation."""
    from pyspark.sql.window import Window

    edges = kb.statements.where((F.col("o_kind") == "E") & ~F.col("p").isin(*hidden) & ((F.col("s") == uri) | (F.col("o") == uri)))
    edges = edges.select(F.col("s").alias("source"), "p", F.col("o").alias("target")).distinct()
    other = F.when(F.col("source") == uri, F.col("target")).otherwise(F.col("source"))
    edges = edges.withColumn("auto", F.substring(F.substring_index(other, "#", -1), 2, 1) == "a").withColumn("other", other)
    rank = F.row_number().over(Window.partitionBy("p", "auto").orderBy("other"))
    return edges.withColumn("rank", rank).where(f"NOT auto OR rank <= {cap}").drop("rank", "other")


def ego_graph(kb: KB, uri: str, radius: int) -> DataFrame:
    """(node, hops): what is at most ``radius`` undirected edges away."""
    one = kb.statements.where("o_kind = 'E'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    found = written(kb.spark.range(1).select(F.lit(uri).alias("node"), F.lit(0).alias("hops")), "ego")
    new = found
    for hop in range(1, radius + 1):
        out = one.join(new, one["a"] == new["node"]).select(one["b"].alias("node"))
        back = one.join(new, one["b"] == new["node"]).select(one["a"].alias("node"))
        new = written(out.unionByName(back).distinct().join(found, "node", "left_anti").withColumn("hops", F.lit(hop)), "ego")
        found = written(found.unionByName(new), "ego")
    return found


def complete_graph(kb: KB, *, blacklist: tuple[str, ...] = ("label", "description"), limit: int | None = None) -> DataFrame:
    """(source, target) of all items, parallel edges as one; ``limit`` keeps the edges of so many sources, least first."""
    edges = kb.statements.where((F.col("o_kind") == "E") & ~F.col("p").isin(*blacklist)).select(F.col("s").alias("source"), F.col("o").alias("target")).distinct()
    if limit is None:
        return edges
    return edges.join(edges.select("source").distinct().orderBy("source").limit(limit), "source", "left_semi")


def simple_graph(kb: KB) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that rules see: entities outside scopes, literals, and the edges between them."""
    edges = kb.edges()
    nodes = edges.select(F.col("s").alias("node")).unionByName(edges.select(F.col("o").alias("node"))).distinct()
    return nodes, edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node that can be reached over (a, b), by alternating star steps."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.select("u", F.col("m").alias("v")).unionByName(linked).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        same = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def direct_instances(kb: KB, cls: str, *, keep: Column | None = None, instance: str = "instance_of") -> DataFrame:
    """(s) of a class's own instances, those that a condition on ``s`` keeps."""
    out = kb.of(instance).where(F.col("o") == cls).select("s").distinct()
    return out if keep is None else out.where(keep)


def class_counts(kb: KB, *, instance: str = "instance_of", subclass: str = "subclass_of") -> DataFrame:
    """(cls, n): instances of each class, those of the classes below it included. An instance counts once for a class."""
    own = kb.of(instance).select("s", F.col("o").alias("cls")).distinct()
    sizes = own.groupBy("cls").agg(F.count("*").alias("n"))
    above = superclasses(kb, subclass=subclass).select("cls", "above")
    single = own.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").limit(1).isEmpty()
    if single:  # every instance has one class: sizes add up along the paths, and no instance is shuffled again
        return sizes.unionByName(sizes.join(above, "cls").select(F.col("above").alias("cls"), "n")).groupBy("cls").agg(F.sum("n").alias("n"))
    every = own.unionByName(own.join(above, "cls").select("s", F.col("above").alias("cls"))).distinct()
    return every.groupBy("cls").agg(F.count("*").alias("n"))


def subclass_pairs(kb: KB, pairs: DataFrame, *, subclass: str = "subclass_of", allow_id: bool = False) -> DataFrame:
    """``pairs`` (cls, above) with ``holds``: whether the second is reached by subclass edges; equal ones only with ``allow_id``."""
    true = superclasses(kb, subclass=subclass).select("cls", "above").withColumn("yes", F.lit(True))
    same = F.lit(allow_id) & (F.col("cls") == F.col("above"))
    return pairs.join(true, ["cls", "above"], "left").select("cls", "above", (F.coalesce("yes", F.lit(False)) | same).alias("holds"))


def walk(kb: KB, start: str, relation: str) -> DataFrame:
    """(node, hops): the chain of a functional relation from one entity until there is no next; a cycle ends it, too."""
    edges = relation_edges(kb, relation)
    found = written(kb.spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hops")), "walk")
    for hop in count(1):
        last = found.where(F.col("hops") == hop - 1)
        new = written(edges.join(last, edges["a"] == last["node"]).select(edges["b"].alias("node"), F.lit(hop).alias("hops")).join(found.select("node"), "node", "left_anti"), "walk")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "walk")
