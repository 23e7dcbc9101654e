"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

Stages, none of which lists all pairs of a group:

1. each text becomes its set of distinct word shingles; a one-permutation MinHash of ``bands * rows`` bins (an
   empty bin takes the value of a non-empty one, probed in an order that depends on the bin alone) gives the band
   keys, and a sum over the set gives a fingerprint by which equal sets collapse to one class;
2. class representatives meet in band buckets; each bucket gives a star around one hub, and each star edge is
   confirmed on the full sets;
3. a bucket whose members lie in one component has no more to say. Of the others, two members of different
   components are compared if they share one of their rarest shingles (prefix filter with sizes and places): an
   exact way for all pairs of a bucket that its star did not settle, in one round, without listing its pairs;
4. components of the confirmed edges, by their least id.

A pair at a Jaccard likeness of 0.75 misses all 32 bands of 4 rows with a chance of 5e-6; every confirmed link is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import attach, text_chunks, written
from .components import components
from .words import mix, shingle_hashes, word_hashes

#: Pairs of one hub that are compared in one place.
HUB_PAIRS = 1000

_SIGNATURE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, sorted by row, then hash."""
    n = len(offsets) - 1
    value, rows = shingle_hashes(*word_hashes(data, offsets), n, size)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[keep], rows[keep]


def one_permutation(value: np.ndarray, rows: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins signatures of sorted sets; bins is a power of two. Rows without elements get zeros."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = rows * bins + (value >> shift).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    out[cell[first]] = value[first]
    full[cell[first]] = True
    some = np.zeros(n, bool)
    some[rows] = True
    todo = np.flatnonzero(~full & np.repeat(some, bins))
    base, place, attempt = todo - todo % bins, (todo % bins).astype(np.uint64), 0
    with np.errstate(over="ignore"):
        while len(todo):
            attempt += 1
            probe = base + (mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
            hit = full[probe]
            out[todo[hit]] = out[probe[hit]]
            todo, base, place = todo[~hit], base[~hit], place[~hit]
    return out.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, bins = signature.shape
    rows = bins // bands
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::rows])
    return key


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, "text"):
                n = end - first
                value, at = shingle_sets(data, offsets, size)
                counts = np.bincount(at, minlength=n).astype(np.int64)
                sums = np.zeros((2, n), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(2):
                        np.add.at(sums[k], at, mix(value + np.uint64(k + 1)))
                keys = band_keys(one_permutation(value, at, n, bands * rows), bands)
                some = counts > 0
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)), pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(counts), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), listed],
                    names=_SIGNATURE.names,
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, "text"):
                value, at = shingle_sets(data, offsets, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=end - first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], names=_SETS.names)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle``-word shingles. A null
    text is empty; an empty set is linked with nothing. A row with a null id keeps itself and has no component.
    Rows that repeat an id are one document each; they share the component. Other columns are not read. An empty
    table gives an empty one. No key (a set, a band, a hub) with many rows has them in one task: see ``attach``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_signatures(shingle, bands, rows), _SIGNATURE), "signatures")
    sets = signed.where("n_shingles > 0 AND id IS NOT NULL")
    same, total = ["set_a", "set_b", "n_shingles"], signed.count()
    classes = written(sets.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = written(
        attach(sets, classes, same, "copies", total).select("id", "rep", "n_shingles", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "members"
    )
    links = _links(members.where("bands IS NOT NULL").dropDuplicates(["id"]), texts, shingle, percent, total * bands)
    found = members.select("id", "rep").distinct().join(links, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n_shingles").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def _links(reps: DataFrame, texts: DataFrame, shingle: int, percent: int, total: int) -> DataFrame:
    """(node, component) of representatives that a confirmed link joins to another; ``total`` bounds their band keys."""
    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("held")).where("hub < last").select("key", "hub", "held")
    buckets = written(attach(keys, written(shared, "shared"), ["key"], "held", total).select("key", "id", "hub"), "buckets")
    nodes = buckets.select("id").distinct()
    sets = written(texts.join(nodes, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_full_sets(shingle), _SETS), "sets")
    pairs = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    compared = written(_confirmed(pairs, sets, percent), "compared")
    stars = compared.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = components(stars)
    placed = buckets.select("key", "id").join(joined, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    left = written(_prefixes(placed, sets, percent), "prefixes")
    if left.isEmpty():
        return joined
    again = _prefix_pairs(left, percent).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = written(_confirmed(again, sets, percent).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "confirmed")
    return joined if more.isEmpty() else components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _prefixes(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, id, component, n, place: the rarest shingles of each member of a bucket with two components or more.

    Of two sets of n and m shingles that are linked, overlap >= o = percent * (n + m) / (100 + percent) holds, so
    their n - o + 1 and m - o + 1 rarest shingles (in one order of all) have one in common. A partner shares a
    bucket, so the least size in a member's buckets bounds m. Shingles of one component alone are left out.
    """
    sized = placed.join(sets.select("id", F.size("shingles").alias("n")), "id")
    keys = sized.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low < high").select("key", "least")
    nodes = sized.join(keys, "key").groupBy("id").agg(F.min("component").alias("component"), F.min("n").alias("n"), F.min("least").alias("least"))
    prefix = F.col("n") - F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent)) + 1
    nodes = written(nodes.select("id", "component", "n", prefix.alias("prefix")), "open")
    tokens = sets.join(nodes, "id").select("id", "component", "n", "prefix", F.explode("shingles").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("held"), (F.min("component") < F.max("component")).alias("apart"))
    ranked = tokens.join(known, "token").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("held", "token")))
    return ranked.where("place <= prefix AND apart").select("token", "id", "component", "n", "place")


def _prefix_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share a shingle of both prefixes and may still have enough in common."""
    x, y = left.alias("x"), left.alias("y")
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    can = 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.id") < F.col("y.id")) & can)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by the full sets of both. A hub of many pairs has its set in as many slices as keep them apart."""
    pairs = written(pairs, "pairs")
    hubs = written(pairs.groupBy("a").agg(F.count("*").alias("held")), "hubs").withColumn("slices", F.ceil(F.col("held") / HUB_PAIRS))
    sliced = attach(pairs, hubs, ["a"], "held", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), "slices").alias("slice"))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_x")).join(hubs.select("a", "slices"), "a")
    one = one.select("a", "set_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_y"))
    both = F.size(F.array_intersect("set_x", "set_y"))
    return sliced.join(other, "b").join(one, ["a", "slice"]).select("a", "b", (100 * both >= percent * (F.size("set_x") + F.size("set_y") - both)).alias("linked"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 75 * (m.n + k.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, f.y FROM r JOIN f ON r.reach = f.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id, min(reach) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
