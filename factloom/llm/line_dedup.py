"""Recurring line templates across documents: a log-template tree of fixed depth, in Spark SQL functions.

A line is parsed down a tree: the number of its tokens, then its first DEPTH tokens; there is its leaf. A token with a
digit is a variable field ``<*>`` from the start. Within a leaf, lines are compared by their other tokens, cut into SEGMENTS
runs by place: lines that agree in all but two runs are of one template, whose other tokens are variable fields, if those
are at most a quarter of all tokens. So a line has a key for each pair of runs that may vary, and one without any. Keys
are made only for lines of leaves that enough lines share, so most lines are left after one count; a line that recurs
without variables has its other keys made once, for its first document, and makes the templates it is of recurring.

A template of MIN_DOCUMENTS documents or more is dropped from all but the first of them (least id): what leaves the corpus
with a line is a quarter of its tokens at most. Lines of fewer than MIN_TOKENS tokens have the key without variables alone
and are dropped only from SHORT_DOCUMENTS documents on, for they are often plain sentences.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, written

#: Leading tokens in the tree path, documents that make a template recurring, tokens of a line that is compared with others.
DEPTH = 2
MIN_DOCUMENTS = 3
MIN_TOKENS = 4
#: Documents that make a line of fewer tokens recurring; runs that a line's other tokens are cut into.
SHORT_DOCUMENTS = 20
SEGMENTS = 8
#: One variable token for so many of a line.
SHARE = 4
#: Templates that are sent to all executors at most (24 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000


def masked(line: Column) -> Column:
    """The line with tokens joined by single spaces, those with a digit as ``<*>``."""
    tight = F.trim(F.regexp_replace(line, r"[\x09-\x0D ]{2,}|[\x09-\x0D]", " "))
    return F.transform(F.array(tight), lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, r"(?<!\S)[^\s0-9]*+[0-9]\S*", "<*>")).otherwise(t))[0]


def _edge(n: Column, k: int, depth: int) -> Column:
    """Tokens before the k-th run of a line of ``n`` tokens."""
    return depth + F.floor(k * F.greatest(n - depth, F.lit(0)) / SEGMENTS).cast("int")


def parsed(line: Column, *, depth: int, min_tokens: int) -> Column:
    """An array of one n, leaf and the hashes of the runs; its entry is null for a line without a token. A short line is a leaf by itself."""

    def of(t: Column) -> Column:
        n = F.size(t)
        leaf = F.xxhash64(n, F.when(n < min_tokens, t).otherwise(F.slice(t, 1, depth)))
        runs = F.array(*[F.hash(F.slice(t, _edge(n, k, depth) + 1, _edge(n, k + 1, depth) - _edge(n, k, depth))) for k in range(SEGMENTS)])
        return F.when(t[0] != "", F.struct(n.alias("n"), leaf.alias("leaf"), runs.alias("runs")))

    return F.transform(F.array(F.split(masked(line), " ")), of)


def _whole() -> Column:
    """The hash of a parsed line: the leaf's and the runs' by exclusive or, so that a run is taken out by the same."""
    whole = F.xxhash64("leaf")
    for k in range(SEGMENTS):
        whole = whole.bitwiseXOR(F.xxhash64(F.get("runs", k), F.lit(k)))
    return whole


def _keyed(lines: DataFrame, extra: list[str], *, depth: int) -> DataFrame:
    """``extra`` and key of each template with variables that a parsed line (n, runs, whole) may be of.

    Pairs with an empty run are one template each: of such runs the first one stands for all, and the first of all is one of them.
    """
    pair = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(range(SEGMENTS), 2)]))
    rows = lines.select(*extra, "n", "runs", "whole", F.greatest(F.col("n") - depth, F.lit(0)).alias("rest"))
    rows = rows.select("*", pair)  # one row a pair keeps the expressions small enough for generated code

    def size(k: Column) -> Column:
        return F.floor((k + 1) * F.col("rest") / SEGMENTS) - F.floor(k * F.col("rest") / SEGMENTS)

    a, b = F.col("a"), F.col("b")
    rows = rows.where((size(b) > 0) & ((a == 0) | (size(a) > 0)) & ((size(a) + size(b)) * SHARE <= F.col("n")))
    out = [F.xxhash64(F.get("runs", k), k) for k in (a, b)]
    return rows.select(*extra, F.xxhash64(F.col("whole").bitwiseXOR(out[0]).bitwiseXOR(out[1]), a, b).alias("key"))


def _matched(left: DataFrame, right: DataFrame, on: str, total: int, *, how: str) -> DataFrame:
    """``left`` joined, inner or left, with a table of one row a key and its ``weight``: broadcast up to MOST_BROADCAST rows, else hot keys alone."""
    if right.count() <= MOST_BROADCAST:
        return left.join(F.broadcast(right), on, how)
    if how == "inner":
        return attach(left, right, [on], "weight", total)
    bound = max(10_000, total // 100_000)
    hot = right.where(F.col("weight") >= bound)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col("weight") < bound), on, "left")
    return left.join(F.broadcast(hot), on).unionByName(rest)


def _holders(keys: DataFrame, key: str, *more: Column) -> DataFrame:
    """key, documents, first, weight (rows) of each key of (key, id, ...): a document counts once, reduced before it is shuffled. ``more`` are aggregates that may be taken twice."""
    names = [F.col(f"_{k}") for k in range(len(more))]
    pairs = keys.groupBy(key, "id").agg(F.count("*").alias("weight"), *[m.alias(f"_{k}") for k, m in enumerate(more)])
    return pairs.groupBy(key).agg(F.count("*").alias("documents"), F.min("id").alias("first"), F.sum("weight").alias("weight"), *[F.max(n).alias(f"_{k}") for k, n in enumerate(names)])


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, *, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """id, hash (of the text), line, n, leaf, runs of every line with a token, in a table of the shared folder: texts are parsed once."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = rows.select("id", "hash", F.posexplode(F.split("text", "\n")).alias("line", "said"))  # the text itself stays behind
    found = rows.select("id", "hash", "line", F.inline(parsed(F.col("said"), depth=depth, min_tokens=min_tokens)))  # a generator evaluates it once
    return written(found.where("n IS NOT NULL"), "lines")


def recurring_lines(parsed: DataFrame, *, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS, short_documents: int = SHORT_DOCUMENTS) -> DataFrame:
    """id, hash, line of parsed lines whose template recurs, but for those of its first document."""
    total = parsed.count()
    where, least = ["id", "hash", "line"], min(min_documents, short_documents)
    low, high, weight = F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("weight")
    leaves = parsed.groupBy("leaf").agg(low, high, weight).where((F.col("low") < F.col("high")) & (F.col("weight") >= least)).select("leaf", "weight")
    lines = written(_matched(parsed, written(leaves, "leaves"), "leaf", total, how="inner").drop("weight").withColumn("whole", _whole()), "shared")

    # lines without variables: those that recur go from all but the first document, where one of them stands for all (strong)
    need = F.when(F.col("_0") < min_tokens, short_documents).otherwise(min_documents)
    exact = written(_holders(lines, "whole", F.max("n")).where(F.col("documents") >= need).select("whole", "first", "weight"), "exact")
    marked = written(_matched(lines, exact, "whole", total, how="left").drop("weight"), "marked")
    rest = marked.where((F.col("n") >= min_tokens) & (F.col("first").isNull() | (F.col("id") == F.col("first")))).withColumn("strong", F.col("first").isNotNull()).drop("first")

    # two runs may vary, so of three groups of runs one is the same in all lines of a template: others have no partner
    groups = rest.select(*where, "strong", F.explode(F.array(*[F.xxhash64("leaf", F.lit(g), F.slice("runs", 1 + 3 * g, 3)) for g in range(3)])).alias("key"))
    met = groups.groupBy("key").agg(low, high, weight, F.max("strong").alias("strong")).where((F.col("low") < F.col("high")) & (F.col("strong") | (F.col("weight") >= min_documents))).select("key", "weight")
    some = _matched(groups.drop("strong"), written(met, "met"), "key", total, how="inner").select(*where).distinct()
    some = written(rest.join(some, where, "left_semi"), "candidates")
    holders = _holders(_keyed(some, ["id", "strong"], depth=depth), "key", F.max("strong"))
    recurring = written(holders.where((F.col("documents") >= min_documents) | (F.col("_0") & (F.col("documents") > 1))).select("key", "first", "weight"), "templates")
    found = _matched(_keyed(some, where, depth=depth), recurring, "key", total, how="inner")
    return found.unionByName(marked, allowMissingColumns=True).where("id <> first").select(*where).distinct()


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, short_documents: int = SHORT_DOCUMENTS) -> DataFrame:
    """``docs`` with ``text_col`` freed of recurring lines and a column ``lines_dropped`` (long), which replaces one of that name.

    A line ends at a line feed; kept lines are joined as they stood. Null text stays null and drops nothing; a row
    with a null id is kept as it is and counts for nothing. Rows that repeat an id are one document, so lines that they
    alone share stay. An empty table gives an empty one. All other columns stay, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() != "lines_dropped"]
    (table,) = fresh(docs.columns, "dropped")
    found = recurring_lines(parsed_lines(docs, id_col, text_col, depth=depth, min_tokens=min_tokens), depth=depth, min_tokens=min_tokens, min_documents=min_documents, short_documents=short_documents)
    dropped = found.groupBy("id", "hash").agg(F.array_sort(F.collect_set("line")).alias(table)).select(F.col("id").alias(f"{table}_id"), F.col("hash").alias(f"{table}_hash"), table)
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    text = rows[f"`{text_col}`"]
    out = rows.join(dropped, (rows[f"`{id_col}`"] == dropped[f"{table}_id"]) & (F.xxhash64(text) == dropped[f"{table}_hash"]), "left")

    lines, at = F.split(text, "\n"), F.col(table)
    # a flag for each line, made from the stretches between those that are dropped: linear in the lines
    stay = F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(lines))), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))))
    rest = F.transform(F.array(F.struct(lines.alias("lines"), stay.alias("stay"))), lambda x: F.filter(x["lines"], lambda _, i: F.get(x["stay"], i)))[0]
    new = F.when(F.col(table).isNull(), text).otherwise(F.array_join(rest, "\n"))
    n = F.coalesce(F.size(table), F.lit(0)).cast("long")
    return out.select(*[new.alias(c) if c == text_col else rows[f"`{c}`"] for c in names], n.alias("lines_dropped"))


#: The same templates by their tokens as text.
ORACLE = r"""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i) WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, string_split(regexp_replace(trim(regexp_replace(line, '[\x09-\x0D ]+', ' ', 'g'), ' '), '\S*[0-9]\S*', '<*>', 'g'), ' ') AS t FROM l),
n AS (SELECT doc_id, i, t, len(t) AS n, greatest(len(t) - 2, 0) AS r FROM t WHERE t[1] <> ''),
p AS (SELECT a, b FROM range(8) a(a), range(8) b(b) WHERE a < b),
k AS (SELECT doc_id, i, n, array_to_string(t, ' ') AS key FROM n UNION ALL
      SELECT doc_id, i, n, concat_ws(' ', a, b, array_to_string(list_transform(t, lambda x, j: CASE WHEN j - 2 > a * r // 8 AND j - 2 <= (a + 1) * r // 8 OR j - 2 > b * r // 8 AND j - 2 <= (b + 1) * r // 8 THEN '' ELSE x END), ' ')) FROM n, p
      WHERE n >= 4 AND (a + 1) * r // 8 - a * r // 8 + (b + 1) * r // 8 - b * r // 8 BETWEEN 1 AND n // 4),
h AS (SELECT n, key, min(doc_id) AS first FROM k GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= CASE WHEN n < 4 THEN 20 ELSE 3 END),
d AS (SELECT DISTINCT doc_id, i FROM k JOIN h USING (n, key) WHERE doc_id <> first),
g AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (d.i IS NULL) AS text, count(d.i) AS n FROM l LEFT JOIN d USING (doc_id, i) GROUP BY 1)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(n, 0) AS lines_dropped FROM documents o LEFT JOIN g USING (doc_id)
"""
