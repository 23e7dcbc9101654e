"""Ranked lexical search: a blocked sparse product of item-term multiplicities and term-document impacts.

``Items`` (the stated queries) are cut into blocks of about ``BLOCK_TERMS`` entries (item, term, multiplicity) by a hash
of their id; a block is what a worker holds of them. For each block of items

1. every document is read once: its terms that the block has become one sparse row (term numbers and frequencies) of a
   written table, beside its number of terms;
2. document frequencies are counted in arrays by task and summed, so the driver sees one number for each term of the block;
3. each task takes blocks of about ``BLOCK_CELLS`` entries of that table, turns them by term, and gets each item's row of the
   product by Gustavson's method: the term-document rows of the item's terms, times their multiplicity, are merged by adding
   them into one array over the block's documents. Impacts and sums are 64-bit integers.
4. Only what can be among an item's ``k`` best of the task so far is kept, and a task's best meet those of the others by slices
   of the document ids first, so that no task of the last step reads more than ``SLICES`` times k rows of an item.

With documents of 10^10 and a benchmark of some hundred items there is one block; more items mean more blocks, each with
one scan of the texts.

Null and empty texts have no terms: as documents they don't count and are not found, as items they find nothing. Equal rows of
``items`` are one item, different texts with one id together are one item's text, and items without an id are left out. Each row of ``docs`` is a
document of its own, repeated or not; equal scores are ordered by id, rows without an id behind the others. Other columns, whatever their names, are
not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Entries of a block of items, and of a block of documents in a task.
BLOCK_TERMS = 1 << 20
BLOCK_CELLS = 1 << 22
#: Bytes of a text that are cut into terms at once.
TEXT_BYTES = 1 << 20
#: Slices of the document ids in which an item's candidates meet first.
SLICES = 64

#: ASCII digits and letters and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
_TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")

_MATRIX = "doc_id long, n long, terms array<int>, counts array<int>"
_HITS = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all terms of ``items`` (item_id, text)."""
    lower = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    terms = F.regexp_extract_all(lower, F.lit(_TERM_PATTERN), F.lit(0))
    rows = items.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    return rows.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).cast("long").alias("times"))


class ItemBlock:
    """Item-term multiplicities of one block by item, with terms numbered from 0."""

    def __init__(self, rows: list):
        self.items = list(dict.fromkeys(r["item_id"] for r in rows))
        self.numbers = {t: k for k, t in enumerate(dict.fromkeys(r["term"].encode() for r in rows))}
        number = {x: k for k, x in enumerate(self.items)}
        row = np.fromiter((number[r["item_id"]] for r in rows), np.int64, len(rows))
        order = np.argsort(row, kind="stable")
        self.terms = np.fromiter((self.numbers[r["term"].encode()] for r in rows), np.int64, len(rows))[order]
        self.times = np.fromiter((r["times"] for r in rows), np.int64, len(rows))[order]
        self.first = np.searchsorted(row[order], np.arange(len(self.items) + 1))


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``TEXT_BYTES``, cut where no term is."""
    at = 0
    while len(text) - at > TEXT_BYTES:
        found = _BREAK.search(text, at + TEXT_BYTES)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _term_rows(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ints = numbers.get, pa.list_(pa.int32())
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1):
                total, found = 0, Counter()
                for part in _parts(text.as_py() or b""):
                    words = _TERM.findall(part.lower())  # of bytes: A-Z only
                    total += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                n.append(total)
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, ints), pa.array(counts, ints)], ["doc_id", "n", "terms", "counts"])

    return run


def _frequencies(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["term", "df"])

    return run


class Best:
    """The best ``k`` documents of each item so far: score descending, then id ascending, rows without an id last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        empty = np.zeros(0, np.int64)
        self.rows = [(empty, empty, empty)] * n_items  # scores, ids, whether an id is missing
        self.least = np.ones(n_items, np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least[item])
        if not len(some):
            return
        if len(some) > self.k:  # nothing below the block's own k-th score; what equals it competes by id
            own = scores[some]
            some = some[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
        s, d, m = (np.concatenate([a, b[some]]) for a, b in zip(self.rows[item], (scores, ids, missing), strict=True))
        order = np.lexsort((d, m, -s))[: self.k]
        self.rows[item] = s[order], d[order], m[order]
        if len(order) == self.k:
            self.least[item] = s[order[-1]]


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Runs of batches with about ``cells`` entries together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(2).flatten())
        if n >= cells:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if sum(len(b) for b in held):
        yield pa.Table.from_batches([b for b in held if len(b)]).combine_chunks().to_batches()[0]


def _product(block: ItemBlock, weight: np.ndarray, n_docs: int, all_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    first, item_term, times = block.first, block.terms, block.times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(first) - 1, k)
        for rows in _blocks(batches, BLOCK_CELLS):
            missing = rows.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = rows.column(0).fill_null(0).to_numpy()
            length = 25 + (75 * rows.column(1).to_numpy() * n_docs) // all_terms
            doc = np.repeat(np.arange(len(rows)), rows.column(2).value_lengths().to_numpy())
            term, tf = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
            by_term = np.argsort(term, kind="stable")
            doc, impact = doc[by_term], impact[by_term]
            start = np.searchsorted(term[by_term], np.arange(len(weight) + 1))
            for item in range(len(first) - 1):
                row = np.zeros(len(rows), np.int64)
                for entry in range(first[item], first[item + 1]):
                    part = slice(start[item_term[entry]], start[item_term[entry] + 1])
                    row[doc[part]] += times[entry] * impact[part]  # a document has each term once: no index comes twice
                best.add(item, row, ids, missing)
        for item, (scores, ids, missing) in enumerate(best.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item, np.int32)), pa.array(ids, mask=missing == 1), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _top(rows: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id long, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    wanted = written(item_terms(items), "items")
    n_blocks = -(-wanted.count() // BLOCK_TERMS)
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), *_HITS.fields[1:]]))
    for b in range(n_blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        block = ItemBlock(mine.collect())  # about BLOCK_TERMS rows
        if not block.items:
            continue
        matrix = written(texts.mapInArrow(_term_rows(block.numbers), _MATRIX).where("n > 0"), "terms")
        n_docs, all_terms = matrix.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.numbers), np.int64)
        for r in matrix.select("terms").mapInArrow(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        hits = matrix.where(F.size("terms") > 0).mapInArrow(_product(block, weight, n_docs, all_terms, k), _HITS)
        sliced = _top(hits, k, "item", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
        names = spark.createDataFrame(list(enumerate(block.items)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        found = _top(sliced.drop("rank"), k, "item").join(F.broadcast(names), "item")
        out = out.unionByName(written(found.select("item_id", "rank", "doc_id", "score"), "found"))
    return out


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
lengths AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
    SELECT item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
    GROUP BY item_id, term),
impacts AS (
    SELECT r, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))) AS impact
    FROM tf JOIN df USING (term) JOIN lengths USING (r), totals),
scored AS (SELECT item_id, r, sum(times * impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, r),
ordered AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN lengths USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ordered WHERE rank <= 10
"""
