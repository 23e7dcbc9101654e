"""Importance resampling towards a target distribution, over hashed word runs.

A vectorised automaton over the bytes of Arrow's text buffers finds the features: a lookup table gives the class of
each byte, differences of the classes the borders of the words, and a table-driven CRC-32 advances over all words
at once, one byte a step; a run of more words goes on from where the run without its last word stopped. A feature's
bucket is its CRC modulo ``buckets``.

1. Each task counts its buckets in one array; the sums over documents and target give a gain for each bucket, so the
   driver sees ``buckets`` numbers, whatever the corpus.
2. Each document's weight is the mean of its features' gains, rounded down; Gumbel noise keyed by its id turns the
   ``percent`` highest scores into a sample without replacement.
3. Ranks need no global window: the driver sees counts of scores in bins (a score lies between bounds that follow
   from 64-bit counts, so there are at most some thousand bins), the bins that can be drawn are sorted by range, and
   a row's rank is its place in its task plus the counts of the tasks before.

Null texts and texts without words have no features and weight 0. A row with a null id takes the empty string for
it in its key and comes before the others of its score. Repeated rows count each; equal rows get ranks of their own,
in any order. Without documents or without target every gain is defined (counts of 0). Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_chunks, written

#: Scores in one bin of the histogram that bounds what is sorted.
BIN = 64
#: Words that are still being read one byte a step; fewer are finished one after another.
FEWEST = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Class of each byte: digits, letters and all bytes of characters beyond ASCII are parts of words.
_WORD = np.zeros(256, np.int8)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD[_first : _last + 1] = 1


def _crc_table() -> np.ndarray:
    """What a CRC-32 (reversed polynomial 0xEDB88320) makes of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words; ``offsets`` are the borders of the rows in ``data``."""
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = _WORD[data]
    step = np.diff(kind)
    # two words of two rows may touch: a border inside a run of word bytes ends one and starts the next
    border = np.unique(offsets[1:-1])
    border = border[(kind[border] == 1) & (kind[border + 1] == 1)]
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(border):
        starts, ends = np.union1d(starts, border), np.union1d(ends, border)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each span, all spans a byte a step; the longest go last, alone."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, state, left = starts[order], state[order], lengths[order]
    going, k = int(np.count_nonzero(left)), 0
    while going > FEWEST:
        now = state[:going]
        state[:going] = _CRC[(now ^ data[at[:going] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        k += 1
        going = int(np.searchsorted(-left, -k, "left"))
    for j in range(going):  # few spans are left, maybe very long ones
        rest = data[at[j] + k : at[j] + left[j]].tobytes()
        state[j] = zlib.crc32(rest, int(state[j] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all runs of one to ``longest`` words, and the words of each row."""
    starts, ends, rows = words(data, offsets)
    data = _LOWER[data]
    state = advance(np.full(len(starts), _ONES), data, starts, ends)
    found = [(rows, state)]
    for k in range(1, longest):
        # the run from word i that has k words goes on over a space and word i + k
        there = np.flatnonzero(rows[k:] == rows[: len(rows) - k]) if len(rows) > k else np.zeros(0, np.int64)
        state = state[: len(rows) - k][there] if k == 1 else state[np.searchsorted(last, there)]
        state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = advance(state, data, starts[there + k], ends[there + k])
        last = there
        found.append((rows[there], state))
    all_rows = np.concatenate([r for r, _ in found])
    crc = np.concatenate([s for _, s in found]) ^ _ONES
    return all_rows, (crc % np.uint32(buckets)).astype(np.int64), np.bincount(rows, minlength=len(offsets) - 1)


def _counts(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, "text"):
                total += np.bincount(features(data, offsets, longest, buckets)[1], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all rows of ``texts`` (text) in each bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm of each bucket's smoothed share of the target over that of the source, rounded down."""
    buckets = float(len(source))
    s_all, t_all = float(source.sum()) + buckets, float(target.sum()) + buckets
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weighed(gain: np.ndarray, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch, "text"):
                rows, bucket, n_words = features(data, offsets, longest, len(gain))
                n, order = np.bincount(rows, minlength=end - first), np.argsort(rows, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                stop = np.cumsum(n)
                weight = (sums[stop] - sums[stop - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_weighed(gain, longest), f"doc_id {kind}, n_words long, n_features long, weight long")


def noisy_score(seed: str):
    """weight plus Gumbel noise keyed by seed and id, in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible, percent: int) -> DataFrame:
    """``scored`` (a written table with doc_id and score) with ``rank`` of the drawn rows: 1 is the highest score, then the least id."""
    bins = scored.where(eligible).groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    draw = sum(r["count"] for r in bins) * percent // 100
    seen, least = 0, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if seen >= draw:
            break
        seen, least = seen + r["count"], r["bin"] * BIN
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    top = eligible & (F.col("score") >= least)
    # the row's place in its task of the sorted rows: the lower 33 bits of Spark's increasing ids
    place = F.monotonically_increasing_id()
    placed = scored.where(top).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")).withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "drawn")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    drawn = placed.join(F.broadcast(parts), "part").withColumn("rank", F.when(rank <= draw, rank)).drop("part", "place", "before")
    return scored.where(~top).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``target`` (text) is the distribution to come near; the drawn rows are those with a rank: of the documents with
    ``least_words`` words or more, ``percent`` in a hundred.
    """
    if longest < 1 or not 0 < buckets < 1 << 32:
        raise ValueError("longest must be 1 or more, buckets between 1 and 2^32")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = written(weights(docs, gain, longest).withColumn("score", noisy_score(seed)), "scored")
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: For runs of one word, 10,000 buckets, 10 percent, 20 words.
ORACLE = r"""
WITH bytes AS (SELECT i, list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) AS x FROM range(256) t(i)),
crc AS (SELECT list(x ORDER BY i) AS entries FROM bytes),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
aims AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark),
seen AS (SELECT r, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM docs),
aimed AS (SELECT translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM aims),
distinct_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM seen UNION SELECT word FROM aimed)),
hashed AS (
    SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
        lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM distinct_words, crc),
s AS (SELECT bucket, count(*) AS n FROM seen JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aimed JOIN hashed USING (word) GROUP BY bucket),
gain AS (
    SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM seen) + 10000.0::DOUBLE)
        / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM aimed) + 10000.0::DOUBLE))))::BIGINT AS gain
    FROM range(10000) g(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
sums AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM seen JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (
    SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM docs LEFT JOIN sums USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, sum((n_features >= 20)::INT) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
    CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place::BIGINT END AS rank
FROM ordered
"""
