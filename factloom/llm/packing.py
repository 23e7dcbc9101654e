"""Sequence packing: combinations of lengths that fill a window, repeat counts by non-negative least squares.

Each document becomes token ids and an end id; whole windows are cut off it and the remainder is one more piece.
What has to be packed is then a histogram over at most ``window`` lengths, which is all that the driver sees:

1. lengths are rounded up to one of 512 units; every combination of at most three units that fills the window
   exactly is a column, and repeat counts >= 0 that come nearest to the histogram are found by accelerated
   projected gradients and rounded down;
2. the rest is packed greedily, largest first, a pattern at a time and as often as the counts allow.

The plan is a list of runs (length, first rank, count, sequence, offset), bounded by the window, not by the corpus.
A piece finds its place by its rank among the pieces of its length: a rank within its task plus the sum of the
counts of the tasks before.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import text_chunks, written
from .words import lower_hashes, word_spans

#: Words that a worker remembers at most; beyond it forgets them all and starts anew.
CACHE_WORDS = 2_000_000
UNITS = 512

_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank")])
_PLACED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of words, remembered: this tokenizer drops white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids("Ab, c.D e.") != [x for part in ("ab", ",", "C.d", "\n E", ".") for x in ids(part)]:
            raise ValueError(f"{path}: ids of words do not make up those of a text, or depend on the case")
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.words, self.used = np.zeros(1 << 16, np.int64), 0, 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: encoded as one text, told apart by where each id stands in it."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = np.searchsorted(ends, np.array([a for a, _ in found.offsets], np.int64), "right")
        return np.array(found.ids, np.int64), np.bincount(at, minlength=len(words))

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, counts = self.encode(words)
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.insert(self.first, place, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, place, counts)
        self.used += total

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end_id``, and the row offsets."""
        starts, lengths, rows = _parts(data, *word_spans(data, offsets))
        n = len(offsets) - 1
        keys = lower_hashes(data, starts, lengths)
        # the one thing that case changes is a special token's string
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for k in np.unique(np.searchsorted(starts, marks, "right") - 1).tolist():
            keys[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : starts[k] + lengths[k]].tobytes(), digest_size=8).digest(), "little")
        hashes, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        if len(hashes):
            place = np.searchsorted(self.keys, hashes)
            known = np.zeros(len(hashes), bool)
            inner = place < len(self.keys)
            known[inner] = self.keys[place[inner]] == hashes[inner]
            if not known.all():
                raw = data.tobytes()
                new = at[~known]
                self.learn(hashes[~known], [raw[a : a + b].decode() for a, b in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
        place = np.searchsorted(self.keys, hashes)
        first, count = self.first[place][inverse], self.count[place][inverse]
        tokens = np.bincount(rows, weights=count, minlength=n).astype(np.int64) + 1 if len(rows) else np.ones(n, np.int64)
        ends = np.concatenate([[0], np.cumsum(tokens)])
        out = np.full(ends[-1], end_id, "<u4")
        total = int(count.sum())
        source = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
        out[np.arange(total) + np.repeat(rows, count)] = self.flat[source]
        return out, ends


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _parts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one last stop behind an ASCII letter or digit as a word of its own: it never shares a token with that."""
    last = starts + lengths - 1
    at = np.flatnonzero((lengths > 1) & _STOP[data[last]] & _ALNUM[data[np.maximum(last - 1, 0)]])
    lengths = lengths.copy()
    lengths[at] -= 1
    return np.insert(starts, at + 1, last[at]), np.insert(lengths, at + 1, 1), np.insert(rows, at + 1, rows[at])


_tokens: dict[str, WordTokens] = {}


def _pieces(find_tokenizer: Callable[[], str], window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = find_tokenizer()
        encoder = _tokens.setdefault(path, None) or _tokens.__setitem__(path, WordTokens(path)) or _tokens[path]
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            ids_of = batch.column(0)
            for first, end, data, offsets in text_chunks(batch, "text"):
                ids, ends = encoder.ids(data, offsets, end_id)
                tokens = np.diff(ends)
                per = -(-tokens // window)
                row = np.repeat(np.arange(end - first), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * window
                length = np.minimum(window, tokens[row] - start)
                crc = np.fromiter((zlib.crc32(ids[a : a + b]) for a, b in zip((ends[row] + start).tolist(), length.tolist(), strict=True)), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=window + 1)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(seen, runs)
                seen += runs
                columns = [ids_of.take(pa.array(row + first)), start, length, crc, tokens[row], np.full(len(row), task), rank]
                yield pa.RecordBatch.from_arrays([c if k == 0 else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names=_PIECES.names)

    return run


def combinations(units: int) -> np.ndarray:
    """All (a >= b >= c >= 0) with a + b + c = units."""
    c, b = np.meshgrid(np.arange(units + 1), np.arange(units + 1), indexing="ij")
    a = units - b - c
    fit = (a >= b) & (b >= c)
    return np.stack([a[fit], b[fit], c[fit]], 1)


def repeat_counts(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Counts x >= 0 of the columns that minimise the squared distance of their lengths' sums to the histogram."""
    size = len(histogram)

    def lengths(x):
        out = sum(np.bincount(columns[:, k], weights=x, minlength=size) for k in range(columns.shape[1]))
        out[0] = 0
        return out

    def back(r):
        r = np.concatenate([[0.0], r[1:]])
        return r[columns].sum(1)

    norm, v = 1.0, np.ones(len(columns))
    for _ in range(30):  # largest eigenvalue, for the step
        v = back(lengths(v))
        norm = np.linalg.norm(v)
        if not norm:
            return v
        v /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0.0, y - back(lengths(y) - histogram) / (1.05 * norm))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / t_after * (after - x), after, t_after
    return x


def plan(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, offset) that place every piece once."""
    left = histogram.astype(np.int64).copy()
    given = np.zeros(window + 1, np.int64)
    runs: list[tuple[int, ...]] = []
    sequences = 0

    def place(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, each in parts:
            runs.append((length, int(given[length]), times * each, each, sequences, offset))
            given[length] += times * each
            left[length] -= times * each
            offset += length * each
        sequences += times

    if left[window]:
        place([(window, 1)], int(left[window]))
    unit = -(-window // UNITS)
    units = window // unit
    columns = combinations(units)
    of_unit = np.minimum(units, -(-np.arange(window + 1) // unit))
    coarse = np.bincount(of_unit, weights=left, minlength=units + 1)
    columns = columns[((coarse[columns] > 0) | (columns == 0)).all(1) & (columns[:, 0] < units)]
    if len(columns):
        counts = np.floor(repeat_counts(columns, coarse)).astype(np.int64)
        within = [np.flatnonzero(of_unit == u)[::-1] for u in range(units + 1)]
        for k in np.argsort(-counts, kind="stable"):
            todo = int(counts[k])
            while todo > 0:  # as long as each unit has a length left
                parts: dict[int, int] = {}
                for u in columns[k][columns[k] > 0]:
                    length = next((int(x) for x in within[u] if x and left[x] > parts.get(int(x), 0)), 0)
                    if not length:
                        break
                    parts[length] = parts.get(length, 0) + 1
                else:
                    times = min(todo, *(int(left[x]) // n for x, n in parts.items()))
                    place(list(parts.items()), times)
                    todo -= times
                    continue
                break
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > 0]
    while len(lengths):
        room, top, parts = window, len(lengths), []
        while room and (top := int(np.searchsorted(lengths[:top], room, "right"))):
            length = int(lengths[top - 1])
            each = min(int(left[length]), room // length)
            parts.append((length, each))
            room -= each * length
            top -= 1
        place(parts, min(int(left[x]) // n for x, n in parts))
        lengths = lengths[left[lengths] > 0]
    return np.array(runs, np.int64).reshape(-1, 6)


def _placed(runs: np.ndarray):
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("length", "rank"))
            found = runs[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 4] + nth // found[:, 3]), pa.array(found[:, 5] + nth % found[:, 3] * length)], names=_PLACED.names)

    return run


def pack(docs: DataFrame, *, window: int = 4096, end_id: int = 2, tokenizer: Callable[[], str] = default_tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of a document.

    ``tokenizer`` finds the tokenizer's file on the executor. A null text is empty and gives the end id alone; a
    null id stays null. Rows with equal ids are separate documents. An empty table gives no pieces. The text of a
    row is tokenised whole; a text longer than a window is cut at its multiples.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(texts.mapInArrow(_pieces(tokenizer, window, end_id), _PIECES), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["length"]] = row["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_placed(plan(histogram, window)), _PLACED)
