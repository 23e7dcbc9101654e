"""Benchmark passages in documents, up to an edit distance: pigeonhole pieces, then Myers' bit-parallel check.

An item of n characters may be hit with at most e = n // ERROR_SHARE edits. Split into e + 1 pieces, one piece at
least must stand unchanged in any text that holds the item within e edits. An Aho-Corasick automaton finds the
pieces of all items in one pass over a text; each hit gives the window where the item would lie, and Myers'
algorithm finds its least distance there. Letters are compared in lower case and runs of white space are one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One edit for so many characters of an item.
ERROR_SHARE = 20
#: Bytes of benchmark text that may be shipped to every worker; a larger benchmark is matched in blocks of this size.
BLOCK_BYTES = 16 << 20

_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "distance", "end")])


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    size, more = divmod(len(item), errors + 1)
    out, at = [], 0
    for k in range(errors + 1):
        n = size + (k < more)
        out.append((at, item[at : at + n]))
        at += n
    return out


class Myers:
    """Least edit distance of a pattern to any substring of a text, by words of as many bits as the pattern is long."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.mask, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.eq: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first least match."""
        plus, minus, score, mask, top, get = self.mask, 0, self.n, self.mask, self.top, self.eq.get
        least, end = score, 0
        for at, c in enumerate(text):
            eq = get(c, 0)
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(h | plus) & mask, plus & h
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & mask, down << 1 & mask
            plus, minus = (down | ~(v | up)) & mask, up & v
            if score < least:
                least, end = score, at + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.errors = [len(t) // ERROR_SHARE for _, t in self.items]
        self.myers: dict[int, Myers] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces_of(t, self.errors[k]):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item number: (distance, end) for all items within their error budget."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return found
        tried: set[tuple[int, int]] = set()
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                if found.get(k, (1, 0))[0] == 0:
                    continue
                begin = end + 1 - n - at
                if (k, begin) in tried:  # another piece of the item at the same place
                    continue
                tried.add((k, begin))
                e, size = self.errors[k], len(self.items[k][1])
                low = max(0, begin - e)
                myers = self.myers.get(k) or self.myers.setdefault(k, Myers(self.items[k][1]))
                distance, stop = myers.best(text[low : begin + size + e])
                if distance <= e and distance < found.get(k, (e + 1, 0))[0]:
                    found[k] = (distance, low + stop)
        return found


def _scan(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (distance, end) in matcher.find(normalise(text.as_py())).items():
                    rows.append((doc_id, matcher.items[k][0], distance, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=_FOUND.names)

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in runs of about BLOCK_BYTES of text, so that what a worker holds has a bound."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end: each benchmark item that a document holds within the item's error budget.

    ``distance`` is the least found, ``end`` where that match ends in the normalised text. Null and empty texts and
    items match nothing. Rows that repeat an id give their rows again. The documents are scanned once for each
    block of the benchmark.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(_scan(block), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (all their columns) that hold no benchmark item: one pass, without a join."""
    names = docs.columns
    out = docs
    for block in blocks(benchmark, "item_id", "text"):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            at = names.index(text_col)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normalise(t.as_py())) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
