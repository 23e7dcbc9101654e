"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

A text is cut at special strings and then into pieces by the tokenizer's pattern. A piece starts as its bytes, a
linked list of symbols; a heap holds the rank of each adjacent pair that has a merge. The lowest rank (the leftmost of
equal ones) is popped again and again, its right symbol leaves the list and the two pairs around it are pushed. A
piece has as many tokens as it has bytes, less the merges. Pieces come again and again, so a worker remembers the
counts of short ones up to a bound.

Each text is counted where it stands: there is no shuffle, and a lost executor costs its own tasks only.

Null texts count as empty: 0 bytes, 0 tokens. Rows that are repeated, have equal ids or a null id each give a row.
Very long texts and pieces take memory and time in proportion to their length (times its logarithm). An empty table
gives none. Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts a worker remembers at most, and the characters of the longest of them.
REMEMBERED = 1_000_000
REMEMBERED_CHARS = 64
#: Bits of a heap entry for the place in the piece; the rank stands above them.
_PLACE = 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class TokenCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or splitter.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path}: BPE options that change the merges")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that look at what stands around them")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = regex.compile(PATTERN).findall
        self.library_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

        number = model["vocab"]
        self.first_symbols = [number[s] for s in byte_symbols()]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = [number[a] for a, _ in merges]
        self.right = [number[b] for _, b in merges]
        self.made = [number[a + b] for a, b in merges]
        # of a pair that is listed twice the later line holds, as in the library
        self.rank = {pair: k for k, pair in enumerate(zip(self.left, self.right, strict=True))}
        self.known = _Known(self)
        #: Characters met so far that Unicode's tables have: on others the pattern's classes may differ from the library's.
        self.assigned: set[str] = set()

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left of a piece; ``symbols`` is used up."""
        n, rank, left, right, made = len(symbols), self.rank.get, self.left, self.right, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << _PLACE | k for k in range(n - 1) if (r := rank((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        merges, place = 0, (1 << _PLACE) - 1
        while heap:
            entry = heapq.heappop(heap)
            r, k = entry >> _PLACE, entry & place
            if symbols[k] != left[r] or (j := after[k]) == n or symbols[j] != right[r]:
                continue  # a symbol of this pair has been merged meanwhile
            merges += 1
            symbols[k], symbols[j], after[k] = made[r], -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((symbols[k], symbols[after[k]]))) is not None:
                    heapq.heappush(heap, r << _PLACE | k)
            if (i := before[k]) >= 0 and (r := rank((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, r << _PLACE | i)
        return n - merges

    def piece(self, piece: str) -> int:
        return self.merged([self.first_symbols[b] for b in piece.encode()])

    def pieces(self, text: str) -> list[str]:
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return [text[a:b] for _, (a, b) in self.library_split(text)]
        self.assigned |= new
        return self.split(text)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.known.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, self.pieces(part))) for part in parts)


class _Known(dict):
    """Counts of pieces: what is not there is counted, and kept if it is short."""

    def __init__(self, counter: TokenCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self.counter.piece(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@functools.cache
def _counter(path: str) -> TokenCounter:
    """One counter for each file and worker process."""
    return TokenCounter(path)


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path).count
        for batch in batches:
            texts = batch.column(1)
            n = np.fromiter((count(t.as_py() or "") for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of the vocabulary on every worker. Special strings in a text are one token each.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
