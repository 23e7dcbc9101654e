"""Interpolated modified Kneser-Ney model of any order: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are 64-bit hashes; a word's id is its rank in the sorted vocabulary. Counts travel as compressed blocks of
sorted arrays, one for each task and range, not as rows:

1. each task counts its words; ranges of hashes are merged to the vocabulary (hash, count);
2. each task counts its grams of ``order`` words; they go to ranges of the last but one word with about equal numbers
   of tokens. All shorter grams that end in the same two words, and all contexts that end in that one, lie in the same
   range, so it has all levels from ``order`` down to pairs whole: the grams with their counts (of distinct words to
   the left, below the highest level) and the totals of each context. A word with more tokens than a range is split
   by the word that follows it; only the totals of its contexts are then partial and added up in ranges of their own;
3. the ranges give for each word the number of words it follows, merged by ranges of words.

All arrays are files in the shared folder. A gram's key is a hash of 48 bits, made anew with another seed where two of a
range meet, so that a range is exact and an unseen gram is taken for a seen one with a chance of 1e-8. A worker maps
the arrays and searches them, with a bound on what it has mapped, so its memory does not grow with the model. The
driver sees sums and the ranges' borders.

Probabilities: P(w|c) = max(n(cw) - D, 0) / n(c) + g(c) P(w|c'), where c' is c without its first word, n counts
occurrences at the highest level and distinct left neighbours below, D is one of three discounts of the level by the
count (1, 2, 3 or more) and g(c) is what the discounts leave. Below the words is the uniform distribution with one more
word. A text starts after ``order`` - 1 starts, which are no words, and has an end, which is one.
"""

from __future__ import annotations

import io
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, scratch_path, text_chunks
from .words import mix, word_hashes

#: Words of the longest gram.
ORDER = 3
#: The end of a text, as a word.
END = np.uint64(0xE11D_0F7E_C7ED_0C5A)
#: Entries that a task merges at most before it hands them on; tokens of a range of grams; characters of text for a range of words.
BUFFER = 3_000_000
RANGE_TOKENS = 3_000_000
WORD_RANGE_CHARS = 1 << 28
#: Bytes of arrays that a worker has mapped (or, from a store without local paths, read) at once.
MAPPED_BYTES = 384 << 20
#: Bytes of text that are looked up together: the more, the fewer rounds over the arrays.
TEXT_BYTES = 8 << 20
#: Ids are packed two to 64 bits at worst, so a vocabulary may have no more words.
MOST_WORDS = 2**32 - 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.BinaryType())])
_SUMMARY = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("numbers", T.ArrayType(T.LongType()))])
_SUMMARY_ARROW = pa.schema([("part", pa.int64()), ("block", pa.binary()), ("numbers", pa.list_(pa.int64()))])


def _summary(rows: list[tuple[int, bytes | None, list[int] | None]]) -> pa.Table:
    return pa.table({n: [r[k] for r in rows] for k, n in enumerate(_SUMMARY.names)}, schema=_SUMMARY_ARROW)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first (sorted) as differences, byte by byte of all of them, compressed."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.zeros(1, np.uint64))
    wide = np.concatenate([c.astype("<u8").view(np.uint8).reshape(-1, 8).T for c in (first, *columns[1:])])
    used = wide.any(1)
    data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide[used]).tobytes())
    return len(first).to_bytes(8, "little") + len(columns).to_bytes(1, "little") + np.packbits(used).tobytes() + data


def _unpacked(block: bytes) -> list[np.ndarray]:
    n, columns = int.from_bytes(block[:8], "little"), block[8]
    used = np.unpackbits(np.frombuffer(block[9 : 9 + columns], np.uint8)).astype(bool)
    wide = np.zeros((8 * columns, n), np.uint8)
    wide[used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[9 + columns :]), np.uint8).reshape(-1, n)
    out = [np.ascontiguousarray(wide[8 * k : 8 * k + 8].T).view("<u8").reshape(-1) for k in range(columns)]
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys (rows of the key columns), sorted, with their sums."""
    if not len(keys[0]):
        return keys, sums
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(s[order], first) for s in sums]


class _Counter:
    """Counts of keys, merged whenever the buffer is full."""

    def __init__(self) -> None:
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, keys: list[np.ndarray], counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(counts)

    def merge(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.uint64)], np.zeros(0, np.int64)
        joined = [np.concatenate(c) for c in zip(*(p[0] for p in self.parts), strict=True)]
        counts = np.concatenate([p[1] for p in self.parts])
        self.parts.clear()
        keys, (counts,) = _merged(joined, [counts])
        self.parts, self.size = [(keys, counts)], len(counts)
        return keys, counts

    def full(self) -> bool:
        """True if it is still nearly full after merging."""
        if self.size < BUFFER:
            return False
        self.merge()
        return self.size > BUFFER * 2 // 3

    def clear(self) -> None:
        self.parts, self.size = [], 0


def _handed(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A batch for each run of ``part`` (sorted)."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), pa.array([_packed([c[a:b] for c in columns])], pa.binary())], names=_BLOCK.names)


def _blocks_of(table: pa.Table, sums: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Merged content of the blocks of one range, whose last ``sums`` columns are added up."""
    parts = [_unpacked(b.as_py()) for b in table.column("block")]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return _merged(columns[:-sums], [c.astype(np.int64) for c in columns[-sums:]])


def _save(path: str, name: str, array: np.ndarray) -> None:
    """An array file in the shared folder: written aside, then moved, so that a task may run again."""
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    aside = f"{base}/.{name}-{os.getpid()}-{np.random.default_rng().integers(2**62)}"
    with store.open_output_stream(aside) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(array))
        out.write(np.ascontiguousarray(array).data)
    store.move(aside, f"{base}/{name}.npy")


def _opened(path: str, name: str) -> np.ndarray:
    """An array file: mapped, or read where the store has no local paths. Empty if there is none."""
    store, base = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        try:
            return np.load(f"{base}/{name}.npy", mmap_mode="r")
        except FileNotFoundError:
            return np.zeros(0, np.uint8)
    if store.get_file_info(f"{base}/{name}.npy").type == fs.FileType.NotFound:
        return np.zeros(0, np.uint8)
    with store.open_input_stream(f"{base}/{name}.npy") as data:
        return np.load(io.BytesIO(data.read()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Hashes of the words of each text and its end, and their rows."""
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch, "text", TEXT_BYTES):
            words, rows = word_hashes(data, offsets)
            n = end - first
            counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
            out = np.full(len(words) + n, END)
            out[np.arange(len(words)) + rows] = words
            yield batch, first, end, out, np.repeat(np.arange(n), counts + 1)


def _hash_cuts(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


@dataclass
class Model:
    """Where the arrays are and the numbers that all workers need. The ranges' borders are arrays, too."""

    path: str
    order: int = ORDER
    parts: int = 1
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    #: Three discounts of each level from 1 to ``order``.
    discounts: list[list[float]] = field(default_factory=list)
    word_share: float = 1.0
    #: Bits of a word's id.
    bits: int = 1


class Arrays:
    """The mapped arrays of a model in one worker; the least recently used go when they are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()
        self.bytes = 0
        self.hash_cuts = _hash_cuts(model.parts)
        own = lambda name, kind: np.array(_opened(model.path, name)).astype(kind)
        self.sizes, self.cuts, self.split = own("vocabulary", np.int64), own("cuts", np.uint64), own("split", np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def get(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = _opened(self.model.path, name)
            self.bytes += self.open[name].nbytes
            while self.bytes > MAPPED_BYTES and len(self.open) > 1:
                self.bytes -= self.open.popitem(last=False)[1].nbytes
        return self.open[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for words that are not in the vocabulary."""
        out = np.full(len(hashes), -1, np.int64)
        edges = np.concatenate([[0], np.searchsorted(hashes, self.hash_cuts), [len(hashes)]])
        for part in np.flatnonzero(np.diff(edges)):
            if self.model.words and self.sizes[part]:
                known, asked = self.get(f"word-{part}"), hashes[edges[part] : edges[part + 1]]
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                out[edges[part] : edges[part + 1]] = np.where(known[at] == asked, at + self.offsets[part], -1)
        return out

    def of_words(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array of the vocabulary, 0 for unknown words."""
        out = np.zeros(len(ids), np.int64)
        part = np.searchsorted(self.offsets, ids, "right") - 1
        for p in np.unique(part[ids >= 0]):
            here = (part == p) & (ids >= 0)
            out[here] = self.get(f"{kind}-{p}")[ids[here] - self.offsets[p]]
        return out

    def found(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """Places of 64-bit keys in one sorted hash array, -1 for those that are not there."""
        out = np.full(len(keys), -1, np.int64)
        high = self.get(f"{kind}-high")
        if not len(high):
            return out
        low = self.get(f"{kind}-low")
        short = _short(keys, int(self.get(f"{kind}-seed")[0]))
        top, rest = (short >> np.uint64(16)).astype(np.uint32), (short & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.argsort(top)  # neighbours in the array are asked for together
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(high, top[order])
        todo = np.flatnonzero(at < len(high))
        while len(todo):  # a run of equal upper halves is nearly always one long
            todo = todo[high[at[todo]] == top[todo]]
            hit = low[at[todo]] == rest[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < len(high)]
        return out

    def of_grams(self, level: int, part: int, keys: np.ndarray) -> np.ndarray:
        """Counts of grams of one range by their 64-bit keys."""
        out = np.zeros(len(keys), np.int64)
        at = self.found(f"gram-{level}-{part}", keys)
        some = np.flatnonzero(at >= 0)
        if len(some):
            out[some] = self.get(f"times-{level}-{part}")[at[some]]
            large = some[out[some] == 255]
            if len(large):
                place = np.searchsorted(self.get(f"large-{level}-{part}"), at[large])
                out[large] = self.get(f"largetimes-{level}-{part}")[place]
        return out

    def of_contexts(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Rows (tokens, words once, twice, more often) of contexts; zeros for those that are not stored."""
        out = np.zeros((len(keys), 4), np.int64)
        at = self.found(name, keys)
        some = at >= 0
        if some.any():
            out[some] = self.get(f"{name}-totals")[at[some]]
        return out


_arrays: dict[str, Arrays] = {}


def _arrays_of(model: Model) -> Arrays:
    """The worker's arrays of a model at one stage of its making."""
    key = f"{model.path} {model.words} {len(model.discounts)}"
    if key not in _arrays:
        _arrays.clear()
        _arrays[key] = Arrays(model)
    return _arrays[key]


def _discounts(n: np.ndarray) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(v) for v in n[:4])
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.01), k - 0.01) for d, k in zip(found, (1, 2, 3), strict=True)]


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, cuts = _Counter(), _hash_cuts(parts)

        def hand() -> Iterator[pa.RecordBatch]:
            (keys,), counts = counter.merge()
            yield from _handed(np.searchsorted(cuts, keys, "right"), [keys, counts])
            counter.clear()

        for _, _, _, words, _ in _texts(batches):
            keys, counts = np.unique(words, return_counts=True)
            counter.add([keys], counts)
            if counter.full():
                yield from hand()
        yield from hand()

    return run


def _merge_words(path: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        (keys,), (counts,) = _blocks_of(table, 1)
        _save(path, f"word-{part}", keys)
        _save(path, f"seen-{part}", counts)
        # where the range passes each 64th of its tokens, and its words with more than that: (local id, tokens before)
        before = np.cumsum(counts) - counts
        step = max(1, int(counts.sum()) // 64)
        at = np.unique(np.concatenate([np.searchsorted(before, np.arange(1, 64) * step), np.flatnonzero(counts > step), np.flatnonzero(counts > step) + 1]))
        at = at[at < len(keys)]
        end = np.flatnonzero(keys == END)
        return _summary([(part, None, [len(keys), int(counts.sum()), int(counts[end].sum()), *np.stack([at, before[at]], 1).reshape(-1).tolist()])])

    return run


def _grams_of(arrays: Arrays, words: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The words of each token's gram by id: the one before it, itself, then those further to the left. A start is the id after all words."""
    hashes, inverse = np.unique(words, return_inverse=True)
    ids = arrays.ids(hashes)[inverse]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))

    def before(n: int) -> np.ndarray:
        out = np.full(len(ids), arrays.model.words, np.int64)
        out[n:] = np.where(place[n:] >= n, ids[:-n], arrays.model.words)[: max(0, len(ids) - n)]
        return out

    return [before(1), ids, *(before(n) for n in range(2, arrays.model.order))]


def _together(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Ids packed into as few 64-bit columns as hold them, in order."""
    per = 64 // bits
    out = []
    for k in range(0, len(words), per):
        column = np.zeros(len(words[0]), np.uint64)
        for w in words[k : k + per]:
            column = column << np.uint64(bits) | w.astype(np.uint64)
        out.append(column)
    return out


def _apart(columns: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    per, out = 64 // bits, []
    for k, column in enumerate(columns):
        here = min(per, n - k * per)
        out += [((column >> np.uint64(bits * (here - 1 - j))) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(here)]
    return out


def _range_of(cuts: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), "right")


def _count_grams(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, counter = _arrays_of(model), _Counter()

        def hand() -> Iterator[pa.RecordBatch]:
            keys, counts = counter.merge()
            if len(counts):
                words = _apart(keys, model.order, model.bits)
                yield from _handed(_range_of(arrays.cuts, words[0], words[1]), [*keys, counts])
            counter.clear()

        for _, _, _, words, rows in _texts(batches):
            keys = _together(_grams_of(arrays, words, rows), model.bits)
            counter.add(keys, np.ones(len(words), np.int64))
            if counter.full():
                yield from hand()
        yield from hand()

    return run


def _chained(words: list[np.ndarray], seed: int) -> Iterator[np.ndarray]:
    """64-bit keys of the first word, the first two, and so on."""
    with np.errstate(over="ignore"):
        key = np.full(len(words[0]), seed, np.uint64)
        for w in words:
            key = mix(key * _ODD + w.astype(np.uint64) + np.uint64(1))
            yield key


def _gram_keys(words: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the grams of two words, three, and so on."""
    return list(_chained(words, 1))[1:]


def _context_keys(words: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the contexts of one word, two, and so on (the gram's second entry, its last word, is no part of them)."""
    return list(_chained([words[0], *words[2:]], 2))


def _short(keys: np.ndarray, seed: int) -> np.ndarray:
    """The upper 48 bits of the keys, mixed with a seed."""
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(seed) * _ODD) >> np.uint64(16)


def _save_hashes(path: str, kind: str, keys: np.ndarray) -> np.ndarray:
    """Stores 64-bit keys as a sorted array of 48 bits without repeats; their order."""
    for seed in range(64):
        short = _short(keys, seed)
        order = np.argsort(short)
        short = short[order]
        if not (short[1:] == short[:-1]).any():
            _save(path, f"{kind}-seed", np.array([seed]))
            _save(path, f"{kind}-high", (short >> np.uint64(16)).astype(np.uint32))
            _save(path, f"{kind}-low", (short & np.uint64(0xFFFF)).astype(np.uint16))
            return order
    raise ValueError(f"two keys of {kind} are equal: 64 bits are too few")


def _save_contexts(path: str, name: str, keys: np.ndarray, totals: np.ndarray) -> None:
    order = _save_hashes(path, name, keys)
    _save(path, f"{name}-totals", totals[order].astype(np.uint32 if not len(totals) or totals.max() < 2**32 else np.uint64))


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct context keys with tokens, words once, twice and more often."""
    found, sums = _merged([keys], [counts, (counts == 1) * 1, (counts == 2) * 1, (counts > 2) * 1])
    return found[0], np.stack(sums, 1)


def _merge_grams(model: Model):
    def run(table: pa.Table) -> pa.Table:
        arrays, part, order = _arrays_of(model), table.column("part")[0].as_py(), model.order
        keys, (times,) = _blocks_of(table, 1)
        words = _apart(keys, order, model.bits)
        new = np.concatenate([[True], (words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1])])
        starts = [new]
        for w in words[2:]:
            new = new | np.concatenate([[True], w[1:] != w[:-1]])
            starts.append(new)
        grams, contexts = _gram_keys(words), _context_keys(words)
        shared = bool(np.isin(words[0][:1], arrays.split)[0])
        numbers, out = [], []
        for level in range(2, order + 1):
            at = np.flatnonzero(starts[level - 2])
            counts = times if level == order else np.add.reduceat(starts[level - 1].astype(np.int64), at)
            numbers += [len(at), *(int((counts == k).sum()) for k in range(1, 5))]
            name = f"{level}-{part}"
            sorting = _save_hashes(model.path, f"gram-{name}", grams[level - 2][at])
            stored = counts[sorting]
            _save(model.path, f"times-{name}", np.minimum(stored, 255).astype(np.uint8))
            large = np.flatnonzero(stored > 254)
            _save(model.path, f"large-{name}", large)
            _save(model.path, f"largetimes-{name}", stored[large])
            found, totals = _totals(contexts[level - 2][at], counts)
            if shared:  # other ranges have more of these contexts
                piece = np.searchsorted(arrays.hash_cuts, found, "right")
                for p in np.unique(piece):
                    here = piece == p
                    out.append((int(model.parts + p), _packed([found[here], np.full(int(here.sum()), level), *totals[here].T]), None))
            else:
                # a longer context with one token is not stored: its words are a gram of the level below
                keep = np.ones(len(found), bool) if level == 2 else (totals[:, 0] > 1) | np.isin(found, contexts[level - 2][at][words[0][at] == model.words])
                _save_contexts(model.path, f"context-{name}", found[keep], totals[keep])
        followed, follows = np.unique(words[1][starts[0]], return_counts=True)
        edges = np.searchsorted(followed, arrays.offsets)
        for p in np.flatnonzero(np.diff(edges)):
            out.append((int(p), _packed([followed[edges[p] : edges[p + 1]], follows[edges[p] : edges[p + 1]]]), None))
        return _summary([(-1 - part % 64, None, numbers), *out])

    return run


def _merge_rest(model: Model):
    """Adds up the ranges' numbers (parts below 0), and merges words' numbers of left neighbours and contexts of split words."""

    def run(table: pa.Table) -> pa.Table:
        arrays, part = _arrays_of(model), table.column("part")[0].as_py()
        if part < 0:
            return _summary([(part, None, np.sum([n.as_py() for n in table.column("numbers")], 0).tolist())])
        if part >= model.parts:
            (keys, levels), sums = _blocks_of(table, 4)
            totals = np.stack(sums, 1)
            for level in range(2, model.order + 1):
                here = levels == level
                _save_contexts(model.path, f"shared-{level}-{part - model.parts}", keys[here], totals[here])
            return _summary([])
        (words,), (follows,) = _blocks_of(table, 1)
        out = np.zeros(arrays.sizes[part], np.uint32 if follows.max() < 2**32 else np.uint64)
        out[words.astype(np.int64) - arrays.offsets[part]] = follows
        _save(model.path, f"follows-{part}", out)
        return _summary([(part, None, [int((follows == k).sum()) for k in range(1, 5)] + [int((follows > 2).sum())])])

    return run


def _range_cuts(words: int, tokens: int, marks: list[tuple[int, int]], ranges: int) -> tuple[list[int], list[int]]:
    """First keys of all ranges of grams but the first, with about equal numbers of tokens by the marks (id, tokens before), and the words that are split."""
    cuts: list[int] = []
    split: list[int] = []
    target = max(1, tokens // ranges)
    ends = [*marks[1:], (words + 1, tokens)]
    last = 0
    for (at, before), (after, until) in zip(marks, ends, strict=True):
        if after == at + 1 and until - before > target:  # one word with more than a range: split by the words after it
            pieces = -(-(until - before) // target)
            cuts += [(at << 32) + words * k // pieces for k in range(pieces)]
            cuts.append(after << 32)
            split.append(at)
            last = until
        elif until - last >= target:
            cuts.append(after << 32)
            last = until
    return sorted({c for c in cuts if c > 0}), split


def train(texts: DataFrame, *, order: int = ORDER) -> Model:
    """The model of all rows of ``texts`` (column ``text``; null is empty). ``order`` is the words of the longest gram, 2 at least.

    Repeated rows count as often as they stand. Without a row there are no tokens, and every word is equally likely.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    texts = texts.select("text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(partitions(spark), chars // WORD_RANGE_CHARS)
    model = Model(scratch_path(spark, "ngrams"), order, parts)
    counted = texts.mapInArrow(_count_words(parts), _BLOCK).groupBy("part").applyInArrow(_merge_words(model.path), _SUMMARY)
    found = {r["part"]: r["numbers"] for r in counted.collect()}  # a row a range of words
    sizes = [found[p][0] if p in found else 0 for p in range(parts)]
    model.tokens, model.words = sum(n[1] for n in found.values()), sum(sizes)
    if model.words > MOST_WORDS:
        raise OverflowError(f"{model.words} words, ids are of 32 bits")
    if not model.tokens:
        model.discounts = [_discounts(np.zeros(4))] * order
        return model
    marks, first, tokens = [], 0, 0
    for p in sorted(found):
        marks.append((first, tokens))
        marks += [(first + a, tokens + b) for a, b in zip(found[p][3::2], found[p][4::2], strict=True) if a]
        first, tokens = first + found[p][0], tokens + found[p][1]
    starts = sum(n[2] for n in found.values())  # as many starts as ends
    cuts, split = _range_cuts(model.words, model.tokens + starts, [*marks, (model.words, model.tokens)], max(parts, model.tokens // RANGE_TOKENS))
    for name, array in (("vocabulary", np.array(sizes, np.int64)), ("cuts", np.array(cuts, np.uint64)), ("split", np.array(split, np.int64))):
        _save(model.path, name, array)
    model.bits = int(model.words + 1).bit_length()
    merged = texts.mapInArrow(_count_grams(model), _BLOCK).groupBy("part").applyInArrow(_merge_grams(model), _SUMMARY)
    rows = merged.groupBy("part").applyInArrow(_merge_rest(model), _SUMMARY).collect()  # 64 rows, and one a range of words
    counts = np.sum([r["numbers"] for r in rows if r["part"] < 0], 0).reshape(order - 1, 5)
    words = np.sum([r["numbers"] for r in rows if r["part"] >= 0], 0)
    model.pairs = int(counts[0][0])
    d = _discounts(words)
    model.discounts = [d, *(_discounts(c[1:]) for c in counts)]
    model.word_share = float(d[0] * words[0] + d[1] * words[1] + d[2] * words[4]) / model.pairs
    return model


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def word_probability(model: Model, follows: np.ndarray) -> np.ndarray:
    uniform = model.word_share / (model.words + 1)
    return _discounted(follows, model.discounts[0]) / max(model.pairs, 1) + uniform


def gram_probability(counts: np.ndarray, totals: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
    """A level's probabilities; ``lower`` where the context was never seen."""
    total = np.maximum(totals[:, 0], 1)
    return np.where(totals[:, 0] > 0, _discounted(counts, d) / total + totals[:, 1:] @ np.array(d) / total * lower, lower)


def _levels(arrays: Arrays, words: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, counts, totals) of each token's grams, from pairs up."""
    model = arrays.model
    n = len(words[0])
    known = (words[0] >= 0) & (words[1] >= 0)
    part = np.where(known, _range_of(arrays.cuts, np.maximum(words[0], 0), np.maximum(words[1], 0)), -1)
    # the context's range: that of its last word, unless it is split
    home = np.where(words[0] >= 0, _range_of(arrays.cuts, np.maximum(words[0], 0), np.zeros(n, np.int64)), -1)
    is_split = np.isin(words[0], arrays.split)
    seen = words[0] >= 0
    for level, (gram, context) in enumerate(zip(_gram_keys(words), _context_keys(words), strict=True), 2):
        counts, totals = np.zeros(n, np.int64), np.zeros((n, 4), np.int64)
        for p, here in _runs(part, (part >= 0) & seen):
            counts[here] = arrays.of_grams(level, p, gram[here])
        for p, here in _runs(home, (home >= 0) & ~is_split & seen):
            totals[here] = arrays.of_contexts(f"context-{level}-{p}", context[here])
        for p, here in _runs(np.searchsorted(arrays.hash_cuts, context, "right"), is_split & seen):
            totals[here] = arrays.of_contexts(f"shared-{level}-{p}", context[here])
        # seen once, and so not stored
        totals[seen & (totals[:, 0] == 0) & (words[0] != model.words) & (level > 2)] = (1, 1, 0, 0)
        yield level, counts, totals
        # the next level's context is this level's gram of the token before; a start's is always stored
        seen = np.concatenate([[False], counts[:-1] > 0])[:n] | (words[0] == model.words)


def _runs(part: np.ndarray, use: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``part`` with the places in use that have it."""
    at = np.flatnonzero(use)
    few = part[at].astype(np.uint16 if len(part) and part.max() < 2**16 else np.int64)  # numbers of 16 bits are sorted by their digits
    at = at[np.argsort(few, kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], part[at][1:] != part[at][:-1], [True]])) if len(at) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[at[a]]), at[a:b]


_SCORES = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays_of(model)
        for batch, first, end, words, rows in _texts(batches):
            n = end - first
            grams = _grams_of(arrays, words, rows)
            distinct, inverse = np.unique(grams[1], return_inverse=True)
            seen = arrays.of_words("seen", distinct)
            base = np.log10((seen + 1) / (model.tokens + model.words + 1))
            p = word_probability(model, arrays.of_words("follows", distinct))[inverse]
            if model.tokens:
                for level, counts, totals in _levels(arrays, grams):
                    p = gram_probability(counts, totals, model.discounts[level - 1], p)
            sums = [np.bincount(rows, minlength=n), np.bincount(rows, weights=seen[inverse] > 0, minlength=n).astype(np.int64), np.bincount(rows, weights=base[inverse], minlength=n), np.bincount(rows, weights=np.log10(p), minlength=n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *map(pa.array, sums)], names=["carried", *(s[0] for s in _SCORES)])

    return run


def score(docs: DataFrame, model: Model, carry: Column, *, text_col: str = "text") -> DataFrame:
    """carried, n_tokens, n_known, base_score, score for each row; ``carry`` is handed through, so ids may be null or repeated.

    ``score`` is the model's log10 probability of the text and its end; ``base_score`` that of add-one unigrams. A null
    text is empty and has the end alone. A model of no text gives every word the same probability.
    """
    rows = docs.select(carry.alias("carried"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("carried", rows.schema["carried"].dataType), *(T.StructField(n, t) for n, t in _SCORES)])
    return rows.mapInArrow(_scored(model), schema)
