"""Token counts, ranked search and importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import importance, lexical_search
from factloom.llm.token_counts import TokenCounter, default_tokenizer, token_counts

SCHEMA = "doc_id long, text string, n_tokens int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 7, 7) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_token_counts_equal_the_library(library):
    r, counter = random.Random(11), TokenCounter(default_tokenizer())
    texts = ["", " ", "a" * 3000, " " * 500 + "x", "\n\n \t\n", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", "՘ ࢏1a", "don't WE'LL we'll", "\x1c \x85 　​1²"]
    letters = [*"ab eé \n\t'sd1９中࢏\U000323b0", "<|endoftext|>", "  ", " the"]
    for _ in range(600):
        texts.append("".join(r.choice(letters) if r.random() < 0.95 else chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(60))))
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counter_forgets(library, monkeypatch):
    monkeypatch.setattr("factloom.llm.token_counts.REMEMBERED", 3)
    counter = TokenCounter(default_tokenizer())
    text = "one two three four five six seven one two"
    assert counter.count(text) == len(library.encode(text).ids) and len(counter.known) <= 3


def test_token_counts_of_odd_tables(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "null id"), (3, "x " * 40000), (4, "a" * 20000), (5, "é" * 1024)]
    got = [tuple(r) for r in token_counts(frame(spark, rows), limit=1000).collect()]
    want = []
    for k, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 1000))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(frame(spark, [])).count() == 0


def test_token_counter_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(r, n):
    return " ".join(r.choice(["Wort", "wort", "été", "x1", "9", "the", "of", "naïve", "中文", "Zebra", "q" * 40]) + r.choice([" ", "_", "-", ". ", "\n"]) for _ in range(n))


ODD_TEXTS = [(900, None), (901, ""), (902, " _-. "), (903, "é"), (903, "é"), (None, "the zebra of wort"), (905, "wort" * 20000), (906, "wort " * 20000), (907, "zebra_the")]


def best(docs, items, k):
    """The search in plain Python: [(item, rank, id, score)]."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, bag, _ in bags for t in bag)
    wanted = {}
    for i, t in set(items):
        if i is not None:
            wanted.setdefault(i, collections.Counter()).update(terms(t))
    out = []
    for i, query in wanted.items():
        scored = []
        for d, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in query.items() if t in bag)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of items and of documents, texts in parts
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 4)
    r = random.Random(12)
    docs = [(k, prose(r, r.randrange(1, 30))) for k in range(80)] + ODD_TEXTS
    docs += [(1000 + k, docs[3][1]) for k in range(25)]  # ties beyond the limit
    items = [(1, "the Zebra"), (2, "wort wort 中文 wort"), (3, None), (4, "nowhere"), (5, prose(r, 20)), (6, docs[3][1]), (6, docs[3][1]), (7, "x1"), (7, "9 9"), (None, "the")]
    got = lexical_search.search(frame(spark, docs).repartition(5), spark.createDataFrame([(i, t, 5, 5) for i, t in items], "item_id long, text string, score int, rank int"), k=10)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(best(docs, items, 10), key=str)


def test_search_in_small_blocks_and_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "TEXT_BYTES", 7)
    text = prose(random.Random(3), 50).encode()
    assert b"".join(lexical_search._parts(text)) == text
    found = [w for part in lexical_search._parts(text) for w in lexical_search._TERM.findall(part.lower())]
    assert found == lexical_search._TERM.findall(text.lower())
    rows = lambda k: pa.RecordBatch.from_arrays([pa.array([k, None]), pa.array([3, 4]), pa.array([[0, 1], [1]], pa.list_(pa.int32())), pa.array([[1, 2], [9]], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])
    block = lexical_search.ItemBlock([{"item_id": "a", "term": "x", "times": 2}, {"item_id": "a", "term": "y", "times": 1}, {"item_id": "b", "term": "y", "times": 1}])
    outs = []
    for cells in (1, 5, 1000):
        monkeypatch.setattr(lexical_search, "BLOCK_CELLS", cells)
        run = lexical_search._product(block, np.array([700, 300]), 10, 40, 3)
        outs.append([x for b in run(iter([rows(5), rows(2), rows(8)])) for x in b.to_pylist()])
    assert outs[0] == outs[1] == outs[2] and [x["doc_id"] for x in outs[0]][:3] == [2, 5, 8]


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark, ODD_TEXTS[:3]), items).count() == 0
    assert lexical_search.search(frame(spark, [(1, "the")]), items.limit(0)).count() == 0


def drawn(docs, target, longest, buckets, percent, least):
    """The resampling in plain Python."""

    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)], len(w)

    s, t = (collections.Counter(b for _, x in rows for b in found(x)[0]) for rows in (docs, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for k, x in docs:
        f, n = found(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35), (3, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, longest, percent):
    r = random.Random(13)
    docs = [(k, prose(r, r.randrange(60))) for k in range(150)] + ODD_TEXTS + [(2000 + k, "The same twenty words " * 5) for k in range(40)]
    target = [(k, prose(r, 8)) for k in range(20)] + [(50, None)]
    got = importance.resample(frame(spark, docs).repartition(3), frame(spark, target), longest=longest, buckets=97, percent=percent, least_words=7)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(drawn(docs, target, longest, 97, percent, 7), key=str)


def test_resampling_of_empty_tables(spark):
    some = frame(spark, [(1, "a b")])
    assert importance.resample(frame(spark, []), some).count() == 0
    got = importance.resample(some, frame(spark, []), least_words=1, percent=100)
    assert [tuple(x) for x in got.collect()] == drawn([(1, "a b")], [], 2, 10_000, 100, 1)


def test_long_words_among_short_ones():
    data = np.frombuffer(b"ab " * 100 + b"Q" * 50000 + b" end", np.uint8)
    rows, buckets, n = importance.features(data, np.array([0, 7, len(data)]), 1, 1 << 31)
    words = ["ab", "ab", "a", "b", *["ab"] * 97, "q" * 50000, "end"]
    assert list(n) == [3, 100] and [zlib.crc32(w.encode()) % (1 << 31) for w in words] == buckets.tolist()
