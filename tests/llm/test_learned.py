"""Models, fingerprints and classifiers against brute force and on odd rows."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import chat_format, language_id, licences, ngram_model
from factloom.llm.fingerprint import SIGNS, WIDE, combine, combined, edited_pairs, fingerprints, likeness, remove, vector

SCHEMA = "doc_id long, text string, lang string, carried string, row int"
ODD = [(900, None, "en", "x", 1), (901, "", None, "x", 1), (902, "  \n\t ", "de", "x", 1), (903, "a", "en", "x", 1), (904, "1234 !!", "en", "x", 1), (903, "a", "en", "x", 1), (905, "long " * 60000, "en", "x", 1)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "Cat", "sat", "on", "mats", "über", "dog", "ran", "x1"]
    return [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 30))), "en", "x", 1) for k in range(n)]


@pytest.mark.parametrize(("order", "range_tokens"), [(2, 10**6), (3, 10**6), (3, 40), (4, 40)])
def test_kneser_ney_equals_brute_force(spark, monkeypatch, order, range_tokens):
    monkeypatch.setattr(ngram_model, "RANGE_TOKENS", range_tokens)
    rows = corpus() + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    model = ngram_model.train(df.where("doc_id % 3 <> 0"), order=order)

    def grams(text):
        tokens = [*words(text), "</s>"]
        padded = ["<s>"] * (order - 1) + tokens
        return [tuple(padded[k : k + order]) for k in range(len(tokens))]

    counts = {order: collections.Counter(g for r in rows if r[0] % 3 for g in grams(r[1]))}
    for level in range(order - 1, 0, -1):  # distinct left neighbours
        counts[level] = collections.Counter(g[1:] for g in counts[level + 1])
    discounts = {level: [0, *ngram_model._discounts([collections.Counter(c.values())[k] for k in (1, 2, 3, 4)])] for level, c in counts.items()}
    followers = collections.defaultdict(list)
    for c in counts.values():
        for g, n in c.items():
            followers[g[:-1], len(g)].append(n)
    uni = collections.Counter(g[-1] for r in rows if r[0] % 3 for g in grams(r[1]))

    def p(gram):
        if not gram:
            return 1 / (len(uni) + 1)
        level, found = len(gram), followers[gram[:-1], len(gram)]
        if not found:
            return p(gram[1:])
        d, n = discounts[level], counts[level][gram]
        return (n - d[min(n, 3)]) / sum(found) + sum(d[min(f, 3)] for f in found) / sum(found) * p(gram[1:])

    assert model.tokens == sum(uni.values()) and model.words == len(uni)
    # probabilities of all words, an unknown one among them, add up to one
    assert abs(sum(p((*["the", "cat", "sat"][1 - order :], w)) for w in [*uni, "unknown"]) - 1) < 1e-9
    for row in ngram_model.score(df, model, F.struct("doc_id", "text")).collect():
        found = grams(row["carried"]["text"])
        want = sum(math.log10(p(g)) for g in found)
        assert abs(row["score"] - want) < 1e-8 * max(1, abs(want)) and row["n_tokens"] == len(found)
        assert row["n_known"] == sum(uni[g[-1]] > 0 for g in found)


def test_model_of_nothing(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = ngram_model.train(df.where("false"))
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in ngram_model.score(df, model, F.col("doc_id")).collect())


def exact_vector(text):
    """Number, wide lanes and bit lanes of a text, two lanes a long, from the standard hash."""
    wide, lanes = [0] * WIDE, [0] * SIGNS
    found = [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x]
    for x in found:
        h = [xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) for k in range(WIDE + SIGNS // 64)]
        wide = [(w + v % 2**61) % 2**61 for w, v in zip(wide, h, strict=False)]
        for k in range(SIGNS):  # long 4 * shift + byte of a hash has that bit of that byte, and of the fourth byte after
            long, upper = divmod(k, 2)
            shift, byte = divmod(long % 32, 4)
            lanes[k] += h[WIDE + long // 32] >> (shift + 8 * byte + 32 * upper) & 1
    longs = [lanes[k] | lanes[k + 1] << 32 for k in range(0, SIGNS, 2)]
    return [len(found), *wide, *(x - 2**64 if x >> 63 else x for x in longs)]


def exact_likeness(a, b):
    x, y = (collections.Counter(p for p in re.split(r"(?<=\n)|(?<=[.!?] )", t) if p) for t in (a, b))
    return 2 * sum(n * y[p] for p, n in x.items()) / sum(n * n for c in (x, y) for n in c.values())


def test_fingerprints(spark):
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(["A b. C d.\nE f. G!\n", "E f. G!\nA b. C d.\n", "A b. C d.\nE f. G!\n", None, "", "x", "éü😀 a"])]
    out = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = [r[1] or "" for r in rows]
    for k, text in enumerate(texts):
        half, after = len(text) // 2, texts[(k + 1) % len(texts)]
        assert out[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert out[k]["n_chars"] == len(text) and 0 <= out[k]["near_edited"] <= 1
    assert out[0]["fingerprint"] == out[2]["fingerprint"] != out[5]["fingerprint"]
    assert out[3]["fingerprint"] == out[4]["fingerprint"]
    assert out[3]["near_next"] == 1.0
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fingerprints(spark.createDataFrame(rows[:1], SCHEMA)).first()["near_next"] == 1.0


def test_next_document_across_ranges_hot_and_null_ids(spark):
    r = random.Random(3)
    rows = [(r.randrange(10**6), "a. " * r.randrange(4) + f"t{k}. ", "en", "x", 1) for k in range(300)] + [(77, f"hot {k}. ", "en", "x", 1) for k in range(200)] + [(None, f"none {k}. ", "en", "x", 1) for k in range(3)]
    rows = list({x[0]: x for x in rows if x[0] not in (77, None)}.values()) + [x for x in rows if x[0] in (77, None)]
    r.shuffle(rows)
    out = [tuple(x) for x in edited_pairs(spark.createDataFrame(rows, SCHEMA).repartition(7)).select("id", "text", "next_id", "edited").collect()]
    signed = lambda t: (lambda h: h - 2**64 if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((x[0], x[1]) for x in rows), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
    want = []
    for k, (key, text) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text) // 2
        want.append((key, text, after[0], text[: len(text) - half] + after[1][:half]))
    assert sorted(out, key=str) == sorted(want, key=str)


def test_vectors_equal_brute_force_and_likeness_is_near(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["one. ", "two\n", "three! ", f"own {k}\n", "four\n"]) for _ in range(r.randrange(1, 60))) for k in range(40)] + ["", "no end", "\n" * 700]
    got = [x["v"] for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1).sort("k").select(vector(F.col("t")).alias("v")).collect()]
    assert got == [exact_vector(t) for t in texts]
    bases = [[f"{k} {j}. " for j in range(40)] for k in range(60)]
    pairs = [("".join(b), "".join(b[: len(b) - n] + [f"new {n} {x}" for x in b[:n]])) for b in bases for n in (0, 10, 20, 40)]
    near = [x["n"] for x in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(1).sort("k").select(likeness(vector(F.col("a")), vector(F.col("b"))).alias("n")).collect()]
    errors = [n - exact_likeness(*p) for n, p in zip(near, pairs, strict=True)]
    assert max(map(abs, errors)) < 0.5 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.125


def test_vectors_of_very_many_paragraphs_and_collections(spark):
    n = 2_200_000  # more than 2**21
    v = spark.range(1).select(vector(F.repeat(F.lit("\n"), n)).alias("v")).first()["v"]
    one = exact_vector("\n")
    assert v[: 1 + WIDE] == [n, *(x * n % 2**61 for x in one[1 : 1 + WIDE])]
    assert [x >> s & 0xFFFFFFFF for x in v[1 + WIDE :] for s in (0, 32)] == [(x >> s & 0xFFFFFFFF) * n for x in one[1 + WIDE :] for s in (0, 32)]
    df = spark.createDataFrame([(0, "a. b. c.\nd.\n"), (1, "d.\na. b. c.\n"), (2, "a. b. c.\n"), (3, "d.\n")], "k int, text string").select("k", vector(F.col("text")).alias("v"))
    a, b, c, d = (x["v"] for x in df.orderBy("k").collect())
    row = spark.createDataFrame([(a, c, d)], "a array<long>, c array<long>, d array<long>").select(combine(F.col("c"), F.col("d")).alias("sum"), remove(F.col("a"), F.col("d")).alias("rest")).first()
    assert a == b == row["sum"] and row["rest"] == c
    assert combined(df.where("k > 1").withColumn("g", F.lit(1)), ["g"], "v").first()["v"] == a


def test_language_id_on_held_out_and_odd_rows(spark):
    r = random.Random(3)
    stems = {"en": ["the", "ing", "tion", "and", "whi"], "de": ["sch", "der", "ung", "ein", "über"], "ru": ["что", "это", "ова", "ние", "ста"]}
    rows = [(k, " ".join("".join(r.choices(stems[lang], k=3)) for _ in range(20)), lang, "x", 1) for k in range(90) for lang in [list(stems)[k % 3]]]
    df = spark.createDataFrame(rows + [o[:2] + (None,) + o[3:] for o in ODD], SCHEMA)
    model = language_id.train(df.where("doc_id < 60"))
    out = language_id.identify(df, model, F.struct("doc_id", "lang")).collect()
    held = [x for x in out if 60 <= x["carried"]["doc_id"] < 90]
    assert all(x["lang_pred"] == x["carried"]["lang"] for x in held)
    odd = {x["carried"]["doc_id"]: x for x in out if x["carried"]["doc_id"] >= 900}
    assert {odd[k]["lang_pred"] for k in (900, 901, 902, 904)} == {"und"} and odd[900]["rejected"]
    assert odd[905]["lang_pred"] in stems
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.where("doc_id < 90").count() == 90 and kept.where("doc_id = 900").count() == 0
    nothing = language_id.train(df.where("false"))
    assert {x["lang_pred"] for x in language_id.identify(df, nothing, F.col("doc_id")).collect()} == {"und"}


def test_language_id_rejects_what_is_no_text_of_its_languages(spark):
    r = random.Random(6)
    letters = lambda alphabet, n: " ".join("".join(r.choices(alphabet, k=r.randint(2, 9))) for _ in range(n))
    starts = {"en": "the and with from that have this were when would there which about their people".split(), "de": "der und mit von dass haben dieser waren wenn würde welche über ihre leute nicht".split()}
    text = lambda lang: " ".join(r.choice(starts[lang]) + r.choice(["", "", "s", "er", "ing", "en"]) for _ in range(r.choice((8, 60, 400))))
    real = [(k, text(["en", "de"][k % 2]), ["en", "de"][k % 2], "x", 1) for k in range(200)]
    junk = ["в начале было слово и слово было у нас дома " * 3, "今天天气很好我们一起去公园散步" * 3, "η θάλασσα ήταν ήρεμη και ο ήλιος " * 3]
    junk += [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (10, 100, 1000)] + [letters("bcdfghjklmnpqrstvwxz", n) for n in (10, 100, 1000)]
    junk += ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)) for n in (60, 600, 6000)]
    df = spark.createDataFrame(real + [(1000 + k, t, None, "x", 1) for k, t in enumerate(junk)], SCHEMA)
    model = language_id.train(df.where("doc_id < 150"))
    rejected = {x["carried"] for x in language_id.identify(df, model, F.col("doc_id")).where("rejected").collect()}
    assert rejected == {1000 + k for k in range(len(junk))}
    assert language_id.keep_identified(df, model).where("doc_id < 200").count() == 200 == language_id.keep_identified(df, model).count()


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "Released under the MIT_License": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
    "This is free and unencumbered software released into the public domain.": "public-domain",
    "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the \"Software\"), to deal in the Software\n# without restriction": "mit",
    " * THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS\n * OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit",
    "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License.": "gpl",
    "Nanna ate bread in the sun.": None,
    "He went mit dem Bus.": "unknown",
    "The license fee of the apache was paid.": "unknown",
    "The license was granted to the software firm in the public interest.": "unknown",
}


def exact_licence(text, model):
    """(probability, likeness, family) of a paragraph; none without a word of ``covers``."""
    tokens = re.findall("[a-z0-9]+", text.lower())
    if not set(tokens) & set(model.covers):
        return None
    runs = {" ".join(tokens[k : k + n]) for n in (1, 2, 3) for k in range(len(tokens) - n + 1)}
    z = [(b + sum(model.weights[g][k] for g in runs if g in model.weights)) / model.temperature for k, b in enumerate(model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    best, own, likeness = z.index(max(z)), {p for p in runs if p.count(" ") == 1}, 0.0
    for t in licences.TEMPLATES.get(model.families[best], []):
        t = re.findall("[a-z0-9]+", t.lower())
        t = {" ".join(p) for p in zip(t, t[1:], strict=False)}
        likeness = max(likeness, len(own & t) / len(t), len(own & t) / len(own) if len(own) >= licences.FRAGMENT else 0)
    ok = model.families[best] != "unknown" and max(e) / sum(e) >= licences.MIN_PROBABILITY and likeness >= licences.MIN_LIKENESS
    return max(e) / sum(e), likeness, model.families[best] if ok else "unknown"


def test_licences_equal_brute_force(spark):
    model, texts = licences.train(), list(NOTICES)
    for text in texts[:-4]:  # each alone, in a text of its own and as one paragraph of several
        assert exact_licence(text, model)[2] == NOTICES[text], (text, exact_licence(text, model))
    several = "\n\n".join(texts)
    rows = [*((k, t, None, "x", 1) for k, t in enumerate(texts)), (50, several, "en", "x", 1), (50, several, "en", "x", 1), (None, texts[1], "en", "x", 1), *ODD]
    out = collections.defaultdict(list)
    for r in licences.scan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        assert r["confirmed"] == (r["family"] != "unknown")
        out[r["doc_id"], r["paragraph"]].append((r["probability"], r["likeness"], r["family"]))
    for k, text in enumerate(texts):
        want = exact_licence(text, model)
        assert want is None if NOTICES[text] is None else want[2] == NOTICES[text], (text, want)
        got = out.pop((k, 0), []) + out.pop((50, k), [])
        assert len(got) == (0 if want is None else 3), text
        assert all(abs(g[0] - want[0]) < 2e-6 and abs(g[1] - want[1]) < 2e-6 and g[2] == want[2] for g in got)
    assert len(out.pop((None, 0))) == 1
    assert all(x[2] == "unknown" for v in out.values() for x in v) and {k[0] for k in out} <= {905}


def test_paragraphs_without_covers_are_unknown():
    model, r = licences.train(), random.Random(4)
    others = sorted({w for g in model.weights for w in g.split()} - set(model.covers))
    for _ in range(500):
        tokens = r.choices(others, k=r.randint(1, 40))
        z = model.bias + sum((model.weights[g] for g in licences.grams(tokens) if g in model.weights), 0)
        assert model.families[int(z.argmax())] == "unknown"


def test_licences_of_nothing_and_clashing_names(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "Released under the MIT License.", 1, 2, 3, 4, 5)], "doc_id long, text string, paragraph int, tokens int, copies int, z0 int, family int")
    assert [r["family"] for r in licences.scan(clash).collect()] == ["mit"]
    assert licences.scan(spark.createDataFrame([(1, "\n" * 2_100_000 + "Released under the MIT License.\n")], "doc_id long, text string")).count() == 1


def test_chat_preferences(spark):
    schema = "pair_id long, turn int, role string, text string, segment string"
    yes = [(1, 0, "user", "a", "c"), (1, 1, "assistant", "b", "c"), (1, 1, "assistant", "b", "c"), (1, 2, "user", None, "c"), (1, 3, "assistant", "good", "c"), (2, 0, "user", "q", "c"), (3, 0, "assistant", "only", "c"), (None, 0, "user", "z", "c")]
    no = [*yes[:4], (1, 3, "assistant", "bad", "c"), (1, 4, "user", "more", "c"), (2, 0, "user", "q", "c")]
    out = chat_format.format_preferences(spark.createDataFrame(yes, schema), spark.createDataFrame(no, schema)).collect()
    got = sorted((r["pair_id"], r["part"], r["turn"], r["trained"]) for r in out)
    assert got == [(1, "chosen", 3, True), (1, "prompt", 0, False), (1, "prompt", 1, False), (1, "prompt", 2, False), (1, "rejected", 3, True), (1, "rejected", 4, False), (2, "prompt", 0, False), (3, "chosen", 0, True)]
    assert chat_format.format_preferences(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
