"""Deduplication, packing, decontamination, surrogates and the pipeline against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import common, components, decontaminate, line_dedup, surrogates
from factloom.llm.line_dedup import drop_recurring_lines
from factloom.llm.near_dedup import near_duplicates
from factloom.llm.packing import default_tokenizer, pack, plan, repeat_counts
from factloom.llm.surrogates import replace_entities

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, rank int"
ODD = [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one two"), (905, "w" * 100000), (906, "\n".join("line %d of many here" % k for k in range(3000)))]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, 2) for k, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def copies(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    out = []
    for _ in range(6):  # families: copies of a base with more and more words changed, in any order
        base = [word() for _ in range(r.choice((8, 40, 120)))]
        family = [" ".join(base)] * 2
        for n in (1, 1, 2, 3, 4, 6):
            text = list(base)
            for at in r.sample(range(len(base)), min(n, len(base))):
                text[at] = word()
            family.append(" ".join(text))
        r.shuffle(family)
        out += family
    return list(enumerate(out)) + ODD


def test_components_without_large_nodes_are_windows(spark, monkeypatch):
    r = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(5, 5), (120, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    ends = {x for u, v in edges if u != v for x in (u, v)}
    table = spark.createDataFrame(edges, "u long, v long")
    found = lambda: sorted(tuple(row) for row in components.components(table).collect())
    want = sorted((x, find(x)) for x in ends)
    monkeypatch.setattr(components, "MOST_EDGES", 3)
    assert found() == want
    monkeypatch.undo()
    monkeypatch.setattr(components, "attach", None)
    assert found() == want


def test_attach_without_hot_keys_is_a_plain_join(spark):
    left = spark.range(60).selectExpr("id % 20 AS k", "id")
    right = spark.range(20).selectExpr("id AS k", "3L AS held")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for least, hot in ((3, True), (4, False)):
            got = common.attach(left, right, ["k"], "held", 60, least=least)
            assert sorted(tuple(r) for r in got.collect()) == sorted((k % 20, k, 3) for k in range(60))
            assert ("Broadcast" in got._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in got._jdf.queryExecution().toString()) == hot
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_near_duplicates_equal_brute_force(spark):
    rows = copies()
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, rows)).collect()}
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in sets}
    assert near_duplicates(frame(spark, [])).count() == 0


def recurring(rows):
    """doc_id: numbers of the lines that go, by comparing all lines of a leaf token by token."""
    lines = []
    for k, text in {(k, t) for k, t in rows if k is not None and t is not None}:
        for at, line in enumerate(text.split("\n")):
            tokens = [re.sub(r".*[0-9].*", "<*>", t) for t in line.split()]
            if tokens:
                lines.append((k, at, tokens))
    gone = collections.defaultdict(set)
    for k, at, tokens in lines:
        n, rest = len(tokens), max(0, len(tokens) - 2)
        run = [-1, -1, *(min(s for s in range(8) if j < (s + 1) * rest // 8) for j in range(rest))]
        leaf = [x for x in lines if len(x[2]) == n and x[2][:2] == tokens[:2]]
        same = {x[0] for x in leaf if x[2] == tokens}
        if len(same) >= (20 if n < 4 else 3) and k != min(same):
            gone[k].add(at)
        for pair in itertools.combinations(range(8), 2) if n >= 4 else ():
            free = [j for j in range(n) if run[j] in pair]
            if 0 < len(free) <= n // 4:
                like = {x[0] for x in leaf if all(x[2][j] == tokens[j] or j in free for j in range(n))}
                if len(like) >= 3 and k != min(like):
                    gone[k].add(at)
    return gone


def test_line_templates(spark):
    own = lambda k, n: " ".join(f"{chr(97 + k)}{'xyz'[j % 3] * (j + 1)}" for j in range(n))
    texts = []
    for k in range(5):
        texts.append(
            "\n".join(
                [
                    f"own line of doc {own(k, 5)}",
                    f"Posted at 12:30 on 2020-01-{k + 1:02} by the same old bot",
                    f"twelve tokens are here and {own(k, 1)} is the one that differs now",
                    f"eight tokens {own(k, 1)} where two {own(k + 1, 2).split()[1]} differ here",
                    f"one common first half of a sentence has {own(k, 8)}",
                    "short one",
                    "",
                ]
            )
        )
    rows = list(enumerate(texts)) + ODD
    got = {r["doc_id"]: r for r in drop_recurring_lines(frame(spark, rows)).collect()}
    assert got[0]["text"] == texts[0] and got[0]["lines_dropped"] == 0
    for k in range(1, 5):  # what differs in a quarter goes, what differs in half stays, a short line too
        kept = texts[k].split("\n")
        assert got[k]["text"] == "\n".join([kept[0], *kept[4:]]) and got[k]["lines_dropped"] == 3
    assert got[900]["text"] is None and all(got[k]["text"] == t for k, t in ODD if t is not None)
    assert drop_recurring_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [line_dedup.MOST_BROADCAST, 0])  # key tables broadcast, or joined by a shuffle
def test_line_templates_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    r = random.Random(9)
    word = lambda: r.choice(["the", "of", "cat", "dog", "sat", "on", "x1", "2020"])
    bases = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 23) for _ in range(3)]

    def line():
        out = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            out[r.randrange(len(out))] = word()
        return r.choice(["", " "]) + r.choice([" ", "  "]).join(out)

    rows = [(k, "\n".join(line() for _ in range(r.randrange(1, 9)))) for k in range(60)]
    rows += [rows[3], (None, rows[4][1]), (7, "the cat sat on the other mat"), *ODD[:5]]  # a repeated row, no id, another text of an id
    gone = recurring(rows)
    df = frame(spark, rows).withColumnRenamed("id", "dropped").withColumnRenamed("rank", "lines_dropped").withColumnRenamed("lang", "Line")
    out = drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "Line", "source", "n_chars", "dropped", "lines_dropped"]
    want = collections.Counter()
    for k, t in rows:
        at = {a for a in gone[k] if (k, a) in {(k, a) for a in gone[k]}} if k not in (7, None) and t is not None else set()
        want[k, t if not at else "\n".join(x for a, x in enumerate(t.split("\n")) if a not in at), len(at)] += 1
    got = collections.Counter((x["doc_id"], x["text"], x["lines_dropped"]) for x in out.collect())
    assert {x: n for x, n in got.items() if x[0] != 7} == {x: n for x, n in want.items() if x[0] != 7} and sum(got.values()) == len(rows)


def test_lines_are_dropped_in_linear_time(spark):
    many = "\n".join("a recurring line of this log" if k % 2 else f"own{'x' * (k % 50)} words {'y' * (k % 61)} stay put {'z' * (k % 67)}" for k in range(100_000))
    rows = [(k, "a recurring line of this log") for k in range(3)] + [(5, many)]
    assert {r["doc_id"]: r["lines_dropped"] for r in drop_recurring_lines(frame(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1, 5: 50_000}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    rows = [(k, " ".join(r.choices(["Hello", "wörld", "it's", "42", "<|endoftext|>", "x,y", "日本"], k=r.randint(0, 200)))) for k in range(80)] + ODD
    got = pack(frame(spark, rows), window=256).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in rows}
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for p in got:
        pieces[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) and p["doc_tokens"] == len(ids[p["doc_id"]])
    for found, sizes in ((pieces, {k: len(v) for k, v in ids.items()}), (sequences, None)):
        for k, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at <= 256 if sizes is None else at == sizes[k]
    assert set(pieces) == set(ids) and pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_places_every_piece_once(seed):
    histogram = np.random.default_rng(seed).poisson(3, 257)
    histogram[0] = 0
    histogram[100] = 5000  # one length has most pieces
    runs = plan(histogram, 256)
    total, filled = collections.Counter(), collections.Counter()
    for length, first, n, each, sequence, _ in runs:
        assert first == total[length]
        total[length] += n
        for k in range(n // each):
            filled[sequence + k] += length * each
    assert total == {k: v for k, v in enumerate(histogram.tolist()) if v} and max(filled.values()) <= 256


def test_least_squares_counts():
    columns = np.array([[4, 0, 0], [3, 1, 0], [2, 2, 0]])
    x = repeat_counts(columns, np.array([0, 5, 8, 5, 7]), rounds=2000)
    assert np.allclose(x, [7, 5, 4], atol=0.05)


def test_decontamination_equals_edit_distance(spark):
    r = random.Random(5)
    item = " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(20))
    budget = len(item) // decontaminate.ERROR_SHARE

    def edited(n):
        text = list(item)
        for at in r.sample(range(5, len(text) - 5), n):
            text[at] = r.choice(["", "Z", text[at] + "q"])
        return "before it " + "".join(text) + " after it"

    rows = [(k, edited(n)) for k, n in enumerate([0, 1, budget, budget, budget + 3])] + [(10, item.upper().replace(" ", "\n ")), (11, item[: len(item) // 2])] + ODD

    def distance(pattern, text):
        last = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            now = [i]
            for j, d in enumerate(text, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
            last = now
        return min(last)

    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    found = {r["doc_id"]: r["distance"] for r in decontaminate.contaminations(frame(spark, rows), benchmark).collect()}
    want = {k: distance(item, decontaminate.normalise(t)) for k, t in rows if t and len(t) < 5000}
    assert found == {k: d for k, d in want.items() if d <= budget}
    clean = decontaminate.clean(frame(spark, rows), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {k for k, _ in rows} - set(found)
    assert decontaminate.contaminations(frame(spark, rows), benchmark.where("false")).count() == 0


def test_surrogates(spark):
    text = "Mail Ann.Lee7@Mail.example.com, ann.lee7@mail.example.com or +1 (017) 555-7713 and +1 017-555-7713; card 4111 1111 1111 1111, ip 10.2.3.4. Frau Müller, Mr. Kern."
    rows = [(1, text), (2, "again ANN.LEE7@MAIL.EXAMPLE.COM and 4111111111111111!"), (3, "nothing 1.2 or 2020 here"), *ODD]
    out = {r["doc_id"]: r for r in replace_entities(frame(spark, rows), key="k").collect()}
    new = out[1]["text"]
    for old in ("nn.lee7", "555-7713", "1111 1111", "10.2.3.4", "Müller", "Kern"):
        assert old not in new
    mails = re.findall(r"[\w.]+@[\w.]+\w", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1] and mails[0][0].isupper()
    phones = re.findall(r"\+1 [\d() -]{11,}\d", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and len(phones) == 2
    assert out[2]["text"].split()[1].lower() == mails[0].lower() and re.search(r"card (\d{4} ){3}\d{4}", new).group().replace(" ", "")[4:] in out[2]["text"]
    assert out[3]["text"] == rows[2][1] and out[900]["text"] is None and out[1]["entities_replaced"] == 8
    other = {r["doc_id"]: r["text"] for r in replace_entities(frame(spark, rows[:1]), key="z").collect()}
    assert other[1] != new


def test_surrogates_stay_distinct(spark):
    names = ["Mr. " + "".join(p).capitalize() for p in itertools.product("abcdefghij", repeat=2)]
    out = replace_entities(frame(spark, list(enumerate(names))), key="k").collect()
    assert len({r["text"] for r in out}) == len(names) and not {r["text"] for r in out} & set(names)


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10


def test_surrogates_by_brute_force(spark):
    """Keyed, distinct, coreferent and of the same form, over thousands of entities of small spaces."""
    r = random.Random(11)
    short = [f"{a}{b}@x.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz0123456789"]  # most of a small space
    phones = [f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(10**4):04}" for _ in range(300)]
    names = [f"{t} {g} {f}" for t in ("Mr.", "Ms.", "Dr.") for g in ("John", "Kim", "Ola") for f in ("Kern", "Lee", "Voss", "O'brien")]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112"]
    others = ["123-45-6789", "AKIA" + "ABCDEFGH12345678", "ghp_" + "a1B2" * 9, "0123456789abcdef" * 2]
    mentions = [(m, "mail " + m) for m in short] + [(p, "call " + p) for p in phones] + [(p, "call " + p[3:]) for p in phones[:50]] + [(n, n + " spoke") for n in names] + [(n, n.split()[0] + " " + n.split()[2] + " left") for n in names]
    mentions += [(c, "card " + c) for c in cards] + [(o, "key " + o) for o in others]
    rows = [(k, text) for k, (_, text) in enumerate(mentions)]
    out = {x["doc_id"]: x["text"] for x in replace_entities(frame(spark, rows), key="k").collect()}
    other = {x["doc_id"]: x["text"] for x in replace_entities(frame(spark, rows), key="z").collect()}
    assert sum(out[k] != other[k] for k in out) > 0.99 * len(out)
    made, family, given = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for k, (entity, text) in enumerate(mentions):
        new = out[k]
        assert new != text and new.split()[0] == text.split()[0]
        if entity in names:
            title, *rest = new.split()[:-1]
            family[entity.split()[2]].add(rest[-1])
            if len(rest) > 1:
                given[title, entity.split()[1]].add(rest[0])
        else:
            made[entity].add(re.sub(r"\D", "", new)[-10:] if entity in phones else new.split(" ", 1)[1])
            assert entity in phones or re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new)))[-4:] == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))[-4:] or entity in others[3:]
    for found in (made, family, given):  # one surrogate an entity, one entity a surrogate
        assert all(len(v) == 1 for v in found.values()) and len({x for v in found.values() for x in v}) == len(found)
    assert not {x for v in made.values() for x in v} & {m for m, _ in mentions}
    card = {c: next(iter(made[c])) for c in cards}
    assert all(luhn(card[c]) == 0 and card[c][0] == c[0] for c in cards[:2]) and re.fullmatch(r"(\d{4} ){3}\d{4}", card[cards[2]])
    assert next(iter(made[others[1]])).startswith("AKIA") and next(iter(made[others[2]])).startswith("ghp_")


def test_surrogates_without_another_form_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "MOST_SALTS", 2)
    with pytest.raises(surrogates.SurrogateError, match="-@-.com"):
        replace_entities(frame(spark, [(1, "to -@-.com now")]), key="k")


def test_surrogates_of_odd_tables(spark):
    names = [f"{a}@{b}.io" for a in "abcdefgh" for b in "abcdefgh"]
    df = spark.createDataFrame([(None if k % 3 else k, f"to {m}", "x", 1, 2) for k, m in enumerate(names)], "doc_id long, text string, spots string, entities_replaced int, Salts int")
    out = replace_entities(df, key="k")
    assert out.columns == ["doc_id", "text", "spots", "Salts", "entities_replaced"]
    found = [x["text"] for x in out.collect()]
    assert len(set(found)) == len(names) and not set(found) & {f"to {m}" for m in names}
    assert replace_entities(df.where("false"), key="k").count() == 0


def test_surrogates_of_phones_without_separators(spark):
    phones = ["+12125551234", "+442079460958", "+4915112345678", "+35312345678", "+79161234567", "+1 212-555-1234"]
    out = [r["text"] for r in replace_entities(frame(spark, [(k, f"call {p} now") for k, p in enumerate(phones)]), key="k").orderBy("doc_id").collect()]
    for old, new, code in zip(phones, out, ["+1", "+44", "+49", "+353", "+7", "+1 "], strict=True):
        new = re.fullmatch(r"call (.*) now", new).group(1)
        assert new != old and new.startswith(code) and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", old)
        assert new[len(code) :] != old[len(code) :]
    assert re.sub(r"\D", "", out[0]) == re.sub(r"\D", "", out[5])  # two spellings of one number


def test_surrogates_end_where_the_format_has_no_other(spark):
    mails = ["_@-.com", *(f"{c}@-.org" for c in "abcdefghijklmnopqrstuvwxyz")]
    out = [r["text"] for r in replace_entities(frame(spark, list(enumerate(mails))), key="k").collect()]
    assert len(set(out)) == len(mails) and not set(out) & set(mails)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choices(["the", "ing", "and", "tion", "er"], k=2)) for _ in range(n))
    item = say(30)
    texts = [say(40) for _ in range(20)]
    rows = list(enumerate(texts)) + [(50, texts[3]), (51, texts[4] + " tail"), (52, say(20) + " " + item), (53, "12 34"), (54, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        left[name] = {x["doc_id"] for x in docs.collect()}
    assert left["language"] == set(range(20)) | {50, 51, 52}
    assert left["near_copies"] == set(range(20)) | {52} and left["benchmarks"] == set(range(20))
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))


def longest_shared_run(a, b):
    """Letters of the longest stretch of letters that both have, in any case."""
    runs = {r[i : i + n] for r in re.findall(r"[^\W\d_]+", a.lower()) for n in range(1, len(r) + 1) for i in range(len(r) - n + 1)}
    return max((len(r) for r in runs if r in b.lower()), default=0)


def test_surrogates_of_other_spellings_and_forms(spark):
    """Letters beyond ASCII, national numbers, account numbers with check digits, IPv6 in any spelling, secret access keys."""
    pairs = [
        ("müller@example.de", "MÜLLER@EXAMPLE.de"), ("a@bücher.example", "A@bücher.example"), ("иванова@почта.рф", "Иванова@Почта.рф"), ("415-555-2671", "+1 415 555 2671"), ("415.555.2672", "(415) 555-2672"),
        ("020 7946 0958", "020-7946-0958"), ("01 23 45 67 89", "01.23.45.67.89"), ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"),
        ("2001:db8::ff00:42:8329", "2001:0DB8:0000:0:0:FF00:42:8329"), ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ]
    rows = [(2 * k + n, f"see {m}, please") for k, pair in enumerate(pairs) for n, m in enumerate(pair)]
    rows += [(99, "nothing: 2020-01-02 at 10:20:30, std::vector a::b, 3000 4000, ISBN 12 and v1.2.3"), (98, "请联系foo@example.com谢谢")]
    out = {r["doc_id"]: r for r in replace_entities(frame(spark, rows), key="k").collect()}
    bare = lambda t: re.sub(r"\W", "", t.lower())
    made = []
    for k, pair in enumerate(pairs):
        new = [out[2 * k + n]["text"].removeprefix("see ").removesuffix(", please") for n in (0, 1)]
        made.append(bare(new[0]))
        for n, (old, m) in enumerate(zip(pair, new, strict=True)):
            top = r"\.[^.]+$" if "@" in old else "^$"
            assert out[2 * k + n]["entities_replaced"] == 1 and m != old and longest_shared_run(re.sub(top, "", old), re.sub(top, "", m)) < 3
            assert re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", m)) == re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", old)) or "::" in old or old.count(":") == 7
        if "::" in pair[0]:
            full = lambda a: [int(g or "0", 16) for g in a.replace("::", ":0" * (8 - len([g for g in a.split(":") if g])) + ":").split(":")]
            assert full(new[0]) == full(new[1]) and "::" in new[0]
        else:
            assert bare(new[0])[-10:] == bare(new[1])[-10:]
        if pair[0][:2] in ("DE", "GB"):
            a = bare(new[0]).upper()
            assert int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1 and a[:2] == pair[0][:2]
    assert len(set(made)) == len(pairs)
    assert out[99]["entities_replaced"] == 0 and out[99]["text"] == rows[-2][1]
    assert re.fullmatch("请联系[a-z]{3}@[a-z]{7}.com谢谢", out[98]["text"]) and "foo" not in out[98]["text"]


def test_names_without_their_title(spark):
    text = "Mr. John Kern met Ms. J. R. O'Brien. Kern said John's hat was KERN's. Smith-Kern and Kernel stay. Mr. McDonald, Mr. Ludwig van Berg and Frau Müller-Lüdenscheidt left. McDonald ran."
    rows = [(1, text), (2, "Kern and John were not named here"), (3, "Mrs. Kern"), (4, None)]
    out = {r["doc_id"]: r for r in replace_entities(frame(spark, rows), key="k").collect()}
    new = out[1]["text"]
    given, family = re.match(r"Mr\. (\w+) (\w+) met Ms\. [A-Z]\. [A-Z]\. \w+\. ", new).groups()
    assert f". {family} said {given}'s hat was {family.upper()}'s. Smith-Kern and Kernel stay. Mr. " in new and re.search(r"Mr\. (\w+), Mr\. \w+ van \w+ and Frau \w+ left\. \1 ran\.$", new)
    assert not re.search(r"\b(?:John|O'Brien|McDonald|Donald|Ludwig|Berg|Müller|Lüdenscheidt)\b", new) and out[1]["entities_replaced"] == 9
    assert out[2]["text"] == rows[1][1] and out[3]["text"] == f"Mrs. {family}" and out[4]["text"] is None


def test_names_grow_when_their_forms_run_out(spark, monkeypatch):
    """With one syllable and one ending, most names meet another until they are longer."""
    monkeypatch.setattr(surrogates, "_SYLLABLES", {s: (["b", "d"], ["a", "e"]) for s in surrogates._SYLLABLES})
    monkeypatch.setattr(surrogates, "_ENDINGS", {k: ["n"] for k in surrogates._ENDINGS})
    names = ["Mr. " + "".join(p).capitalize() for p in itertools.product("xyzwv", repeat=3)]
    out = replace_entities(frame(spark, list(enumerate(names))), key="k").collect()
    assert len({r["text"] for r in out}) == len(names) and max(len(r["text"]) for r in out) > len("Mr. badaban")
