"""Document fingerprints: sums of vectors hashed from paragraphs, modulo powers of two.

A paragraph is a piece of text up to and with a line feed, or up to the end of a sentence in a line, so that the
paragraphs of a text join to the text itself. A paragraph's vector is a one, WIDE lanes of 61 bits and SIGNS lanes of
one bit, all from hashes with seeds of their own; a text's is the sum of its paragraphs' vectors. Wide lanes are added
modulo 2**61, bit lanes modulo 2**32, the number of paragraphs modulo 2**62. The sum does not depend on the order, and
paragraphs are put in or taken out by adding or subtracting their vectors: ``combine`` and ``remove``. The wide lanes tell
equal multisets of paragraphs from others (two that differ agree with a chance of 2**-244); from the bit lanes, as signs,
the inner product of two multisets is estimated, and with it their likeness 2 <a, b> / (<a, a> + <b, b>), with a standard
error of sqrt(2 / SIGNS) at worst, 0.125.

A vector is an array of longs: the number, the wide lanes, then two bit lanes a long. A text is summed where it stands, by
aggregates over its paragraphs, before any shuffle: CHUNK paragraphs at a time with eight bit lanes a long, which so few
cannot make run over, and then into lanes of 32 bits, more than a text can have paragraphs. All expressions are Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, text_or_empty

#: Lanes of 61 bits, one a hash, and of one bit, 64 a hash; paragraphs that are summed with eight bit lanes a long.
WIDE = 4
SIGNS = 128
CHUNK = 127
_HASHES = WIDE + SIGNS // 64
_WIDE_MASK = 2**61 - 1
#: The lower of two lanes of a long; the lowest bit of eight lanes; the lowest and the fifth byte.
_LANE = 2**32 - 1
_EIGHT = 0x0101010101010101
_TWO = 0x000000FF000000FF
#: A paragraph ends after a line feed, or after a full stop, question or exclamation mark and the spaces that follow.
PARAGRAPH_END = r"(?<=\n)|(?<=[.!?] )"


def paragraphs(text: Column) -> Column:
    """The text cut after each paragraph's end; the last may be empty and counts nothing."""
    return F.split(text, PARAGRAPH_END)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hashes(paragraph: Column) -> Column:
    """Independent 64-bit hashes: the seed goes in before the paragraph, so that two that meet under one seed part under others."""
    return F.array(*[F.xxhash64(F.lit(k), paragraph) for k in range(_HASHES)])


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _chunk(found: Column) -> Column:
    """Sums over CHUNK paragraphs at most: their number, the wide lanes, the bit lanes eight a long."""

    def add(total: Column, paragraph: Column) -> Column:
        def with_hashes(h: Column) -> Column:
            out = [total[0] + 1] + [F.pmod(total[1 + k] + h[k].bitwiseAND(F.lit(_WIDE_MASK)), F.lit(2**61)) for k in range(WIDE)]
            for k in range(SIGNS // 8):
                bits = h[WIDE + k // 8]
                out.append(total[1 + WIDE + k] + (F.shiftrightunsigned(bits, k % 8) if k % 8 else bits).bitwiseAND(F.lit(_EIGHT)))
            return F.array(*out)

        return F.when(paragraph == "", total).otherwise(_let(_hashes(paragraph), with_hashes))

    return F.aggregate(found, _zeros(1 + WIDE + SIGNS // 8), add)


def vector(text: Column) -> Column:
    """The vector of a text: number of paragraphs, wide lanes, bit lanes; null for a null text."""

    def add(total: Column, c: Column) -> Column:
        out = [total[0] + c[0]] + [F.pmod(total[1 + k] + c[1 + k], F.lit(2**61)) for k in range(WIDE)]
        for k in range(SIGNS // 2):
            out.append(total[1 + WIDE + k] + F.shiftrightunsigned(c[1 + WIDE + k // 4], 8 * (k % 4)).bitwiseAND(F.lit(_TWO)))
        return F.array(*out)

    def summed(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found), F.lit(CHUNK))
        return F.aggregate(starts, _zeros(1 + WIDE + SIGNS // 2), lambda total, at: _let(_chunk(F.slice(found, at, F.lit(CHUNK))), lambda c: add(total, c)))

    return F.when(text.isNotNull(), _let(paragraphs(text), summed))


def _pair(low: Column, high: Column) -> Column:
    return low.bitwiseAND(F.lit(_LANE)).bitwiseOR(F.shiftleft(high, 32))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LANE))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _apply(a: Column, b: Column, sign: int) -> Column:
    lanes = F.zip_with(F.slice(a, 2 + WIDE, SIGNS // 2), F.slice(b, 2 + WIDE, SIGNS // 2), lambda x, y: _pair(F.pmod(_low(x) + sign * _low(y), F.lit(2**32)), F.pmod(_high(x) + sign * _high(y), F.lit(2**32))))
    return F.concat(F.array(F.pmod(a[0] + sign * b[0], F.lit(2**62)), *[F.pmod(a[k] + sign * b[k], F.lit(2**61)) for k in range(1, 1 + WIDE)]), lanes)


def combine(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs (insertion)."""
    return _apply(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b`` (deletion)."""
    return _apply(a, b, -1)


def combined(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys`` and the sum of all vectors ``column`` of their rows, for collections of any size.

    Longs are added in halves of 32 bits, so 2**31 rows of a key are summed without overflow; rows are added up before
    the shuffle, so a key that most rows have is no hot spot.
    """
    size = 1 + WIDE + SIGNS // 2
    lanes = [F.sum(f(F.get(column, k))).alias(f"{name}{k}") for k in range(size) for name, f in (("l", _low), ("h", _high))]
    added = rows.groupBy(*keys).agg(*lanes)

    def whole(k: int, power: int) -> Column:
        return F.pmod(F.pmod(F.col(f"h{k}"), F.lit(2 ** (power - 32))) * 2**32 + F.pmod(F.col(f"l{k}"), F.lit(2**62)), F.lit(2**power))

    longs = [whole(0, 62), *(whole(k, 61) for k in range(1, 1 + WIDE)), *(_pair(F.col(f"l{k}"), F.col(f"h{k}")) for k in range(1 + WIDE, size))]
    return added.select(*keys, F.array(*longs).alias(column))


def encode(vector: Column) -> Column:
    """The vector as text in hexadecimal: number and wide lanes, then the bit lanes modulo 2**16."""
    short = lambda x: F.shiftleft(_high(x).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF)))
    head = F.transform(F.slice(vector, 1, 1 + WIDE), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.array_join(F.concat(head, F.transform(F.slice(vector, 2 + WIDE, SIGNS // 2), lambda x: F.lpad(F.hex(short(x)), 8, "0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated 2 <a, b> / (<a, a> + <b, b>), 0 to 1; exactly 1 for equal vectors."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda v: _likeness(v["a"], v["b"]))


def _likeness(a: Column, b: Column) -> Column:
    signs = lambda v: F.slice(v, 2 + WIDE, SIGNS // 2)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    low = lambda x, v: 2.0 * _low(x) - v[0]
    high = lambda x, v: 2.0 * _high(x) - v[0]
    cross = total(F.zip_with(signs(a), signs(b), lambda x, y: low(x, a) * low(y, b) + high(x, a) * high(y, b)))
    square = lambda v: total(F.transform(signs(v), lambda x: low(x, v) * low(x, v) + high(x, v) * high(x, v)))
    whole = square(a) + square(b)
    return F.when(a == b, F.lit(1.0)).when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * cross / whole))).otherwise(F.lit(0.0))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (id, tie, ...) with ``part`` and ``last``: ranges of (id, tie), each ended by a copy of the next range's first row.

    The borders are quantiles of the id; an id that takes up several quantiles is a range by itself and is cut into so many
    pieces by its ``tie``. A row finds its range by bisection. One row a range is gathered.
    """
    n = 4 * partitions(rows.sparkSession)
    bounds = sorted(int(b) for b in rows.where("id IS NOT NULL").approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n))
    # an empty or null id sorts before the first border
    hot = {b: bounds.count(b) for b in set(bounds) if bounds.count(b) > 1}
    bounds = sorted({*bounds, *(b + 1 for b in hot if b < 2**63 - 1)})
    pieces = [1, *(hot.get(b, 1) for b in bounds)]
    most = max(pieces)
    if bounds:
        listed, steps = F.array(*map(F.lit, bounds)), [1 << k for k in reversed(range(len(bounds).bit_length()))]
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(listed, a + s - 1) <= F.col("id"), a + s).otherwise(a))
    else:
        at = F.lit(0)
    cut = F.get(F.array(*map(F.lit, pieces)), F.col("at"))
    piece = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * cut).cast("int")
    placed = rows.withColumn("at", at).withColumn("part", F.col("at") * most + F.least(piece, cut - 1)).drop("at")
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "tie")).alias("first")).orderBy("part").collect()
    if not firsts:
        return placed.withColumn("last", F.lit(False))
    order = [r["part"] for r in firsts]
    size = max(order) + 1
    ids, ties, before = [None] * size, [None] * size, [0] * size
    for k, r in enumerate(firsts):
        ids[r["part"]], ties[r["part"]], before[r["part"]] = r["first"]["id"], r["first"]["tie"], order[k - 1]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("part"))
    is_first = F.col("id").eqNullSafe(of(ids, "long")) & F.col("tie").eqNullSafe(of(ties, "long"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    copy = F.struct(of(before, "int").alias("part"), F.lit(True).alias("last"))
    return placed.withColumn("to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).withColumn("part", F.col("to.part")).withColumn("last", F.col("to.last")).drop("to")


def edited_pairs(docs: DataFrame, *more: Column) -> DataFrame:
    """id, text, next_id, edited, with ``more`` columns of each row and, named next_..., of the next.

    The next row is that with the next id, then hash of the text, then text; after the last comes the first. ``edited`` is
    the text with its second half replaced by the beginning of the next text. Each text is shuffled once; see ``_dealt``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"), *more)
    names = [c for c in rows.columns if c != "tie"]
    order = Window.partitionBy("part").orderBy("last", F.asc_nulls_first("id"), "tie", "text")
    led = _dealt(rows).select("last", *names, *[F.lead(c).over(order).alias(f"next_{c}") for c in names]).where("NOT last").drop("last")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.substring("next_text", F.lit(1), half))
    return led.withColumn("edited", edited).drop("next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    A null text is empty. The next document is the next row by id (null before all), then hash of the text, then text; rows that
    repeat an id are documents of their own. A single document is its own next. Other columns are not read.
    """
    pairs = edited_pairs(docs, vector(F.col("text")).alias("own"))
    pairs = pairs.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", vector(F.col("edited")).alias("changed"))
    return pairs.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", encode(F.col("own")).alias("fingerprint"), encode(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
