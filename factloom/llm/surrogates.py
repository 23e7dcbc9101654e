"""Surrogates for personal data: keyed, type-consistent, the same for each mention of an entity, distinct for others.

Detected are e-mail addresses in any script, international and national phone numbers, card, account (IBAN) and social
security numbers, IPv4 and IPv6 addresses, hexadecimal secrets, keys of well-known forms, secret access keys and names
behind a title; where a text has a name behind a title, its words are found in the rest of the text without one, too. An
entity's canonical form (letters in lower case, digits without their separators, a North American number without its
country code, an IPv6 address in full) names it, so mentions in other spellings corefer. A name is taken apart: family
and given name are entities of their own, so ``Mr. Kern`` and ``Mr. John Kern`` keep one family name; particles stay, an
initial gets another letter. A surrogate takes letters and digits from a keyed SHA-256 stream and keeps the format: letter
case, script, separators, lengths, a phone's country code or leading zero, an address's last label, a key's prefix, valid
octets, zero groups, a card's first digit, an account's country, check digits if the old ones were right; a name
keeps its title, and its surrogate, built from syllables, has the name's script and, by the title, its gender. Behind a
title without gender (Dr, Prof) a given name has a surrogate of its own.

Distinctness: the surrogates of all entities are compared with one another and with the entities themselves; those
that meet another take the next stream, again until none do. Names, phones and e-mail addresses grow by letters or digits
when their form runs out, so only forms that are used up end in a ``SurrogateError`` (after MOST_SALTS). Only salted
entities need a look-up when texts are rewritten: all other surrogates are computed where they stand, without a join.
Spark SQL functions only.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Streams that an entity may try before it is an error; slices of the mentions of one entity when salts are looked up.
MOST_SALTS = 60
SLICES = 16

_FEMALE_TITLES = "Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Госпожа|Κυρία"
_MALE_TITLES = "Mr|Monsieur|Herr|Señor|Sr|Господин|Κύριος"
_OTHER_TITLES = "Dr|Prof"
# scripts without spaces between words (Han, kana, Thai), as ranges: script properties are looked up for each character
_WIDE = r"\u0E00-\u0E7F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
_WORD = rf"A-Za-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{_WIDE}]]"
_LABEL = rf"(?:[-{_WORD}]++|[{_WIDE}]++)"
#: A word of a name, and what may stand before the family name.
_PIECE = r"\p{Lu}(?:[\p{L}\p{M}]++(?:['’-]\p{L}[\p{L}\p{M}]++)*+|['’]\p{L}[\p{L}\p{M}]++)"
_PARTICLE = "van|von|de|der|den|del|della|di|da|du|la|le|el|al|bin|ibn|ter|ten|zu"
#: Detectors, all anchored where a run of their characters begins, so that no text is searched twice.
PATTERNS = {
    "email": rf"(?:(?<![-._%+{_WORD}])[-._%+{_WORD}]{{1,64}}+|(?<![{_WIDE}])[{_WIDE}]{{1,64}}+)@{_LABEL}(?:\.{_LABEL}){{1,20}}+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abprs]-[0-9A-Za-z-]{10,64})(?![0-9A-Za-z_-])",
    "access_key": r"(?<![0-9A-Za-z/+])(?=[0-9A-Za-z/+]{0,39}[0-9])(?=[0-9A-Za-z/+]{0,39}[A-Z])(?=[0-9A-Za-z/+]{0,39}[a-z])[0-9A-Za-z/+]{40}(?![0-9A-Za-z/+=])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:(?=[A-Fa-f]{0,3}[0-9])[0-9A-Fa-f]{3,4}|[Ff][CcDd][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z]|:[0-9A-Fa-f:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "local_phone": r"(?<![0-9A-Za-z+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}"
    r"|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}|0[1-9](?:[ .][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /-][0-9]{5,8})(?![0-9A-Za-z]|[ .-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_FEMALE_TITLES}|{_MALE_TITLES}|{_OTHER_TITLES})\.? (?:\p{{Lu}}\. ?){{0,3}}(?:(?:{_PARTICLE}) ){{0,3}}{_PIECE}(?: (?:\p{{Lu}}\. ?){{0,2}}(?:(?:{_PARTICLE}) ){{0,3}}{_PIECE})?",
}
#: A word that may be a name of which the text has a title elsewhere.
UNTITLED = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_PIECE}(?![\p{{L}}\p{{M}}\p{{N}}])"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A phone's country code: the assigned ones of one and two digits, all others have three. It needs no separator behind it.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Stretches that only a secret or key without a digit has, and what stays of a key.
_BARE_SECRET = "[a-f]{32}|[A-F]{32}|AKIA|gh[pousr]_|sk-[A-Za-z]{20}|xox[abprs]-"
_KEY_PREFIX = r"^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)"


def may_hold(text: Column) -> Column:
    """False only for texts that hold no entity: every kind has a digit, an at sign, a title or a stretch of hexadecimal letters."""
    out = text.contains("@") | text.rlike("[0-9]") | text.rlike(_BARE_SECRET)
    for title in "|".join((_FEMALE_TITLES, _MALE_TITLES, _OTHER_TITLES)).split("|"):
        out = out | text.contains(title + " ") | text.contains(title + ". ")
    return out


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty array where none can be."""
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Onsets and vowels of syllables by script; endings of family names, and of given names by gender.
_SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v w br cl dr fl gr st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ц ч ш".split(), "а е и о у".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο ω".split()),
}
_ENDINGS = {
    ("latin", "family"): "son ner man berg ley ton sen wood".split(),
    ("latin", "f"): "na lia rina bella".split(),
    ("latin", "m"): "ro rius lan bert".split(),
    ("cyrillic", "family"): "нко щук вых ских".split(),
    ("cyrillic", "f"): "на лия рина".split(),
    ("cyrillic", "m"): "рий лан мир".split(),
    ("greek", "family"): "νίου ράκη λίδη".split(),
    ("greek", "f"): "να λία ρη".split(),
    ("greek", "m"): "νος λης ρας".split(),
}


_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Kinds of the parts of a name that have surrogates of their own.
NAMES = ("family", "given-f", "given-m", "given-n")


class SurrogateError(ValueError):
    """An entity that has no surrogate of its own in its format."""


def kind(entity: Column) -> Column:
    """Which detector a found entity belongs to."""
    out: Column = F.lit("name")
    for name in ("card", "ssn", "local_phone", "phone", "ip", "ip6", "iban", "access_key", "token", "secret", "email"):
        out = F.when(entity.rlike("^(?:" + PATTERNS[name] + ")$"), name).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _groups(e: Column) -> Column:
    """The eight groups of an IPv6 address, in lower case and without leading zeros (an empty one is zero)."""
    side = lambda n: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(e), "::"), n), F.lit("")), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), 8 - F.size(side(0)) - F.size(side(1)))
    return F.transform(F.concat(side(0), gap, side(1)), lambda g: F.regexp_replace(g, "^0+", ""))


def _canon(e: Column, k: Column) -> Column:
    """Kind and bare letters and digits of a piece: equal for all spellings of one entity."""
    american = (k == "phone") & _digits(e).rlike("^1[2-9][0-9]{9}$") & e.startswith("+1")
    value = (
        F.when(american, F.substring(_digits(e), 2, 10))
        .when(k == "phone", F.concat(F.lit("+"), _digits(e)))
        .when(k.isin("card", "ssn", "local_phone"), _digits(e))
        .when(k == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(k == "ip6", F.array_join(_groups(e), ":"))
        .when(k == "access_key", e)
        .otherwise(F.lower(e))
    )
    return F.concat(F.when(k == "local_phone", "phone").otherwise(k), F.lit(":"), value)


def atoms(entity: Column) -> Column:
    """(canon, piece, kind) of what is replaced: the entity itself, or the parts of a name.

    A given name's canonical form has the gender of the title: ``given-f``, ``given-m``, or ``given-n`` without one.
    The last word is the family name. Particles (``keep``) and initials are no entities and have no distinct surrogates.
    """

    def of(x: Column) -> Column:
        e, k = x["e"], x["k"]
        title = F.regexp_replace(F.regexp_extract(e, r"^\S+", 0), r"\.$", "")
        gender = F.when(title.isin(_FEMALE_TITLES.split("|")), "f").when(title.isin(_MALE_TITLES.split("|")), "m").otherwise("n")
        parts = F.split(F.regexp_replace(F.regexp_replace(e, r"^\S+ ", ""), r"(?<= |^)(\p{Lu}\.)(?=\S)", "$1 "), " ")
        what = lambda p, i: F.when(i == F.size(parts) - 1, "family").when(p.rlike(r"^\p{Lu}\.$"), "initial").when(p.rlike(r"^\p{Ll}"), "keep").otherwise(F.concat(F.lit("given-"), gender))
        named = F.transform(parts, lambda p, i: F.struct(p.alias("piece"), what(p, i).alias("kind")))
        whole = F.array(F.struct(e.alias("piece"), k.alias("kind")))
        return F.transform(F.when(k == "name", named).otherwise(whole), lambda a: F.struct(_canon(a["piece"], a["kind"]).alias("canon"), a["piece"].alias("piece"), a["kind"].alias("kind")))

    return let(F.struct(entity.alias("e"), kind(entity).alias("k")), of)


def plain(canon: Column) -> Column:
    """What must differ between entities: the canonical form; that of a given name without its gender."""
    return F.regexp_replace(canon, "^given-.:", "given:")


def _pick(names: list[str], stream: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % len(names) + 1)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    turned = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    each = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10


def _letters(e: Column, k: Column, stream: Column) -> Column:
    """The piece with its letters and digits from the stream, but for what its format fixes."""
    front = (
        F.when(k == "phone", F.length(F.regexp_extract(e, COUNTRY, 0)))
        .when(k == "local_phone", F.length(F.regexp_extract(e, r"^\(?0", 0)))
        .when(k == "token", F.length(F.regexp_extract(e, _KEY_PREFIX, 0)))
        .when(k == "card", 1)
        .when(k == "iban", 4)
        .otherwise(0)
    )
    top = F.when(k == "email", F.length(F.regexp_extract(e, r"\.[^.]+$", 0))).otherwise(0)

    def swapped(x: Column, fixed: Column) -> Column:
        i, c = x["i"], x["c"]
        value = F.conv(F.substring(stream, F.pmod(2 * x["at"], F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
        hexed = F.substring(stream, F.pmod(x["at"], F.lit(128)) + 1, F.lit(1))
        letters = F.when(c.rlike(r"\p{IsCyrillic}"), _LETTERS["cyrillic"]).when(c.rlike(r"\p{IsGreek}"), _LETTERS["greek"]).otherwise(_LETTERS["latin"])
        low = F.substring(letters, value % F.length(letters) + 1, F.lit(1))
        return (
            F.when((i <= fixed["front"]) | (i > fixed["end"]) | ~c.rlike(r"[\p{L}\p{N}]"), c)
            .when(k == "secret", F.when(fixed["upper"], F.upper(hexed)).otherwise(hexed))
            .when(c.rlike(r"\p{N}"), (value % 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.upper(low))
            .otherwise(low)
        )

    def joined(fixed: Column) -> Column:
        # a character's number in the stream counts letters and digits behind the fixed front alone, so neither separators nor a country code shift it
        chars = F.transform(
            F.sequence(F.lit(1), F.length(e)),
            lambda i: F.struct(i.alias("i"), F.substring(e, i, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substring(e, fixed["front"] + 1, F.greatest(i - fixed["front"], F.lit(0))), r"[^\p{L}\p{N}]", "")).alias("at")),
        )
        return F.array_join(F.transform(chars, lambda x: swapped(x, fixed)), "")

    made = let(F.struct(front.alias("front"), (F.length(e) - top).alias("end"), (e == F.upper(e)).alias("upper")), joined)
    right = (k == "card") & (_luhn(_digits(e)) == 0)
    check = lambda m: F.concat(F.substring(m, F.lit(1), F.length(m) - 1), ((10 - _luhn(F.concat(F.regexp_replace(F.substring(m, F.lit(1), F.length(m) - 1), "[^0-9]", ""), F.lit("0")))) % 10).cast("string"))
    account = (k == "iban") & (_mod97(e) == 1)
    spelled = lambda m: F.concat(F.substring(m, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), F.substring(m, F.lit(5), F.length(m))))).cast("string"), 2, "0"), F.substring(m, F.lit(5), F.length(m)))
    return F.when(right, let(made, check)).when(account, let(made, spelled)).otherwise(made)


def _mod97(account: Column) -> Column:
    """An account number's remainder modulo 97: the first four characters go to the end, letters count from 10."""
    bare = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _long_address(e: Column, stream: Column) -> Column:
    """An IPv6 address in its spelling: zero groups stay, the others get as many digits, the first keeps its first one."""

    def group(g: Column, at: Column) -> Column:
        bare = F.regexp_replace(F.lower(g), "^0+", "")
        lead = F.when(at == 0, F.substring(bare, 1, 1)).otherwise(F.translate(F.substring(stream, 4 * at + 1, F.lit(1)), "0", "7"))
        new = F.concat(F.repeat(F.lit("0"), F.length(g) - F.length(bare)), lead, F.substring(stream, 4 * at + 2, F.length(bare) - 1))
        return F.when(bare == "", g).when((e == F.upper(e)) & (e != F.lower(e)), F.upper(new)).otherwise(new)

    side = lambda n, front: F.array_join(F.transform(F.filter(F.split(F.get(F.split(e, "::"), n), ":"), lambda g: g != ""), lambda g, i: group(g, i + front)), ":")
    right = 8 - F.size(F.filter(F.split(F.coalesce(F.get(F.split(e, "::"), 1), F.lit("")), ":"), lambda g: g != ""))
    return F.when(e.contains("::"), F.concat(side(0, F.lit(0)), F.lit("::"), side(1, right))).otherwise(side(0, F.lit(0)))


def _address(stream: Column) -> Column:
    octet = lambda a: F.conv(F.substring(stream, a, 2), 16, 10)
    return F.concat_ws(".", (octet(1).cast("int") % 223 + 1).cast("string"), octet(3), octet(5), (octet(7).cast("int") % 254 + 1).cast("string"))


def _syllables(stream: Column, salt: Column, onsets: list[str], vowels: list[str]) -> Column:
    """What a name gets more as its salt rises: a syllable with each sixth."""
    one = lambda n: let(F.sha2(F.concat(stream, n.cast("string")), 256), lambda t: F.concat(_pick(onsets, t, 1), _pick(vowels, t, 5)))
    return F.when(salt > 5, F.array_join(F.transform(F.sequence(F.lit(1), F.floor(salt / 6).cast("int")), one), "")).otherwise("")


def _name(piece: Column, k: Column, stream: Column, salt: Column) -> Column:
    """A name of the piece's script: syllables, one more with each sixth salt, and an ending by kind and gender."""
    script = F.when(piece.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(piece.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    even = F.conv(F.substring(stream, 9, 2), 16, 10).cast("int") % 2 == 0
    group = F.when(k == "family", "family").when((k == "given-f") | ((k == "given-n") & even), "f").otherwise("m")

    def named(x: Column) -> Column:
        out: Column = F.lit(None).cast("string")
        for s, (onsets, vowels) in _SYLLABLES.items():
            syllable = lambda n, onsets=onsets, vowels=vowels: F.concat(_pick(onsets, stream, 11 + 8 * n), _pick(vowels, stream, 15 + 8 * n))
            end: Column = F.lit(None).cast("string")
            for g in ("family", "f", "m"):
                end = F.when(x["group"] == g, _pick(_ENDINGS[(s, g)], stream, 51)).otherwise(end)
            third = F.when(x["group"] == "family", syllable(2)).otherwise("")
            out = F.when(x["script"] == s, F.concat(syllable(0), syllable(1), third, _syllables(stream, salt, onsets, vowels), end)).otherwise(out)
        return let(out, lambda o: F.when((F.length(piece) > 1) & (piece == F.upper(piece)), F.upper(o)).otherwise(F.initcap(o)))

    return let(F.struct(script.alias("script"), group.alias("group")), named)


def replaced(atom: Column, salt: Column, key: str) -> Column:
    """The replacement of one atom's piece under a key and a salt (0 unless a collision was found)."""

    def made(x: Column) -> Column:
        e, k, stream, salt = x["piece"], x["kind"], x["stream"], x["salt"]
        # addresses of few or no letters run out of others in their format: from the fourth salt on six more go before them
        more = F.when((k == "email") & (salt > 3), F.translate(F.substring(stream, 20, 6), "0123456789", "ghijklmnop")).otherwise("")
        longer = F.when(k.isin("phone", "local_phone") & (salt > 11), F.translate(F.substring(stream, F.lit(40), F.floor(salt / 12).cast("int")), "abcdef", "012345")).otherwise("")
        return (
            F.when(k == "ip", _address(stream))
            .when(k == "ip6", _long_address(e, stream))
            .when(k.isin(*NAMES), _name(e, k, stream, salt))
            .when(k == "keep", e)
            .when(k == "initial", F.concat(F.translate(F.upper(F.substring(F.translate(stream, "0123456789", "ghijklmnop"), 1, 1)), "Q", "R"), F.lit(".")))
            .otherwise(F.concat(more, _letters(e, k, stream), longer))
        )

    secret = hashlib.sha256(key.encode()).hexdigest()
    seed = F.concat(F.lit(secret + "|"), salt.cast("string"), F.lit("|"), atom["canon"])
    streamed = lambda s: let(F.struct(atom["piece"].alias("piece"), atom["kind"].alias("kind"), F.concat(F.sha2(s, 256), F.sha2(F.concat(s, F.lit("+")), 256)).alias("stream"), salt.alias("salt")), made)
    return let(seed, streamed)


def surrogate(entity: Column, salt_of: Callable[[Column], Column], key: str) -> Column:
    """The replacement of one entity; ``salt_of`` gives the salt of a canonical form."""

    def joined(e: Column) -> Column:
        new = F.array_join(F.transform(atoms(e), lambda a: replaced(a, salt_of(a["canon"]), key)), " ")  # initials are set apart by spaces
        return F.when(kind(e) == "name", F.concat(F.regexp_extract(e, r"^\S+ ", 0), new)).otherwise(new)

    return let(entity, joined)


def collisions(found: DataFrame, key: str) -> DataFrame | None:
    """(canon, salt) of the atoms whose surrogate under salt 0 meets another surrogate or a real entity.

    ``found`` has distinct ``canon``, each with one ``piece`` and its ``kind``; a surrogate's canonical form depends on
    the canonical form alone, so one spelling stands for all. None if no two meet. Of those that share a surrogate the
    least canonical form keeps it; the others go on to the next salt. ``SurrogateError`` if MOST_SALTS are not enough.
    """

    new = replaced(F.struct("canon", "piece", "kind"), F.col("salt"), key)

    def under(rows: DataFrame) -> DataFrame:
        return rows.withColumn("made", new).withColumn("new", plain(_canon(F.col("made"), F.col("kind")))).drop("made")

    first = written(under(found.withColumn("salt", F.lit(0))), "surrogates")
    real = first.select(plain(F.col("canon")).alias("new"))
    taken, settled, now = real, [], first
    while True:
        keeper = now.groupBy("new").agg(F.min("canon").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = taken.distinct().withColumn("met", F.lit(True))
        clashes = F.coalesce((F.col("keeper") != F.col("canon")) | F.col("met"), F.lit(False))
        fate = now.join(keeper, "new", "left").join(met, "new", "left").withColumn("clashes", clashes).drop("keeper", "met")
        if now is first:
            # most surrogates of the first round stand; all stay taken, so later rounds read one column of them
            fate = written(fate.where("clashes"), "clashes")
            taken = real.unionByName(first.select("new"))
        else:
            fate = written(fate, "clashes")
            settled.append(fate.where("NOT clashes").select("canon", "salt"))
            taken = taken.unionByName(fate.where("NOT clashes").select("new"))
        worst = fate.where("clashes").orderBy(F.desc("salt"), "canon").limit(1).collect()
        if not worst:
            break
        if worst[0]["salt"] >= MOST_SALTS:
            raise SurrogateError(f"no surrogate of its own for {worst[0]['canon']}")
        again = fate.where("clashes").select("canon", "piece", "kind", (F.col("salt") + 1).alias("salt"))
        now = written(under(again), "surrogates")
    return functools.reduce(DataFrame.unionByName, settled) if settled else None


def _untitled(titled: Column, salt_of: Callable[[Column], Column], key: str) -> Column:
    """Map from the words of a text's names, in lower case, to their surrogates; of a word's kinds family name comes first."""
    words = F.filter(F.flatten(F.transform(titled, atoms)), lambda a: a["kind"].isin(*NAMES))
    words = F.transform(words, lambda a: F.struct(F.lower(a["piece"]).alias("word"), a["kind"].alias("kind"), a["canon"].alias("canon"), F.initcap(a["piece"]).alias("piece")))
    once = let(F.array_sort(F.array_distinct(words)), lambda ws: F.filter(ws, lambda w, i: F.coalesce(F.get(ws, i - 1)["word"] != w["word"], F.lit(True))))
    return F.map_from_entries(F.transform(once, lambda w: F.struct(w["word"], replaced(w, salt_of(w["canon"]), key))))


def replace_entities(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and a column ``entities_replaced`` (long), which replaces one of that name.

    Null text stays null and counts 0; rows with equal or null ids are rewritten alike and separately, repeated rows
    alike; an empty table gives an empty one. All other columns stay, whatever their names.
    """
    text, names = F.col(f"`{text_col}`"), [c for c in docs.columns if c.lower() != "entities_replaced"]
    every = F.explode(F.array_distinct(F.flatten(F.transform(entities(text), atoms)))).alias("atom")
    found = docs.where(may_hold(text)).select(every).select("atom.*").where("kind NOT IN ('keep', 'initial')").groupBy("canon").agg(F.min(F.struct("kind", "piece")).alias("one"))
    salts = collisions(found.select("canon", "one.piece", "one.kind"), key)
    spots, hashed, table, named, parts = fresh(docs.columns, "spots", "hashed", "salts", "named", "parts")
    rows = docs.withColumn(spots, entities(text))
    if salts is None:
        salt_of = lambda canon: F.lit(0)
    else:
        # only mentions of salted entities leave their row, each document's once; what comes back is their number and salt
        mine = docs.where(may_hold(text)).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), F.flatten(F.transform(entities(text), atoms)).alias("atoms"))
        mine = mine.select("id", "hash", F.explode(F.array_distinct("atoms")).alias("atom")).select("id", "hash", F.col("atom.canon").alias("canon"), F.pmod("hash", F.lit(SLICES)).alias("slice"))
        sliced = salts.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
        back = mine.join(sliced, ["canon", "slice"]).groupBy("id", "hash").agg(F.map_from_entries(F.collect_set(F.struct("canon", "salt"))).alias(table))
        back = back.select(F.col("id").alias(f"{table}_id"), F.col("hash").alias(f"{table}_hash"), table)
        rows = rows.withColumn(hashed, F.xxhash64(text))
        rows = rows.join(back, rows[f"`{id_col}`"].eqNullSafe(back[f"{table}_id"]) & (rows[hashed] == back[f"{table}_hash"]), "left")
        salt_of = lambda canon: F.coalesce(F.try_element_at(F.col(table), canon), F.lit(0))
    new = F.transform(F.col(spots), lambda e: surrogate(e, salt_of, key))
    titled = F.filter(F.col(spots), lambda e: kind(e) == "name")
    rows = rows.withColumn(named, F.when(F.size(titled) > 0, _untitled(titled, salt_of, key)))
    known = lambda w: F.try_element_at(F.col(named), F.lower(w))
    cased = lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(known(w))).otherwise(known(w))
    told = lambda p: F.regexp_extract_all(p, F.lit(UNTITLED), F.lit(0))
    again = lambda p: _woven(F.split(p, UNTITLED, -1), F.transform(told(p), lambda w: F.coalesce(cased(w), w)))
    rows = rows.withColumn(parts, F.when(F.size(F.col(spots)) > 0, F.split(text, ANY, -1)))
    joined = _woven(F.when(F.col(named).isNotNull(), F.transform(F.col(parts), again)).otherwise(F.col(parts)), new)
    out = F.when(F.size(F.col(spots)) > 0, joined).otherwise(text)
    untitled = F.aggregate(F.col(parts), F.lit(0), lambda n, p: n + F.size(F.filter(told(p), lambda w: known(w).isNotNull())))
    n = F.greatest(F.coalesce(F.size(F.col(spots)), F.lit(0)), F.lit(0)) + F.when(F.col(named).isNotNull(), untitled).otherwise(0)
    return rows.select(*[out.alias(c) if c == text_col else rows[f"`{c}`"] for c in names], n.cast("long").alias("entities_replaced"))


def _woven(between: Column, new: Column) -> Column:
    """Stretches of text with the replacements that stand behind them."""
    return F.array_join(F.flatten(F.zip_with(between, new, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")
