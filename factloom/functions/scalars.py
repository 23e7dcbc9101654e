"""Scalar functions over keys, URIs, labels and literals, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key syntax, sub-namespaces of reified triples, languages, the default language.
SHORT_KEY = r"^((Ia?)|(Ra?)|(S))(\d+)$"
SUB_NAMESPACES = ("STATEMENTS", "PREDICATES", "QUALIFIERS")
LANGUAGES = ("en", "de", "fr", "it", "es")
DEFAULT_LANGUAGE = "en"
PALETTE = ("blue", "orange", "green", "red", "purple", "brown", "pink", "gray", "olive", "cyan")


def underscored(text: Column) -> Column:
    """Spaces and dashes as underscores."""
    return F.translate(text, " -", "__")


def make_uri(base: Column, key: Column) -> Column:
    return F.concat(base, F.lit("#"), key)


def uri_base(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def uri_key(uri: Column) -> Column:
    return F.substring_index(uri, "#", -1)


def sub_uri(uri: Column, kind: str) -> Column:
    """The URI in one of the sub-namespaces."""
    return F.regexp_replace(uri, "#", f"/{kind}#")


def valid_base(uri: Column) -> Column:
    """A base has a colon and a slash but neither a hash nor a double underscore."""
    return uri.contains(":") & uri.contains("/") & ~uri.contains("#") & ~uri.contains("__")


def valid_key(key: Column) -> Column:
    return key.rlike(SHORT_KEY)


def valid_uri(uri: Column) -> Column:
    return valid_base(uri_base(uri)) & (F.size(F.split(uri, "#")) == 2) & valid_key(uri_key(uri))


def key_number(key: Column) -> Column:
    return F.regexp_extract(key, r"(\d+)$", 1).cast("long")


def key_kind(key: Column) -> Column:
    """I, R or S; null for other texts."""
    return F.when(valid_key(key), F.substring(key, 1, 1))


def is_auto(key: Column) -> Column:
    return F.substring(key, 2, 1) == "a"


def parse_key(text: Column) -> Column:
    """prefix, key, label and language of any of the spellings: key, key__label, prefix__key__label, key["label"], with __xx.

    The language is one of LANGUAGES at the very end. Fields that are not there are null.
    """
    parts = r'^(?:([A-Za-z]\w*?)__)?([IR]a?\d+)(?:__(\w+?))??(?:\["([^"]*)"\])?(?:__(' + "|".join(LANGUAGES) + r"))?$"
    get = lambda k: F.nullif(F.regexp_extract(text, parts, k), F.lit(""))
    return F.struct(get(1).alias("prefix"), get(2).alias("key"), F.coalesce(get(3), get(4)).alias("label"), get(5).alias("lang"))


def literal_key(kind: Column, lex: Column, lang: Column, *, graph: bool = True) -> Column:
    """One string for equal literals: for patterns true, 1 and 1.0 are one number; for SPARQL the type tells them apart."""
    number = F.when(F.lower(lex) == "true", F.lit(1.0)).when(F.lower(lex) == "false", F.lit(0.0))
    numeric = kind.isin("bool", "int", "float")
    if graph:
        value = F.coalesce(F.when(kind == "bool", number), lex.try_cast("double"))
        return F.when(numeric, F.concat(F.lit("n:"), value.cast("string"))).otherwise(F.concat_ws("", F.lit("s:"), lex, F.when(lang.isNotNull(), F.concat(F.lit("@"), lang))))
    return F.concat_ws("", kind, F.lit(":"), lex, F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)))


def ensure_language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(DEFAULT_LANGUAGE))


def inline_latex(text: Column) -> Column:
    r"""Dollar-delimited formulas in the form \( ... \)."""
    return F.regexp_replace(text, r"\$([^$]*)\$", r"\\($1\\)")


def escaped(text: Column) -> Column:
    """Text for HTML: the characters that it gives a meaning, as entities."""
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def entity_html(label: Column, key: Column, uri: Column) -> Column:
    return F.format_string('<a href="/e/%s">%s [&quot;%s&quot;]</a>', F.url_encode(uri), escaped(key), escaped(label))


def literal_html(text: Column) -> Column:
    return F.format_string('<span class="literal">&quot;%s&quot;</span>', escaped(text))


def colour_of_number(n: Column) -> Column:
    """Palette colour of a relation's number."""
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(n - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def colour_of_item(key: Column) -> Column:
    return F.when(is_auto(key), "gray").otherwise("black")


def render(template: Column, bindings: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its binding."""
    out = template
    for name, value in bindings.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def node_kind(o_kind: Column, o_type: Column) -> Column:
    return F.when(o_kind == "E", "entity").when(o_type == "str", "string").otherwise(F.concat(F.lit("literal:"), o_type))


def map_of(pairs: dict[str, Column]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in pairs.items())) if pairs else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))


def label_segments(label: Column, width: int) -> Column:
    """The label in pieces of at most ``width`` characters, each as long as can be, cut behind a space, dash, underscore or colon.

    Piece by piece in one regular expression: a longest run that ends at a break or at the end, else ``width``
    characters of a word that has no break. Spaces at the cuts go.
    """
    pieces = F.regexp_extract_all(label, F.lit(rf"(?:.{{1,{width}}}$|.{{0,{width - 1}}}[-_: ]|.{{{width}}})"), F.lit(0))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
