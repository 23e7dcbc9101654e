"""A SPARQL subset, parsed here and lowered to DataFrames.

SELECT [DISTINCT] with expressions and aggregates, ASK, CONSTRUCT; basic graph patterns with predicate variables,
FILTER, OPTIONAL, UNION, MINUS, BIND, VALUES, FILTER (NOT) EXISTS, sub-SELECT, GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET;
property paths ^ / | * + ?; blank nodes, also with properties in brackets. Matches are homomorphisms over distinct triples and keep their multiplicity.
A URI is written as prefix:name or <uri>; names stand for themselves (``:name`` is the entity ``name``) unless their
prefix is declared with another base.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import reachable, transitive_closure
from ..operators.pattern import sliced_join
from .model import KB, constants


class SparqlError(ValueError):
    """A query that cannot be read; the message shows it with line numbers."""


_TOKEN = re.compile(
    r"""\#[^\n]*|(?P<uri><[^>\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+)?)|(?P<num>[+-]?\d+(?:\.\d+)?)"""
    r"""|(?P<name>[A-Za-z_][\w-]*?:[\w.-]*(?:\["[^"]*"\])?|:[\w.-]+(?:\["[^"]*"\])?)|(?P<word>[A-Za-z_]\w*)|(?P<op>\|\||&&|!=|<=|>=|[{}()\[\].,;*+?/|^=<>!-])"""
)


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise _error(text, at, f"cannot read {text[at : at + 12]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return out


def _error(text: str, at: int, what: str) -> SparqlError:
    line = text.count("\n", 0, at) + 1
    shown = "\n".join(f"{n:4d} {x}" for n, x in enumerate(text.split("\n"), 1))
    return SparqlError(f"line {line}: {what}\n{shown}")


def checked(text: str, labels: dict[str, str]) -> str:
    """The query with keys like ``:R16__has_property`` reduced to ``:R16`` after a look at the label."""

    def plain(m: re.Match) -> str:
        key, label = m.groups()
        if key in labels and labels[key].replace(" ", "_").replace("-", "_").lower() != label.lower():
            raise SparqlError(f"{key} is labelled {labels[key]!r}, not {label!r}")
        return f":{key}"

    return re.sub(r":([IR]a?\d+)__(\w+)", plain, text)


@dataclass
class _Group:
    """What stands in braces, in order."""

    triples: list[tuple] = field(default_factory=list)
    steps: list[tuple] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0
        self.prefixes: dict[str, str] = {}
        self.fresh = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead][:2] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def word(self, *words: str) -> str | None:
        if self.peek()[0] == "word" and self.peek()[1].upper() in words:
            return self.next()[1].upper()
        return None

    def op(self, *ops: str) -> str | None:
        return self.next()[1] if self.peek()[0] == "op" and self.peek()[1] in ops else None

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"expected {op}")

    def fail(self, what: str) -> None:
        at = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        raise _error(self.text, at, what)

    def new(self) -> str:
        self.fresh += 1
        return f"__{self.fresh}"

    # terms are ("var", name), ("uri", uri) or ("lit", key)
    def name(self, value: str) -> str:
        prefix, _, local = value.partition(":")
        return self.prefixes.get(prefix, "") + re.sub(r'\["[^"]*"\]$', "", local)

    def term(self) -> tuple[str, str]:
        kind, value = self.next()
        if kind == "var":
            return "var", value[1:]
        if kind == "uri":
            return "uri", value[1:-1]
        if kind == "name" and value.startswith("_:"):
            return "var", f"__{value[2:]}"  # a blank node is a variable that no one can name
        if kind == "name":
            return "uri", self.name(value)
        if kind == "num":
            return "lit", f"n:{float(value)}"
        if kind == "str":
            text, _, lang = value.rpartition('"')
            return "lit", "s:" + re.sub(r"\\(.)", r"\1", text[1:]) + lang
        if kind == "word" and value.lower() in ("true", "false"):
            return "lit", f"n:{float(value.lower() == 'true')}"
        self.at -= 1
        self.fail("expected a term")

    def path(self):
        out = [self.sequence()]
        while self.op("|"):
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence(self):
        out = [self.step()]
        while self.op("/"):
            out.append(self.step())
        return out[0] if len(out) == 1 else ("seq", out)

    def step(self):
        if self.op("^"):
            return ("inverse", self.step())
        if self.op("!"):
            several, out = self.op("("), [self.term()[1]]
            while several and self.op("|"):
                out.append(self.term()[1])
            if several:
                self.need(")")
            return ("not", out)
        if self.op("("):
            out = self.path()
            self.need(")")
        else:
            out = self.term()
        while (mark := self.op("*", "+", "?")) is not None:
            out = ("repeat", out, mark)
        return out

    def group(self) -> _Group:
        self.need("{")
        out = _Group()

        def flush() -> None:
            if out.triples:
                out.steps.append(("triples", out.triples))
                out.triples = []

        while not self.op("}"):
            word = self.word("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "SELECT")
            if word == "FILTER":
                negated = bool(self.word("NOT"))
                if self.word("EXISTS"):
                    out.steps.append(("exists", self.group(), negated, True))
                else:
                    out.steps.append(("filter", self.expression()))
            elif word in ("OPTIONAL", "MINUS"):
                flush()
                out.steps.append((word.lower(), self.group()))
            elif word == "BIND":
                flush()
                self.need("(")
                e = self.expression()
                self.word("AS")
                out.steps.append(("bind", e, self.term()[1]))
                self.need(")")
            elif word == "VALUES":
                flush()
                out.steps.append(self.values())
            elif self.peek() == ("op", "{"):
                flush()
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                out.steps.append(("union", branches))
            elif word == "SELECT":
                self.at -= 1
                flush()
                out.steps.append(("select", self.select()))
            elif not self.op("."):
                self.triples(out)
        flush()
        return out

    def values(self) -> tuple:
        names, rows = [], []
        several = self.op("(")
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not several:
                break
        if several:
            self.need(")")
        self.need("{")
        while not self.op("}"):
            if several:
                self.need("(")
                rows.append(tuple(self.term()[1] for _ in names))
                self.need(")")
            else:
                rows.append((self.term()[1],))
        return ("values", names, rows)

    def node(self, out: _Group) -> tuple[str, str]:
        """A term, or a variable of its own for a blank node, whose properties in brackets become triples."""
        if not self.op("["):
            return self.term()
        blank = ("var", self.new())
        if not self.op("]"):
            self.properties(blank, out)
            self.need("]")
        return blank

    def triples(self, out: _Group) -> None:
        blank = self.peek() == ("op", "[")
        s = self.node(out)
        if not (blank and self.peek() in (("op", "."), ("op", "}"))):
            self.properties(s, out)

    def properties(self, s: tuple[str, str], out: _Group) -> None:
        while True:
            p = self.path()
            while True:
                o = self.node(out)
                out.triples.append((s, p, o))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            if self.peek() in (("op", "."), ("op", "}"), ("op", "]")):
                return

    # expressions are ("var", n), ("lit", k), ("uri", u), (op, a, b), ("call", name, args, distinct)
    def expression(self, level: int = 0):
        levels = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))
        if level == len(levels):
            return self.unary()
        out = self.expression(level + 1)
        while (op := self.op(*levels[level])) is not None:
            out = (op, out, self.expression(level + 1))
        if level == 2 and (word := self.word("IN", "NOT")) is not None:
            if word == "NOT" and not self.word("IN"):
                self.fail("expected IN")
            self.need("(")
            listed = []
            while not self.op(")"):
                listed.append(self.expression(3))
                self.op(",")
            same = ("in", out, listed)
            out = ("!", same) if word == "NOT" else same
        return out

    def unary(self):
        if self.op("!"):
            return ("!", self.unary())
        if self.op("("):
            out = self.expression()
            self.need(")")
            return out
        if self.peek()[0] == "word" and self.peek()[1].lower() not in ("true", "false"):
            name, args = self.next()[1].upper(), []
            self.need("(")
            distinct = bool(self.word("DISTINCT"))
            if self.op("*"):
                self.need(")")
                return ("call", name, [], distinct)
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            return ("call", name, args, distinct)
        return self.term()

    def select(self) -> dict:
        if not self.word("SELECT"):
            self.fail("expected SELECT")
        out: dict = {"form": "select", "distinct": bool(self.word("DISTINCT", "REDUCED")), "names": []}
        if self.op("*"):
            out["names"] = None
        else:
            while self.peek()[0] == "var" or self.peek() == ("op", "("):
                if self.op("("):
                    e = self.expression()
                    self.word("AS")
                    out["names"].append((self.term()[1], e))
                    self.need(")")
                else:
                    name = self.next()[1][1:]
                    out["names"].append((name, ("var", name)))
        self.word("WHERE")
        out["where"] = self.group()
        return self.modifiers(out)

    def modifiers(self, out: dict) -> dict:
        out |= {"group": [], "having": None, "order": [], "limit": None, "offset": 0}
        while (word := self.word("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")) is not None:
            if word == "GROUP":
                self.word("BY")
                while self.peek()[0] == "var":
                    out["group"].append(self.next()[1][1:])
            elif word == "HAVING":
                out["having"] = self.expression()
            elif word == "ORDER":
                self.word("BY")
                while self.peek()[0] == "var" or self.peek()[1].upper() in ("ASC", "DESC"):
                    way = self.word("ASC", "DESC")
                    out["order"].append((self.expression(), way == "DESC"))
            else:
                out[word.lower()] = int(self.next()[1])
        return out

    def query(self) -> dict:
        while self.word("PREFIX"):
            name = self.next()[1]
            self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
        if self.word("ASK"):
            self.word("WHERE")
            out = {"form": "ask", "where": self.group()}
        elif self.word("CONSTRUCT"):
            template = self.group()
            self.word("WHERE")
            out = {"form": "construct", "template": [t for s in template.steps for t in s[1]], "where": self.group()}
        else:
            out = self.select()
        if self.peek()[0] != "end":
            self.fail("unexpected")
        return out


def _loose(df: DataFrame) -> set[str]:
    """Variables that a solution may leave unbound."""
    return getattr(df, "_loose", set())


def _marked(df: DataFrame, loose: set[str]) -> DataFrame:
    df._loose = {c for c in loose if c in df.columns}
    return df


class _Plan:
    """Lowers parsed groups. Columns are variables; values are URIs or literal keys."""

    AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")

    def __init__(self, kb: KB):
        self.kb = kb
        #: Columns that stand for a variable while the condition of an outer join is made.
        self.over: dict[str, Column] = {}

    def edges(self, p: str | None = None) -> DataFrame:
        out = self.kb.edges(p, graph=False)
        return out.distinct() if self.kb.bag else out

    def pairs(self, path) -> DataFrame:
        """(a, b) of a property path."""
        kind = path[0]
        if kind == "uri":
            return self.edges(path[1]).select(F.col("s").alias("a"), F.col("o").alias("b"))
        if kind == "not":
            return self.edges().where(~F.col("p").isin(*path[1])).select(F.col("s").alias("a"), F.col("o").alias("b"))
        if kind == "inverse":
            return self.pairs(path[1]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.withColumnRenamed("a", "m"), "m").select("a", "b"), map(self.pairs, path[1]))
        if kind == "alt":
            return reduce(DataFrame.unionByName, map(self.pairs, path[1]))
        if kind == "repeat":
            one = self.pairs(path[1]).distinct()
            if path[2] == "?":
                nodes = one.select("a").unionByName(one.select(F.col("b").alias("a"))).distinct()
                return one.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
            return transitive_closure(one, reflexive=path[2] == "*").select("a", "b").distinct()
        raise SparqlError("a variable stands in a property path")

    def ends(self, s, p, o) -> DataFrame:
        """(s, o) of a path between two terms; from a given term over any number of hops by a search from there."""
        given = [x for x in (s, o) if x[0] != "var"]
        if p[0] == "repeat" and p[2] in "*+" and given:
            one = self.pairs(p[1]).distinct()
            forward = s[0] != "var"
            start = given[0][1]
            found = reachable(one if forward else one.select(F.col("b").alias("a"), F.col("a").alias("b")), start)
            if p[2] == "+":  # the start itself only if a cycle leads back to it
                back = one.where(F.col("b" if forward else "a") == start).select(F.col("a" if forward else "b").alias("node")).join(found, "node", "left_semi")
                found = found.where(F.col("node") != start).unionByName(back.limit(1).select(F.lit(start).alias("node")))
            return found.select(*((F.lit(start).alias("s"), F.col("node").alias("o")) if forward else (F.col("node").alias("s"), F.lit(start).alias("o"))))
        out = self.pairs(p).select(F.col("a").alias("s"), F.col("b").alias("o"))
        if p[0] == "repeat" and p[2] == "?" and given:
            out = out.unionByName(constants(self.kb.spark, [(x[1], x[1]) for x in given], ["s", "o"])).distinct()
        return out

    def triple(self, t) -> DataFrame:
        s, p, o = t
        if p[0] == "var":
            df = self.edges().select("s", "p", "o")
        elif p[0] == "uri":
            df = self.edges(p[1]).select("s", "o")
        else:
            df = self.ends(s, p, o)
        names: dict[str, str] = {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if column not in df.columns:
                continue
            if term[0] != "var":
                df = df.where(F.col(column) == term[1])
            elif term[1] in names:
                df = df.where(F.col(names[term[1]]) == F.col(column))
            else:
                names[term[1]] = column
        return df.select(*[F.col(c).alias(n) for n, c in names.items()]) if names else df.limit(1).select()

    def basic(self, triples: list) -> DataFrame:
        """All triples of a block: first the one with most constants, then always the one with most variables bound by then."""
        constants_of = lambda t: sum(x[0] in ("uri", "lit") for x in t if len(x) == 2)
        names = lambda t: {x[1] for x in t if x[0] == "var"}
        todo = list(triples)
        first = max(todo, key=constants_of)
        todo.remove(first)
        out, bound = self.triple(first), names(first)
        while todo:
            linked = [t for t in todo if names(t) & bound]
            t = min(linked or todo, key=lambda t: (-len(names(t) & bound), not (t[0][0] != "var" or t[0][1] in bound), -constants_of(t)))
            todo.remove(t)
            rows, own = self.triple(t), names(t)
            follows = lambda u, of: u[1][0] == "uri" and u[1][1] in self.kb.single and u[0][0] == "var" and u[0][1] in of
            pairs = t[0][0] == "var" and t[0][1] not in bound and bool(own & bound)
            if pairs:  # subjects of one object: what each of them has one of joins it first
                while more := [u for u in todo if follows(u, own - bound)]:
                    todo.remove(more[0])
                    rows = self.join(rows, self.triple(more[0]))
                    own = own | names(more[0])
            shared = sorted(own & bound)
            out = sliced_join(out, rows, shared) if pairs and own - bound else self.join(out, rows)
            bound |= own
        return out

    def join(self, x: DataFrame, y: DataFrame, how: str = "inner", filters: list = ()) -> DataFrame:
        """Compatible solutions of both sides: equal where both bind a variable. ``filters`` see the variables of both (outer joins)."""
        shared = [c for c in x.columns if c in y.columns]
        soft = [c for c in shared if c in _loose(x) | _loose(y)]
        # what stays unbound: loose on both sides, or on the one side that has it, or of the optional side alone
        loose = {c for c in _loose(x) | _loose(y) if c not in shared or (c in _loose(x) and (c in _loose(y) or how == "left"))}
        if how == "left":
            loose |= {c for c in y.columns if c not in x.columns}
        if not soft and not filters:
            if shared:
                return _marked(x.join(y, shared, how), loose)
            return _marked(x.crossJoin(y) if how == "inner" else x.join(y, F.lit(True), how), loose)
        if how == "inner" and not filters and len(soft) == len(shared):
            # nothing to hash on but variables that may be unbound: bound rows meet by equality, only unbound ones meet all
            c = soft[0]
            known = lambda df, yes: _marked(df.where(F.col(c).isNotNull() if yes else F.col(c).isNull()), _loose(df) - {c} if yes else _loose(df))
            parts = [self.join(known(x, True), known(y, True)), self._loosely(known(x, False), y, shared, soft, []), self._loosely(known(x, True), known(y, False), shared, soft, [])]
            return _marked(reduce(DataFrame.unionByName, parts), loose)
        return _marked(self._loosely(x, y, shared, soft, filters, how), loose)

    def _loosely(self, x: DataFrame, y: DataFrame, shared: list[str], soft: list[str], filters: list, how: str = "inner") -> DataFrame:
        """A join in which an unbound variable of either side meets every value of the other."""
        right = y.select(*[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in y.columns])
        on = reduce(lambda p, q: p & q, [self.same(c, c in soft) for c in shared], F.lit(True))
        self.over = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in soft}
        for e in filters:
            on = on & self.truth(e, [*x.columns, *y.columns])
        self.over = {}
        out = x.join(right, on, how)
        names = [F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in soft else F.col(c) for c in x.columns]
        return out.select(*names, *[F.col(c) for c in y.columns if c not in x.columns])

    def optional(self, x: DataFrame, g: _Group) -> DataFrame:
        """OPTIONAL: filters and (NOT) EXISTS of its group see the variables of both sides."""
        inner, filters = self.apart(g)
        tests = [s for s in inner.steps if s[0] == "exists"]
        inner.steps = [s for s in inner.steps if s[0] != "exists"]
        more = self.group(inner)
        if more is None:
            return x
        if not tests:
            return self.join(x, more, "left", filters)
        # each different solution with its candidates, those that pass all tests, and then back to all solutions
        own = _marked(x.distinct().select(*x.columns, *[F.col(c).alias(f"__x_{c}") for c in x.columns]), _loose(x))
        found = self.join(own, more)
        for e in filters:
            found = _marked(found.where(self.truth(e, found.columns)), _loose(found))
        for _, group, negated, *_ in tests:
            found = self.there(found, group, negated)
        left = x.select(*[F.col(c).alias(f"__l_{c}") for c in x.columns])
        on = reduce(lambda p, q: p & q, [F.col(f"__l_{c}").eqNullSafe(F.col(f"__x_{c}")) for c in x.columns], F.lit(True))
        out = left.join(found, on, "left").select(*[F.coalesce(F.col(c), F.col(f"__l_{c}")).alias(c) for c in x.columns], *[F.col(c) for c in more.columns if c not in x.columns])
        return _marked(out, _loose(x) | {c for c in more.columns if c not in x.columns})

    def same(self, c: str, soft: bool) -> Column:
        equal = F.col(c) == F.col(f"__r_{c}")
        return equal | F.col(c).isNull() | F.col(f"__r_{c}").isNull() if soft else equal

    def without(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """MINUS: not the solutions that a compatible one of ``y`` shares a bound variable with."""
        shared = [c for c in x.columns if c in y.columns]
        if not shared:
            return x
        soft = [c for c in shared if c in _loose(x) | _loose(y)]
        y = y.select(*shared).distinct()
        if not soft:
            return _marked(x.join(y, shared, "left_anti"), _loose(x))
        right = y.select(*[F.col(c).alias(f"__r_{c}") for c in shared])
        on = reduce(lambda p, q: p & q, [self.same(c, c in soft) for c in shared])
        if len(soft) == len(shared):
            on = on & reduce(lambda p, q: p | q, [F.coalesce(F.col(c) == F.col(f"__r_{c}"), F.lit(False)) for c in shared])
        return _marked(x.join(right, on, "left_anti"), _loose(x))

    def there(self, x: DataFrame, g: _Group, negated: bool) -> DataFrame:
        """(NOT) EXISTS: its group's filters see the outer variables."""
        inner, filters = self.apart(g)
        how = "left_anti" if negated else "left_semi"
        y = self.group(inner)
        y = y if y is not None else self.kb.spark.range(1).select()
        shared = [c for c in x.columns if c in y.columns]
        if not shared and not filters:
            return _marked(x.join(y.limit(1), F.lit(True), how), _loose(x))
        right = y.select(*[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in y.columns]).distinct()
        on = reduce(lambda p, q: p & q, [self.same(c, c in _loose(x) | _loose(y)) for c in shared], F.lit(True))
        for e in filters:
            on = on & self.truth(e, [*x.columns, *y.columns])
        return _marked(x.join(right, on, how), _loose(x))

    def apart(self, g: _Group) -> tuple[_Group, list]:
        """A group without its own filters, and these."""
        inner = _Group()
        inner.steps = [s for s in g.steps if s[0] != "filter"]
        return inner, [s[1] for s in g.steps if s[0] == "filter"]

    def value(self, e, columns: list[str]) -> Column:
        """A term for comparing: numbers as numbers, all else as text."""
        kind = e[0]
        if kind == "var":
            return self.over.get(e[1], F.col(e[1])) if e[1] in columns else F.lit(None).cast("string")
        if kind in ("lit", "uri"):
            return F.lit(e[1])
        if kind == "call":
            name, args = e[1], e[2]
            if name in self.AGGREGATES:
                return F.col(f"__agg{self.key(e)}")
            a = [self.value(x, columns) for x in args]
            text = lambda c: F.when(c.startswith("s:"), F.substring(c, F.lit(3), F.length(c))).otherwise(c)
            if name == "BOUND":
                return a[0].isNotNull()
            if name == "STR":
                return F.concat(F.lit("s:"), F.regexp_replace(text(a[0]), r"@[A-Za-z-]+$", ""))
            if name == "LANG":
                return F.concat(F.lit("s:"), F.regexp_extract(a[0], r"^s:.*@([A-Za-z-]+)$", 1))
            if name == "CONTAINS":
                return F.contains(text(a[0]), text(a[1]))
            if name == "STRSTARTS":
                return F.startswith(text(a[0]), text(a[1]))
            if name == "REGEX":
                return F.rlike(text(a[0]), text(a[1]))
            if name == "ISIRI":
                return ~a[0].rlike("^[sn]:")
            if name == "COALESCE":
                return F.coalesce(*a)
            if name == "IF":
                return F.when(self.truth(args[0], columns), a[1]).otherwise(a[2])
            raise SparqlError(f"no function {name}")
        if kind in ("+", "-", "*", "/"):
            x, y = self.number(e[1], columns), self.number(e[2], columns)
            return F.concat(F.lit("n:"), {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[kind].cast("string"))
        return self.truth(e, columns)

    def number(self, e, columns: list[str]) -> Column:
        v = self.value(e, columns)
        return F.when(v.startswith("n:"), F.substring(v, F.lit(3), F.length(v))).try_cast("double")

    def truth(self, e, columns: list[str]) -> Column:
        if e[0] == "||":
            return self.truth(e[1], columns) | self.truth(e[2], columns)
        if e[0] == "&&":
            return self.truth(e[1], columns) & self.truth(e[2], columns)
        if e[0] == "!":
            return ~self.truth(e[1], columns)
        if e[0] == "in":
            return reduce(lambda x, y: x | y, [self.truth(("=", e[1], x), columns) for x in e[2]], F.lit(False))
        if e[0] in ("=", "!="):
            same = self.value(e[1], columns) == self.value(e[2], columns)
            return same if e[0] == "=" else ~same
        if e[0] in ("<", ">", "<=", ">="):
            compare = lambda x, y: {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e[0]]
            x, y = self.number(e[1], columns), self.number(e[2], columns)
            return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(compare(self.value(e[1], columns), self.value(e[2], columns)))
        if e[0] in ("var", "lit"):
            return self.value(e, columns) == "n:1.0"
        return self.value(e, columns)

    def group(self, g: _Group) -> DataFrame | None:
        out: DataFrame | None = None
        late = []
        for step in g.steps:
            kind = step[0]
            if kind in ("filter", "exists"):
                late.append(step)
                continue
            if out is None and kind in ("bind", "optional", "minus"):
                out = self.kb.spark.range(1).select()
            if kind == "bind":
                out = _marked(out.withColumn(step[2], self.value(step[1], out.columns)), _loose(out) | {step[2]})
                continue
            if kind == "optional":
                out = self.optional(out, step[1])
                continue
            if kind == "minus":
                out = self.without(out, self.group(step[1]))
                continue
            if kind == "triples":
                more = self.basic(step[1])
            elif kind == "values":
                more = constants(self.kb.spark, step[2], step[1])
            elif kind == "union":
                branches = [self.group(b) for b in step[1]]
                every = {c for b in branches for c in b.columns}
                loose = {c for c in every if any(c not in b.columns or c in _loose(b) for b in branches)}
                more = _marked(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), branches), loose)
            elif kind == "select":
                more = self.select(step[1])
            else:
                more = self.group(step[1])
            out = more if out is None else self.join(out, more)
        for step in late:
            if out is None:
                out = self.kb.spark.range(1).select()
            if step[0] == "filter":
                out = _marked(out.where(self.truth(step[1], out.columns)), _loose(out))
            else:
                out = self.there(out, step[1], step[2])
        return out

    def key(self, e) -> str:
        return format(abs(hash(repr(e))) % 10**12, "d")

    def aggregates(self, e, found: dict) -> None:
        if isinstance(e, tuple):
            if e[0] == "call" and e[1] in self.AGGREGATES:
                found[self.key(e)] = e
            for x in e:
                if isinstance(x, list):
                    for y in x:
                        self.aggregates(y, found)
                else:
                    self.aggregates(x, found)

    def aggregate(self, e, columns: list[str]) -> Column:
        name, args, distinct = e[1], e[2], e[3]
        number = lambda c: F.concat(F.lit("n:"), c.cast("double").cast("string"))
        if name == "COUNT":
            if not args:
                return number(F.count(F.lit(1)))
            v = self.value(args[0], columns)
            return number(F.countDistinct(v) if distinct else F.count(v))
        if name in ("SUM", "AVG"):
            v = self.number(args[0], columns)
            return number((F.sum_distinct(v) if distinct else F.sum(v)) if name == "SUM" else F.avg(v))
        v = self.value(args[0], columns)
        if name == "GROUP_CONCAT":
            text = F.when(v.startswith("s:"), F.substring(v, F.lit(3), F.length(v))).otherwise(v)
            return F.concat(F.lit("s:"), F.array_join(F.array_sort(F.collect_set(text) if distinct else F.collect_list(text)), " "))
        if name in ("MIN", "MAX"):
            n, f = self.number(args[0], columns), F.min if name == "MIN" else F.max
            return F.when(F.count(n) == F.count(v), number(f(n))).otherwise(f(v))
        return F.min(v)

    def select(self, q: dict) -> DataFrame:
        df = self.group(q["where"])
        if df is None:
            df = self.kb.spark.range(1).select()
        q["where_bound"] = set(df.columns) - _loose(df)
        names = q["names"]
        if names is None:
            names = [(c, ("var", c)) for c in df.columns if not c.startswith("__")]
        found: dict = {}
        for e in [*(e for _, e in names), q["having"], *(e for e, _ in q["order"])]:
            self.aggregates(e, found)
        if found or q["group"]:
            keys = [c for c in q["group"]]
            df = df.groupBy(*keys).agg(*[self.aggregate(e, df.columns).alias(f"__agg{k}") for k, e in found.items()] or [F.lit(1).alias("__one")])
        if q["having"] is not None:
            df = df.where(self.truth(q["having"], df.columns))
        for name, e in names:
            if e != ("var", name):
                df = df.withColumn(name, self.value(e, df.columns))
        asked = [n for n, _ in names]
        if q["distinct"]:  # before the order, which a distinct would lose
            df = df.select(*[self.value(("var", n), df.columns).alias(n) for n in asked]).distinct()
        if q["order"]:
            keys = []
            for e, down in q["order"]:
                if q["distinct"] and e[0] == "var" and e[1] not in df.columns:
                    raise SparqlError(f"?{e[1]} orders distinct rows that do not have it")
                for c in (self.number(e, df.columns), self.value(e, df.columns)):
                    keys.append(c.desc() if down else c.asc())
            df = df.orderBy(*keys)
        out = df.select(*[self.value(("var", n), df.columns).alias(n) for n in asked])
        if q["offset"]:
            out = out.offset(q["offset"])
        if q["limit"] is not None:
            out = out.limit(q["limit"])
        # a group's key, a count and a variable that every solution binds are bound
        fixed = {n for n in asked if n in df.columns and n in q["where_bound"] and not found} | {n for n in q["group"] if n in q["where_bound"]}
        return _marked(out, set(asked) - fixed)


def query(kb: KB, text: str, *, labels: dict[str, str] | None = None) -> DataFrame:
    """The result of a query as a DataFrame of URIs and literal keys; a variable that nothing binds is null.

    ASK gives one row (answer), CONSTRUCT distinct triples (s, p, o).
    """
    q = _Parser(checked(text, labels or {})).query()
    plan = _Plan(kb)
    if q["form"] == "select":
        return plan.select(q)
    found = plan.group(q["where"])
    if q["form"] == "ask":
        return found.limit(1).agg((F.count("*") > 0).alias("answer"))
    parts = [found.select(*[plan.value(term, found.columns).alias(n) for term, n in zip(t, ("s", "p", "o"), strict=True)]) for t in q["template"]]
    return reduce(DataFrame.unionByName, parts).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def plain(df: DataFrame) -> DataFrame:
    """Every cell's value without its key prefix: URIs and texts as they are, numbers as text; language tags stay."""
    return df.select([F.when(F.col(c).rlike("^[sn]:"), F.substring(c, F.lit(3), F.length(c))).otherwise(F.col(c)).alias(c) for c in df.columns])
