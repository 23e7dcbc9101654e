"""Symbolic expressions: calls of operators become entities named by the operator and its arguments."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expr:
    """An operator applied to arguments, or a leaf. Operators add, mul and pow make up all arithmetic."""

    op: str
    args: tuple = ()

    def __add__(self, other):
        return Expr("add", (self, _leaf(other)))

    def __radd__(self, other):
        return Expr("add", (_leaf(other), self))

    def __mul__(self, other):
        return Expr("mul", (self, _leaf(other)))

    def __rmul__(self, other):
        return Expr("mul", (_leaf(other), self))

    def __neg__(self):
        return Expr("mul", (_leaf(-1), self))

    def __sub__(self, other):
        return self + (-_leaf(other))

    def __rsub__(self, other):
        return _leaf(other) + (-self)

    def __pow__(self, other):
        return Expr("pow", (self, _leaf(other)))

    def __rpow__(self, other):
        return Expr("pow", (_leaf(other), self))

    def __truediv__(self, other):
        return self * Expr("pow", (_leaf(other), _leaf(-1)))

    def __rtruediv__(self, other):
        return _leaf(other) * Expr("pow", (self, _leaf(-1)))

    @property
    def name(self) -> str:
        """The entity's name: equal for equal expressions."""
        import hashlib

        return hashlib.sha256(json.dumps([self.op, *(a.name for a in self.args)]).encode()).hexdigest() if self.args else self.op

    def rows(self) -> list[tuple[str, str, list[str]]]:
        """(mapping, operator, arguments) of this and all inner calls, each once."""
        out: dict[str, tuple[str, str, list[str]]] = {}
        for a in self.args:
            out |= {r[0]: r for r in a.rows()}
        if self.args:
            out[self.name] = (self.name, self.op, [a.name for a in self.args])
        return list(out.values())


def _leaf(x) -> Expr:
    return x if isinstance(x, Expr) else Expr(f"n:{float(x)}" if isinstance(x, int | float) else str(x))


def fold(op: str, *args) -> Expr:
    """An n-ary call as nested two-place calls from the left."""
    out = _leaf(args[0])
    for a in args[1:]:
        out = Expr(op, (out, _leaf(a)))
    return out


def evaluated(calls: DataFrame, operator: str) -> DataFrame:
    """(mapping, args) for each distinct argument array of ``calls`` (args array<string>): the same call is the same entity."""
    name = F.sha2(F.to_json(F.concat(F.array(F.lit(operator)), "args")), 256)
    return calls.select("args").distinct().select(name.alias("mapping"), "args")


#: Kinds of mathematical relations by sign; unequal is a strict inequality unless told otherwise.
RELATIONS = {"==": "equation", "<": "strict_inequality", ">": "strict_inequality", "<=": "inequality", ">=": "inequality", "!=": "strict_inequality"}


def relation_rows(lhs: Expr, sign: str, rhs: Expr, *, kinds: dict[str, str] = RELATIONS) -> list[tuple[str, str, str]]:
    """(s, p, o) of a mathematical relation: its class and sides, and the statement it stands for as a proxy."""
    if lhs == rhs:
        raise ValueError("both sides are the same expression")
    proxy = Expr(sign, (lhs, rhs)).name
    return [(proxy, "instance_of", kinds[sign]), (proxy, "has_lhs", lhs.name), (proxy, "has_rhs", rhs.name), (lhs.name, f"is_related:{sign}", rhs.name)]


def related(rows: DataFrame, *, kinds: dict[str, str] = RELATIONS) -> DataFrame:
    """(s, p, o) of mathematical relations ``rows`` (lhs, sign, rhs): as ``relation_rows``, for all rows at once.

    Equal relations are one item. Raises for an unknown sign or two equal sides, before anything is made.
    """
    bad = rows.where(~F.col("sign").isin(*kinds) | (F.col("lhs") == F.col("rhs")) | F.col("lhs").isNull() | F.col("rhs").isNull() | F.col("sign").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"no relation: {bad[0]['lhs']} {bad[0]['sign']} {bad[0]['rhs']}")
    item = F.sha2(F.to_json(F.array("sign", "lhs", "rhs")), 256)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("sign"))
    facts = [(item, F.lit("instance_of"), kind), (item, F.lit("has_lhs"), F.col("lhs")), (item, F.lit("has_rhs"), F.col("rhs")), (F.col("lhs"), F.concat(F.lit("is_related:"), "sign"), F.col("rhs"))]
    each = F.explode(F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in facts]))
    return rows.select("lhs", "sign", "rhs").distinct().select(each.alias("x")).select("x.*").distinct()
