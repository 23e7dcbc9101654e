"""Calling operators: the result of an operator for some arguments is an entity of the operator's range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import COLUMNS, KB, content_id, statement
from ..plans.tables import keyed, written
from .edit import tuple_rows
from .expressions import Expr
from .rules import Rule, as_statements, bindings, template_rows, unscoped

APPLIED, ARGUMENTS, RANGE, INSTANCE = "applied_mapping_of", "has_arguments", "range", "instance_of"
ELEMENT, LENGTH = "has_element", "has_length"
#: The variable of a post-processing rule that stands for a call's result.
RESULT = "result"


class NotCallable(TypeError):
    """An operator without a range: nothing says what its results are."""


def result_id(operator: Column, args: Column) -> Column:
    """The entity that a call gives, whoever makes it."""
    return F.concat(F.lit("Ia"), F.substring(content_id(F.lit("call"), operator, F.to_json(args)), 1, 32))


def evaluate(kb: KB, tree: Expr, inputs: DataFrame, *, result: str = "result", **more) -> tuple[KB, DataFrame]:
    """(``kb`` with all calls of an expression for each row of ``inputs``, ``inputs`` with the result's entity).

    Leaves that are named as columns of ``inputs`` stand for their values, keys or URIs; other leaves for themselves. Calls are made a level of
    nesting at a time, each one once, whichever rows and places of the expression it comes from.
    """
    depth: dict[str, tuple[int, Expr]] = {}

    def place(e: Expr) -> int:
        level = 1 + max(map(place, e.args)) if e.args else 0
        depth[e.name] = (level, e)
        return level

    top = place(tree)
    own = list(inputs.columns)
    column = lambda e: F.col(f"`{e.op}`") if not e.args and e.op in own else F.col(f"`__{e.name}`") if e.args else F.lit(e.op)
    frame = inputs
    for level in range(1, top + 1):
        nodes = [e for n, e in depth.values() if n == level]
        arguments = {e.name: F.array(*[column(a) for a in e.args]) for e in nodes}
        asked = frame.select(F.explode(F.array(*[F.struct(F.lit(e.op).alias("operator"), arguments[e.name].alias("args")) for e in nodes])).alias("x")).select("x.*")
        kb, _ = call(kb, asked, **more)
        frame = frame.select("*", *[result_id(F.lit(e.op), arguments[e.name]).alias(f"__{e.name}") for e in nodes])
    return kb, frame.select(*own, column(tree).alias(result))


def call(kb: KB, calls: DataFrame, *, post: list[Rule] | None = None, secondary: str = "secondary_instance_of", mod: str = "calls") -> tuple[KB, DataFrame]:
    """(``kb`` with the results, (operator, args, result, made)) of ``calls`` (operator, args array<string>).

    The same operator and arguments give the same entity, in one call or many; ``made`` tells whether it is new. A result is an
    instance of the first class of the operator's range and, beside that, of the others. ``post`` are rules with a variable ``result``: they are
    matched on the knowledge base with the results, and what they assert is stored for new results alone. An argument that is null or an
    empty array is a call of no arguments. Raises ``NotCallable`` for an operator without a range, before anything is stored.
    """
    args = F.coalesce("args", F.array().cast("array<string>"))
    asked = calls.select("operator", args.alias("args")).distinct().withColumn("result", result_id(F.col("operator"), F.col("args")))
    old = kb.of(APPLIED).select(F.col("s").alias("result")).distinct().withColumn("old", F.lit(True))
    # what is stored is a row a call: the statements about it are made of that row where they are asked for
    asked = keyed(asked.join(old, "result", "left").select("operator", "args", "result", F.col("old").isNull().alias("made")), "calls", "result")
    ranges = kb.of(RANGE).select(F.col("s").alias("operator"), F.col("o").alias("cls"), "seq", "stm_id")
    bad = asked.select("operator").distinct().join(ranges, "operator", "left_anti").orderBy("operator").limit(1).collect()
    if bad:
        raise NotCallable(f"{bad[0]['operator']} has no range")
    new = asked.where("made")
    if new.isEmpty():
        return kb, asked
    first = ranges.groupBy("operator").agg(F.min_by("cls", F.struct("seq", "stm_id")).alias("first"))
    classes = written(ranges.select("operator", "cls").distinct().join(first, "operator"), "classes")
    tuples = F.concat(F.lit("T"), "result")
    elements, qualifiers = tuple_rows(new.select(tuples.alias("tuple"), F.col("args").alias("elements")), mod=mod)
    # literals among the arguments are written as their keys
    literal = F.col("o").rlike("^[ns]:") & (F.col("o_kind") == "E")
    text = F.substring("o", F.lit(3), F.length("o"))
    elements = elements.withColumn("o_lex", F.when(literal, text).otherwise(F.col("o_lex"))).withColumn("o_type", F.when(literal, F.when(F.col("o").startswith("n:"), "float").otherwise("str")).otherwise(F.col("o_type"))).withColumn("o_kind", F.when(literal, "L").otherwise(F.col("o_kind")))
    of = lambda p: lambda: elements.where(F.col("p") == p).withColumn("p", F.lit(p)).select(*COLUMNS)
    parts = {
        APPLIED: lambda: new.select(*statement(F.col("result"), APPLIED, F.col("operator"), mod=mod)),
        ARGUMENTS: lambda: new.select(*statement(F.col("result"), ARGUMENTS, tuples, mod=mod)),
        ELEMENT: of(ELEMENT),
        LENGTH: of(LENGTH),
        INSTANCE: lambda: new.join(classes.where("cls = first"), "operator").select(*statement(F.col("result"), INSTANCE, F.col("cls"), mod=mod)),
    }
    others = lambda: new.join(classes.where("cls <> first"), "operator").select(*statement(F.col("result"), secondary, F.col("cls"), mod=mod))
    entities = new.select(F.col("result").alias("uri")).unionByName(new.select(tuples.alias("uri"))).select("uri", F.lit("I").alias("etype"), F.lit(True).alias("is_auto"), F.lit(None).cast("string").alias("scope"), F.lit(mod).alias("mod"), F.lit(False).alias("unlinked"))
    after = kb.with_parts(parts, entities, qualifiers).with_parts({secondary: others})
    after.single = after.single | {APPLIED, ARGUMENTS}
    for rule in post or []:
        found = bindings(after, rule)
        if RESULT not in found.columns:
            raise ValueError(f"{rule.name}: no variable {RESULT}")
        about = found.join(new.select(F.col("result").alias(RESULT)), RESULT, "left_semi")
        # dealt as they are stored, so that making them distinct and storing them moves them once
        facts = unscoped(after, template_rows(rule, about)).select("s", "p", "o_kind", "o").repartition(int(kb.spark.conf.get("spark.sql.shuffle.partitions")), "s").distinct()
        relations = [t.p for t in rule.asserts]
        named = all(isinstance(p, str) for p in relations)
        there = after.of(*dict.fromkeys(relations)) if named else after.statements
        facts = keyed(facts.join(there.select("s", "p", "o"), ["s", "p", "o"], "left_anti"), "post", "s")
        if named:
            after = after.with_parts({p: lambda p=p, facts=facts: as_statements(facts.where(F.col("p") == p).withColumn("p", F.lit(p)), mod=mod) for p in relations})
        else:
            after = after.plus(as_statements(facts, mod=mod), bag=False)
    return after, asked
