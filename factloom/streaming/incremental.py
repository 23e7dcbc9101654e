"""Rules over a stream of statements: each micro-batch is the delta of a semi-naive fixpoint, and the state is a table.

The state lies in a folder: for each epoch the statements that came and those that follow from them, and a log of the epochs that
are complete. A stream that is started again, on whatever driver, goes on from the last complete epoch; an epoch
that Spark runs again writes the same folder anew. Memory holds nothing but the folder's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import derived, semi_naive_fits
from ..operators.rules import Rule, as_statements, delta, fixpoint
from ..plans.model import COLUMNS, KB, STATEMENT
from ..plans.tables import local, scratch_path, written

#: The epoch of what follows from the base alone.
BASE = -1


class Incremental:
    """A knowledge base that grows with a stream. ``foreach`` is given to ``writeStream.foreachBatch``.

    ``path`` is the folder of the state, in storage that driver and executors share; without one it is a new folder below
    ``spark.checkpoint.dir``. It belongs to one base and one list of rules. A batch that was done is not applied
    twice, and statements that are there are not added again. Null rows and repeated ones within a batch do no harm. A rule that
    stops the reasoning raises; the batch's epoch then stays undone. ``sink`` gets what an epoch added.
    """

    def __init__(self, kb: KB, rules: list[Rule], sink: Callable[[DataFrame, int], None] | None = None, *, path: str | None = None):
        self.base, self.rules, self.sink = kb, rules, sink
        self.path = path or scratch_path(kb.spark, "stream")
        if self._epochs() is None:
            after, _, stop = fixpoint(kb, rules)
            if stop is not None:
                raise stop
            new = after.statements.join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS)
            self._store(new, BASE)

    @property
    def spark(self) -> SparkSession:
        return self.base.spark

    def _epochs(self) -> DataFrame | None:
        """(epoch) of those that are complete; None before the first."""
        try:
            return self.spark.read.schema("epoch long").parquet(f"{self.path}/done")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @property
    def last(self) -> int:
        done = self._epochs()
        return BASE if done is None else done.agg(F.max("epoch")).first()[0]

    def _added(self, last: int) -> DataFrame:
        """Statements of the epochs up to one."""
        rows = self.spark.read.schema(f"{STATEMENT}, epoch long").parquet(f"{self.path}/statements")
        return rows.where(F.col("epoch") <= last).select(*COLUMNS)

    @property
    def kb(self) -> KB:
        """The base with everything that has come and followed so far."""
        return self.base.plus(self._added(self.last), bag=False)

    def _store(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/statements/epoch={epoch}")
        local(self.spark, [(epoch,)], "epoch long").write.mode("append").parquet(f"{self.path}/done")

    def foreach(self, batch: DataFrame, epoch: int) -> None:
        last = self.last
        if epoch <= last:
            return
        kb = self.base.plus(self._added(last), bag=False)
        rows = batch.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").dropDuplicates(["s", "p", "o"])
        new = written(rows.join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS), "batch")
        if semi_naive_fits(self.rules):
            found, _, stop = derived(kb, self.rules, delta=new.select("s", "p", "o_kind", "o"))
            follows = found.join(new.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
            added = new.unionByName(as_statements(follows))
        else:
            after, _, stop = fixpoint(kb.plus(new), self.rules)
            added = after.statements.join(kb.statements.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS)
        if stop is not None:
            raise stop
        self._store(added, epoch)
        if self.sink is not None:
            self.sink(self.spark.read.schema(STATEMENT).parquet(f"{self.path}/statements/epoch={epoch}"), epoch)


def enriched(stream: DataFrame, kb: KB, rule: Rule) -> DataFrame:
    """A stateless face: statements of a stream (s, p, o_kind, o) joined with a fixed knowledge base by a one-edge premise."""
    edge = rule.branches[0].edges[0]
    found = stream.where((F.col("p") == edge.p) & (F.col("o_kind") == "E")).select(F.col("s").alias(edge.s.name), F.col("o").alias(edge.o.name))
    return as_statements(delta(kb.but(bag=True), Rule(rule.name, asserts=rule.asserts, only_new=False), found))
