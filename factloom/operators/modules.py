"""Module contexts: where new statements go, where keys are looked up, and how a module's results are taken back."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import COLUMNS, KB
from ..plans.tables import local
from . import edit, rules
from .authoring import Authored, author, resolve_keys


class ModuleError(ValueError):
    """A module that is active where none may be, or none where one must be, or one that is there already."""


@dataclass
class Workspace:
    """A knowledge base that grows by modules. What is inserted, derived or authored lands in the innermost active module.

    ``log`` has (module, action, name) of every step; ``versions`` the knowledge base before each, so the last steps can be undone. A
    module is taken back by its column alone, whatever came after it.
    """

    kb: KB
    builtin: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    stack: list[str] = field(default_factory=list)
    searched: list[str] = field(default_factory=list)
    log: list[tuple[str, str, str]] = field(default_factory=list)
    versions: list[KB] = field(default_factory=list)

    @property
    def active(self) -> str:
        if not self.stack:
            raise ModuleError("no module is active")
        return self.stack[-1]

    def register(self, uri: str, prefix: str | None = None) -> None:
        """Names a module; neither it nor its prefix may be taken."""
        if uri in self.prefixes.values() or prefix in self.prefixes:
            raise ModuleError(f"{uri} or {prefix} is registered")
        self.prefixes[prefix or uri] = uri

    @contextmanager
    def start(self, uri: str, prefix: str | None = None):
        """A module of its own: none may be active, and it must be new."""
        if self.stack:
            raise ModuleError(f"{self.active} is active")
        self.register(uri, prefix)
        with self.module(uri):
            yield self

    @contextmanager
    def module(self, uri: str, prefix: str | None = None):
        """Makes a module the active one; inside another it is that for as long. A prefix holds inside only."""
        added = prefix is not None and prefix not in self.prefixes
        if added:
            self.prefixes[prefix] = uri
        self.stack.append(uri)
        try:
            yield self
        finally:
            self.stack.pop()
            if added:
                del self.prefixes[prefix]

    @contextmanager
    def search(self, uri: str):
        """Looks keys up in a module before the active one."""
        self.searched.append(uri)
        try:
            yield self
        finally:
            self.searched.pop()

    def search_order(self) -> list[str]:
        """Innermost searched module first, then the active one, then the built-ins."""
        order = [*reversed(self.searched), *reversed(self.stack), *([self.builtin] if self.builtin else [])]
        return list(dict.fromkeys(order))

    def prefix_table(self) -> DataFrame:
        return local(self.kb.spark, sorted(self.prefixes.items()), "prefix string, base string")

    def resolve(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key) resolved as they are read here."""
        return resolve_keys(self.kb, keys, self.prefix_table(), search=self.search_order())

    def _step(self, action: str, name: str, kb: KB) -> None:
        self.versions.append(self.kb)
        self.log.append((self.active, action, name))
        self.kb = kb

    def insert(self, rows: DataFrame, *, only_new: bool = False, functional: tuple[str, ...] = (), name: str = "") -> None:
        self._step("insert", name, edit.insert(self.kb, rows.withColumn("mod", F.lit(self.active)).select(*COLUMNS), only_new=only_new, functional=functional))

    def apply(self, rule: rules.Rule, *, functional: tuple[str, ...] = ()) -> DataFrame:
        """Applies a rule; (what it asserts, with provenance)."""
        after, rows = rules.apply(self.kb, rule, functional=functional, mod=self.active)
        self._step("apply", rule.name, after)
        return rows

    def close(self, given: list[rules.Rule], **more) -> rules.RuleStop | None:
        """The rules' fixpoint."""
        after, _, stop = rules.fixpoint(self.kb, given, mod=self.active, **more)
        self._step("close", ", ".join(r.name for r in given), after)
        return stop

    def author(self, rows: DataFrame, *, create: str | None = "I", **more) -> DataFrame:
        """Authored rows; their errors."""
        done: Authored = author(self.kb, rows, self.prefix_table(), mod=self.active, search=self.search_order(), create=create, **more)
        self._step("author", create or "", done.kb)
        return done.errors

    def unload(self, uri: str) -> None:
        """Takes a module back: its entities and statements, and what others say about its entities. Not while it is active."""
        if uri in self.stack:
            raise ModuleError(f"{uri} is active")
        self.versions.append(self.kb)
        self.log.append((uri, "unload", uri))
        self.kb = edit.unload(self.kb, uri)
        self.prefixes = {k: v for k, v in self.prefixes.items() if v != uri}

    def undo(self, steps: int = 1) -> None:
        """The knowledge base as it was before the last steps."""
        if not 0 < steps <= len(self.versions):
            raise ModuleError(f"{len(self.versions)} steps to undo")
        self.kb = self.versions[-steps]
        del self.versions[-steps:], self.log[-steps:]

    @contextmanager
    def trial(self, uri: str):
        """A module that stays only if the block ends without an error."""
        n = len(self.versions)
        try:
            with self.module(uri):
                yield self
        except BaseException:
            if len(self.versions) > n:
                self.undo(len(self.versions) - n)
            raise
