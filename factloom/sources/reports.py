"""Text outputs: rule reports as HTML, reports as LaTeX, graphs as DOT. Rows are streamed to the driver, not collected."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import PALETTE
from ..plans.model import KB
from .modules import ModuleError


def rule_report(delta: DataFrame, *, limit: int | None = None) -> Iterator[str]:
    """HTML lines: a section for each rule, a row for each of its statements with its explanation if there is one."""
    rows = delta.orderBy("rule", "s", "p", "o")
    if limit is not None:
        rows = rows.limit(limit)
    yield "<html><body>"
    current = None
    for row in rows.toLocalIterator():
        if row["rule"] != current:
            if current is not None:
                yield "</table>"
            current = row["rule"]
            yield f"<h2>{html.escape(current)}</h2><table>"
        why = row.asDict().get("explanation") or ""
        yield "<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in (row["s"], row["p"], row["o"], why)) + "</tr>"
    if current is not None:
        yield "</table>"
    yield "</body></html>"


def text_report(delta: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(line) [s | p | o] for each statement."""
    rows = delta.orderBy("s", "p", "o")
    return (rows if limit is None else rows.limit(limit)).select(F.concat(F.lit("["), F.concat_ws(" | ", "s", "p", "o"), F.lit("]")).alias("line"))


def resolved(data, kb: KB):
    """Nested lists and dicts with every string ``:key`` replaced by that entity's {uri, label}."""
    wanted: set[str] = set()

    def walk(x, swap=None):
        if isinstance(x, dict):
            return {k: walk(v, swap) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, swap) for v in x]
        if isinstance(x, str) and x.startswith(":"):
            wanted.add(x[1:])
            return x if swap is None else swap[x[1:]]
        return x

    walk(data)
    labels = {r["s"]: r["o_lex"] for r in kb.of("label").where(F.col("s").isin(*wanted)).select("s", "o_lex").collect()} if wanted else {}
    found = {r["uri"] for r in kb.entities.where(F.col("uri").isin(*wanted)).select("uri").collect()} if wanted else set()
    if wanted - found:
        raise ModuleError(f"unknown entities {sorted(wanted - found)}")
    return walk(data, {k: {"uri": k, "label": labels.get(k, k)} for k in wanted})


def _tex(text: str) -> str:
    for a in "&%$#_{}":
        text = text.replace(a, "\\" + a)
    return text


def latex_report(conf: dict, kb: KB) -> str:
    """A document with title, authors with their affiliations, and sections (title, content) of a configuration."""
    data = resolved(conf, kb)
    name = lambda x: _tex(x["label"] if isinstance(x, dict) else str(x))
    authors = r" \and ".join(name(a["name"]) + (r" \\ " + name(a["affiliation"]) if "affiliation" in a else "") for a in data.get("authors", []))
    body = "\n".join(f"\\section{{{name(s['title'])}}}\n{name(s.get('content', ''))}" for s in data.get("sections", []))
    return f"\\documentclass{{article}}\n\\title{{{_tex(data.get('title', ''))}}}\n\\author{{{authors}}}\n\\begin{{document}}\n\\maketitle\n{body}\n\\end{{document}}\n"


def edge_colours(edges: DataFrame) -> DataFrame:
    """(p, colour): the ten most frequent relations in the palette's order."""
    counts = edges.groupBy("p").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "p"))).where(F.col("k") <= len(PALETTE))  # a row a relation
    return ranked.select("p", F.element_at(F.array(*map(F.lit, PALETTE)), F.col("k")).alias("colour"))


def dot(edges: DataFrame) -> Iterator[str]:
    """DOT lines of (source, p, target), in a stable order."""
    quote = lambda x: '"' + str(x).replace('"', '\\"') + '"'
    coloured = edges.join(F.broadcast(edge_colours(edges)), "p", "left")  # ten rows
    yield "digraph {"
    for row in coloured.orderBy("source", "p", "target").toLocalIterator():
        yield f"  {quote(row['source'])} -> {quote(row['target'])} [label={quote(row['p'])}, color={row['colour'] or 'black'}];"
    yield "}"
