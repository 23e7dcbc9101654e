"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte 2-, 3- and 4-grams of its letters (all else is a space), weighted by
1 + log(count) and the inverse document frequency, of length one. Document frequencies come from every training
text; spherical k-means on a bounded sample of labelled texts gives each language its centroids. A prediction is
the language of the centroid with the largest cosine. A text is rejected below that centroid's cut, which is a low
quantile of the cosines of the training texts that are nearest to it. The vectors have so many cells that chance
overlap, which grows with a text's length, stays below the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks
from .words import mix

#: Size of the hashed vectors; labelled texts of a language that k-means sees about, at most.
DIMENSIONS = 32768
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 4
#: A centroid's cut is this share of this quantile of its training texts' cosines (of its language's, if that is less), and no less than MIN_COSINE.
CUT_QUANTILE = 0.001
CUT_SHARE = 0.9
MIN_COSINE = 0.05
UNKNOWN = "und"
#: Cells that are multiplied with the centroids at once, bytes of text that are cut into grams at once (a longer text goes
#: alone) and rows that leave a worker at once.
PART = 1 << 17
GRAM_BYTES = 1 << 16
ROWS = 1024

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Centroids:
    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    cuts: np.ndarray


def gram_cells(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and count of the hashed byte n-grams, by row and cell; texts are lower-cased before."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    byte = np.where(_LETTER[data], data, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    with np.errstate(over="ignore"):
        for size in (2, 3, 4):
            if len(byte) < size:
                break
            key = np.full(len(byte) - size + 1, size, np.uint64)
            for k in range(size):
                key = key * np.uint64(257) + byte[k : len(byte) - size + 1 + k]
            # grams of one text that are not white space alone or doubled
            keep = (row[: len(key)] == row[size - 1 :]) & ~((byte[: len(key)] == 32) & (byte[1 : len(key) + 1] == 32))
            found.append(((mix(key[keep]) % np.uint64(dims)).astype(np.int64) + row[: len(key)][keep] * dims).astype(np.int32))
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    counts = np.diff(np.append(first, len(at))).astype(np.float32)
    row, cell = np.divmod(at[first].astype(np.int64), dims)
    return row, cell, counts


def unit_weights(n: int, row: np.ndarray, cell: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the cells of ``n`` rows, each row of length one."""
    out = (1 + np.log(counts)) * idf[cell]
    return (out / np.maximum(np.sqrt(np.bincount(row, out * out, n)), 1e-12)[row]).astype(np.float32)


def cosines(n: int, row: np.ndarray, cell: np.ndarray, weights: np.ndarray, by_cell: np.ndarray) -> np.ndarray:
    """n x centroids, from the centroids' weights by cell; the rows' cells are added in bounded parts."""
    out = np.zeros((n, by_cell.shape[1]), np.float32)
    for a in range(0, len(row), PART):
        r = row[a : a + PART]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(weights[a : a + PART, None] * by_cell[cell[a : a + PART]], first, axis=0)
    return out


def _rows(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Cells and counts of a batch, at most 256 texts at once so that they stay small."""
    texts = batch.column(batch.schema.get_field_index("text"))
    for a in range(0, batch.num_rows, 256):
        low = pa.RecordBatch.from_arrays([pc.utf8_lower(texts.slice(a, 256))], names=["text"])
        for first, end, data, offsets in text_chunks(low, "text", GRAM_BYTES):
            yield a + first, a + end, gram_cells(data, offsets, dims)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows, so that what is made of one stays small in the worker and in the JVM."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for first, end, (_, cell, _) in _rows(batch, dims):
                total += np.bincount(cell, minlength=dims)
                n += end - first
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1), pa.int64()), pa.array(np.append(total[cells], n), pa.int64())], names=["cell", "n"])

    return run


def _sampled(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, (row, cell, counts) in _rows(batch, dims):
                ends = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(1).slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(counts)),
                    ],
                    names=["key", "lang", "cells", "counts"],
                )

    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; starts from texts that lie far apart."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen].copy()
    for _ in range(rounds):
        owner = (x @ centre.T).argmax(1)
        for j in range(len(centre)):
            if (owner == j).any():
                centre[j] = x[owner == j].sum(0)
                centre[j] /= max(np.linalg.norm(centre[j]), 1e-12)
    return centre


def train(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", dims: int = DIMENSIONS, sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids of the labelled rows of ``docs`` (null label or text: not used).

    Every labelled text counts for the document frequencies. k-means sees a sample of about ``sample`` texts per
    language, chosen by a hash of the id; what reaches the driver is bounded by languages x sample x dims.
    """
    known = docs.select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL")
    total, n = np.zeros(dims, np.int64), 0
    found = known.select("text").mapInArrow(_frequencies(dims), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in found.collect():  # at most dims + 1 rows
        if row["cell"] < 0:
            n = row["n"]
        else:
            total[row["cell"]] = row["n"]
    idf = np.log((1 + n) / (1 + total)).astype(np.float32) + 1
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return Centroids([], np.zeros(0, int), np.zeros((0, dims), np.float32), idf, np.zeros(0))
    share: Column = F.lit(0)
    for lang, value in shares.items():
        share = F.when(F.col("lang") == lang, F.lit(int(value * 2**30))).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("key"), F.lit(2**30)) < share)
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))]
    )
    rows: dict[str, list] = {lang: [] for lang in languages}
    for batch in picked.mapInArrow(_sampled(dims), schema).toArrow().to_batches():
        for key, lang, cells, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
            rows[lang.as_py()].append((key.as_py() or "", np.asarray(cells.values), np.asarray(counts.values)))
    owner, vectors = [], []
    for k, lang in enumerate(languages):
        rows[lang].sort(key=lambda r: r[0])
        x = np.zeros((max(1, len(rows[lang])), dims), np.float32)
        for j, (_, cells, counts) in enumerate(rows[lang]):
            x[j, cells] = unit_weights(1, np.zeros(len(cells), int), cells, counts, idf)
        centre = spherical_kmeans(x, centroids)
        owner += [k] * len(centre)
        vectors.append(centre)
    model = Centroids(languages, np.array(owner), np.concatenate(vectors), idf, np.full(len(owner), MIN_COSINE))
    model.cuts = _cuts(model, known.select("text"))
    return model


def _cuts(model: Centroids, texts: DataFrame) -> np.ndarray:
    """The centroids' cuts by all training texts with a letter. Few outliers may share a centroid, so their language's quantile bounds its cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            top, score = _nearest(model, batch.column(0))
            told = top < len(model.owner)
            yield pa.RecordBatch.from_arrays([pa.array(top[told]), pa.array(np.append(model.owner, 0)[top[told]]), pa.array(score[told])], names=["centroid", "owner", "score"])

    low = F.percentile_approx("score", F.lit(CUT_QUANTILE), F.lit(10000)).alias("low")
    found = texts.mapInArrow(run, "centroid long, owner long, score double").rollup("owner", "centroid").agg(low).where("owner IS NOT NULL").collect()  # a row a centroid and language
    quantile = {(r["owner"], r["centroid"]): r["low"] for r in found}
    lows = [min(quantile.get((k, c), 1.0), quantile.get((k, None), 0.0)) for c, k in enumerate(model.owner.tolist())]
    return np.maximum(MIN_COSINE, CUT_SHARE * np.array(lows))


def _nearest(model: Centroids, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (all of them: none) and the cosine, for each text."""
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score = np.full(len(texts), len(model.owner)), np.zeros(len(texts))
    if len(model.owner):
        by_cell = np.ascontiguousarray(model.vectors.T)
        for first, end, (row, cell, counts) in _rows(pa.RecordBatch.from_arrays([texts], names=["text"]), len(model.idf)):
            near = cosines(end - first, row, cell, unit_weights(end - first, row, cell, counts, model.idf), by_cell)
            top = near.argmax(1)
            best[first:end], score[first:end] = top, near[np.arange(end - first), top]
    best[~lettered], score[~lettered] = len(model.owner), 0
    return best, score


def _accepted(model: Centroids, best: np.ndarray, score: np.ndarray) -> np.ndarray:
    return score >= np.append(model.cuts, np.inf)[best]


def keep_identified(docs: DataFrame, model: Centroids, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that are not rejected: see ``identify``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            best, score = _nearest(model, batch.column(at))
            yield batch.filter(pa.array(_accepted(model, best, score)))

    return docs.mapInArrow(run, docs.schema)


def _predicted(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages[k] for k in model.owner), UNKNOWN], object)
        for batch in _parts(batches):
            best, score = _nearest(model, batch.column(1))
            columns = [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(float)), pa.array(~_accepted(model, best, score))]
            yield pa.RecordBatch.from_arrays(columns, names=["carried", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Centroids, carry: Column, *, text_col: str = "text") -> DataFrame:
    """carried, lang_pred, score, rejected for each row; ``carry`` is handed through.

    Null text, or none with a letter, is ``und`` with score 0 and rejected. Without a trained language all are.
    """
    rows = docs.select(carry.alias("carried"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("carried", rows.schema["carried"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(_predicted(model), schema)
