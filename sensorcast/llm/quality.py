"""Ordinal quality classifier: cumulative links over hashed text.

Documents rated with a grade 0..K-1 teach one weight per hashed feature, shared by all grades, and
K-1 ordered thresholds: P(grade > k) = sigmoid(w.x - threshold_k). Selection uses the probability of
the tail and the expected grade.

The model is fitted on a bounded sample of the rated documents (``sample``, by hash of the id) with
whole texts; its features are all that reaches the driver. Every document is then scored where it is
read, over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.llm.words import Memo, doc_columns

BITS = 18
SHAPES = 1 << 10  # the first cells hold word shapes, the rest words
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def _describe(word: str) -> int:
    """Cells of a word's letters (0: it has none) and of its shape, as cell * SHAPES + shape."""
    letters = "".join(_LETTERS.findall(word)).lower()
    shape = _DIGITS.sub("9", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))[:8]
    cell = 0
    if letters:
        cell = SHAPES + xxhash.xxh3_64_intdigest(letters.encode("utf-8", "surrogatepass")) % ((1 << BITS) - SHAPES)
    return cell * SHAPES + 2 + xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) % (SHAPES - 2)


class Features:
    """Sparse features of a text: 1 for each distinct word, 4 times the share of each word shape, and
    4 times the share of words that repeat the one before (cell 1)."""

    def __init__(self):
        self._memo = Memo(_describe)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        both = np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))
        letters = both // SHAPES
        cells = np.unique(letters)
        cells = cells[cells > 0]
        counts = np.bincount(both % SHAPES, minlength=SHAPES)
        shapes = np.flatnonzero(counts)
        counts = counts[shapes]
        echo = np.count_nonzero((letters[1:] == letters[:-1]) & (letters[1:] > 0)) / len(words)
        return (
            np.concatenate([[1], shapes, cells]),
            np.concatenate([[4 * echo], 4 * counts / len(words), np.ones(len(cells))]),
        )


@dataclass
class OrdinalModel:
    """weights per cell and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: float) -> np.ndarray:
        """P(grade > k) for k = 0..K-2, descending."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -50, 50)))


def fit_ordinal(
    indices: list[np.ndarray],
    values: list[np.ndarray],
    grades: np.ndarray,
    classes: int,
    steps: int = 250,
    rate: float = 0.1,
    ridge: float = 1e-4,
    least: int = 5,
) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam over the whole sample.

    Cells seen in fewer than ``least`` documents get no weight. Thresholds stay ordered, as their
    gaps are exponentials; grades weigh the inverse root of their frequency."""
    size = 1 << BITS
    # Narrow types, as this is held by the driver.
    rows = np.repeat(np.arange(len(indices), dtype=np.int32), [len(i) for i in indices])
    cells = np.concatenate(indices).astype(np.int32, copy=False) if len(indices) else np.empty(0, np.int32)
    vals = np.concatenate(values).astype(np.float32, copy=False) if len(values) else np.empty(0, np.float32)
    seen = np.bincount(cells, minlength=size)
    used = (seen[cells] >= max(least, 0.002 * len(indices))) & (cells > 0)
    rows, cells, vals = rows[used], cells[used], vals[used]
    names = np.flatnonzero(np.bincount(cells, minlength=size))
    place = np.zeros(size, np.int32)
    place[names] = np.arange(len(names))
    cells = place[cells]
    n, d = len(indices), len(names)
    share = np.bincount(grades, minlength=classes) / max(n, 1)
    importance = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
    importance /= max(importance.sum(), 1e-12)
    x = np.zeros(d + classes - 1)
    x[d] = -1.0
    m, v = np.zeros_like(x), np.zeros_like(x)

    def thresholds(p):
        return np.concatenate([[p[0]], p[0] + np.cumsum(np.exp(p[1:]))])

    for step in range(1, steps + 1 if n else 1):
        t = thresholds(x[d:])
        margin = np.bincount(rows, vals * x[cells], minlength=n)
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        s_low = 1 / (1 + np.exp(-np.clip(bounds[grades] - margin, -50, 50)))
        s_high = 1 / (1 + np.exp(-np.clip(bounds[grades + 1] - margin, -50, 50)))
        p = np.maximum(s_high - s_low, 1e-12)
        g_low, g_high = s_low * (1 - s_low), s_high * (1 - s_high)
        g_margin = importance * (g_high - g_low) / p
        g_t = np.zeros(classes - 1)
        np.add.at(g_t, grades[grades < classes - 1], (-importance * g_high / p)[grades < classes - 1])
        np.add.at(g_t, grades[grades > 0] - 1, (importance * g_low / p)[grades > 0])
        g = np.empty_like(x)
        g[:d] = np.bincount(cells, vals * g_margin[rows], minlength=d) + ridge * x[:d]
        g[d] = g_t.sum()
        for k in range(1, classes - 1):
            g[d + k] = g_t[k:].sum() * np.exp(x[d + k])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[names] = x[:d]
    return OrdinalModel(weights, thresholds(x[d:]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(documents: DataFrame, ratings: DataFrame, classes: int = 3, sample: int = 12_000) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents. ``ratings`` has (doc_id, grade).

    A document rated more than once takes its lowest grade; null ids and grades are left out."""
    rated = (
        ratings.filter("doc_id is not null and grade is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = doc_columns(documents).join(F.broadcast(rated), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for frame in frames:
            made = [features.of(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "grade": frame["grade"],
                    "cells": [i.astype("<i4").tobytes() for i, _ in made],
                    "vals": [v.astype("<f4").tobytes() for _, v in made],
                }
            )

    made = texts.mapInPandas(run, "grade int, cells binary, vals binary").toPandas()
    order = np.lexsort((made["vals"], made["cells"], made["grade"])) if len(made) else []
    made = made.iloc[order]
    return fit_ordinal(
        [np.frombuffer(b, "<i4") for b in made["cells"]],
        [np.frombuffer(b, "<f4") for b in made["vals"]],
        made["grade"].to_numpy(np.int64),
        classes,
    )


def scores_of(texts: pa.Array, model: OrdinalModel, features: Features) -> np.ndarray:
    """P(grade > k) per text and k; texts without words are certain to have grade 0."""
    out = np.zeros((len(texts), len(model.thresholds)))
    for n, text in enumerate(texts):
        cells, values = features.of(text.as_py())
        if len(cells):
            out[n] = model.tails(float(model.weights[cells] @ values))
    return out


def score(documents: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_1 .. tail_K-1, kept) of every row; tail_k is P(grade >= k), and a
    document is kept if that of the top grade is at least ``least``.

    Null, empty and blank texts have expected grade 0 and are not kept. Null ids, repeated rows and
    other columns pass; an empty table gives no rows."""
    names = [f"tail_{k + 1}" for k in range(len(model.thresholds))]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            tails = scores_of(batch.column(1), shared.value, features)
            columns = [batch.column(0), pa.array(tails.sum(axis=1)), *map(pa.array, np.ascontiguousarray(tails.T))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(tails[:, -1] >= least)], names=["doc_id", "expected_grade", *names, "kept"]
            )

    schema = "doc_id long, expected_grade double, " + ", ".join(f"{n} double" for n in names) + ", kept boolean"
    return doc_columns(documents).mapInArrow(run, schema)


def select(documents: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are kept; see ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            kept = scores_of(batch.column(at), shared.value, features)[:, -1] >= least
            yield batch.filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)
