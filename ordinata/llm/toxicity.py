"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import cut, discard
from ordinata.llm.features import content, labelled, rows_of, select, verdicts
from ordinata.llm.linear import Rows, logistic, ordinal, sigmoid
from ordinata.llm.texts import U, slices

#: Bins of the share of a text's features that are chosen ones, by doubling: columns after the features'.
BINS = 12


@dataclasses.dataclass
class Model:
    """Chosen features, one weight each and for each bin, and the thresholds between grades."""

    chosen: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _columns(batch: pa.RecordBatch, chosen: np.ndarray) -> Rows:
    """A row for each text: its chosen features and the bins up to that of its share of hits."""
    parts = content(batch.column("text"))
    c, to, hits = rows_of(parts, chosen)
    share = hits / np.maximum(sum(np.diff(at) for _, at in parts), 1)
    bins = np.where(hits > 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9)) + BINS), 0, BINS - 1) + 1, 0).astype(np.int64)
    n = np.diff(to)
    ends = np.append(0, np.cumsum(n + bins))
    out = np.empty(ends[-1], np.int64)
    out[np.repeat(ends[:-1] - to[:-1], n) + np.arange(to[-1])] = c
    low = np.append(0, np.cumsum(bins))
    out[np.repeat(ends[:-1] + n - low[:-1], bins) + np.arange(low[-1])] = len(chosen) + np.arange(low[-1]) - np.repeat(low[:-1], bins)
    return Rows(out, ends, len(chosen) + BINS)


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, grades: int = 4) -> Model:
    """Learn from rows (id, text) and labels (id, y): at most about `most` labelled rows, drawn by hash of id.

    `y` is a grade, 0 for clean.  Where the labels have only 0 and 1, the marked
    texts get grades 1 to `grades` - 1, in equal numbers, by how sure models are of them
    that learned from the other thirds of the sample (equal certainty, equal grade).  Null texts and grades teach nothing; an id with
    several grades has the highest.  Fewer than two grades: everything is clean.
    """
    marks = labels.where("y is not null and y >= 0").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    known = cut(labelled(docs.select("id", "text"), marks, most))
    # only features more frequent in marked texts, by a wide margin, are evidence
    binary_rows = known.withColumn("y", (F.col("y") > 0).cast("int"))
    chosen = select(binary_rows, "content", most=5000, least_z=5.0, least_share=0.03, lift=5.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            r = _columns(b, chosen)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.ListArray.from_arrays(pa.array(r.offsets, pa.int32()), pa.array(r.columns, pa.int32()))], ["id", "y", "c"])

    got = known.mapInArrow(run, "id long, y int, c array<int>").toPandas().sort_values("id", kind="stable")
    discard(known)
    y = got["y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2 or not (y == 0).any():
        return Model(np.empty(0, U), np.zeros(BINS), np.full(grades - 1, 30.0))
    parts = [np.asarray(x, np.int64) for x in got["c"]]
    x = Rows(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), len(chosen) + BINS)
    if y.max() == 1:
        y = graded(x, y, grades)
    weights, thresholds = ordinal(x, y, int(y.max()) + 1)
    return Model(chosen, weights, thresholds)


def graded(x: Rows, y: np.ndarray, grades: int, folds: int = 3) -> np.ndarray:
    """Grades from 0 / 1: rows of 1 cut in `grades` - 1 equal parts by the log odds that models of the other folds give them."""
    fold, odds = np.random.Generator(np.random.PCG64(7)).permutation(len(y)) % folds, np.zeros(len(y))
    for f in range(folds):
        w = logistic(x.take(np.flatnonzero(fold != f)), y[fold != f].astype(float))
        odds[fold == f] = x.take(np.flatnonzero(fold == f)).dot(w[:-1]) + w[-1]
    cuts = np.quantile(odds[y == 1], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else np.empty(0)
    return np.unique(np.where(y == 1, 1 + np.searchsorted(cuts, odds, "left"), 0), return_inverse=True)[1]


def judged(m: Model, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The expected grade and the likeliest one of rows with text."""
    r = _columns(b, m.chosen)
    over = sigmoid(r.dot(m.weights)[:, None] - m.thresholds)  # P(grade > k)
    chance = np.concatenate((np.ones((len(over), 1)), over), 1) - np.concatenate((over, np.zeros((len(over), 1))), 1)
    return over.sum(1), chance.argmax(1).astype(np.int32)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, severity, grade) of every row (id, text), from whole texts: the expected grade and the likeliest one.

    All thresholds share the weights, so a higher score raises every grade's
    chance to be passed.  Null and empty texts have no features and the
    severity of such a row; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, judged(shared.value, b))], ["id", "severity", "grade"])

    return docs.select("id", "text").mapInArrow(run, "id long, severity double, grade int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` (with text), all columns, whose expected grade stays under `threshold`: no row is dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return verdicts(docs, ["text"], lambda b: judged(shared.value, b)[0] < threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, severity, grade, toxic) of every document; `labels` has doc_id and toxic."""
    return score(rows(docs), learned(docs, labels)).withColumn("toxic", F.col("severity") >= threshold)


def rows(docs: DataFrame) -> DataFrame:
    """`docs` as rows (id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for `docs` from `labels` with doc_id and toxic."""
    return fit(rows(docs), labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("y")))
