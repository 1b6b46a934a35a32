"""Quality by co-training: a content view and a page view teach each other, then score together."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import cut, discard
from ordinata.llm.features import VIEWS, labelled, rows_of, select, unlabelled, verdicts
from ordinata.llm.linear import Rows, logistic, sigmoid
from ordinata.llm.texts import U, slices


@dataclasses.dataclass
class Model:
    """For each view its features and weights (intercept last), the calibration (intercept and a factor a view), and the score under which a document is rejected."""

    chosen: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]
    joint: np.ndarray
    threshold: float = 0.5


def sample_rows(rows: DataFrame, chosen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, Rows]]:
    """(ids, y, rows of each view) of a bounded sample, sorted by id: the driver gets the chosen features' numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            lists = []
            for view, features in chosen.items():
                c, at, _ = rows_of(VIEWS[view](b), features)
                lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c, pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists], ["id", "y", *chosen])

    got = rows.mapInArrow(run, "id long, y int, " + ", ".join(f"{v} array<int>" for v in chosen)).toPandas().sort_values("id", kind="stable")
    out = {}
    for view, features in chosen.items():
        parts = [np.asarray(x, np.int64) for x in got[view]]
        out[view] = Rows(np.concatenate(parts) if parts else np.empty(0, np.int64), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64), len(features))
    return got["id"].to_numpy(), got["y"].to_numpy(), out


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, pool: int = 6000, rounds: int = 4, grow: int = 400, sure: float = 0.95, lost: float = 0.005) -> Model:
    """Learn from rows (id, text, source, lang) and labels (id, y of 0 or 1).

    At most about `most` labelled and `pool` unlabelled rows are drawn, by hash of
    id, one of equal texts.  A fifth of the labelled ones is kept for calibration and for the
    threshold, under which at most the share `lost` of that fifth's good documents fall.  In each of
    `rounds` each view labels the up to `grow` pool rows of either class of which it
    is most certain (probability `sure` or more) for the other view.  Rows without a
    label in 0 or 1, or with null text, teach nothing; an id with several labels
    counts as its least.  Fewer than two classes: every document scores 1 / 2 or
    the share of the only class, and none is rejected.
    """
    marks = labels.where("y in (0, 1)").groupBy("id").agg(F.min("y").cast("int").alias("y"))
    base = docs.select("id", "text", "source", "lang")
    known = cut(labelled(base, marks, most))
    free = cut(unlabelled(base, marks, pool).withColumn("y", F.lit(-1)))
    chosen = {view: select(known, view) for view in VIEWS}
    ids, y, x = sample_rows(known, chosen)
    _, _, extra = sample_rows(free, chosen)
    discard(known)
    discard(free)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model({v: np.empty(0, U) for v in VIEWS}, {v: np.zeros(1) for v in VIEWS}, np.array([np.log(share / (1 - share)), 0.0, 0.0]), 0.0)
    check = np.random.Generator(np.random.PCG64(5)).permutation(len(y)) % 5 == 0
    train, held = np.flatnonzero(~check), np.flatnonzero(check)
    pseudo = {v: (np.empty(0, np.int64), np.empty(0)) for v in VIEWS}
    weights = {}
    for turn in range(rounds + 1):
        for v in VIEWS:
            own, rows = x[v].take(train), extra[v].take(pseudo[v][0])
            both = Rows(np.concatenate((own.columns, rows.columns)), np.append(own.offsets, own.offsets[-1] + rows.offsets[1:]), own.width)
            weights[v] = logistic(both, np.append(y[train], pseudo[v][1]), np.append(np.ones(len(train)), np.full(len(rows), 0.5)))
        if turn == rounds or not len(extra["page"]):
            break
        told = {}
        for v, other in (("content", "page"), ("page", "content")):
            p = sigmoid(extra[v].dot(weights[v][:-1]) + weights[v][-1])
            by = np.argsort(-p, kind="stable")
            good = by[: grow * (turn + 1)]
            bad = by[::-1][: grow * (turn + 1)]
            good, bad = good[p[good] >= sure], bad[p[bad] <= 1 - sure]
            told[other] = (np.append(good, bad), np.append(np.ones(len(good)), np.zeros(len(bad))))
        pseudo = told
    # the views' logits on rows that neither has seen, each a feature of one last regression
    z = np.stack([x[v].take(held).dot(weights[v][:-1]) + weights[v][-1] for v in VIEWS], 1)
    joint = calibrate(z, y[held]) if len(np.unique(y[held])) == 2 else np.array([0.0, 0.5, 0.5])
    return Model(chosen, weights, joint, threshold(z, y[held], lost))


def threshold(z: np.ndarray, y: np.ndarray, lost: float) -> float:
    """The highest score, 1 / 2 at most, under which no more than the share `lost` of the good rows fall.

    Each half of the rows is scored by a calibration that the other half taught.
    Where a half has one class only, 1 / 2.
    """
    half, scores = np.arange(len(y)) % 2, np.zeros(len(y))
    for h in (0, 1):
        if len(np.unique(y[half != h])) < 2:
            return 0.5
        w = calibrate(z[half != h], y[half != h])
        scores[half == h] = sigmoid(w[0] + z[half == h] @ w[1:])
    good = np.sort(scores[y == 1])
    return min(0.5, float(good[int(lost * len(good))])) if len(good) else 0.5


def calibrate(z: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Intercept and factors of a logistic regression on a few numbers, by Newton steps."""
    a = np.column_stack([np.ones(len(z)), z])
    w, keep = np.append(0.0, np.full(z.shape[1], 1 / z.shape[1])), np.diag([0.0] + [ridge] * z.shape[1])
    prior = w.copy()
    for _ in range(30):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-6 * np.eye(len(w)), a.T @ (p - y) + keep @ (w - prior))
        w = w - np.clip(step, -1, 1)
    return w


def judged(m: Model, b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Each view's probability and the joint one of rows with text, source and lang."""
    z = {}
    for v in VIEWS:
        c, at, _ = rows_of(VIEWS[v](b), m.chosen[v])
        z[v] = Rows(c, at, len(m.chosen[v])).dot(m.weights[v][:-1]) + m.weights[v][-1]
    joint = sigmoid(m.joint[0] + sum(f * z[v] for f, v in zip(m.joint[1:], VIEWS, strict=True)))
    return {v: sigmoid(x) for v, x in z.items()} | {"score": joint}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, content, page, score): each view's own probability and the joint one, for every row (id, text, source, lang), from whole texts.

    Null texts have no content features; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            found = judged(shared.value, b)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, found.values())], ["id", *found])

    return docs.select("id", "text", "source", "lang").mapInArrow(run, "id long, content double, page double, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (with text, source and lang), all columns, whose joint score reaches the model's threshold: no row is dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return verdicts(docs, ["text", "source", "lang"], lambda b: judged(shared.value, b)["score"] >= shared.value.threshold)


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as rows (id, text, source, lang)."""
    have = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), have("source").alias("source"), have("lang").alias("lang"))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for `docs` from `labels` with doc_id and quality."""
    return fit(rows(docs), labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("y")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, content, page, score, keep) of every document; `labels` has doc_id and quality."""
    model = learned(docs, labels)
    return score(rows(docs), model).withColumn("keep", F.col("score") >= model.threshold)
