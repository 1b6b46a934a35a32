"""Soft-membership mixing: document rates whose expected token totals by domain match targets."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import cut, discard, utf8
from ordinata.llm.features import content, labelled, rows_of, select
from ordinata.llm.linear import Rows, softmax
from ordinata.llm.quality import sample_rows
from ordinata.llm.texts import slices, word_hashes


def posteriors(docs: DataFrame, labels: DataFrame, domains: int, most: int = 8000) -> DataFrame:
    """(id, tokens, p): of every row (id, text) its words and the probability of each domain.

    `labels` (id, y) gives some rows' domain, 0 to `domains` - 1; a multinomial
    regression on text features learns from at most about `most` of them, drawn by
    hash of id.  A domain without examples has probability 0.  Without any
    examples all domains are as likely.  Null texts have no words.
    """
    marks = labels.where((F.col("y") >= 0) & (F.col("y") < domains)).groupBy("id").agg(F.min("y").cast("int").alias("y"))
    known = cut(labelled(docs.select("id", "text"), marks, most))
    chosen = {"content": select(known, "content", most=10_000)}
    _, y, x = sample_rows(known, chosen)
    discard(known)
    seen = np.unique(y)
    weights = softmax(x["content"], np.searchsorted(seen, y), len(seen)) if len(seen) > 1 else np.zeros((len(chosen["content"]) + 1, max(len(seen), 1)))
    shared = docs.sparkSession.sparkContext.broadcast((chosen["content"], weights, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w, seen = shared.value
        for b in (s for batch in batches for s in slices(batch, "text")):
            c, at, _ = rows_of(content(b.column("text")), features)
            r = Rows(c, at, len(features))
            z = np.stack([r.dot(w[:-1, i]) for i in range(w.shape[1])], 1) + w[-1]
            e = np.exp(z - z.max(1, keepdims=True))
            p = np.full((b.num_rows, domains), 1 / domains) if not len(seen) else np.zeros((b.num_rows, domains))
            if len(seen):
                p[:, seen] = e / e.sum(1, keepdims=True)
            tokens = np.diff(word_hashes(*utf8(b.column("text")))[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * domains, pa.int32()), pa.array(p.ravel()))], ["id", "tokens", "p"])

    return docs.select("id", "text").mapInArrow(run, "id long, tokens long, p array<double>")


def _replayed(p: np.ndarray, errors: list[np.ndarray]) -> np.ndarray:
    """Rates after the gradient steps that `errors` record: from 1, down the expected errors, never below 0."""
    r = np.ones(len(p))
    for e in errors:
        r = np.maximum(r - p @ e, 0)
    return r


def _mapped(table: DataFrame, fn: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = b.column("p").flatten().to_numpy().reshape(b.num_rows, -1)
                yield from fn(b, np.asarray(b.column("tokens"), np.float64), p)

    return table.mapInArrow(run, schema)


def rates(table: DataFrame, targets: Callable[[np.ndarray, np.ndarray], np.ndarray], steps: int = 200, close: float = 2e-4) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """`table` (id, tokens, p) with `rate`, and the wanted and the reached token totals by domain.

    `targets` gets the expected totals at rate 1, and the part of them from documents
    that belong to the domain with probability 1 / 2 or more, and gives those wanted.
    Projected gradient descent on half the squared errors of the expected totals, in
    the metric of the documents' tokens: a step moves a document's rate by its
    expected (scaled) error, and rates below 0 go to 0.  Steps are scaled by the inverse of the
    domains' product sums over the documents with a positive rate, and halved while
    the squared error does not fall; where that leads nowhere, by one over the largest curvature.
    Each trial is one pass that sums a few numbers per domain; a
    rate is a function of the document's posteriors and the past steps, so nothing is
    stored between passes and a lost task repeats them.  Ends when no total is off by
    more than `close` of the sum of all, or when no step lowers the error or `steps` passes did not do: the targets
    are then out of reach, the totals those nearest to them that were found, and a warning says what they are.  A domain that no document has keeps its error and moves nothing.
    """

    def sums(past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By domain: totals, those of sure members, and products with all domains over the documents with a positive rate."""

        def fn(b: pa.RecordBatch, tokens: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            r = _replayed(p, past)
            mass = (r * tokens)[:, None] * p
            parts = np.column_stack([mass.sum(0), (mass * (p >= 0.5)).sum(0), (p * (tokens * (r > 0))[:, None]).T @ p])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), parts.shape[1])), pa.array(np.tile(np.arange(parts.shape[1], dtype=np.int32), len(parts))), pa.array(parts.ravel())], ["d", "j", "s"])

        got = _mapped(table, fn, "d int, j int, s double").groupBy("d", "j").agg(F.sum("s").alias("s")).collect()
        out = np.zeros((max((r["d"] for r in got), default=-1) + 1, max((r["j"] for r in got), default=1) + 1))
        for r in got:
            out[r["d"], r["j"]] = r["s"]
        return out[:, 0], out[:, 1], out[:, 2:]

    past, want, now = descend(sums, targets, steps, close)

    def final(b: pa.RecordBatch, tokens: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tokens"), b.column("p"), pa.array(_replayed(p, past))], ["id", "tokens", "p", "rate"])

    return _mapped(table, final, "id long, tokens long, p array<double>, rate double"), want, now


def descend(sums: Callable, targets: Callable, steps: int, close: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps that `rates` describes, the wanted and the reached totals; `sums` makes a pass over the documents."""
    now, sure, gram = sums([])
    want = targets(now, sure) if len(now) else now
    if not now.any():
        return [], want, now
    has, scale = now > 0, now.sum()
    off = lambda totals: np.where(has, totals - want, 0.0)
    past: list[np.ndarray] = []
    passes, newton = 1, True
    while np.abs(off(now)).max() > close * scale:
        error, ridge = off(now), 1e-9 * max(np.trace(gram), 1e-300)
        # the metric of the tokens makes the plain step's curvature at most the largest eigenvalue
        step = np.linalg.solve(gram + ridge * np.eye(len(now)), error) if newton else error / max(np.linalg.eigvalsh(gram).max(), 1e-300)
        for _ in range(12):
            new, _, new_gram = sums([*past, step])
            passes += 1
            if (off(new) ** 2).sum() < (1 - 1e-3) * (error**2).sum():
                past, now, gram, newton = [*past, step], new, new_gram, True
                break
            step = step / 2
        else:
            if not newton:
                break
            newton = False
        if passes > steps:
            break
    if np.abs(off(now)).max() > close * scale:
        warnings.warn(f"targets out of reach in {passes} passes: totals {now.tolist()}, wanted {want.tolist()}", stacklevel=3)
    return past, want, now


def copies(rate: Column, id_col: Column) -> Column:
    """Whole copies of a document for a rate: the fraction decides by hash of the id."""
    u = F.pmod(F.xxhash64(id_col, F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + u).cast("int")


def domains(labels: DataFrame) -> DataFrame:
    """(id, y): 0 for labels of quality 1 that are not toxic, 1 for quality 0, 2 for toxic; `labels` has doc_id, quality and toxic."""
    y = F.when(F.col("toxic") > 0, 2).when(F.col("quality") == 0, 1).when(F.col("quality") > 0, 0).otherwise(-1)
    return labels.select(F.col("doc_id").cast("long").alias("id"), y.alias("y"))


def mix(docs: DataFrame, labels: DataFrame, weights: list[float]) -> DataFrame:
    """(id, tokens, p, rate, copies, reached) of every row (id, text): the rates give the domains their `weights` of all tokens.

    The total stays; weights are scaled to 1.  `reached`, the same in all rows, has the
    domains' shares of all tokens at these rates: where documents cannot meet the
    weights (a domain without documents) it tells how far off they are.  No rows, no rows.
    """
    share = np.array(weights, float) / sum(weights)
    table = cut(posteriors(docs, labels, len(weights)))
    out, want, now = rates(table, lambda base, _: share * base.sum())
    reached = F.array(*[F.lit(float(x)) for x in now / max(want.sum(), 1e-300)]) if len(now) else F.lit(None).cast("array<double>")
    return out.withColumn("copies", copies(F.col("rate"), F.col("id"))).withColumn("reached", reached)
