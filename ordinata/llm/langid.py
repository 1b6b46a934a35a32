"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import prepare
from ordinata.llm.texts import mix, slices

UND = "und"
_LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams of all texts, one text after the other, and the n + 1 offsets of the texts in them.

    Code points count in lower case; ASCII signs, digits and controls and general
    punctuation are one space a run, and a space stands at either end.
    A text without letters has no n-grams, nor does one shorter than n.
    """
    lower = [f" {t.lower()} " if _LETTER.search(t) else "" for t in texts]
    owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    cp = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = ((cp < 0x80) & ~((cp >= 0x61) & (cp <= 0x7A))) | ((cp >= 0x2000) & (cp < 0x2070)) | ((cp >= 0x80) & (cp < 0xC0))
    again = np.zeros(len(cp), bool)
    again[1:] = plain[1:] & plain[:-1] & (owner[1:] == owner[:-1])
    cp, owner = np.where(plain, np.uint32(0x20), cp)[~again].astype(np.uint64), owner[~again]
    h = cp.copy()
    for n in range(1, max(orders, default=0) + 1):
        if n > 1:  # h: of the n code points from each place on
            h = h[:-1] * np.uint64(0x100000001B3) + cp[n - 1 :]
        if n in orders:
            whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
            bucket = (mix(h + np.uint64(n << 56)) >> np.uint64(32)).astype(np.int64) & (buckets - 1)
            own = owner[: len(owner) - n + 1][whole]
            yield bucket[whole], np.append(0, np.cumsum(np.bincount(own, minlength=len(texts))))


def log_odds(texts: list[str], m: Model) -> np.ndarray:
    """The log probability of each text and language: the sparse batch of n-gram counts by texts, multiplied with the model's matrix.

    A language's column is gathered at the batch's buckets and summed text by text, so that no dense row of counts is made.
    """
    z = np.tile(m.log_prior, (len(texts), 1))
    for bucket, at in _grams(texts, m.orders, m.log_prob.shape[0]):
        some = np.flatnonzero(np.diff(at))
        for j in range(z.shape[1] if len(some) else 0):
            z[some, j] += np.add.reduceat(m.log_prob[:, j][bucket], at[some])
    return z


@dataclasses.dataclass
class Model:
    """Learned languages and the matrix of log probabilities, buckets by languages."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]


def fit(labelled: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, smoothing: float = 0.1, most: int = 20_000, seed: int = 17) -> Model:
    """Learn from rows (id, text, lang), at most about `most` of each language, drawn by hash of id and text.

    Rows with null text or lang teach nothing, nor do texts without letters.
    Counts are summed on the tasks, then by language and bucket, so the driver gets
    languages x buckets numbers however many rows there are.  No rows, no
    languages.  The number of languages must stay under 1000: the matrix is
    broadcast (256 kB a language).
    """
    rows = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(1000).collect()}
    if len(counts) >= 1000:
        raise ValueError("more than 999 languages")
    if not counts:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in (s for batch in batches for s in slices(batch, "text")):
            langs = b.column("lang").to_pylist()
            for bucket, at in _grams(b.column("text").to_pylist(), orders, buckets):
                for i in np.flatnonzero(np.diff(at)):
                    np.add.at(sums.setdefault(langs[i], np.zeros(buckets, np.int64)), bucket[at[i] : at[i + 1]], 1)
        for lang, c in sums.items():
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(c[hit])], ["lang", "bucket", "n"])

    summed = rows.where(drawn).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    langs = sorted(set(got["lang"]))
    table = np.full((buckets, len(langs)), smoothing)
    for j, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    prior = np.array([counts[x] for x in langs], float)
    return Model(langs, np.asfortranarray(np.log(table / table.sum(0))), np.log(prior / prior.sum()) if langs else prior, orders)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (id, lang_pred, score) and the columns of `keep` for every document, from its whole text.

    `und` with score 0 for null texts, texts without letters, and where nothing
    was learned.  The score is the posterior probability of the language; of equal
    posteriors the first name in order wins.  Repeated rows are scored alike.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    schema = ", ".join(f"{n} {t}" for n, t in rows.drop("text").dtypes) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (s for batch in batches for s in slices(batch, "text")):
            langs, scores = [UND] * b.num_rows, np.zeros(b.num_rows)
            if m.langs:
                texts = [t or "" for t in b.column("text").to_pylist()]
                z = log_odds(texts, m)
                best = z.argmax(1)
                chance = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts):
                    if _LETTER.search(t):
                        langs[i], scores[i] = m.langs[best[i]], chance[i]
            kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], [*[n for n in b.schema.names if n != "text"], "lang_pred", "score"])

    return rows.mapInArrow(score, schema)
