"""Sparse features of whole texts, and which of them tell classes apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import cut, prepare, small_side, utf8
from ordinata.llm.texts import U, mix, slices, word_hashes

#: Bytes that end a word here: ASCII other than letters.
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:128] = True
_NOT_LETTER[[*range(65, 91), *range(97, 123)]] = False
#: Classes of bytes in shapes: capitals, small letters, digits, other letters; signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")
PREFIXES = (4, 5, 6)


def _tagged(kind: int, *values: np.ndarray) -> np.ndarray:
    """A feature of its own for each kind and combination of values."""
    h = U((kind + 1) * 0xD6E8FEB86659FD93 % 2**64)
    for v in values:
        h = mix(h + v.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    return h


def _log_bin(share: np.ndarray) -> np.ndarray:
    """0 for none, then one more for each doubling from 1 / 1024."""
    return np.where(share > 0, np.clip(np.floor(np.log2(np.maximum(share, 2.0**-11)) + 11), 1, 11), 0).astype(np.int64)


#: Features of a kind and the offsets of the rows in them.
Part = tuple[np.ndarray, np.ndarray]


def content(texts: pa.Array) -> list[Part]:
    """Features of each text by kind, with repeats: words in lower case, their first bytes, token shapes by share with share of different words.

    Null and empty texts have no features.
    """
    data, offsets = utf8(texts)
    docs = len(offsets) - 1
    words, at, *heads = word_hashes(data, offsets, gaps=_NOT_LETTER, prefixes=PREFIXES)
    count = np.diff(at)
    parts = [(words, at), *[(h[h != 0], np.append(0, np.cumsum(h != 0))[at]) for h in heads]]
    # tokens between white space, runs of one class as one sign
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    tokens, tat = word_hashes(shape[keep], np.append(0, np.cumsum(keep))[offsets], fold=False)
    feats, ends = [np.empty(0, U)], np.zeros(docs + 1, np.int64)
    for d in range(docs):
        if tat[d] < tat[d + 1]:
            kind, n = np.unique(tokens[tat[d] : tat[d + 1]], return_counts=True)
            feats.append(_tagged(0, kind, _log_bin(n / n.sum())))
        if count[d]:
            share = len(np.unique(words[at[d] : at[d + 1]])) / count[d]
            feats.append(_tagged(1, np.array([int(share * 10)]), np.array([int(np.log2(count[d]) / 2)])))
        ends[d + 1] = ends[d] + (tat[d] < tat[d + 1] and len(kind)) + (count[d] > 0)
    return [*parts, (np.concatenate(feats), ends)]


def page(batch: pa.RecordBatch) -> list[Part]:
    """Features of each row's metadata: source, language, length, and how the page is laid out in lines and signs."""
    data, offsets = utf8(batch.column("text"))
    n = np.diff(offsets)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    size = np.maximum(n, 1)
    lines = sums(data == 10) + 1
    capital = sums((data >= 65) & (data < 91)) / size
    digit = sums((data >= 48) & (data < 58)) / size
    sign = sums((data < 128) & _NOT_LETTER[data] & (data > 32)) / size
    white = sums(data <= 32) / size
    lang, source = (np.array([hash_text(v) for v in batch.column(c).to_pylist()], U) for c in ("lang", "source"))
    numbers = [np.log2(size).astype(np.int64), np.log2(lines).astype(np.int64), np.log2(size / lines).astype(np.int64), *[(20 * x).astype(np.int64) for x in (capital, digit, sign, white)]]
    cols = [_tagged(10, lang), _tagged(11, source), _tagged(12, lang, source), *[_tagged(13 + i, x) for i, x in enumerate(numbers)], _tagged(30, numbers[5], numbers[6])]
    table = np.stack(cols, 1)
    return [(table.ravel(), np.arange(len(n) + 1) * table.shape[1])]


def hash_text(value: str | None) -> int:
    out = 0xCBF29CE484222325
    for b in (value or "").encode():
        out = (out ^ b) * 0x100000001B3 % 2**64
    return out


VIEWS = {"content": lambda b: content(b.column("text")), "page": page}


def _lot(seed: int, share: float) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))


def labelled(docs: DataFrame, marks: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """The rows of `docs` (id, text, ...) that `marks` (id, y) label, of at most about `most` labels, drawn by hash of id; one of equal texts.

    The labels are drawn before they meet the texts, so that texts are not dealt.
    """
    prepare(docs.sparkSession)
    few = cut(marks.where(_lot(seed, most / max(marks.count(), 1))))
    return docs.where("text is not null").join(small_side(few), "id").dropDuplicates(["text"])


def unlabelled(docs: DataFrame, marks: DataFrame, most: int, seed: int = 12) -> DataFrame:
    """At most about `most` rows of `docs` without a label, drawn by hash of id; one of equal texts."""
    few = docs.where("text is not null").where(_lot(seed, most / max(docs.count(), 1)))
    return few.join(marks.select("id"), "id", "left_anti").dropDuplicates(["text"])


def select(rows: DataFrame, view: str, most: int = 20_000, least_z: float = 4.0, least_share: float = 0.01, lift: float = 0.0) -> np.ndarray:
    """Sorted features of `view` that tell some class `y` of the (bounded) sample `rows` from the rest, by z-score; `most` of them at most.

    Features are counted once a document, summed on the tasks, then by feature.  A
    feature must be in three documents and in `least_share` as many as the
    smallest class has, so that the words of one text and its near copies do not pass for a class's.
    With `lift`, its share of the last class must be that many times its share of the rest.
    """
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return np.empty(0, U)
    classes, n = sorted(total), sum(total.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            parts = VIEWS[view](b)
            ys = np.asarray(b.column("y"))
            once = [np.unique(np.concatenate([h[at[i] : at[i + 1]] for h, at in parts])) for i in range(b.num_rows)]
            for y in np.unique(ys):
                f, k = np.unique(np.concatenate([o for o, z in zip(once, ys, strict=True) if z == y]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.full(len(f), y, np.int32)), pa.array(k)], ["f", "y", "k"])

    counted = rows.mapInArrow(count, "f long, y int, k long").groupBy("f").agg(F.sum("k").alias("df"), *[F.sum(F.when(F.col("y") == y, F.col("k")).otherwise(0)).alias(f"c{y}") for y in classes])
    scores = []
    for y in classes:
        inside, p = F.col(f"c{y}"), F.col("df") / n
        scores.append(F.abs(inside / total[y] - (F.col("df") - inside) / max(n - total[y], 1)) / F.sqrt(p * (1 - p) * (1 / total[y] + 1 / max(n - total[y], 1)) + 1e-300))
    if lift:
        last, rest = F.col(f"c{classes[-1]}") / total[classes[-1]], (F.col("df") - F.col(f"c{classes[-1]}")) / (n - total[classes[-1]])
        counted = counted.where(last >= lift * rest)
    best = counted.where((F.col("df") >= max(3, least_share * min(total.values()))) & (F.col("df") < n)).select("f", (F.greatest(*scores)).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(most)
    return np.sort(np.array([r["f"] for r in best.collect()], np.int64).view(U))


def rows_of(parts: list[Part], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of the `chosen` features by row: column numbers (each once a row), offsets, and how often any occurs."""
    n = len(parts[0][1]) - 1
    pairs, hits = [np.empty(0, np.int64)], np.zeros(n, np.int64)
    if len(chosen):
        table = np.zeros(1 << 20, bool)
        table[(chosen & U((1 << 20) - 1)).astype(np.int64)] = True
        for h, at in parts:
            may = np.flatnonzero(table[(h & U((1 << 20) - 1)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(chosen, h[may]), len(chosen) - 1)
            sure = chosen[spot] == h[may]
            owner = np.searchsorted(at, may[sure], "right") - 1
            hits += np.bincount(owner, minlength=n)
            pairs.append(owner * len(chosen) + spot[sure])
    pair = np.unique(np.concatenate(pairs))
    width = max(len(chosen), 1)
    return pair % width, np.append(0, np.cumsum(np.bincount(pair // width, minlength=n))), hits


def verdicts(docs: DataFrame, columns: list[str], judge: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` says True of by `columns` (with text): only these go to Python, only a boolean comes back."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            arrays = arrays if isinstance(arrays, tuple) else (arrays,)
            b = pa.RecordBatch.from_arrays(list(arrays), columns)
            yield pa.array(np.concatenate([judge(s) for s in slices(b, "text")] or [np.empty(0, bool)]), pa.bool_())

    return docs.where(kept(*[F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in columns]))
