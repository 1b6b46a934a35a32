"""Document fingerprints by winnowing, in DataFrame functions alone."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinata.llm.common import cut, prepare, small_side

#: Bits of a packed key that hold the complement of a position: texts of up to 2^28 words.
POS_BITS = 28
POS_MAX = 2**POS_BITS - 1


def winnow(df: DataFrame, text: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """`df` with column `out`: the winnowed fingerprint of column `text`, an array of packed longs.

    Words are runs without white space, at most 24 characters each, in lower
    case.  Each window of `window` neighbouring k-word hashes gives its least
    hash, the rightmost one on ties.  A key packs the hash (36 bits) above the
    complement of its position (28 bits), so the least key *is* that choice, and
    `hashes` and `positions` take it apart.  Two texts that share
    k + window - 1 words in a row share a key's hash there.

    The least of a window of 2^j comes from two windows of 2^(j-1): log2(window)
    passes over the array, none of them quadratic.  A text of fewer than k words
    has one gram, the words it has; null or blank texts have an empty array.
    """
    if window & (window - 1) or window < 1 or k < 1:
        raise ValueError("window must be a power of two and k positive")
    w, g, m = f"__{out}_w", f"__{out}_g", f"__{out}_m"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\S{1,24}"), F.lit(0)), lambda t: F.xxhash64(t)))

    def gram(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, *[F.get(F.col(w), i + j) for j in range(1, k)])
        return F.shiftleft(h, POS_BITS).bitwiseOR(F.lit(POS_MAX).cast("long") - i)

    df = df.withColumn(g, F.transform(w, gram))
    # grams that would run over the end go, but for the one gram of a short text
    df = df.withColumn(g, F.slice(g, 1, F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1)))))
    least, step = g, 1
    while step < window:
        df = df.withColumn(nxt := f"{m}{step}", F.transform(least, _least_ahead(least, step)))
        least, step = nxt, step * 2
    n = F.size(g)
    df = df.withColumn(out, F.array_distinct(F.slice(least, 1, F.greatest(n - (window - 1), F.least(n, F.lit(1))))))
    return df.drop(w, g, *[c for c in df.columns if c.startswith(m)])


def _least_ahead(column: str, step: int):
    return lambda x, i: F.least(x, F.get(F.col(column), i + step))


def hashes(keys: Column) -> Column:
    """The set of hashes of a fingerprint."""
    return F.array_distinct(F.transform(keys, lambda x: F.shiftrightunsigned(x, POS_BITS)))


def positions(keys: Column) -> Column:
    """The word positions (from 0) of a fingerprint's keys, in text order."""
    return F.transform(keys, lambda x: F.lit(POS_MAX).cast("long") - x.bitwiseAND(F.lit(POS_MAX).cast("long")))


def written(keys: Column) -> Column:
    """A fingerprint as text: `hash:position` in hexadecimal, in text order, joined by spaces."""
    pair = F.transform(keys, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, POS_BITS))), F.lit(":"), F.lower(F.hex(F.lit(POS_MAX).cast("long") - x.bitwiseAND(F.lit(POS_MAX).cast("long"))))))
    return F.array_join(pair, " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of hash sets; two empty sets are alike (1), one empty is not (0)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


#: Stretches that `next_rows` cuts its rows into at most, and rows drawn for each to find where.
STRETCHES, DRAWN = 8192, 20


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _stretches(d: DataFrame, order: list[str]) -> Column:
    """The number of a row's stretch in `order` (long columns): stretches of about as many rows each, one after the other.

    Their bounds come from a draw by hash of at most about STRETCHES * DRAWN rows; they
    settle how even the stretches are, and nothing else.  A row finds its stretch by
    bisection.
    """
    count = min(4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), STRETCHES)
    share = min(1.0, count * DRAWN / max(d.count(), 1))
    drawn = d.where(F.pmod(F.xxhash64(*order, F.lit("stretch")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*order).collect()
    bounds = sorted(tuple(r) for r in drawn)[DRAWN::DRAWN] if drawn else []
    if not bounds:
        return F.lit(0)
    columns = [_array(list(c)) for c in zip(*bounds, strict=True)]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def bisect(at: Column, step: Column) -> Column:
        bound = F.struct(*[F.get(c, at + step - 1).alias(f"c{i}") for i, c in enumerate(columns)])
        return F.when((at + step <= len(bounds)) & (bound <= row), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), bisect)


def next_rows(df: DataFrame, key: str, text: str, carry: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`add(df)` with `next_<c>` for each c of `carry`: that of the next row in descending `key`, after the last the first.

    Rows of one key follow each other by xxhash64 of column `text`, then in any order: they
    are alike.  A null key counts as the least long.  Rows are cut into stretches of
    this order, dealt once, and looked ahead within each; many rows of one key, or of one
    key and text, fill several stretches.  A stretch's last row takes the first row of the stretch after
    it: those rows, one a stretch, are read again.  One row follows itself; no rows, no rows.
    """
    order = ["__k", "__t", "__m"]
    key_up = F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))  # rises as the key falls
    d = df.withColumns({"__k": key_up, "__t": F.xxhash64(text), "__m": F.monotonically_increasing_id()})
    d = d.withColumn("__b", _stretches(d, order))
    firsts = sorted(d.groupBy("__b").agg(F.min(F.struct(*order)).alias("f")).select("__b", "f.__k", "f.__t").collect())  # a row a stretch
    after = [*firsts[1:], *firsts[:1]]
    pairs = F.arrays_zip(_array([r[0] for r in firsts]).alias("b"), _array([r[1] for r in after]).alias("k"), _array([r[2] for r in after]).alias("t"))
    to = df.sparkSession.range(1).select(F.inline(pairs)).toDF("__b", "__k", "__t")
    heads = add(d.drop("__b", "__m").join(F.broadcast(to.select("__k", "__t").distinct()), ["__k", "__t"]).dropDuplicates(["__k", "__t"]))
    heads = cut(to.join(heads.select("__k", "__t", F.struct(*carry).alias("__head")), ["__k", "__t"]).select("__b", "__head"))
    w = W.partitionBy("__b").orderBy(*order)
    d = add(d.repartition("__b")).withColumn("__next", F.lead(F.struct(*carry)).over(w)).join(small_side(heads), "__b", "left")
    nxt = F.coalesce("__next", "__head")
    return d.select(*[c for c in d.columns if not c.startswith("__")], *[nxt[c].alias(f"next_{c}") for c in carry])


def edit(d: DataFrame) -> DataFrame:
    """`d` (text, next_text) with `n_chars` and `edited`: the last third of the code points gives way to the first as many of the next text."""
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    return d.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring("next_text", F.lit(1), third)))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited) of every row, as `fingerprints` has them, without the fingerprints."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return edit(next_rows(d, "id", "text", ["text"], lambda x: x)).select("id", "n_chars", "edited")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprint every text and its edit: rows (id, n_chars, edited, keys, edited_keys, near_edited, near_next).

    The edit replaces the last third of the code points (rounded down) by the
    first as many of the next text in descending id (all, if it has fewer; `next_rows` says
    what follows among equal and missing ids).  Nulls count as empty texts; equal texts have
    equal keys; columns besides id and text are not read.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = next_rows(d, "id", "text", ["text", "keys"], lambda x: winnow(x, "text", "keys", k, window))
    d = winnow(edit(d).drop("text", "next_text"), "edited", "edited_keys", k, window)
    d = d.withColumns({"h": hashes(F.col("keys")), "he": hashes(F.col("edited_keys")), "hn": hashes(F.col("next_keys"))})
    return d.select("id", "n_chars", "edited", "keys", "edited_keys", likeness("h", "he").alias("near_edited"), likeness("h", "hn").alias("near_next"))
