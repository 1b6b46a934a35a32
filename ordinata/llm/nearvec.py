"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import binary, chunk_pairs, components, cut, grouped, join_classes, prepare, search, utf8
from ordinata.llm.texts import U, mix

#: Projections whose windows are counted, and a window's half width in distances at the threshold.
PROJECTIONS, HALF = 48, 1.5
#: Width of a cell in distances at the threshold, vectors wanted in a cell, chance to miss a pair at the threshold.
CELL, WANTED, MISS = 4.0, 128, 1e-3
#: Vectors of a cell that are compared in one task; a larger cell is cut in pairs of chunks.
MOST = 2000


def _normal_cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def _same_cell(sd: float, width: float) -> float:
    """Chance that two numbers with a normal difference fall into one cell of a randomly placed grid."""
    x = (np.arange(2000) + 0.5) / 2000 * width
    return float((2 * np.exp(-((x / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi)) * (1 - x / width)).sum() * width / 2000)


def plan(vectors: int, cosine: float) -> tuple[float, int, int, int]:
    """(distance at the threshold, dimensions of a cell, tables of cells, collisions asked) for the largest label.

    A cell has more dimensions the more vectors there are, so that an unrelated
    pair rarely shares one; the number of tables makes up for it, so that a pair at
    the threshold shares one with probability 1 - MISS.  The count asked of
    PROJECTIONS windows is passed by such a pair with probability 1 - MISS too.
    """
    distance = math.sqrt(2 - 2 * cosine)
    near, far = _same_cell(distance, CELL * distance), _same_cell(math.sqrt(2), CELL * distance)
    depth = max(1, math.ceil(math.log(max(vectors, 2) / WANTED) / math.log(1 / far)))
    tables = max(1, math.ceil(math.log(MISS) / math.log(1 - near**depth)))
    p, below, asked = 2 * _normal_cdf(HALF) - 1, 0.0, 0
    while (below := below + math.comb(PROJECTIONS, asked) * p**asked * (1 - p) ** (PROJECTIONS - asked)) < MISS:
        asked += 1
    return distance, depth, tables, asked


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each dimension; only vectors that are whole, finite and not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.append(0, np.cumsum(n))[:-1]
    for dim in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == dim)
        v = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        yield rows[good], v[good]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _directions(dim: int, count: int, stream: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([0xE3B, dim, stream])).standard_normal((dim, count))


def collisions(p: np.ndarray, half: float) -> np.ndarray:
    """For each pair of rows of `p`, the projections (columns) in which one lies in the window centred at the other.

    Each projection is sorted; a row's window is a run of that order.
    """
    n = len(p)
    count = np.zeros((n, n), np.uint8)
    order = np.argsort(p, axis=0, kind="stable")
    place = np.arange(n)
    for j in range(p.shape[1]):
        s = p[order[:, j], j]
        lo, hi = np.searchsorted(s, p[:, j] - half, "left"), np.searchsorted(s, p[:, j] + half, "right")
        count[:, order[:, j]] += (place >= lo[:, None]) & (place < hi[:, None])
    return count


def links(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component) of every vector: its links and the least id that links reach, its own included.

    Vectors of equal, non-null labels and equal length link at a cosine of
    `cosine` or more, in double precision.  Vectors that are null, empty or zero,
    or hold null or non-finite components, link with nothing, as do null labels; a
    null id stays null.  Equal vectors of a label are one class, whose members all
    link; copies are never expanded into pairs.

    Unit vectors are dealt into cells of several tables (each a grid on a few
    projections); in a cell, sorted projections count the collisions of each pair,
    and pairs with the count asked are verified.  A pair counts in the first table
    whose cell it shares.  `plan` sets the numbers: about 0.2 % of pairs exactly at
    the threshold are missed, closer ones less.
    """
    prepare(vectors.sparkSession)
    kind = vectors.schema[vec_col].dataType
    single = "float" in kind.simpleString()
    real = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [None] * b.num_rows
            names = np.zeros((b.num_rows, 2), np.int64)
            dims = np.zeros(b.num_rows, np.int32)
            for at, v in _matrix(b.column("vec")):
                for i, x in zip(at.tolist(), v.astype(real), strict=True):
                    vec[i] = x.tobytes()
                    names[i] = np.frombuffer(hashlib.blake2b(vec[i], digest_size=16).digest(), np.int64)
                dims[at] = v.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(dims), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(vec, pa.binary())], ["id", "label", "dim", "h1", "h2", "vec"])

    parsed = cut(rows.mapInArrow(parse, "id long, label string, dim int, h1 long, h2 long, vec binary"))
    keys = ["label", "dim", "h1", "h2"]
    good = parsed.where("dim > 0 and label is not null and id is not null")
    classes = cut(good.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    distance, depth, tables, asked = plan(largest, cosine)
    reps = good.join(classes.select(*keys, F.col("rep").alias("id"), "copies"), [*keys, "id"]).dropDuplicates(keys).select("id", "copies", "label", "dim", "vec")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                v = _unit(np.frombuffer(utf8(own.column("vec"))[0].tobytes(), real).reshape(-1, dim).astype(np.float64))
                width = CELL * distance
                shift = np.random.Generator(np.random.PCG64([0xE3C, dim])).uniform(0, width, depth * tables)
                grid = np.floor((v @ _directions(dim, depth * tables, 1) + shift) / width).astype(np.int64).view(U).reshape(-1, tables, depth)
                label = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in own.column("label").to_pylist()], U)
                key = mix(label + U(dim))[:, None] + mix(np.arange(tables, dtype=U))
                for j in range(depth):
                    key = mix(key + grid[:, :, j])
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[:, t].copy().view(np.int64)), pa.array(np.full(len(v), t, np.int32)), own.column("id"), own.column("copies"), own.column("dim"), binary(key.ravel(), np.arange(len(v) + 1) * tables), own.column("vec")],
                        ["cell", "t", "id", "copies", "dim", "cells", "vec"],
                    )

    dealt = reps.mapInArrow(deal, "cell long, t int, id long, copies long, dim int, cells binary, vec binary")
    size = dealt.groupBy("cell").agg(F.count("*").alias("all")).where(F.col("all") > MOST)
    dealt = chunk_pairs(dealt, "cell", size, MOST)

    def compare(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies, dims, chunk, no = (t.column(c).to_numpy() for c in ("id", "copies", "dim", "chunk", "t"))
        cells = utf8(t.column("cells"))[0].tobytes()
        cells = np.frombuffer(cells, U).reshape(-1, tables)
        data, at = utf8(t.column("vec"))
        data = data.tobytes()
        out_id, out_n, out_root = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            dim, m = int(dims[lo]), hi - lo
            v = _unit(np.frombuffer(data[at[lo] : at[hi]], real).reshape(m, dim).astype(np.float64))
            may = collisions(v @ _directions(dim, PROJECTIONS, 2), HALF * distance) >= asked
            np.fill_diagonal(may, False)
            own = chunk[lo:hi]
            if own.min() != own.max():  # pairs within a chunk meet in a part of their own
                may &= own[:, None] != own
            i, j = np.nonzero(may)
            if not len(i):
                continue
            earlier = np.zeros(len(i), bool)
            for s in range(int(no[lo])):
                earlier |= cells[lo + i, s] == cells[lo + j, s]
            i, j = i[~earlier], j[~earlier]
            near = np.concatenate([np.einsum("ij,ij->i", v[i[a : a + 100_000]], v[j[a : a + 100_000]]) >= cosine for a in range(0, len(i), 100_000)] or [np.empty(0, bool)])
            i, j = i[near], j[near]
            if not len(i):
                continue
            adjacent = np.zeros((m, m), bool)
            adjacent[i, j] = True
            n = np.bincount(i, weights=copies[lo + j], minlength=m).astype(np.int64)
            root = np.arange(m)
            for r, found in search(m, lambda x, free, adjacent=adjacent: adjacent[x, free]):
                root[found] = r
            hit = np.flatnonzero(n)
            out_id.append(ids[lo + hit])
            out_n.append(n[hit])
            out_root.append(ids[lo + root[hit]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_id, out_n, out_root)], ["id", "n", "root"])

    found = cut(grouped(dealt, ["cell", "part"], compare, "id long, n long, root long"))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "rep")
    info = classes.join(counts, "rep", "left").join(comps, "rep", "left").select(*keys, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component"))
    linked = parsed.select("id", *[F.when(F.col("dim") > 0, F.col(k)).alias(k) if k == "label" else F.col(k) for k in keys])
    out = join_classes(linked, info, keys, "copies", parsed.count())
    return out.select("id", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
