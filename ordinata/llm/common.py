"""What several operators share: tables, cuts of the lineage, grouped Arrow code, components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, after its rows and values were measured.
BROADCAST_BYTES = 8 << 20

#: The setting of bytes in a batch, its default, and what is set here: long texts then stay within a worker's memory.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b", "4m")

_local_dir: list[str] = []
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the batches that go to Python, unless the session does, and send this package to executors that lack it.

    Every operator calls it.  The bound is a setting of the session, since Spark has it nowhere
    else; a session that sets `spark.sql.execution.arrow.maxBytesPerBatch` keeps its own.  Python finds the package by PYTHONPATH or the working folder; else it is sent, once.
    """
    if spark.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]:
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in (os.path.abspath(p) for p in found if p):
        return
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/ordinata", "zip", root, "ordinata"))  # Spark serves the file from there
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where Spark runs in one process."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="ordinata-"))
    return _local_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: later plans start from the files.

    A lost executor then costs a reread, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame) -> DataFrame:
    """A hint to broadcast `df` if its values, measured here, are few bytes; else `df` as it is, to be shuffled.

    `df` should be a cut, since it is read first.
    """
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def _fixed(df: DataFrame) -> int | None:
    """Bytes of a row as `measured` counts them; None where they differ from row to row."""
    nested = ("string", "binary", "array", "struct", "map")
    return None if any(f.dataType.typeName() in nested for f in df.schema.fields) else 16 + 8 * len(df.columns)


def measured(df: DataFrame) -> int:
    """Bytes of the values of `df`: 16 a row, 8 a number, the lengths of texts, and for nested values those of their JSON."""
    if _fixed(df):
        return df.count() * _fixed(df)
    size = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "struct", "map"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected `edges` (a long, b long): rows (v, comp), comp the least vertex.

    Rounds of large-star and small-star contraction; each node's neighbours are
    reduced by `min` and joined back (`known`: a hub's edges are not dealt by the hub), so no
    neighbourhood is gathered anywhere.
    Vertices without edges are not listed; no edges, no rows.  Self-loops and
    repeated edges do no harm.
    """
    least = [F.min("v").alias("m"), F.count("*").alias("n")]
    cur = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        made: list[DataFrame] = []
        # large star: every larger neighbour of u hangs on the least of u's neighbourhood
        back = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))
        of = cur.select("u", "v").union(back).groupBy("u").agg(*least).withColumn("m", F.least("m", "u"))
        large = cut(known(back, of, ["u"], "n", 2 * cur.count(), made).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # small star: u and its smaller neighbours hang on the least of them
        low = large.groupBy("u").agg(*least)
        small = known(large, low, ["u"], "n", large.count(), made)
        nxt = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # done when every vertex hangs on one root and no root hangs on anything
        moved = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        for old in (cur, large, *made):
            discard(old)
        cur = nxt
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(cur.select("v", F.col("v").alias("comp")).distinct())


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None) -> DataFrame:
    """`fn` over whole groups of `keys`, many groups at a call.

    The rows are dealt by `keys` and sorted in their partition; `fn` gets a table
    of complete groups and the offsets where they start (and the end).  A group
    must fit in a task: callers bound it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b, held[-1] if held else None, keys)
            if not len(starts):
                held.append(b)
                continue
            last = int(starts[-1])
            t = pa.Table.from_batches([*held, b.slice(0, last)]) if held or last else None
            if t is not None and t.num_rows:
                yield from fn(t.combine_chunks(), _offsets(t, keys))
            held = [b.slice(last)]
        if held:
            t = pa.Table.from_batches(held)
            yield from fn(t.combine_chunks(), _offsets(t, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def _starts(b: pa.RecordBatch, before: pa.RecordBatch | None, keys: list[str]) -> np.ndarray:
    """Rows of `b` at which a new group starts (not row 0 if it goes on with `before`)."""
    new = np.zeros(b.num_rows, bool)
    new[0] = before is None
    for k in keys:
        v = b.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
        if before is not None and before.column(k)[before.num_rows - 1].as_py() != b.column(k)[0].as_py():
            new[0] = True
    return np.flatnonzero(new)


def _offsets(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes from one array and the offsets of its rows, in items."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * values.itemsize, np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def known(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, made: list[DataFrame] | None = None) -> DataFrame:
    """`rows` left-joined with `facts`, which has a row for each value of `keys` that some of the `total` rows have, and in `count` how many have it.

    Facts of few bytes are broadcast, by the rows there can be or as measured on a cut of them; `join_classes` joins others.
    `made` gets the cut, if there is one, for the caller to discard.
    """
    width = _fixed(facts)
    if not width or total * width > BROADCAST_BYTES:
        if not hasattr(facts, "cut_path"):
            facts = cut(facts)
            if made is not None:
                made.append(facts)
        if measured(facts) > BROADCAST_BYTES:
            return join_classes(rows, facts, keys, count, total)
    return rows.join(F.broadcast(facts), keys, "left").select(*rows.columns, *[c for c in facts.columns if c not in keys])


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """`rows` left-joined with `classes` (unique on `keys`, all filled) without a task that gets a hot class whole.

    Classes of more than a thousandth of the `total` rows, by their column `count`,
    are fewer than a thousand and joined by broadcast.  Their rows, and those with a null key, take part in
    the other join under a key of their own, by place: copies, equal or missing ids do not heap up.
    """
    values = [c for c in classes.columns if c not in keys]
    bound = max(total / 1000, 8)
    key, filled = F.xxhash64(*keys), F.lit(True)
    for k in keys:
        filled = filled & F.col(k).isNotNull()
    hot = classes.where(F.col(count) > bound).select(*keys, F.struct(*values).alias("__hot"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__key", F.when(F.col("__hot").isNull() & filled, key).otherwise(F.monotonically_increasing_id()))
    cold = classes.where(F.col(count) <= bound).select(key.alias("__key"), *[F.col(k).alias(f"__c_{k}") for k in keys], F.struct(*values).alias("__cold"))
    same = rows["__key"] == cold["__key"]
    for k in keys:
        same = same & (rows[k] == cold[f"__c_{k}"])
    out = rows.join(cold, same, "left").drop(cold["__key"])
    got = F.coalesce("__hot", "__cold")
    return out.select(*[c for c in rows.columns if not c.startswith("__")], *[got[v].alias(v) for v in values])


def chunk_pairs(rows: DataFrame, key: str, big: DataFrame, most: int) -> DataFrame:
    """`rows` (with `id`) with `part` and `chunk`: all 0 in a group of `key` that is not in `big` (key, all), else a row for each pair of chunks.

    A group of `big` is cut into q = all / most chunks by hash of `id`, and a row
    of chunk c goes to the q parts of (c, d), so that any two rows of the group
    meet in a part, and a part holds two chunks at most.
    """
    big = cut(big.select(key, "all"))
    q = F.coalesce(F.ceil(F.col("all") / most).cast("int"), F.lit(1))
    total = big.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    d = known(rows, big, [key], "all", total).withColumn("q", q).withColumn("c", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("q")).cast("int"))
    d = d.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return d.withColumn("part", F.least("c", "d").cast("long") * 65536 + F.greatest("c", "d")).withColumnRenamed("c", "chunk").drop("q", "d", "all")


def search(n: int, alike) -> Iterator[tuple[int, np.ndarray]]:
    """Components of n nodes, breadth first: (root, members found from it); alike(i, others) says which of `others` node i meets.

    A node is compared with nodes that no component has yet, so a dense group costs little more than its size.
    """
    free = np.arange(n)
    while len(free) > 1:
        root, free = int(free[0]), free[1:]
        todo = [root]
        while todo and len(free):
            hit = alike(todo.pop(), free)
            if hit.any():
                found = free[hit]
                free = free[~hit]
                todo += found.tolist()
                yield root, found
