"""Sharding by a k-d tree over metadata, cut at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinata.llm.common import cut, prepare, small_side

#: Bits of a cut's key: the place along the dimension above, a hash that breaks ties below.
PLACE_BITS, TIE_BITS, STEP_BITS = 23, 40, 12
DIMS = ("first_id", "length", "source", "lang")
#: A point over this share of its node is placed whole before the rest is cut: fewer than 64 in a node.
HEAVY = 1 / 64


def _points(rows: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their point's key, and the points: one for each text, several for a text whose copies outweigh a shard."""
    text = rows.groupBy("h", "crc", "size").agg(F.sum("size").alias("all")).where(F.col("all") > target)
    pieces = small_side(cut(text.select("h", "crc", "size", F.ceil(2 * F.col("all") / target).alias("pieces"))))
    rows = rows.join(pieces, ["h", "crc", "size"], "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces"))))
    rows = rows.withColumn("pid", F.xxhash64("h", "crc", "size", "piece")).select("id", "size", "crc", "source", "lang", "pid")
    points = rows.groupBy("pid").agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.coalesce(F.min("id"), F.lit(0)).cast("double").alias("first_id"), F.log(F.first("size").cast("double")).alias("length"),
        F.crc32(F.coalesce(F.min("source"), F.lit(""))).cast("double").alias("source"), F.crc32(F.coalesce(F.min("lang"), F.lit(""))).cast("double").alias("lang"),
    )
    return rows, points


def _key(dim: str, low: float, high: float) -> Column:
    """The cut's key of a point: its place in [low, high] along `dim`, ties by hash."""
    place = F.floor((F.col(dim) - low) / max(high - low, 1e-300) * (2**PLACE_BITS - 1)).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64("pid", F.lit(dim)), 64 - TIE_BITS)
    return F.shiftleft(F.greatest(F.least(place, F.lit(2**PLACE_BITS - 1)), F.lit(0)), TIE_BITS).bitwiseOR(tie)


def _pick(nodes: dict[int, Column], default: Column) -> Column:
    out = default
    for n, c in nodes.items():
        out = F.when(F.col("node") == n, c).otherwise(out)
    return out


def tree(points: DataFrame, shards: int) -> DataFrame:
    """`points` (pid, w, n and DIMS) with `node`, the leaf of each: 0 to shards - 1.

    Each node with more than one shard to fill is cut along its widest dimension
    (its spread over that of all points) so that both sides get their share of
    its bytes.  Points heavier than HEAVY of it go first, whole, to the side with
    most room.  The cut is found by histograms of 2^STEP_BITS bins over the keys,
    each time within the bin that holds it, for all nodes of a level at once: the
    driver sees sums by bin, never points.  Plans grow with the nodes: meant for up to
    some hundred shards.
    """
    points = points.withColumn("node", F.lit(0))
    parts, whole = {0: (0, shards)}, None
    while any(k > 1 for _, k in parts.values()):
        ask = [F.sum("w").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]]
        stats = {r["node"]: r for r in points.groupBy("node").agg(*ask).collect()}
        if whole is None:
            whole = {d: (stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) or 1.0 for d in DIMS} if stats else {}
        todo = {n: k for n, (_, k) in parts.items() if k > 1 and n in stats}
        if not todo:
            break
        key, cuts, left = {}, {}, {}
        for n in todo:
            dim = max(DIMS, key=lambda d, s=stats[n]: (s[f"max_{d}"] - s[f"min_{d}"]) / whole[d])
            key[n] = _key(dim, stats[n][f"min_{dim}"], stats[n][f"max_{dim}"])
        limit = _pick({n: F.lit(stats[n]["w"] * HEAVY) for n in todo}, F.lit(float("inf")))
        heavy: dict[int, list] = {n: [] for n in todo}
        for r in points.where(F.col("w") > limit).select("node", "pid", "w").collect():  # fewer than 64 a node
            heavy[r["node"]].append((r["w"], r["pid"]))
        sides: dict[int, tuple[list[int], list[int]]] = {}
        for n, k in todo.items():
            want = stats[n]["w"] * (k // 2) / k
            room, sides[n] = [want, stats[n]["w"] - want], ([], [])
            for w, pid in sorted(heavy[n], reverse=True):
                s = int(room[1] > room[0])
                sides[n][s].append(pid)
                room[s] -= w
            left[n] = max(room[0], 0.0)
            cuts[n] = [0, PLACE_BITS + TIE_BITS, 0.0, None]  # low end, bits of the range, weight before it, the cut
        light = points.where(F.col("w") <= limit).withColumn("key", _pick(key, F.lit(0).cast("long")))
        while open_ := {n: c for n, c in cuts.items() if c[3] is None}:
            shift = {n: max(c[1] - STEP_BITS, 0) for n, c in open_.items()}
            inside = F.lit(False)
            for n, c in open_.items():
                inside = inside | ((F.col("node") == n) & (F.col("key") >= c[0]) & (F.col("key") - c[0] <= 2 ** c[1] - 1))
            bins = _pick({n: F.shiftright(F.col("key") - c[0], shift[n]) for n, c in open_.items()}, F.lit(0).cast("long"))
            rows = light.where(inside).groupBy("node", bins.alias("bin")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
            for n, c in open_.items():
                before, at = c[2], None
                for r in sorted((r for r in rows if r["node"] == n), key=lambda r: r["bin"]):
                    if before + r["w"] > left[n]:
                        at = r
                        break
                    before += r["w"]
                if at is None:
                    c[3] = c[0] + 2 ** c[1]  # all of it goes left
                elif at["n"] == 1 or not shift[n]:
                    end = 0 if left[n] - before < before + at["w"] - left[n] else 1  # the nearer side of the point
                    c[3] = c[0] + ((at["bin"] + end) << shift[n])
                else:
                    c[0], c[1], c[2] = c[0] + (at["bin"] << shift[n]), shift[n], before
        new, grown = dict(parts), {}
        for n, k in todo.items():
            first = parts[n][0]
            new[n], other = (first, k // 2), first + k // 2
            new[other] = (other, k - k // 2)
            right = (F.col("w") <= stats[n]["w"] * HEAVY) & (key[n] >= cuts[n][3]) if cuts[n][3] < 2**63 else F.lit(False)
            if sides[n][1]:
                right = right | F.col("pid").isin(sides[n][1])
            grown[n] = F.when(right, F.lit(other)).otherwise(F.lit(n))
        points, parts = points.withColumn("node", _pick(grown, F.col("node"))), new
    return points


def slots(rows: DataFrame, spread: int = 20_000) -> DataFrame:
    """`rows` (id, shard and others) with `slot`: 0, 1, 2 ... in each shard, no gaps.

    Rows are numbered in buckets of about `spread` rows of a shard, by hash of id; a bucket starts
    where the buckets before it end.  No task sees a whole shard.
    """
    rows = cut(rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "crc", F.lit("slot")), F.lit(max(32, rows.count() // spread))))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("k"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = small_side(cut(sizes.select("shard", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))))
    number = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "crc"))
    return rows.withColumn("nr", number).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("nr") - 1).drop("nr", "start", "bucket")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal `docs` into `shards` of nearly equal bytes: rows (id, size, crc, shard, slot).

    A row's size is the UTF-8 bytes of its text (null: none) plus one.  Rows of
    equal texts make one point and stay together, unless together they outweigh
    a shard; then pieces of them, by hash of id, are points.  Points are dealt by
    `tree` over the first id, the length, the source and the language.  Missing
    metadata counts as empty.  Repeated rows count as rows; no rows, no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    have = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("h"), have("source").alias("source"), have("lang").alias("lang")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    rows, points = _points(rows, total / shards or 1.0)
    points = cut(points)
    placed = tree(points, shards)
    # the few points of many rows are joined by broadcast, the rest without a hot key
    many = placed.where(F.col("n") > max(count / 1000, 8)).select("pid", F.col("node").alias("hot"))  # fewer than 1000 points
    rows = rows.join(F.broadcast(many), "pid", "left")
    rest = placed.where(F.col("n") <= max(count / 1000, 8)).select(F.col("pid").alias("cold"), "node")
    rows = rows.withColumn("cold", F.when(F.col("hot").isNull(), F.col("pid")).otherwise(F.monotonically_increasing_id())).join(rest, "cold", "left")
    return slots(rows.select("id", "size", "crc", F.coalesce("hot", "node").cast("int").alias("shard")))
