"""N-gram Jaccard join: blocked sparse products of documents by n-grams, with bounds from the set sizes.  Exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.common import binary, components, cut, discard, grouped, join_classes, known, prepare, search, small_side, utf8
from ordinata.llm.texts import U, mix, shingle_hashes, slices, word_hashes

#: Sets, and n-grams of them, that are multiplied in one task; a larger block is cut in parts.
SETS, GRAMS = 96, 200_000


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, sorted, and the offsets of the texts in them."""
    h, at = shingle_hashes(*word_hashes(*utf8(texts)), k)
    sets = [np.unique(h[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    to = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=to[1:])
    return np.concatenate(sets) if sets else np.empty(0, U), to


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each with its length, as byte planes, compressed."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        parts += [np.array([len(c), c.itemsize], "<u4").tobytes(), c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _loose(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = np.frombuffer(data, "<u4", 2, at).tolist()
        planes = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += 8 + n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which wrap around; `np.cumsum` in the same type undoes them."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], k: int, block_bytes: int) -> Iterator[dict]:
    """Runs of rows (id, th, text) of one task with about `block_bytes` of text.

    Each has its distinct n-grams in rising order with the number of its sets that
    hold them; its distinct sets, by size and two sums, as places in that list; and its
    rows, each with the number of its set, -1 for none.  The block's name is made of its place in
    the task and what it holds.
    """
    task, number = TaskContext.get().partitionId(), 0
    known: dict[tuple[int, int, int], int] = {}
    held: list[np.ndarray] = []
    ids: list = []
    ths: list = []
    which: list[int] = []
    size = 0

    def flush() -> dict:
        grams, places, counts = np.unique(np.concatenate(held) if held else np.empty(0, U), return_inverse=True, return_counts=True)
        seal = hashlib.blake2b(repr((task, number, ids[0], ids[-1], len(ids), len(grams), grams[:9].tolist())).encode(), digest_size=8)
        keys = np.array(list(known), U).reshape(-1, 3)
        return {"name": int.from_bytes(seal.digest(), "little", signed=True), "grams": grams, "counts": counts.astype(np.uint32), "places": places.astype(np.uint32), "keys": keys, "ids": ids, "ths": ths, "which": which}

    for batch in batches:
        for b in slices(batch, "text"):
            h, at = _sets(b.column("text"), k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            s1, s2 = (np.zeros(len(n), U) for _ in "ab")
            if len(full):
                s1[full], s2[full] = np.add.reduceat(mix(h), at[full]), np.add.reduceat(mix(h ^ U(0xABCDEF0123456789)), at[full])
            for i, key in enumerate(zip(s1.tolist(), s2.tolist(), n.tolist(), strict=True)):
                if not key[2]:
                    which.append(-1)
                    continue
                if key not in known:
                    known[key] = len(known)
                    held.append(h[at[i] : at[i + 1]])
                which.append(known[key])
            ids += b.column("id").to_pylist()
            ths += b.column("th").to_pylist()
            size += b.column("text").nbytes
            if size >= block_bytes:
                yield flush()
                known, held, ids, ths, which, size, number = {}, [], [], [], [], 0, number + 1
    if ids:
        yield flush()


_ROWS = "block long, kind int, ids array<long>, ths array<long>, which array<int>, packed binary"


def _row(block: int, kind: int, ids: list | None, ths: list | None, which: list | None, packed: bytes) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), *[pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (ths, pa.int64()), (which, pa.int32()))], pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "ids", "ths", "which", "packed"])


def incidence(docs: DataFrame, percent: int, k: int, block_bytes: int = 8 << 20) -> DataFrame:
    """The incidence of sets and n-grams that matter, from rows (id, th, text): (id, th, s1, s2, n) of every row, with null m, and (s1, s2, n, m, grams) of sets that may link.

    An n-gram's level is the logarithm of the number of sets that hold it, over all
    documents: blocks send their distinct n-grams, packed, to a deal by their first bits, where they
    are counted; the levels of those that more than one set holds go back.  So a frequent n-gram
    costs an entry a block.  Sorted by level, then hash, two sets that link share an n-gram among
    the first n - ceil(percent n / 100) + 1 of each.  `grams` has a set's n-grams that
    others hold, in this order (no other n-gram can be shared), and `m` counts those among the
    first ones.  A set whose first n-grams are all its own links with nothing but equal sets, and is left out.

    Two passes over `docs`, which should be files or a cut, give the n-grams and the
    places of them in sets; a reply to a block that the second pass does not know raises.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, math.ceil(math.log2(max(parts, docs.count() / 1000))))
    bits = min(bits, 18)

    def grams_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, k, max(block_bytes, 256 << bits)):  # rows of some dozen n-grams at least
            deal = (b["grams"] >> U(64 - bits)).astype(np.int32)
            found, starts = np.unique(deal, return_index=True)
            ends = np.append(starts[1:], len(deal))
            for lo in range(0, len(found), 256):
                rows = [_squeezed(np.array([a], np.uint32), _steps(b["grams"][a:z]), b["counts"][a:z]) for a, z in zip(starts[lo : lo + 256].tolist(), ends[lo : lo + 256].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 256]), pa.array([b["name"]] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["deal", "block", "packed"])

    def count(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            rows = [_loose(x.as_py()) for x in t.column("packed").slice(lo, hi - lo)]
            grams = [np.cumsum(steps, dtype=U) for _, steps, _ in rows]
            _, spot = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(spot, weights=np.concatenate([n for _, _, n in rows]))
            level = np.minimum(np.floor(np.log2(total)), 255).astype(np.uint8)[spot]
            at = 0
            for block, (first, _, _), g in zip(t.column("block").slice(lo, hi - lo).to_pylist(), rows, grams, strict=True):
                own = level[at : at + len(g)]
                at += len(g)
                shared = np.flatnonzero(own)
                if len(shared):
                    yield _row(block, 1, None, None, None, _squeezed(_steps((shared + first[0]).astype(np.uint32)), _steps(g[shared]), own[shared]))

    def sets_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, k, max(block_bytes, 256 << bits)):
            packed = _squeezed(np.array([len(b["grams"])], np.uint32), *[np.ascontiguousarray(b["keys"][:, i]) for i in range(3)], _steps(b["places"]))
            yield _row(b["name"], 0, b["ids"], b["ths"], b["which"], packed)

    def assemble(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if t.column("kind")[lo].as_py() != 0:
                raise RuntimeError("n-grams of a block without its sets: the input changed between two passes")
            (width,), s1, s2, n, places = _loose(t.column("packed")[lo].as_py())
            places, n = np.cumsum(places, dtype=np.uint32), n.astype(np.int64)
            level, gram = np.zeros(int(width), np.uint8), np.zeros(int(width), U)
            for x in t.column("packed").slice(lo + 1, hi - lo - 1):
                spot, steps, own = _loose(x.as_py())
                spot = np.cumsum(spot, dtype=np.uint32)
                level[spot], gram[spot] = own, np.cumsum(steps, dtype=U)
            which = t.column("which").slice(lo, 1).combine_chunks().flatten().to_numpy()
            pick = lambda x, kind=np.int64: pa.array(np.where(which >= 0, np.append(x, 0)[which], 0).astype(kind))
            none = len(which)
            ids, ths = (t.column(c).slice(lo, 1).combine_chunks().flatten() for c in ("ids", "ths"))
            yield pa.RecordBatch.from_arrays([ids, ths, pick(s1.view(np.int64)), pick(s2.view(np.int64)), pick(n), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], _NAMES)
            if not len(n):
                continue
            ends = np.cumsum(n)
            alone = np.add.reduceat(level[places] == 0, ends - n)
            m = n - (percent * n + 99) // 100 + 1 - alone
            for some in np.array_split(np.flatnonzero(m > 0), max(1, int(n[m > 0].sum()) // 500_000)):
                spots = np.repeat(ends[some] - n[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n[some].sum())
                p, owner = places[spots], np.repeat(np.arange(len(some)), n[some])
                keep = level[p] > 0
                p, owner = p[keep], owner[keep]
                order = np.lexsort((gram[p], level[p], owner))
                to = np.append(0, np.cumsum(np.bincount(owner, minlength=len(some))))
                blank = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([blank, blank, pa.array(s1[some].view(np.int64)), pa.array(s2[some].view(np.int64)), pa.array(n[some]), pa.array(m[some]), binary(gram[p][order], to)], _NAMES)

    replies = grouped(docs.mapInArrow(grams_out, "deal int, block long, packed binary"), ["deal"], count, _ROWS)
    return grouped(docs.mapInArrow(sets_out, _ROWS).union(replies), ["block"], assemble, "id long, th long, s1 long, s2 long, n long, m long, grams binary", order=["kind"])


_NAMES = ["id", "th", "s1", "s2", "n", "m", "grams"]


class _Product:
    """Rows of the product of sets by n-grams with its transpose: overlaps of one set with others, kept where they reach the bound that both sizes set."""

    def __init__(self, h: np.ndarray, at: np.ndarray, n: np.ndarray, percent: int, columns: np.ndarray | None = None):
        """Sets h[at[i]:at[i+1]] of sizes n; with `columns`, overlaps are with these sets only."""
        held = np.diff(at)
        self.n, self.percent, self.free = n, percent, len(n)
        owner = np.repeat(np.arange(len(n)), held)
        _, column, df = np.unique(h, return_inverse=True, return_counts=True)
        shared = df[column] > 1
        self.column, owner = column[shared], owner[shared]
        self.rows = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))
        order = np.argsort(self.column, kind="stable")
        self.posts, self.cols = owner[order], np.append(0, np.cumsum(np.bincount(self.column, minlength=len(df))))
        if columns is not None:
            self._only(columns)

    def _only(self, columns: np.ndarray) -> None:
        left = np.zeros(len(self.n), bool)
        left[columns] = True
        keep = left[self.posts]
        self.cols, self.posts, self.free = np.append(0, np.cumsum(keep))[self.cols], self.posts[keep], len(columns)

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` link with set i: 100 * intersection >= percent * union."""
        if len(others) * 2 < self.free:  # postings of the sets that are left
            self._only(others)
        c = self.column[self.rows[i] : self.rows[i + 1]]
        start, count = self.cols[c], self.cols[c + 1] - self.cols[c]
        total = int(count.sum())
        if not total:
            return np.zeros(len(others), bool)
        spots = np.repeat(start - np.cumsum(count) + count, count) + np.arange(total)
        overlap = np.bincount(self.posts[spots], minlength=len(self.n))[others]
        return (overlap > 0) & (100 * overlap >= self.percent * (self.n[i] + self.n[others] - overlap))


def _multiplied(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Edges (a, b) that join the sets of each group of `members` (keys, name, n, grams, seeks) that links connect, by their names.

    Rows with `seeks` 0 make up the group.  Where rows have `seeks` 1, only these are compared, with all of `seeks` 0.
    Sets of one name are connected already: an edge is given once.
    """

    def run(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, at = utf8(t.column("grams"))
        h, at = np.frombuffer(data.tobytes(), U), at // 8
        names, n, seeks = (t.column(c).to_numpy() for c in ("name", "n", "seeks"))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            sets = h[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n[lo:hi], percent
            if seeks[lo:hi].any():
                there = np.flatnonzero(seeks[lo:hi] == 0)
                made = _Product(*sets, columns=there)
                pairs = ((i, there[made.alike(i, there)]) for i in np.flatnonzero(seeks[lo:hi]).tolist())
            else:
                pairs = search(hi - lo, _Product(*sets).alike)
            for i, found in pairs:
                found = np.unique(names[lo + found])
                a.append(np.full(len(found), names[lo + i]))
                b.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return grouped(members, keys, run, "a long, b long")


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links connect among `members` (block, class, n, grams): all links are within blocks.

    A block of more than SETS sets or GRAMS n-grams is cut in parts by hash.  Each part is
    multiplied by itself, with one set of the block that all parts have.  What that connects to the
    most sets is done; each other set is then compared with all parts.  So a block of
    near copies costs little more than its size, and only a block whose sets do not link costs the square.
    """
    grams = F.octet_length("grams") / 8
    sizes = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum(grams) / GRAMS)).alias("q"), F.min("class").alias("hub"), F.count("*").alias("size"))
    big = cut(sizes.where("q > 1"))
    sized = known(members, big, ["block"], "size", members.count())
    small = _multiplied(sized.where("q is null").select("block", F.col("class").alias("name"), "n", "grams", F.lit(0).alias("seeks")), ["block"], percent)
    if not big.limit(1).count():
        return small
    whole = cut(sized.where("q is not null").drop("size").withColumn("part", F.pmod(F.xxhash64("class", F.lit("part")), F.col("q")).cast("int")))
    parts = F.explode(F.sequence(F.lit(0), (F.col("q") - 1).cast("int")))
    hubs = whole.where("class = hub").withColumn("own", F.col("part")).withColumn("part", parts).where("part <> own").drop("own")
    first = cut(_multiplied(whole.unionByName(hubs).select("block", "part", F.col("class").alias("name"), "n", "grams", F.lit(0).alias("seeks")), ["block", "part"], percent))
    comp = components(first)
    placed = whole.drop("hub").join(small_side(cut(comp.withColumnRenamed("v", "class"))), "class", "left").withColumn("name", F.coalesce("comp", "class")).drop("comp")
    total = whole.count()
    main = placed.groupBy("block", "name").count().groupBy("block").agg(F.max(F.struct("count", "name"))["name"].alias("main"), F.sum("count").alias("size"))
    main = cut(main)
    rest = cut(known(placed, main, ["block"], "size", total).where("name <> main").drop("part", "main", "size"))
    chunks = rest.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum(grams) / GRAMS)).cast("int").alias("chunks"))
    chunks = cut(chunks.join(main.select("block", "size"), "block"))
    asked = known(rest, chunks, ["block"], "size", total).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("chunks")).cast("int")).withColumn("part", parts).withColumn("seeks", F.lit(1))
    there = known(placed, chunks, ["block"], "size", total).where("chunks is not null").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("seeks", F.lit(0))
    keep = ["block", "part", "chunk", "name", "n", "grams", "seeks"]
    return small.union(first).union(_multiplied(asked.select(*keep).union(there.select(*keep)), ["block", "part", "chunk"], percent))


def link(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): the components of documents that link at `percent`.

    A document's set is that of its k-word shingles (`texts` says what words
    are); with fewer words the whole sequence is the one shingle; null, empty and
    blank texts have none and link with nothing.  Two documents link when
    100 * intersection >= percent * union.  The component is the least id that
    links reach, the document's own included.  Repeated rows and equal texts are
    in one component; different texts under one id are documents of their own, each in
    its own component.  A document without an id links as others do but has no component's name.
    """
    return groups(docs, percent, k, id_col, text_col).select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def groups(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_shingles, group, component) of every row: `th` is xxhash64 of the text, so that (id, th) names a row but for equal ones.

    `group` numbers the components of `link`, whatever the ids; null where there is no set.

    Equal sets are one class from the start, and classes are what is linked.  Sets that
    share one of the rarest n-grams of each (`incidence`) and are of like size
    share a block; `_linked` multiplies blocks.  No link is missed, but for clashes of 64-bit hashes.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    made, key = cut(incidence(rows, percent, k)), ["s1", "s2", "n"]
    sets = cut(made.where("m is null").select("id", "th", *key))
    facts = [F.min("id").alias("id"), F.count_if(F.col("m").isNull()).alias("members"), F.max("m").alias("m"), F.first("grams", ignorenulls=True).alias("grams")]
    classes = cut(made.where("n > 0").groupBy(*key).agg(*facts).withColumn("class", F.monotonically_increasing_id()))
    discard(made)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("grams"))
            m = np.asarray(b.column("m"))
            spots = np.repeat(at[:-1] // 8 - (np.cumsum(m) - m), m) + np.arange(m.sum())
            repeat = lambda c: pa.array(np.repeat(np.asarray(b.column(c)), m))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)[spots]), repeat("class"), repeat("band")], ["gram", "class", "band"])

    # sizes of linked sets are at most one band apart: each set is in its own and the next
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / percent, 1.0001)) + 1e-9)
    seen = classes.where("m > 0").select("class", "m", "grams", band.cast("int").alias("band")).mapInArrow(rare, "gram long, class long, band int")
    seen = cut(seen.select("gram", "class", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")))
    hubs = seen.groupBy("gram", "band").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1")
    blocks = components(known(seen, hubs, ["gram", "band"], "n", seen.count()).where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct())
    discard(seen)
    blocks = small_side(cut(blocks.select(F.col("v").alias("class"), F.col("comp").alias("block"))))
    members = cut(classes.select("class", "n", "grams").join(blocks, "class"))
    named = cut(classes.select("class", "id", "members", *key))
    discard(classes)
    linked = components(_linked(members, percent)).withColumnRenamed("v", "class")
    found = cut(named.join(linked, "class", "left").withColumn("group", F.coalesce("comp", "class")))
    least = found.groupBy("group").agg(F.min("id").alias("component"), F.count("*").alias("classes"))
    found = known(found.select("group", "members", *key), least, ["group"], "classes", found.count()).drop("classes")
    out = join_classes(sets.where("n > 0"), found, key, "members", sets.count())
    none = sets.where("n = 0").withColumns({"group": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    out = out.select("id", "th", "n", "group", "component").union(none.select("id", "th", "n", "group", "component"))
    return out.select("id", "th", F.col("n").alias("n_shingles"), "group", "component")
