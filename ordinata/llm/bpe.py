"""Byte-level BPE: each distinct word of the corpus is encoded once; ids go back to the texts by position."""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.llm.common import binary, grouped, prepare, utf8
from ordinata.llm.texts import slices


def _file(spark, path: str):
    """The vocabulary file as a broadcast: executors need not see the driver's path.  Its size is that of the tokenizer."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: Distinct words whose ids a task remembers at most.
WORDS = 1_000_000

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@functools.lru_cache(maxsize=2)
def ranks(data: bytes) -> dict[bytes, int]:
    """The token-byte table of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@functools.lru_cache(maxsize=2)
def _coder(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(data), special_tokens={})


@functools.lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> list[bytes]:
    out = [b""] * (max(ranks(data).values()) + 1)
    for token, i in ranks(data).items():
        out[i] = token
    return out


def _packed(places: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, compressed: frequent words have small places, so high planes vanish."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_bytes: int) -> Iterator[tuple[int, list[str], np.ndarray, list, list[int]]]:
    """Runs of rows of one task with about `block_bytes` of text: (block, words, places, ids, lengths).

    A block's distinct words are listed once, frequent ones first; its texts are
    sequences of places in that list: the exploded table of pre-tokens with
    positions, packed.  The block's name is made of its place in the task and what
    it holds.
    """
    find = regex.compile(pattern).findall
    task, number, size = TaskContext.get().partitionId(), 0, 0
    places: dict[str, int] = {}
    spots: list[np.ndarray] = []
    lengths: list[int] = []
    ids: list = []

    def flush() -> tuple[int, list[str], np.ndarray, list, list[int]]:
        spot, listed = np.concatenate(spots), list(places)
        order = np.argsort(-np.bincount(spot, minlength=len(places)), kind="stable")
        rank = np.empty(len(places), np.int32)
        rank[order] = np.arange(len(places), dtype=np.int32)
        listed = [listed[i] for i in order.tolist()]
        name = hashlib.blake2b(repr((task, number, ids[0], ids[-1], len(ids), len(spot), len(listed), listed[:9])).encode("utf-8", "surrogatepass"), digest_size=8)
        return int.from_bytes(name.digest(), "little", signed=True), listed, rank[spot], ids, lengths

    for batch in batches:
        for b in slices(batch, "text", 1 << 20):
            ids += b.column(0).to_pylist()
            for t in b.column(1).to_pylist():
                words = find(t or "")
                for w in words:
                    if w not in places:
                        places[w] = len(places)
                spots.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
            size += b.column(1).nbytes
            if size >= block_bytes:
                yield flush()
                places, spots, lengths, ids, size, number = {}, [], [], [], 0, number + 1
    if ids:
        yield flush()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, then: Batches | None = None, schema: str = "id long, ids binary") -> DataFrame:
    """(id, ids): the token ids of every text, as little-endian unsigned 32-bit integers.

    `then` maps the batches of the result to ones of `schema` where they are made, in the same Python process.

    Null texts count as empty and have no tokens; repeated rows are encoded row by
    row; other columns are not read; no rows, no rows.  Special tokens have no
    meaning: their strings are ordinary text.

    Words are dealt out by hash, at most once from each block, so a word that is in
    every text costs an entry a block.  Each distinct word is encoded once, by
    ranks (a task that has met WORDS words of one deal forgets them, to bound its memory), and its ids go back to the blocks that hold it, where the texts are put
    together by position.  Words and positions come from two passes over `docs`,
    which should be files or a cut: its rows and their order must be the same in
    both.  A block that does not get the ids of all its words raises.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = _file(spark, path)
    deals = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, *_ in _blocks(batches, pattern, block_bytes):
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            deal = np.fromiter((zlib.crc32(w) % deals for w in raw), np.int32, len(raw))
            order = np.argsort(deal, kind="stable")
            found, starts = np.unique(deal[order], return_index=True)
            rows = []
            for group in np.split(order, starts[1:]) if len(raw) else []:
                own = [raw[i] for i in group.tolist()]
                rows.append(_pack(np.array([len(own)], "<u4"), group.astype("<u4"), np.array([len(w) for w in own], "<u4"), np.frombuffer(b"".join(own), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array(rows, pa.binary())], ["deal", "block", "packed"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _coder(vocabulary.value, pattern)._encode_single_piece
        deal, once = None, {}  # rows of a deal follow each other; none is held
        for row in (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("deal", "block", "packed")), strict=True)):
            if row[0] != deal or len(once) > WORDS:
                deal, once = row[0], {}
            data = zstandard.ZstdDecompressor().decompress(row[2])
            n = int(np.frombuffer(data, "<u4", 1)[0])
            places, ends = np.frombuffer(data, "<u4", n, 4), np.append(0, np.cumsum(np.frombuffer(data, "<u4", n, 4 + 4 * n), dtype=np.int64)) + 4 + 8 * n
            ids = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                w = data[a:z]
                if w not in once:
                    once[w] = piece(w)
                ids.append(once[w])
            flat = np.fromiter((i for x in ids for i in x), "<u4")
            kind = "<u2" if not len(flat) or flat.max() < 2**16 else "<u4"
            packed = _pack(np.array([n, int(kind[2])], "<u4"), places, np.array([len(x) for x in ids], "<u4"), flat.astype(kind))
            yield pa.RecordBatch.from_arrays([pa.array([row[1]], pa.int64()), pa.array([1], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int32())), pa.array([packed], pa.binary())], ["block", "kind", "ids", "lengths", "packed"])

    def positions_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, places, ids, lengths in _blocks(batches, pattern, block_bytes):
            packed = np.array([len(words)], "<u4").tobytes() + _packed(places)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([packed], pa.binary())], ["block", "kind", "ids", "lengths", "packed"])

    def assembled(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = together(t, offsets)
        return then(made) if then else made

    def together(t: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = t.slice(a, 1)
            if own.column("kind")[0].as_py() != 0:
                raise RuntimeError("words of a block without its texts: the input changed between two passes")
            doc_ids, lengths = (own.column(c).combine_chunks().flatten() for c in ("ids", "lengths"))
            packed = own.column("packed")[0].as_py()
            places, size = _unpacked(packed[4:]), int(np.frombuffer(packed, "<u4", 1)[0])
            counts, got = np.zeros(size, np.int64), []
            for row in t.column("packed").slice(a + 1, z - a - 1):
                data = zstandard.ZstdDecompressor().decompress(row.as_py())
                n, width = np.frombuffer(data, "<u4", 2).tolist()
                spot, k = np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n).astype(np.int64)
                counts[spot] = k
                got.append((spot, k, np.frombuffer(data, f"<u{width}", -1, 8 + 8 * n)))
            if sum(len(s) for s, _, _ in got) != size or not counts.all():
                raise RuntimeError("a block lacks words: the input changed between two passes")
            at = np.append(0, np.cumsum(counts))
            flat = np.empty(at[-1], np.uint32)
            for spot, k, ids in got:
                flat[np.repeat(at[spot] - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
            ends = np.cumsum(lengths.to_numpy().astype(np.int64))
            lo = 0
            while lo < len(ends):  # some 200,000 words at a time
                start = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, start + 200_000, "right")))
                p = places[start : ends[hi - 1]]
                n = counts[p]
                to = np.append(0, np.cumsum(n))
                tokens = flat[np.repeat(at[p] - to[:-1], n) + np.arange(to[-1])]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), binary(tokens, to[np.append(0, ends[lo:hi] - start)])], ["id", "ids"])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "block long, kind int, ids array<long>, lengths array<int>, packed binary"
    dealt = rows.mapInArrow(words_out, "deal int, block long, packed binary").repartition("deal").sortWithinPartitions("deal").mapInArrow(encode_words, kind)
    return grouped(rows.mapInArrow(positions_out, kind).union(dealt), ["block"], assembled, schema, order=["kind"])


def decoder(spark: SparkSession, path: str) -> Batches:
    """What adds `decoded` to batches (id, ids): a join with the token-byte table.

    The table has a row for each token of the vocabulary file and is broadcast:
    its size is the tokenizer's, whatever the corpus.  An id that is not in the
    table raises.  No ids, no bytes.
    """
    vocabulary = _file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(vocabulary.value)
        lengths = np.array([len(t) for t in tokens], np.int64)
        for b in batches:
            data, at = utf8(b.column("ids"))
            ids = np.frombuffer(data.tobytes(), np.uint32)
            if len(ids) and (ids.max() >= len(lengths) or not lengths[ids].all()):
                raise ValueError("an id is not in the token table")
            ends = np.append(0, np.cumsum(lengths[ids]))
            text = np.frombuffer(b"".join(map(tokens.__getitem__, ids.tolist())), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), binary(text, ends[at // 4])], ["id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, decoded): the bytes of each row's ids, as `decoder` gives them."""
    return encoded.select("id", "ids").mapInArrow(decoder(encoded.sparkSession, path), "id long, ids binary, decoded binary")
