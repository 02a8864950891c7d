"""Documents in chunks of bytes, and round trips between chunks and hash buckets.

A chunk is one row with the concatenated texts of some documents. The chunks are stored once, bucketed by their
number, so that what other steps find out about a chunk (its reply) is joined to it without shuffling texts.
Steps send packed arrays of hashes, one blob per chunk and bucket, rather than a row per hash.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import session_with
from .common import Scratch, hot_bound, join_groups, partitions, spread
from .grid import text_bytes

CHUNK_BYTES = 1 << 20
#: Bits of the hashes that round trips exchange. Equal short hashes of different runs cost work, never results.
SHORT_BITS = 48
#: A document's row number is its chunk's number times this plus its place in the chunk.
PER_CHUNK = 1 << 17
#: Chunk numbers of a partition: the partition's number times this, and up.
PER_PART = 1 << 25
NO_ID = np.iinfo(np.int64).max


#: Text that a bucket of the stored chunks is meant to hold: what one task of a pass reads, whatever the table's size.
BUCKET_TEXT = 16 << 20
#: Buckets of a table at most, beyond which they grow.
MOST_BUCKETS = 50_000


def bucket_of(cids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark stores chunk numbers in: its 32-bit Murmur3 hash of a long, seed 42, modulo their number."""
    v, h = cids.astype(np.uint64), np.full(len(cids), 42, np.uint32)
    turned = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    with np.errstate(over="ignore"):
        for half in ((v & np.uint64(0xFFFFFFFF)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint32)):
            h = turned(h ^ turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def chunk_numbers(part: int, parts: int, buckets: int, run: float) -> Iterator[int]:
    """Rising numbers for the chunks of a partition, about run after run in one bucket, so that a task writes a file per run and not one per chunk.

    The partitions (parts of them) begin at places spread evenly over the buckets; those of one size fill them evenly. Should the
    numbers run short, the rest follow each other.
    """
    first, start, n, done, step = part * PER_PART, part * buckets / parts, 0, 0, 1 << 12
    while True:
        target = int(start + done / run)
        left = max(1, math.ceil((target + 1 - start) * run) - done)
        done += left
        while left and n < PER_PART - (PER_PART >> 3):
            at = first + n + np.arange(step)
            hits = np.nonzero(bucket_of(at, buckets) == target % buckets)[0][:left]
            yield from at[hits].tolist()
            left -= len(hits)
            n += step if left else int(hits[-1]) + 1
        if left:
            yield from range(first + n, first + PER_PART)
            raise ValueError("too many chunks in a partition")


class Chunks:
    """The stored chunks: cid, ids (64-bit, null as NO_ID), known (whether an id is none of these), lens, text, n_bytes.

    A chunk is a large row, so passes over chunks run in a session of their own whose Arrow batches hold two.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.scratch = docs.sparkSession, scratch
        self.wide = session_with(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="2", spark__sql__parquet__columnarReaderBatchSize="8")
        self.total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = min(max(-(-self.total // BUCKET_TEXT), self.spark.sparkContext.defaultParallelism), MOST_BUCKETS)
        self.name = f"cueforge_chunks_{uuid.uuid4().hex}"
        texts_of = spread(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"))
        buckets, run, n_parts = self.parts, max(1.0, self.total / (self.parts * chunk_bytes)), partitions(texts_of) or self.spark.sparkContext.defaultParallelism

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = chunk_numbers(TaskContext.get().partitionId(), n_parts, buckets, run)
            ids: list[np.ndarray] = []
            known: list[np.ndarray] = []
            lens: list[np.ndarray] = []
            texts: list[bytes] = []
            size = rows = 0

            def close() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"cid": pa.array([next(numbers)]), "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "known": pa.array([np.concatenate(known).tobytes()], pa.binary()), "lens": pa.array([np.concatenate(lens).tobytes()], pa.binary()), "text": pa.array([b"".join(texts)], pa.binary()), "n_bytes": pa.array([size], pa.int64())})

            for batch in batches:
                buf, off = text_bytes(batch.column(1))
                own, valid = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                start = 0
                while start < batch.num_rows:
                    stop = max(start + 1, int(np.searchsorted(off, off[start] + chunk_bytes - size, side="right")) - 1)
                    stop = min(stop, start + PER_CHUNK - rows)
                    ids.append(own[start:stop])
                    known.append(valid[start:stop])
                    lens.append(np.diff(off[start : stop + 1]))
                    texts.append(buf[off[start] : off[stop]].tobytes())
                    size, rows, start = size + int(off[stop] - off[start]), rows + stop - start, stop
                    if size >= chunk_bytes or rows >= PER_CHUNK or start < batch.num_rows:
                        yield close()
                        ids, known, lens, texts, size, rows = [], [], [], [], 0, 0
            if rows:
                yield close()

        rows = texts_of.mapInArrow(pack, "cid long, ids binary, known binary, lens binary, text binary, n_bytes long")
        rows.write.bucketBy(self.parts, "cid").option("path", f"{scratch.root}/chunks").option("compression", "zstd").option("parquet.page.size.row.check.min", "1").option("parquet.enable.dictionary", "false").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.wide.table(self.name)

    def buckets(self, bytes_each: int) -> int:
        """Buckets for hashes, a power of two: at least so many that a task's share is bytes_each of text."""
        return 1 << (max(self.parts, -(-self.total // bytes_each), 64) - 1).bit_length()

    def joined(self, *replies: DataFrame) -> DataFrame:
        """Chunks with the columns of replies (each cid and others, a row per chunk at most); chunks without one have nulls."""
        out = self.table().select("cid", "ids", "known", "lens", "text")
        for r in replies:
            out = out.join(r.hint("merge"), "cid", "left")
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("chunks")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, bytes, offsets) of a chunk's row."""
    lens = np.frombuffer(row["lens"], np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["text"], np.uint8), np.concatenate([[0], np.cumsum(lens)])


def known_ids(row: dict) -> np.ndarray:
    """Which of a chunk's documents have a doc_id."""
    return np.frombuffer(row["known"], bool)


def trim() -> None:
    """Gives freed memory back to the system: workers live on, and arrays of chunks leave holes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it manages by itself


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one by one, so that one chunk is in Python's memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            trim()


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers, sorted ones as their steps, byte planes compressed: planes of zeros cost next to nothing."""
    v = np.ascontiguousarray(values, np.uint64)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    steps = values.astype(np.uint64)
    steps[1:] = steps[1:] - values[:-1].astype(np.uint64)
    return pack_ints(steps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob), dtype=np.uint64)


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SHORT_BITS)


def runs_of(values: np.ndarray, bits: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, where it begins and the last ends) of sorted hashes of so many bits: the occupied ones of n_buckets equal ranges, a power of two."""
    at = (values >> np.uint64(bits - n_buckets.bit_length() + 1)).astype(np.int64) if n_buckets > 1 else np.zeros(len(values), np.int64)
    starts = np.nonzero(np.diff(at, prepend=-1))[0]
    return at[starts], np.append(starts, len(values))


SENT = "bucket int, cid long, hashes binary, counts binary"


def send_counts(cid: int, values: np.ndarray, n: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A chunk's distinct short hashes, sorted, with how often it has them, as a row per bucket."""
    full, cut = runs_of(values, SHORT_BITS, n_buckets)
    part = lambda x: [x[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "cid": pa.array([cid] * len(full), pa.int64()), "hashes": pa.array([pack_sorted(x) for x in part(values)], pa.binary()), "counts": pa.array([pack_ints(x) for x in part(n)], pa.binary())})


def by_bucket(sent: DataFrame, n_buckets: int):
    """sent grouped by bucket, over as many tasks as there are buckets: what a task reads stays the same at any size."""
    return sent.repartition(n_buckets, "bucket").groupBy("bucket")


def shared_counts(sent: DataFrame, n_buckets: int) -> DataFrame:
    """Replies (cid, hashes, counts as lists of blobs): of what each chunk sent, the hashes that all chunks together have at least twice, and how often."""

    def meet(got: pa.Table) -> pa.Table:
        cids = got["cid"].to_pylist()
        hashes = [unpack_sorted(b) for b in got["hashes"].to_pylist()]
        n = [unpack_ints(b) for b in got["counts"].to_pylist()]
        sizes = [len(h) for h in hashes]
        every, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, np.concatenate(n).astype(float), len(every)).astype(np.uint64)
        mine = np.split(totals[where], np.cumsum(sizes)[:-1])
        out: dict[str, list] = {"cid": [], "hashes": [], "counts": []}
        for cid, h, t in zip(cids, hashes, mine, strict=True):
            keep = t >= 2
            if keep.any():
                out["cid"].append(cid), out["hashes"].append(pack_sorted(h[keep])), out["counts"].append(pack_ints(t[keep]))
        return pa.table({"cid": pa.array(out["cid"], pa.int64()), "hashes": pa.array(out["hashes"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    found = by_bucket(sent, n_buckets).applyInArrow(meet, "cid long, hashes binary, counts binary")
    return found.groupBy("cid").agg(F.collect_list(F.struct("hashes", "counts")).alias("shared"))


def opened_counts(shared: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """A reply's hashes, sorted, and their counts."""
    if not shared:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    parts = sorted(((unpack_sorted(x["hashes"]), unpack_ints(x["counts"])) for x in shared), key=lambda p: p[0][0])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def looked_up(values: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each value, 0 for values that aren't known."""
    if not len(known):
        return np.zeros(len(values), np.uint64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, counts[at], np.uint64(0))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): connected components of edges (a, b), root being the smallest node. Nodes without edges are left out.

    Alternates large-star and small-star until the edges point to the roots; each step is aggregations and
    joins of edges, written to the shared folder. Where a node has so many edges that they shouldn't gather in one task
    (hot_bound), the joins go through join_groups.
    """
    k, before = 0, None
    cur = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-0")
    while True:
        k += 1
        both = cur.unionByName(cur.selectExpr("b a", "a b"))
        hot = hot_bound(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "n") is not None
        met = lambda rows, least, what: join_groups(rows, scratch.save(least, f"{name}-{k}-{what}"), ["a"], "n") if hot else rows.join(least.drop("n").hint("merge"), "a")  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("m", "a").alias("m"), "n")
        large = met(both, least, "least").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, f"{name}-{k}-large") if hot else large
        stars = met(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "small")
        new = scratch.save(stars.selectExpr("b a", "m b").unionByName(stars.selectExpr("a", "m b")).where("a <> b").distinct(), f"{name}-{k}")
        now = new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        for x in (f"{name}-{k - 1}", f"{name}-{k}-least", f"{name}-{k}-large", f"{name}-{k}-small"):
            scratch.drop(x)
        cur = new
        if now == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
