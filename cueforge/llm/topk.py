"""Exact top-k inner products over an impact-ordered index, score at a time.

The index deals vectors into shards. In a shard each dimension has its postings in segments of falling value,
so that a segment has one quantised impact (its bounds times the query's component). A query processes a
shard's segments by descending impact and adds the lower bound to the accumulators of its members. It stops
only on proof: when the k-th lower bound exceeds what any vector outside the possible members can still reach,
or when all segments are done. Possible members are then scored exactly.

Each block of queries first meets one shard, its home. The k-th score found there is a floor for the other shards: what
can't reach it is no possible member, so that they stop earlier.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spread

#: Rows of a shard and queries of a block, at most: what one task holds, whatever the table's size.
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
SEGMENTS = 8
#: Sums of products stay below this in 64 bits; beyond, scores are Python integers.
_SAFE = 1 << 62
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Shard:
    """ids and their quantised vectors (n, d), with segments per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, segments: int = SEGMENTS):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], np.ascontiguousarray(values[by_id])
        n, self.dims = self.values.shape
        if self.values.dtype == object:  # too wide for 64 bits: searched without an index
            self.top = max((abs(x) for x in self.values.ravel()), default=0) + _SAFE
            return
        edges = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(np.int64))
        self.members: list[np.ndarray] = []
        dims, lows, highs = [], [], []
        for d in range(self.dims):
            order = np.argsort(self.values[:, d], kind="stable")
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                self.members.append(order[a:b])
                dims.append(d)
                lows.append(self.values[order[a], d])
                highs.append(self.values[order[b - 1], d])
        self.dim, self.low, self.high = np.array(dims, np.int64), np.array(lows, np.int64), np.array(highs, np.int64)

        self.top = int(np.abs(self.values).max(initial=0))

    def search(self, query: np.ndarray, k: int, own_id: int | None, check_every: int = 64, floor_score: int | None = None) -> list[tuple[int, int]]:
        """The k best (vec_id, score) but the query's own id, of at least floor_score: higher scores first, then smaller ids."""
        n = len(self.ids)
        if not n or not self.dims:
            rest = [int(i) for i in self.ids if own_id is None or i != own_id][:k]
            return [(i, 0) for i in rest]
        if max(abs(int(x)) for x in query) * self.top * self.dims >= _SAFE:  # no bounds in 64 bits: every score in Python integers
            exact = self.values.astype(object) @ query.astype(object)
            found = sorted((-s, int(i)) for i, s in zip(self.ids, exact, strict=True) if i != own_id)[:k]
            return [(i, -s) for s, i in found]
        query = query.astype(np.int64)
        q = query[self.dim]
        lower, upper = np.minimum(q * self.low, q * self.high), np.maximum(q * self.low, q * self.high)
        least = np.full(self.dims, np.iinfo(np.int64).max)
        np.minimum.at(least, self.dim, lower)
        lower, upper = lower - least[self.dim], upper - least[self.dim]  # from here on nothing is negative
        floor = -_SAFE if floor_score is None else min(max(floor_score, -_SAFE), _SAFE) - int(least.sum())
        order = np.lexsort((np.arange(len(q)), -upper))
        acc = np.zeros(n, np.int64)
        if own_id is not None:
            lo, hi = np.searchsorted(self.ids, [own_id, own_id + 1])
            acc[lo:hi] = -(1 << 60)
        done, want = 0, min(k, n)
        while True:
            for s in order[done : done + check_every]:
                if lower[s]:
                    acc[self.members[s]] += lower[s]
            done = min(done + check_every, len(order))
            # what a vector can gain beyond its lower bounds: the largest width met, or the next segment, in each dimension
            gain = np.zeros(self.dims, np.int64)
            seen, left = order[:done], order[done:]
            np.maximum.at(gain, self.dim[seen], (upper - lower)[seen])
            np.maximum.at(gain, self.dim[left], upper[left])
            kth = max(np.partition(acc, n - want)[n - want], floor)
            possible = np.nonzero(acc + gain.sum() >= kth)[0]
            if done == len(order) or len(possible) <= 4 * k:
                break
        possible = possible[acc[possible] > -(1 << 59)]
        scores = self.values[possible] @ query
        if floor_score is not None:
            possible, scores = possible[scores >= floor_score], scores[scores >= floor_score]
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(self.ids[possible[i]]), int(scores[i])) for i in best]


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part: null ids, null vectors and those with null or non-finite components don't."""
    x = F.col("x")
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where(x.isNotNull() & F.col("vec_id").isNotNull())
    return v.where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) exactly: 64-bit integers, or Python integers if any is beyond 53 bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 256.0)
    if (np.abs(scaled) < 2.0**53).all():
        return scaled.astype(np.int64)
    return np.array([int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256.0) for v in x.tolist()] + [None], object)[:-1]


def _matrix(col: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists as rows of quantised components, padded with zeros to the widest; what lies beyond a given width is cut, its partners being zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = quantised(np.asarray(col.flatten(), np.float64))
    out = np.zeros((len(sizes), width if width is not None else int(sizes.max(initial=0))), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < out.shape[1]
    out[row[inside], at[inside]] = flat[inside]
    return out


def _sort_key(score: int) -> bytes | None:
    """Orders scores that 64 bits don't tell apart: all at or beyond their limits."""
    return None if _LEAST < score < _MOST else (score + (1 << 4400)).to_bytes(552, "big")


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller vec_id.

    Queries are the rows that is_query holds for (default: vec_id divisible by 50), in blocks that meet every
    shard, one block and one shard a task. Every other row is a candidate, also those repeated under one id; only those
    with the query's own id are left out. Queries repeated under one id rank together. Vectors of different lengths count
    as padded with zeros. With fewer than k candidates all are returned; an empty table returns no rows. Components of any
    finite size count in full; a score beyond 64 bits ranks by its true value and is shown as the nearest 64-bit number.
    """
    scratch = Scratch(vectors.sparkSession)
    asked = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    rows = scratch.save(spread(taking_part(vectors)).select("*", F.monotonically_increasing_id().alias("row"), asked.alias("asked")), "rows")
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "row"), F.lit(parts)).cast("int")
    home = F.col("block") % shards
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = rows.select(F.col("vec_id").alias("id"), F.col("x").alias("v"), deal(shards).alias("shard"), all_of(blocks).alias("block"))
    ask = rows.where("asked").select(F.col("vec_id").alias("query_id"), "row", F.col("x").alias("q"), deal(blocks).alias("block"))

    def search(_: tuple, own: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and queries.num_rows:
            values = _matrix(own["v"])
            shard = Shard(own["id"].to_numpy(), values)
            asks = _matrix(queries["q"], values.shape[1])
            for i, row, least, q in zip(queries["query_id"].to_pylist(), queries["row"].to_pylist(), queries["least"].to_pylist(), asks, strict=True):
                out += [(i, row, v, min(max(s, _LEAST), _MOST), _sort_key(s)) for v, s in shard.search(q, k, i, floor_score=least)]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query_id", "row", "vec_id", "score", "key"), cols, (*[pa.int64()] * 4, pa.binary()), strict=True)})

    met = lambda own, ask: own.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInArrow(search, "query_id long, row long, vec_id long, score long, key binary")
    first = scratch.save(met(own.where(F.col("shard") == home), ask.select("*", home.alias("shard"), F.lit(None).cast("long").alias("least"))), "first")
    found = first
    if shards > 1:
        floors = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("row", "least")
        primed = ask.join(floors.hint("merge"), "row", "left").select("query_id", "row", "q", "block", all_of(shards).alias("shard"), "least")
        found = first.unionByName(met(own.where(F.col("shard") != home), primed.where(F.col("shard") != home)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("key"), "vec_id"))
    done = scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "result")
    scratch.drop("rows")
    scratch.drop("first")
    return done
