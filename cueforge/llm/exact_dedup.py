"""Exact deduplication against a minimal perfect hash over historical distinct digests.

History is reduced to its distinct digests, dealt into shards by digest, and each shard becomes a minimal
perfect hash: levels of bit arrays in which a digest stays at the first level where no other one hits its bit,
its slot being the number of set bits before it. Slots hold the full digest and the winner's locator. A lookup
computes the slot and compares the digest byte by byte, so that strangers, which a perfect hash sends to some
slot too, are told apart. Members join their slot's group; nonmembers group among themselves.
The slot tables are an artefact of their own (build_index), stored before the lookups.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, normalised

#: Distinct digests a shard is meant to hold: some 50 bytes each.
SHARD_ROWS = 200_000
MIN_SHARDS = 64
_GAMMA = 1.5


def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as (n, 4) unsigned words."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _at(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (words[:, level % 4] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)) ^ (words[:, (level + 1) % 4] >> np.uint64(17))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests: lookup() gives each of them its own slot below n."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, base = _words(digests), 0
        while len(left):
            bits = max(64, int(len(left) * _GAMMA))
            at = _at(left, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            self.levels.append(alone)
            self.before.append(base + np.cumsum(alone) - alone)
            base += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("digests repeat")
        self.n = base

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has its bit. A stranger may get any slot."""
        words, slots = _words(digests), np.full(len(digests), -1, dtype=np.int64)
        left = np.arange(len(digests))
        for k, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = _at(words[left], k, len(bits))
            hit = bits[at]
            slots[left[hit]] = before[at[hit]]
            left = left[~hit]
        return slots


class SlotTable:
    """Slots with full digests and locators, behind the hash."""

    def __init__(self, digests: np.ndarray, locators: np.ndarray):
        self.hash = PerfectHash(digests)
        slots = self.hash.lookup(digests)
        self.digests, self.locators = np.zeros_like(digests), np.zeros_like(locators)
        self.digests[slots], self.locators[slots] = digests, locators

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a member, row of locators); the digest in the slot has been compared byte by byte."""
        slots = self.hash.lookup(digests)
        if not len(self.digests):
            return np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
        safe = np.maximum(slots, 0)
        return (slots >= 0) & (self.digests[safe] == digests).all(axis=1), safe


def _bytes(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def _rank(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner (n_chars, doc_id and row, the locator) and the number of rows. Spark combines before it shuffles."""
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).select("digest", (-F.col("b.neg")).alias("n_chars"), F.col("b.doc_id").alias("doc_id"), F.col("b.row").alias("row"), "n")


_VALUES = ("n_chars", "doc_id", "row", "n")


def _sharded(ranked: DataFrame, shards: int) -> DataFrame:
    """Dealt out by digest, which is distinct, so shards are even."""
    return ranked.select("digest", *[F.col(c).cast("long").alias(c) for c in _VALUES], F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, index): history (digest, n_chars, doc_id, row, n; digests distinct) as a slot table per shard. Stored, it serves any number of lookups."""

    def build(key: tuple, old: pa.Table) -> pa.Table:
        digests = _bytes(old["digest"])
        values = np.stack([old[c].combine_chunks().fill_null(0).to_numpy() for c in _VALUES], 1)
        known = old["doc_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        table = SlotTable(digests, np.column_stack([values, known]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(table, 5)], pa.binary())})

    return _sharded(history, shards).groupBy("shard").applyInArrow(build, "shard int, index binary")


def lookup_members(index: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """fresh (digest, n_chars, doc_id, row, n; digests distinct), with member and, for members, what their slot holds as old_n_chars and so on."""

    def probe(_: tuple, stored: pa.Table, new: pa.Table) -> pa.Table:
        ask = _bytes(new["digest"])
        if stored.num_rows:
            table = pickle.loads(stored["index"][0].as_py())
            member, slot = table.find(ask)
            got = table.locators[slot] if len(table.locators) else np.zeros((len(ask), 5), np.int64)
        else:
            member, got = np.zeros(len(ask), bool), np.zeros((len(ask), 5), np.int64)
        old = {f"old_{c}": pa.array(got[:, k], mask=~member | (got[:, 4] == 0) if c == "doc_id" else ~member) for k, c in enumerate(_VALUES)}
        return pa.table({"digest": new["digest"], **{c: new[c] for c in _VALUES}, "member": pa.array(member), **old})

    schema = ", ".join(["digest binary", *[f"{c} long" for c in _VALUES], "member boolean", *[f"old_{c} long" for c in _VALUES]])
    return index.groupBy("shard").cogroup(_sharded(fresh, shards).groupBy("shard")).applyInArrow(probe, schema)


def _digest_columns() -> list[Column]:
    """doc_id, the SHA-256 of the text without white space, and the original's code points."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")]


def exact_groups(docs: DataFrame, is_history: Column | None = None, shards: int | None = None) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Rows are equal when their texts agree without white space; null counts as empty. The longest original
    stays, then the smallest doc_id, null ids last, and of rows repeated under one doc_id the first in the order read: one row of
    a group is kept. is_history tells which rows were there before (default: the even half by a hash of
    doc_id); the result does not depend on the split, only the work does.
    """
    scratch = Scratch(docs.sparkSession)
    old = is_history if is_history is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = scratch.save(docs.select(*_digest_columns(), F.monotonically_increasing_id().alias("row"), F.coalesce(old, F.lit(False)).alias("_old")), "rows")
    history, fresh = scratch.save(_rank(rows.where("_old")), "history"), _rank(rows.where("not _old"))
    shards = shards or max(MIN_SHARDS, -(-history.count() // SHARD_ROWS))
    index = scratch.save(build_index(history, shards), "index")
    found = scratch.save(lookup_members(index, fresh, shards), "found")
    # members stand with their slot, nonmembers by themselves; history that nobody met keeps its own winner
    place = lambda p: F.struct((-F.col(f"{p}n_chars")).alias("neg"), F.col(f"{p}doc_id").isNull().alias("no_id"), F.col(f"{p}doc_id").alias("doc_id"), F.col(f"{p}row").alias("row"))
    first = F.when(F.col("member"), F.least(place(""), place("old_"))).otherwise(place(""))
    joined = found.select("digest", first.alias("_first"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"))
    unmet = history.join(found.where("member").select("digest"), "digest", "left_anti").select("digest", place("").alias("_first"), F.col("n").alias("group_size"))
    groups = scratch.save(joined.unionByName(unmet).select("digest", F.col("_first.doc_id").alias("keep_id"), F.col("_first.row").alias("_keep"), "group_size", F.col("group_size").alias("_n")), "groups")
    done = join_groups(rows, groups, ["digest"], "_n").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")
    for name in ("history", "index", "found"):
        scratch.drop(name)
    return done
