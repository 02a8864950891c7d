"""Removal of byte strings that occur earlier in the corpus: ranks of sampled suffixes at growing lengths.

This stands in for prefix doubling over all suffixes (the README says why, with figures). Ranking every suffix at offsets 1, 2, 4, ... would move each byte position through a sort per round. Instead,
only sampled suffixes are ranked: of each string of `length` bytes, the start of its least half-length gram (by a
hash; the leftmost of equals). Equal strings have their sample at the same place, so each string hangs on one
sampled suffix, and runs of neighbouring strings share one. Ranks are then refined at growing lengths, and what
is unique drops out before the next round:

1. grams: suffixes whose first half-length bytes occur once are done;
2. contexts: the bytes that all strings hanging on a suffix span together; equal contexts resolve to the earliest;
3. strings: where one gram has several contexts, each string by itself resolves to the earliest.

Spark deals (rank, position) pairs out by rank; chunks send packed arrays and first drop their own repeats, so a
passage that is everywhere comes once per chunk. Ranks are hashes: 64 bits of the gram and 64 of another base for
the longer string together tell strings apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, Chunks, by_bucket, looked_up, opened, opened_counts, known_ids, pack_ints, pack_sorted, rows_of, runs_of, send_counts, shared_counts, short, trim, unpack_ints, unpack_sorted
from .common import Scratch
from .grid import Runs

LENGTH = 100
BUCKET_BYTES = 4 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def sampled(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sampled positions, first string, number of strings): strings of length bytes within texts, grouped by their sample."""
    none = np.zeros(0, np.int64)
    gram = length // 2
    if len(buf) < length:
        return none, none, none
    g = Runs(buf).every(gram)
    packed = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    least = _sliding_min(packed, length - gram + 1)
    broken = np.zeros(len(buf) + 1, np.int32)  # string starts that would run past their text
    np.add.at(broken, np.maximum(off[:-1], off[1:] - length + 1), 1)
    np.add.at(broken, off[1:], -1)
    start = np.nonzero(np.cumsum(broken)[: len(least)] == 0)[0]
    if not len(start):
        return none, none, none
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.nonzero(new)[0]
    return at[first], start[first], np.diff(np.append(first, len(at)))


class _Suffixes:
    """The sampled suffixes of a chunk whose grams others have too, and what the rounds say about them.

    Order: by gram hash, then context hash, then document and place. kept is the first of each (gram, context).
    """

    def __init__(self, row: dict, length: int):
        self.ids, self.buf, self.off = opened(row)
        at, lo, n = unpack_sorted(row["at"]).astype(np.int64), unpack_sorted(row["lo"]).astype(np.int64), unpack_ints(row["n"]).astype(np.int64)
        known, counts = opened_counts(row["shared"])
        gram = length // 2
        self.runs = Runs(self.buf, 1)
        g = Runs(self.buf)(at, at + gram) if len(at) else np.zeros(0, np.uint64)
        live = looked_up(short(g), known, counts) > 0
        at, lo, n, g = at[live], lo[live], n[live], g[live]
        c = self.runs(lo, lo + n + (length - 1)) if len(at) else g
        doc = self.ids[np.searchsorted(self.off, at, side="right") - 1] if len(at) else at
        order = np.lexsort((lo, doc, c, g))
        self.g, self.c, self.lo, self.n, self.doc = g[order], c[order], lo[order], n[order], doc[order]
        self.first = np.ones(len(g), bool)
        self.first[1:] = (self.g[1:] != self.g[:-1]) | (self.c[1:] != self.c[:-1])


def _joined_blobs(parts: list[dict] | None, name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(p[name], np.uint8) for p in sorted(parts, key=lambda p: p["bucket"])]) if parts else np.zeros(0, np.uint8)


class Repeats:
    """One run over docs; result() has a row per document."""

    def __init__(self, docs: DataFrame, length: int = LENGTH):
        if length < 4:
            raise ValueError("length must be 4 or more")
        self.length, self.spark = length, docs.sparkSession
        self.scratch = Scratch(self.spark)
        self.chunks = Chunks(docs, self.scratch)
        self.n_buckets = self.chunks.buckets(BUCKET_BYTES)

    def _round_1(self) -> None:
        length, n_buckets = self.length, self.n_buckets

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                _, buf, off = opened(row)
                at, lo, n = sampled(buf, off, length)
                yield pa.RecordBatch.from_pydict({"cid": pa.array([row["cid"]], pa.int64()), "at": [pack_sorted(at)], "lo": [pack_sorted(lo)], "n": [pack_ints(n)]})

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                _, buf, _ = opened(row)
                at = unpack_sorted(row["at"]).astype(np.int64)
                if len(at):
                    values, n = np.unique(short(Runs(buf)(at, at + length // 2)), return_counts=True)
                    yield send_counts(row["cid"], values, n, n_buckets)

        self.samples = self.scratch.save(self.chunks.joined().mapInArrow(sample, "cid long, at binary, lo binary, n binary"), "samples")
        self.shared = self.scratch.save(shared_counts(self.chunks.joined(self.samples).mapInArrow(send, SENT), n_buckets), "shared")

    def _round_2(self) -> None:
        length, n_buckets = self.length, self.n_buckets

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                s = _Suffixes(row, length)
                g, c, doc, lo = s.g[s.first], s.c[s.first], s.doc[s.first], s.lo[s.first]
                full, cut = runs_of(g, 64, n_buckets)
                for b, start, stop in zip(full.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    x = slice(start, stop)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "cid": pa.array([row["cid"]], pa.int64()), "g": [pack_sorted(g[x])], "c": [c[x].tobytes()], "doc": [pack_ints(doc[x].view(np.uint64))], "lo": [pack_ints(lo[x])]})

        def meet(got: pa.Table) -> pa.Table:
            trim()
            cids = got["cid"].to_pylist()
            g = [unpack_sorted(x) for x in got["g"].to_pylist()]
            sizes = [len(x) for x in g]
            g = np.concatenate(g)
            c = np.concatenate([np.frombuffer(x, np.uint64) for x in got["c"].to_pylist()])
            doc = np.concatenate([unpack_ints(x) for x in got["doc"].to_pylist()]).view(np.int64)
            lo = np.concatenate([unpack_ints(x) for x in got["lo"].to_pylist()])
            cid = np.repeat(np.array(cids, np.int64), sizes)
            order = np.lexsort((lo, cid, doc, c, g))
            gs, cs = g[order], c[order]
            new_g, new_c = np.ones(len(g), bool), np.ones(len(g), bool)
            new_g[1:] = gs[1:] != gs[:-1]
            new_c[1:] = new_g[1:] | (cs[1:] != cs[:-1])
            contexts = np.bincount(np.cumsum(new_g) - 1, new_c)[np.cumsum(new_g) - 1]
            code = np.zeros(len(g), np.uint8)  # 1: an earlier context is equal; 2: the first of its kind, but the gram has other contexts
            code[order] = np.where(~new_c, 1, np.where(contexts > 1, 2, 0))
            parts = np.split(code, np.cumsum(sizes)[:-1])
            return pa.table({"bucket": got["bucket"], "cid": got["cid"], "code": pa.array([p.tobytes() for p in parts], pa.binary())})

        sent = self.chunks.joined(self.samples, self.shared).mapInArrow(send, "bucket int, cid long, g binary, c binary, doc binary, lo binary")
        met = by_bucket(sent, n_buckets).applyInArrow(meet, "bucket int, cid long, code binary")
        self.codes = self.scratch.save(met.groupBy("cid").agg(F.collect_list(F.struct("bucket", "code")).alias("codes")), "codes")

    def _round_3(self) -> None:
        length, n_buckets = self.length, self.n_buckets

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                s = _Suffixes(row, length)
                mine = np.nonzero(s.first)[0][_joined_blobs(row["codes"], "code") == 2]
                g, n, lo, doc = s.g[mine], s.n[mine], s.lo[mine], s.doc[mine]
                full, cut = runs_of(g, 64, n_buckets)
                for b, start, stop in zip(full.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    x = slice(start, stop)
                    start = np.repeat(lo[x] - (np.cumsum(n[x]) - n[x]), n[x]) + np.arange(n[x].sum())
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "cid": pa.array([row["cid"]], pa.int64()), "g": [pack_sorted(g[x])], "n": [pack_ints(n[x])], "doc": [pack_ints(doc[x].view(np.uint64))], "lo": [pack_ints(lo[x])], "strings": [s.runs(start, start + length).tobytes()]})

        def meet(got: pa.Table) -> pa.Table:
            trim()
            n = [unpack_ints(x).astype(np.int64) for x in got["n"].to_pylist()]
            sizes = [int(x.sum()) for x in n]
            wide = lambda name, f: np.concatenate([np.repeat(f(x), k) for x, k in zip(got[name].to_pylist(), n, strict=True)])
            g, lo = wide("g", unpack_sorted), wide("lo", unpack_ints)
            doc = wide("doc", unpack_ints).view(np.int64)
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in got["strings"].to_pylist()])
            cid = np.repeat(np.array(got["cid"].to_pylist(), np.int64), sizes)
            order = np.lexsort((lo, cid, doc, g, h))
            again = np.zeros(len(h), bool)
            hs, gs = h[order], g[order]
            again[order[1:]] = (hs[1:] == hs[:-1]) & (gs[1:] == gs[:-1])
            parts = np.split(again, np.cumsum(sizes)[:-1])
            return pa.table({"bucket": got["bucket"], "cid": got["cid"], "again": pa.array([p.astype(np.uint8).tobytes() for p in parts], pa.binary())})

        sent = self.chunks.joined(self.samples, self.shared, self.codes).where("codes is not null").mapInArrow(send, "bucket int, cid long, g binary, n binary, doc binary, lo binary, strings binary")
        met = by_bucket(sent, n_buckets).applyInArrow(meet, "bucket int, cid long, again binary")
        self.strings = self.scratch.save(met.groupBy("cid").agg(F.collect_list(F.struct("bucket", "again")).alias("strings")), "strings")

    def result(self, with_text: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text also kept binary and spans array<struct<start, stop>>."""
        try:
            return self._result(with_text)
        finally:
            self.chunks.drop()
            for name in ("samples", "shared", "codes", "strings"):
                self.scratch.drop(name)

    def _result(self, with_text: bool) -> DataFrame:
        self._round_1()
        self._round_2()
        self._round_3()
        length = self.length

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                s = _Suffixes(row, length)
                steps = np.zeros(len(s.buf) + length + 1, np.int32)
                codes = _joined_blobs(row["codes"], "code")
                first = np.nonzero(s.first)[0]
                full = ~s.first
                full[first[codes == 1]] = True
                np.add.at(steps, s.lo[full], 1)
                np.add.at(steps, s.lo[full] + s.n[full] + (length - 1), -1)
                mine = first[codes == 2]
                if len(mine):
                    n, lo = s.n[mine], s.lo[mine]
                    start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    start = start[_joined_blobs(row["strings"], "again") > 0]
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + length, -1)
                gone = np.cumsum(steps)[: len(s.buf)] > 0
                kept = ~gone
                out: list[tuple] = []
                known = known_ids(row)
                for i, (a, b) in enumerate(zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)):
                    x = gone[a:b]
                    removed = int(x.sum())
                    rest = s.buf[a:b][kept[a:b]].tobytes() if removed else s.buf[a:b].tobytes()
                    turns = np.diff(np.concatenate([[0], x.view(np.int8), [0]])) if removed else np.zeros(0, np.int8)
                    ups = np.nonzero(turns == 1)[0]
                    line = (int(s.ids[i]) if known[i] else None, b - a, removed, len(ups), hashlib.sha256(rest).hexdigest())
                    out.append((*line, rest, [{"start": p, "stop": q} for p, q in zip(ups.tolist(), np.nonzero(turns == -1)[0].tolist(), strict=True)]) if with_text else line)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))] * with_text
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, stop: long>>" * with_text
        return self.scratch.save(self.chunks.joined(self.samples, self.shared, self.codes, self.strings).mapInArrow(finish, schema), "result")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): which bytes go because a string of length bytes covers them that also starts earlier.

    Earlier means in a smaller doc_id, or further ahead in the same text; null doc_ids count as the largest, and
    rows repeated under one doc_id follow each other in the order read. Null texts are empty. Strings are judged
    on the input, never across texts; texts shorter than length keep all.
    """
    return Repeats(docs, length).result(with_text)
