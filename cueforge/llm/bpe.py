"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging a pre-token keeps its pieces in a linked list. Each merge rank that occurs has a bucket of list
positions, and a two-level bitmap says which buckets hold any; find-first-set on both levels gives the next
rank, without comparing entries, and its bucket is drained from left to right. An entry whose pair has changed since
it was queued is stale and skipped. A pre-token of n bytes takes O(n) queue steps however long it is, where rescanning
for the best pair takes O(n^2). A bucket is sorted anew only where a merge made a lower rank possible, which needs a token whose
bytes a later rule joins as well: rare in trained vocabularies, but text built against one could make such sorts frequent. Pre-tokens not met before share a queue, so that its steps are paid once for many.

The vocabulary file is read by the driver and broadcast; its size is that of a vocabulary, not of the data.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread

#: Pre-tokens whose ids a worker remembers in each of two generations, at most.
REMEMBERED = 600_000
#: Longer pre-tokens are not remembered.
LONGEST_REMEMBERED = 64
#: Bytes of packed ids after which a batch of output is closed.
BATCH_BYTES = 8 << 20
#: Characters of texts that are encoded together, and bytes of new pre-tokens that share a queue (or one, if longer; few enough for the cache).
GROUP_CHARS, MERGED_BYTES = 2 << 20, 1 << 13

_BITS = 8
_WORD = 1 << _BITS
_GAP = -2


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Merges many pre-tokens with one rank queue: they don't touch, so each one's merges keep their own order."""

    def __init__(self, ranks: dict[bytes, int]):
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for byte {lacking[0]}")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([a])] for a in range(256)], np.int32)
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.words = [0] * ((max(ranks.values()) >> _BITS) + 1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token: the lowest rank merges first, of equal ranks the leftmost.

        Pre-tokens lie in one buffer, a gap before, between and after them; the end of a gap is 0.
        """
        buffer = b"\0" + b"\0".join(pieces) + b"\0"
        raw = np.frombuffer(buffer, np.uint8)
        gaps = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)])
        first = self.single[raw]
        first[gaps] = _GAP
        pairs = np.append(self.double[raw[:-1].astype(np.int32) << 8 | raw[1:]], np.int32(-1))
        pairs[gaps] = pairs[gaps[1:] - 1] = -1
        ends = np.arange(1, len(raw) + 1)
        ends[gaps] = 0
        ids, at, end, prev = first.tolist(), pairs.tolist(), ends.tolist(), list(range(-1, len(raw) - 1))
        places = np.flatnonzero(pairs >= 0)
        places = places[np.argsort(pairs[places], kind="stable")]
        found, starts = np.unique(pairs[places], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(found.tolist(), np.split(places, starts[1:]), strict=True)} if len(found) else {}
        words, top = self.words, 0
        for r in buckets:
            words[w := r >> _BITS] |= 1 << (r & _WORD - 1)
            top |= 1 << w
        find, left = self.ranks.get, {}
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            r = (w << _BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if left.pop(r, 1) != len(bucket):
                bucket.sort(reverse=True)
            least = r
            while bucket:
                i = bucket.pop()
                if at[i] != r:
                    continue  # stale
                j = end[i]
                k = end[i] = end[j]
                ids[i] = r
                ids[j] = at[j] = at[i] = -1
                prev[k] = i
                if e := end[k]:
                    new = at[i] = find(buffer[i:e], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[w := new >> _BITS] |= 1 << (new & _WORD - 1)
                            top |= 1 << w
                        if new < least:
                            least = new
                h = prev[i]
                if end[h]:
                    new = at[h] = find(buffer[h:k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            words[w := new >> _BITS] |= 1 << (new & _WORD - 1)
                            top |= 1 << w
                        if new < least:
                            least = new
                if least < r:
                    break  # a lower rank goes first
            if bucket:
                left[r] = len(bucket)
                continue
            del buckets[r]
            words[w := r >> _BITS] &= ~(1 << (r & _WORD - 1))
            if not words[w]:
                top &= ~(1 << w)
        out = np.array(ids, np.int32)
        out = out[out != -1]
        cuts = (np.flatnonzero(out == _GAP) * 4).tolist()
        packed = out.astype("<u4").tobytes()
        return [packed[a + 4 : b] for a, b in zip(cuts, cuts[1:])]


class Encoder(dict):
    """Pre-token to packed ids (little-endian, 32 bits), as far as remembered.

    There are two generations: when the younger one is full it replaces the older, from which pre-tokens met again
    come back, so that frequent ones stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks, self.merge = ranks, Merger(ranks).merge
        self.split = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _learn(self, pieces: set[str]) -> None:
        """Fill in pre-tokens, those that need merging MERGED_BYTES at a time."""
        names, todo, size = [], [], 0
        for piece in pieces:
            ids = self.older.get(piece)
            if ids is not None:
                self[piece] = ids
                continue
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
                continue
            names.append(piece)
            todo.append(data)
            size += len(data)
            if size >= MERGED_BYTES:
                self.update(zip(names, self.merge(todo)))
                names, todo, size = [], [], 0
        if todo:
            self.update(zip(names, self.merge(todo)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self)
        self._learn(new)
        out = [b"".join(map(self.__getitem__, s)) for s in split]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del self[piece]
        if len(self) > REMEMBERED // 2:
            self.older = dict(self) if len(self) <= REMEMBERED else {}
            self.clear()
        return out

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for; ids without a token stand for none."""
        return self.decode_list(np.frombuffer(ids, "<u4"))

    def decode_list(self, ids: np.ndarray) -> bytes:
        """The same for an array of ids."""
        known = (ids >= 0) & (ids < len(self.tokens))
        return b"".join(map(self.tokens.__getitem__, (ids if known.all() else ids[known]).tolist()))

    def verify(self, text: str, ids: bytes) -> None:
        """Raises unless the packed ids decode to the text."""
        if self.decode(ids) != text.encode():
            raise ValueError(f"{len(ids) // 4} ids do not decode to their text of {len(text)} characters")


_encoders: dict[tuple, Encoder] = {}


def _encoder(key: tuple, shared) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value)
    return _encoders[key]


def _shared(df: DataFrame, ranks_path: str, pattern: str):
    ranks = load_ranks(ranks_path)
    digest = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return (digest,), df.sparkSession.sparkContext.broadcast((ranks, pattern))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The rows (doc_id, text) of a batch in groups of about GROUP_CHARS, null texts empty."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= GROUP_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests_only: bool = False, verify: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_tokens and ids array<int>, or the digests of ids and decoded bytes.

    Each match of pattern is encoded by itself, without special tokens; a null text is empty and has no ids.
    Bytes that aren't UTF-8 are U+FFFD. Texts are processed whole, short ones in groups. With digests_only the columns are n_tokens, ids_sha256 of the ids
    as little-endian unsigned 32-bit integers, and decoded_sha256 of what the ids decode to. With verify
    each text's ids are decoded as well, and the job fails if they do not give the text back.
    """
    key, shared = _shared(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids, doc_ids, size = [], [], 0
            for some_ids, texts in _groups(batch):
                for doc_id, text, packed in zip(some_ids, texts, enc.encode_all(texts), strict=True):
                    doc_ids.append(doc_id)
                    if verify:
                        enc.verify(text, packed)
                    if digests_only:
                        ids.append((len(packed) // 4, sha(packed), sha(enc.decode(packed))))
                        continue
                    ids.append(packed)
                    size += len(packed)
                    if size > BATCH_BYTES:
                        yield _id_rows(doc_ids, ids)
                        ids, doc_ids, size = [], [], 0
            if digests_only and ids:
                n, a, b = zip(*ids, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            elif ids:
                yield _id_rows(doc_ids, ids)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>")
    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "make_valid_utf8(text) text")).mapInArrow(run, schema)


def _id_rows(doc_ids: list, packed: list[bytes]) -> pa.RecordBatch:
    n = np.array([len(p) // 4 for p in packed], np.int64)
    flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n), lists], ["doc_id", "n_tokens", "ids"])


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, decoded binary); null ids and ids without a token decode to nothing."""
    key, shared = _shared(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared)
        for batch in batches:
            out = [enc.decode_list(np.array([i for i in x.as_py() or () if i is not None], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
