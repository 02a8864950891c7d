"""WARC, top-k, mixing, BPE, pipeline: round trips and brute force."""

import base64
import collections
import fractions
import gzip
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from cueforge.llm import bpe, mixing, topk, warc
from cueforge.llm.common import Scratch

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


# --- WARC


def archive(n, gz=True):
    parts = [warc.record(i, f"http://x/{i}\r\nX: y", bytes([i]) * (i * 50), None, False) for i in range(n)]
    return [warc.gzip_member(p) if gz else p for p in parts]


def ids_of(got):
    return [warc._id(x.head.get("warc-record-id")) for x in got if isinstance(x, warc.Found)]


def read(data):
    """Ids of the records and the archive's gaps; what salvage promises of cover and order is checked on the way."""
    got = list(warc.salvage(data))
    inside = {}
    for x in got:
        if isinstance(x, warc.Gap) and x.member is not None:
            inside.setdefault(x.member, []).append((x.start, x.stop))
        elif isinstance(x, warc.Found) and x.inner:
            inside.setdefault(x.at, []).append(x.inner)
    outer = sorted({(x.start, x.stop) for x in got if isinstance(x, warc.Gap) and x.member is None} | {(x.at, x.stop) for x in got if isinstance(x, warc.Found)})
    assert [a for a, _ in outer] + [len(data)] == [0] * bool(outer) + [b for _, b in outer] or not data
    for member, spans in inside.items():
        plain = warc._member(data, member)[0]
        assert [a for a, _ in spans] + [len(plain)] == [0] + [b for _, b in spans]
    return ids_of(got), [(x.start, x.stop) for x in got if isinstance(x, warc.Gap) and x.member is None]


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_after_each_kind_of_damage(gz):
    parts = archive(6, gz)
    whole = b"".join(parts)
    at = [sum(map(len, parts[:k])) for k in range(7)]
    assert read(whole) == ([0, 1, 2, 3, 4, 5], [])
    assert read(b"") == ([], [])
    # a byte flipped inside a record's payload or stream
    hurt = bytearray(whole)
    hurt[at[3] + len(parts[3]) - (20 if gz else 60)] ^= 0x55
    assert read(bytes(hurt)) == ([0, 1, 2, 4, 5], [(at[3], at[4])])
    # junk between records, a missing middle, a cut end
    assert read(whole[: at[2]] + b"junk" * 9 + whole[at[2] :]) == ([0, 1, 2, 3, 4, 5], [(at[2], at[2] + 36)])
    assert read(whole[: at[2] + 9] + whole[at[4] :]) == ([0, 1, 4, 5], [(at[2], at[2] + 9)])
    assert read(whole[: at[6] - 5]) == (([0, 1, 2, 3, 4, 5], []) if gz else ([0, 1, 2, 3, 4], [(at[5], at[6] - 5)]))
    assert read(b"nothing here") == ([], [(0, 12)])


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_members_of_several_records(level):
    r = random.Random(3)
    parts = [warc.record(i, "u", r.randbytes(9000), None, False) for i in range(5)]
    edges = [sum(map(len, parts[:k])) for k in range(6)]
    member = lambda b: gzip.compress(b, level, mtime=0)
    plain, extra = b"".join(parts), warc.gzip_member(warc.record(9, "u", b"x", None, False))
    # bad records inside a whole member: first, middle, two in a row
    for bad in ([0], [2], [1, 2]):
        hurt = bytearray(plain)
        for k in bad:
            hurt[edges[k] + 4000] ^= 1
        one = member(bytes(hurt))
        assert read(one + extra) == ([k for k in range(5) if k not in bad] + [9], [])
        inner = [(x.start, x.stop) for x in warc.salvage(one) if isinstance(x, warc.Gap)]
        assert inner == [(edges[bad[0]], edges[bad[-1] + 1])]
    # a CRC fault, a stream fault, a cut: what came before is kept, and the next member read
    one = member(plain)
    crc = bytearray(one)
    crc[-6] ^= 1
    ids, gaps = read(bytes(crc) + extra)
    assert ids == [0, 1, 2, 3, 4, 9] and len(gaps) == 1 and len(one) - 8 <= gaps[0][0] < gaps[0][1] == len(one)
    ids, gaps = read(one[: len(one) * 7 // 10] + b"\xff" * 3 + extra)
    assert ids == [0, 1, 2, 9] and len(gaps) <= 1
    for cut in (len(one) * 7 // 10, len(one) - 5):
        got = list(warc.salvage(one[:cut]))
        assert ids_of(got) == [k for k in range(5) if k < 3 or cut == len(one) - 5]
        assert isinstance(got[-1], warc.Gap) and got[-1].reason == "gzip: member cut short"


def test_salvage_passes_over_quoted_records():
    quoted = b"x\r\n" + warc.record(7, "u", b"quoted", None, False)
    parts = [warc.record(1, "u", quoted + b"z" * 50, None, False), warc.record(2, "u", b"b", None, False)]
    for wrap in (bytes, gzip.compress):
        whole = b"".join(parts)
        assert ids_of(warc.salvage(wrap(whole))) == [1, 2]
        assert ids_of(warc.salvage(wrap(whole.replace(b"z" * 9, b"z" * 8 + b"y", 1)))) == [2]


def test_salvage_is_linear():
    r = random.Random(1)
    one = [warc.gzip_member(warc.record(i, "u", r.randbytes(500), None, False)) for i in range(16_000)]
    start = time.process_time()
    assert len(ids_of(warc.salvage(b"".join(one)))) == 16_000
    for junk in (b"WARC/1.1\r\nA: b\r\n" * 100_000, b"\x1f\x8b\x08" * 20_000):
        assert ids_of(warc.salvage(one[0] + junk + one[1])) == [0, 1]
    assert time.process_time() - start < 20


def test_salvage_of_foreign_headers(spark):
    def foreign(*lines, block=b"b"):
        return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    data = foreign("WARC-Type: revisit", "X-Payload-Length: many") + foreign("WARC-Type: revisit") + foreign("WARC-Type: response", f"WARC-Record-ID: <urn:page:{1 << 70}>") + foreign("WARC-Type: response", "WARC-Block-Digest: sha256:00", "WARC-Record-ID: <urn:uuid:1>") + foreign("WARC-Type: response", "WARC-Block-Digest: sha1:" + hashlib.sha1(b"b").hexdigest())
    got = warc.read_archives(spark.createDataFrame([("p", data), ("q", None)], "path string, content binary")).collect()
    assert [(x.page_id, x.record_type, x.payload_bytes, x.gap_from) for x in got] == [(None, "revisit", None, None)] * 2 + [(None, "response", 1, None)] * 3


def test_salvage_reads_headers_of_any_length():
    url = "http://x/" + "y" * (3 << 20)
    parts = [warc.record(1, url, b"long", None, False), warc.record(2, "u", b"short", None, False)]
    for wrap in (warc.gzip_member, bytes):
        got = list(warc.salvage(b"".join(map(wrap, parts))))
        assert ids_of(got) == [1, 2] and len(got) == 2 and got[0].head["warc-target-uri"] == url
    cut = parts[0][:500] + b"\r\n"
    assert read(cut + parts[1]) == ([2], [(0, len(cut))])


def test_salvage_keeps_the_bytes_before_a_stream_fault():
    r = random.Random(5)
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(40_000))
    head = c.compress(text) + c.flush(zlib.Z_FULL_FLUSH)
    plain, stop, why = warc._member(head + b"\x07" + b"z" * 50, 0)
    assert plain == text and stop == len(head) and why.startswith("gzip: ")


def test_salvage_covers_every_byte_once_and_gives_back_what_is_whole():
    """read() checks the cover; records whose bytes no damage touches come back."""
    r = random.Random(2)
    parts = archive(9) + archive(4, False)
    parts = [*parts[:3], gzip.compress(b"".join(archive(5, False)), r.choice((0, 6)), mtime=0), *parts[3:]]
    whole, at = b"".join(parts), [0]
    for p in parts:
        at.append(at[-1] + len(p))
    ids = [ids_of(warc.salvage(p)) for p in parts]
    for _ in range(150):
        hurt, spots = bytearray(whole), set()
        for _ in range(r.randint(1, 4)):
            a = r.randrange(len(hurt))
            b = min(len(hurt), a + r.choice((1, 1, 30)))
            hurt[a:b] = r.randbytes(b - a)
            spots |= {k for k in range(len(parts)) if at[k] < b and a < at[k + 1]}
        got = collections.Counter(read(bytes(hurt))[0])
        need = collections.Counter(i for k in range(len(parts)) if k not in spots for i in ids[k])
        assert not need - got


def test_warc_round_trip(spark):
    rows = [(3, "u", "same", "x"), (1, None, "same", "x"), (2, "u", None, "x"), (4, "u", "", "x"), (None, "u", "same", "x"), (1, "u", "same", "x"), (5, "u", "é" * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    store = Scratch(spark).save(warc.write_archives(warc.mark_revisits(pages), archive_bytes=500), "a")
    got = warc.read_archives(store).where("gap_from is null").collect()
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(3, 4, digest("same"), "revisit", 1), (1, 4, digest("same"), "response", None), (2, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 2), (None, 4, digest("same"), "revisit", 1), (1, 4, digest("same"), "revisit", 1), (5, 200_000, digest("é" * 100_000), "response", None)]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    long = next(r for r in got if r.page_id == 5)
    assert bytes(long.payload) == ("é" * 100_000).encode()
    few = warc.mark_revisits(pages, min_bytes=10).where("is_revisit")
    assert few.count() == 0
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)))).count() == 0


# --- top-k


def brute_top(rows, k):
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=False)), j) for j in v if j != q)[:k]
        out += [(q, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "skewed", "odd", "empty", "one"])
def test_top_k(spark, kind):
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    hot = vec()
    rows = {
        "random": lambda: [(i, vec()) for i in range(400)],
        "ties": lambda: [(i, hot if i % 3 else vec()) for i in range(300)],
        "skewed": lambda: [(i, [x * (50 if i % 41 == 0 else 1) for x in vec()]) for i in range(300)],
        "odd": lambda: [(0, vec()), (50, None), (100, [1.0, None]), (150, [float("nan")]), (200, [float("inf")]), (250, []), (1, vec()[:3]), (2, vec()), (2, hot), (None, vec()), (300, [0.0] * 8)][:8] + [(300, [0.0] * 8), (None, vec())],
        "empty": lambda: [],
        "one": lambda: [(0, vec())],
    }[kind]()
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, shard_rows=90, query_block=3).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_top(rows, 5)


def test_top_k_keeps_rows_repeated_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [7.0, 0.0]), (1, [7.0, 0.0]), (2, [0.0, 6.0]), (2, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=3).collect()
    scores = sorted((-65536 * sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in rows if i == 0 for j, y in rows if j)[:5]
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]


@pytest.mark.parametrize("size", [70_000.0, 1e6, 1e15, 1e200, 1.7e308])
def test_top_k_of_huge_components(spark, size):
    r = random.Random(9)
    rows = [(0, [size, 1.0]), (50, [-size, 0.25]), (1, [66_000.0, 1.0]), (2, [size, 0.0]), (3, [size * 0.999, 0.0])] + [(100 + 7 * i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(40)]
    big = lambda v: [math.floor(fractions.Fraction(x) * 256) for x in v]
    want = []
    for i, a in rows:
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(big(a), big(b), strict=True)), j) for j, b in rows if j != i)[:5]
            want += [(i, n + 1, j, min(max(-x, -(1 << 63)), (1 << 63) - 1)) for n, (x, j) in enumerate(s)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=9, query_block=2)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_top_k_stops_only_on_proof():
    r = np.random.default_rng(5)
    values = (r.normal(0, 100, (600, 16)) * (1 + 40 * (r.random((600, 1)) < 0.01))).astype(np.int64)
    shard = topk.Shard(np.arange(600), values)
    for q in range(0, 600, 37):
        exact = values @ values[q]
        want = [(int(i), int(exact[i])) for i in np.lexsort((np.arange(600), -exact)) if i != q][:5]
        for every in (1, 7, 1000):
            assert shard.search(values[q], 5, q, every) == want
            for floor in (want[2][1], want[4][1], want[0][1] + 1, -(1 << 63)):
                assert shard.search(values[q], 5, q, every, floor) == [x for x in want if x[1] >= floor]


# --- mixing


def iterate_targets(sizes, weights, cap):
    total, capped, goal = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goal = [cap * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and goal[i] > cap * sizes[i]}
        if not over:
            return goal
        capped |= over


def test_water_filling_is_the_fixed_point(spark):
    r = random.Random(6)
    for _ in range(4):
        sizes, weights = [r.choice((0, 1, 7, 50, 900, 20_000)) for _ in range(9)], [r.randint(1, 5) for _ in range(9)]
        if not sum(sizes):
            continue
        df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight long")
        got = {x.source: x.target for x in mixing.water_fill(df, 3).collect()}
        for i, g in enumerate(iterate_targets(sizes, weights, 3)):
            assert got[f"s{i}"] == pytest.approx(g, rel=1e-9, abs=1e-9)


def test_mix_on_odd_rows(spark):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (3, "one two", None, 9), (3, "one two", None, 9), (None, "x", "b", 9), (4, "w " * 50_000, "c", 9)] + [(10 + i, "some words here " * (i % 7), "d", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    a, b = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert a == b
    for r in mixing.mix(docs).collect():
        assert r.taken == r.times * r.size <= 3 * r.size
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs).collect():
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    taken, target = per["d"]
    assert abs(taken - target) <= 0.05 * target + 21
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.times for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


# --- BPE


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.load_ranks(RANKS)
    return bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(encoders):
    own, lib = encoders
    r = random.Random(8)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 5000, "\n" * 300 + "x", "é" * 999, "\x1c\x85   x", "it's We'LL"]
    texts += ["".join(r.choice("aet ih.A\n'sßé漢🙂0 1") for _ in range(r.choice((1, 7, 60, 2000)))) for _ in range(60)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_bpe_memory_is_bounded(encoders, monkeypatch):
    own, lib = encoders
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    text = " ".join(f"w{i}" for i in range(50))
    own.clear()
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode_ordinary(text)
    assert len(own) <= 5


def _merged_plainly(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_bpe_shared_queue_equals_plain_merging():
    """Vocabularies in any order: a merge may make a lower rank possible, which then goes before the rest of its bucket."""
    r = random.Random(10)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)] + list({bytes(r.choice(b"ab\0") for _ in range(r.randint(2, 5))) for _ in range(40)})
        r.shuffle(tokens)
        ranks = {t: k for k, t in enumerate(tokens)}
        pieces = [bytes(r.choice(b"ab\0") for _ in range(r.choice((0, 1, 2, 9, 80)))) for _ in range(25)]
        merger = bpe.Merger(ranks)
        for _ in range(2):  # the bitmap serves again
            assert [np.frombuffer(x, "<u4").tolist() for x in merger.merge(pieces)] == [_merged_plainly(p, ranks) for p in pieces]
        assert merger.merge([]) == []


def test_bpe_frames(spark, encoders):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some text", "x"), (3, "some text", "x"), (3, "some text", "x"), (4, "very long text " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(docs, RANKS, P.PATTERN)
    back = bpe.decode(enc, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    d = {r.doc_id: r for r in bpe.encode(docs, RANKS, P.PATTERN, digests_only=True).collect()}
    ids = encoders[1].encode_ordinary("some text")
    assert d[3].n_tokens == len(ids) and d[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert d[1].decoded_sha256 == hashlib.sha256(b"").hexdigest() and d[1].n_tokens == 0
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_on_odd_ids_texts_and_vocabularies(spark, encoders):
    rows = [(1, [97, -1, 10**6, None, 98]), (2, None), (3, [])]
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS, P.PATTERN).collect()}
    assert got == {1: encoders[0].tokens[97] + encoders[0].tokens[98], 2: b"", 3: b""}
    broken = spark.sql("select 1L doc_id, cast(X'61FF62' as string) text")
    assert bytes(bpe.decode(bpe.encode(broken, RANKS, P.PATTERN), RANKS, P.PATTERN).first().decoded).decode() == "a\ufffdb"
    with pytest.raises(ValueError):
        bpe.Merger({b"a": 0})


def test_bpe_verify_shows_a_decoding_fault(encoders, monkeypatch):
    ids = encoders[0].encode("some text")
    encoders[0].verify("some text", ids)
    with pytest.raises(ValueError):
        encoders[0].verify("some texts", ids)
    seen = []
    monkeypatch.setattr(bpe, "encode", lambda *a, **k: seen.append(k))
    corpus_pipeline.tokenise(None, None, "")
    assert seen == [{"verify": True}]


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, "/root/testdata/sf0.001"), "s")
        seen.append(docs)
    assert [d.columns == cols for d in seen] == [True] * 4 + [False]
    good, exact, near, mixed, ids = seen
    norm = lambda t: "".join(t.translate({c: None for c in (9, 10, 11, 12, 13, 32)}))
    texts = {r.doc_id: r.text for r in good.collect()}
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append((-len(t), i))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in near.collect()} <= {r.doc_id for r in exact.collect()}
    assert max(times.values()) <= 3
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in ids.limit(20).collect():
        assert r.ids == lib.encode_ordinary(texts[r.doc_id])
    assert collections.Counter(r.doc_id for r in ids.collect()) == times


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Plain words are kept here.", None, None, 3), (4, "Plain words are kept here.", "en", "s", 3), (4, "Plain words are kept here.", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = Scratch(spark).save(stage(spark, df, ""), "s")
        assert df.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_dedup_decides_row_by_row(spark):
    near = [" ".join(f"w{i}" for i in range(60)) + end for end in ("", " x", " y")]
    rows = [(None, "same text", "a"), (4, "same text", "b"), (4, "same text", "b"), (4, "sametext", "c"), (7, "other", "d"), (4, "other", "e"), (None, "no id", "f"), (None, "no id", "f"), (None, near[0], "g"), (9, near[1], "h"), (8, near[2], "i"), (8, near[2], "i"), (None, None, "j"), (2, "", "k"), (3, "", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    exact = Scratch(spark).save(corpus_pipeline.drop_exact(spark, docs, ""), "e")
    shown = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert shown(exact) == sorted([("4", "same text"), ("4", "other"), ("None", "no id"), ("None", near[0]), ("9", near[1]), ("8", near[2]), ("2", "")])
    assert shown(corpus_pipeline.drop_near(spark, exact, "")) == sorted([("4", "same text"), ("4", "other"), ("None", "no id"), ("8", near[2]), ("2", "")])
    # rows of one text all meet in the Jaccard join too; texts without words are no duplicates there
    assert shown(corpus_pipeline.drop_near(spark, docs, "")) == sorted([("4", "same text"), ("4", "sametext"), ("4", "other"), ("None", "no id"), ("8", near[2]), ("None", ""), ("2", ""), ("3", "")])


def test_pipeline_on_odd_rows_leaves_one_of_each(spark):
    rows = [(1, None), (2, ""), (None, "Plain words are kept here."), (4, "Plain words are kept here."), (4, "Plain words are kept here.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (corpus_pipeline.drop_exact, corpus_pipeline.drop_near):
        docs = Scratch(spark).save(stage(spark, docs, ""), "s")
        assert sorted((r.doc_id, r.text) for r in docs.where("text <> ''").collect()) == [(4, rows[3][1])]
        assert [r.doc_id for r in docs.where("coalesce(text, '') = ''").collect()] == [1]
