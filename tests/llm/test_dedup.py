"""Exact dedup, repeated strings, shingle join: against brute force, and on odd tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from cueforge.llm import chunks, common, exact_dedup, grid, repeats, shingle_join
from cueforge.llm.exact_dedup import PerfectHash, SlotTable

DOCS = "doc_id long, text string, source string, digest string, key long, rid long, n long"
ODD = [(2**63 - 1, "one", None), (1, None, None), (2, "", "s"), (3, "  \n\t", "s"), (4, "one", "s"), (5, "one", "s"), (5, "one", "s"), (None, "one", None), (6, "x " * 30_000, "s"), (7, "x " * 30_000 + "y", "s"), (8, "A b C d E f", None), (9, "a B c D e F", "s"), (None, None, "s")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, 2, 3) for i, t, s in rows], DOCS)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))
    base = [[word() for _ in range(r.choice((0, 1, 3, 12, 60, 150)))] for _ in range(n // 4)]
    common = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 9))):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            w += common
        rows.append((i * 3, r.choice((" ", "  ", "\n")).join(w), f"s{i % 3}"))
    return rows


def equal_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    g = collections.defaultdict(list)
    for i, t, _ in rows:
        g[norm(t)].append((-len(t or ""), i is None, i))
    return sorted(((i, min(g[norm(t)])[2], len(g[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("rows", [ODD, corpus(1), [], [(1, None, None)]])
@pytest.mark.parametrize("split", [None, "doc_id < 30", "true", "false"])
def test_exact_groups(spark, rows, split):
    got = exact_dedup.exact_groups(frame(spark, rows), F.expr(split) if split else None, shards=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == equal_groups(rows)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted({r.text_sha256 for r in got})


def test_perfect_hash_is_minimal_and_strangers_are_told_apart():
    d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    assert sorted(PerfectHash(d[:4000]).lookup(d[:4000])) == list(range(4000))
    t = SlotTable(d[:4000], np.arange(4000) * 7)
    member, row = t.find(d)
    assert member[:4000].all() and not member[4000:].any()
    assert (t.locators[row[:4000]] == np.arange(4000) * 7).all()
    near = d[:10].copy()
    near[:, 31] ^= 1  # same first words, other bytes
    assert not t.find(near)[0].any()
    assert not SlotTable(d[:0], np.zeros(0, np.int64)).find(d)[0].any()


def test_perfect_hash_refuses_repeats():
    d = np.zeros((2, 32), np.uint8)
    with pytest.raises(ValueError):
        PerfectHash(d)


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [5, 40, 100])
@pytest.mark.parametrize("rows", [ODD, corpus(2), [], [(1, "ab" * 200, None), (2, "ba" * 200, None)], [(1, "é" * 50 + "xyz" * 30, None), (0, "xyz" * 30, None)]])
def test_repeats(spark, rows, length):
    got = repeats.remove_repeats(frame(spark, rows), length).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, length)


def test_repeats_gives_text_and_spans(spark):
    r = repeats.remove_repeats(frame(spark, [(1, "hello world!", None), (2, "say hello world!", None)]), 5, with_text=True).orderBy("doc_id").collect()
    assert [bytes(x.kept) for x in r] == [b"hello world!", b"say "]
    assert [(s.start, s.stop) for s in r[1].spans] == [(4, 16)]


def brute_components(rows, percent=80):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        ids[find(k)].append((i is None, i))
    return sorted(((i, len(sets[k]), min(ids[find(k)])[1]) for k, (i, _, _) in enumerate(rows)), key=str)


def _thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_cancel_in_powers_of_two_stay_apart(spark):
    a = _thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a, None), (2, b, None), (3, a + " x y z v w", None), (4, b + " x y z v w", None), (5, "z" * 5000, None), (6, "z" * 5000, None), (7, "z" * 4999 + "y", None)]
    got = shingle_join.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_run_hashes_tell_runs_apart():
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"ab\0") for _ in range(r.choice((0, 1, 7, 8, 9, 16, 17, 40)))) for _ in range(3000)} | {b"q" * k for k in (4095, 4096, 4097, 5000)})
    buf = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    for kind in (0, 1):
        h = grid.run_hashes(buf, off[:-1], off[1:], kind)
        assert len(np.unique(h)) == len(words)
        assert (grid.run_hashes(np.concatenate([buf[3:], buf]), off[:-1] + len(buf) - 3, off[1:] + len(buf) - 3, kind) == h).all()
    assert not (grid.run_hashes(buf, off[:-1], off[1:], 0) == grid.run_hashes(buf, off[:-1], off[1:], 1)).any()


def test_tokens_are_compared_in_full():
    a = (np.array([1, 5, 5, 9], np.uint64), np.array([7, 2, 3, 1], np.uint64))
    b = (np.array([1, 5, 9], np.uint64), np.array([8, 3, 1], np.uint64))
    assert shingle_join.common_tokens(a, b) == shingle_join.common_tokens(b, a) == 2
    assert shingle_join.common_tokens(a, (a[0][:0], a[1][:0])) == 0


def test_a_common_passage_in_many_unlike_texts(spark, monkeypatch):
    """Keys whose members link with nothing go through several rounds of pivots, and the last of them pair by pair."""
    monkeypatch.setattr(shingle_join, "PIVOTS", 9)
    monkeypatch.setattr(shingle_join, "WHOLE", 20)
    r = random.Random(15)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(9)), None) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(" c3 ", " c3 ") + " end", None) for i in range(3)]
    got = shingle_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute_components(rows)


def test_chunk_buckets_follow_the_text():
    values = np.sort(np.array([0, 1, (1 << 48) - 1, 1 << 47, (1 << 47) - 1, 12345 << 20], np.uint64))
    for n in (1, 2, 8, 1 << 20):
        at, cut = chunks.runs_of(values, 48, n)
        assert [b for b, x, y in zip(at, cut[:-1], cut[1:], strict=True) for _ in range(x, y)] == [int(v) * n >> 48 for v in values]


def test_chunk_numbers_fall_into_buckets_by_runs(spark, monkeypatch):
    ids = np.concatenate([np.arange(50), np.arange(50) + (1 << 25) * 3, [(1 << 43) - 1]])
    for n in (1, 7, 64, 50_000):
        hashed = spark.createDataFrame([(int(i),) for i in ids], "i long").selectExpr("i", f"pmod(hash(i), {n}) b").collect()
        assert chunks.bucket_of(ids, n).tolist() == [r.b for r in hashed]
        for part in (0, 2):
            numbers = [x for x, _ in zip(chunks.chunk_numbers(part, 3, n, 4.5), range(40))]
            assert numbers == sorted(set(numbers)) and all(x // chunks.PER_PART == part for x in numbers)
            at = chunks.bucket_of(np.array(numbers), n).tolist()
            assert all((b - int(part * n / 3 + i / 4.5)) % n in (0, 1, n - 1) for i, b in enumerate(at)) and sum(a != b for a, b in zip(at, at[1:])) <= 9
    monkeypatch.setattr(chunks, "PER_PART", 1 << 16)
    numbers = [x for x, _ in zip(chunks.chunk_numbers(1, 2, 50_000, 4.0), range(400))]
    assert numbers == sorted(set(numbers)) and all(x >> 16 == 1 for x in numbers)


def test_hot_groups_meet_their_rows_by_broadcast(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id) k", "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    joined = common.join_groups(rows, groups, ["k"], "n")
    assert joined.columns == ["k", "id", "v"] and joined.where("v <> 2 * k").count() == 0 and joined.count() == 6000
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("rare", "large"), [(2000, 300), (2, 40), (1, 10_000)])
@pytest.mark.parametrize("rows", [ODD, corpus(3, 160), [], [(1, None, None)]])
def test_shingle_join(spark, rows, rare, large):
    got = shingle_join.near_duplicates(frame(spark, rows), rare=rare, large=large).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    # one row of each component stands for it; texts without words stand for themselves
    blank = sum(r.n_shingles == 0 for r in got)
    assert sum(r.is_first for r in got) == len({r.component_id for r in got if r.n_shingles}) + blank
