"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns, of which there are few however many documents there are, estimates how each labeller
votes on either class, and so a posterior for each pattern. The posteriors of a bounded, seeded sample of
documents train a linear scorer on hashed byte trigrams, and the scorer judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread
from .grid import counts, lowered, pieces, run_hashes, word_bounds

#: Documents that the scorer is fitted to, at most; all documents count for the labellers' accuracies.
FIT_ROWS = 3000
BUCKETS = 4096
THRESHOLD = 0.5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"*%$#&!|~^=<>{}[]\\@_+", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SMALL = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_INK = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".?!:;", np.uint8))
#: Trigrams of byte classes: small letter, capital, digit, stop, space, other, and each symbol by itself.
_SHAPE = np.where(_SMALL, 1, np.where(_UPPER, 2, np.where((np.arange(256) >= 48) & (np.arange(256) <= 57), 3, np.where(~_INK, 4, np.where(_SYMBOL, np.arange(256), np.where(_STOP, 5, 6)))))).astype(np.uint32)

LABELLERS = ("symbols", "capitals", "repeats", "variety", "cells", "word_ends", "word_length", "sentences", "letters")
#: A word is said again if one of so many words before it is the same.
NEAR = 16
#: Signs that end sentences or clauses in scripts other than the Latin one, in UTF-8.
_STOPS = [c.encode() for c in "。！？：；…।॥؟؛۔።"]
#: What the labellers are held to do before any document is seen: shares of bad, no and good votes on either class; the share of good documents; and how much of the corpus this is worth.
PRIOR_GOOD, PRIOR_BAD, PRIOR_CLASS, PRIOR_SHARE = (0.005, 0.395, 0.6), (0.5, 0.3, 0.2), 0.9, 0.15


def _foreign_stops(buf: np.ndarray) -> np.ndarray:
    """Where signs of _STOPS begin."""
    out = np.zeros(len(buf), bool)
    for sign in _STOPS:
        n = len(buf) - len(sign) + 1
        if n > 0:
            hit = buf[:n] == sign[0]
            for k in range(1, len(sign)):
                hit &= buf[k : n + k] == sign[k]
            out[:n] |= hit
    return out


def _unspaced(buf: np.ndarray) -> np.ndarray:
    """Where characters of scripts begin that don't put spaces between words: Chinese, Japanese, Thai, Lao, Tibetan, Burmese, Khmer."""
    nxt = np.append(buf[1:], np.uint8(0)) if len(buf) else buf
    return ((buf >= 0xE3) & (buf <= 0xE9)) | ((buf == 0xF0) & (nxt >= 0xA0) & (nxt < 0xB0)) | ((buf == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBF)) | ((buf == 0xE1) & (((nxt >= 0x80) & (nxt <= 0x82)) | (nxt == 0x9E) | (nxt == 0x9F)))


def signals(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, per text. Lengths are in code points; scripts without spaces are taken to have words of two."""
    start, stop, first = word_bounds(buf, off)
    words = run_hashes(lowered(buf), start, stop)
    n_words = np.diff(first)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][n_words > 0]] = False
    place = np.arange(len(words)) - np.repeat(first[:-1], n_words)
    again = np.zeros(len(words), bool)
    for lag in range(1, NEAR + 1):
        again[lag:] |= (words[lag:] == words[:-lag]) & (place[lag:] >= lag)
    last = buf[stop - 1]
    begins = (buf & 0xC0) != 0x80
    ink, letters = counts(_INK[buf] & begins, off), counts((_UPPER | _SMALL)[buf] & begins, off)
    unspaced = counts(_unspaced(buf), off)
    wide = unspaced * 5 >= np.maximum(ink, 1)
    part = lambda a, b: a / np.maximum(b, 1)
    n_units = np.where(wide, ink // 2, n_words)
    foreign = counts(_foreign_stops(buf), off)
    return {
        "words": n_words, "wide": wide, "units": n_units, "symbols": part(counts(_SYMBOL[buf], off), ink), "capitals": part(counts(_UPPER[buf], off), letters),
        "repeats": part(counts(same, first), n_words), "again": part(counts(again, first), n_words), "cells": part(counts((last == ord("|")) & (stop - start == 1), first), n_words),
        "word_ends": part(counts(_SYMBOL[last], first), n_words), "word_length": part(ink, n_words), "sentences": part(counts(_STOP[last], first) + foreign, n_units), "letters": part(letters - foreign, ink),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers) of 1 good, -1 bad, 0 nothing. Those for one kind of junk never vote good; length of words says nothing where words aren't spaced, nor does the want of stops."""
    n = s["words"]
    bad = lambda x: np.where(x, -1, 0)
    either = lambda good, x: np.where(good, 1, bad(x))
    v = np.stack([
        bad(s["symbols"] >= 0.1),
        bad((n >= 5) & (s["capitals"] >= 0.4)),
        bad((n >= 8) & (s["repeats"] >= 0.25)),
        np.where(n >= 8, either(s["again"] < 0.4, s["again"] >= 0.5), 0),
        bad((n >= 8) & (s["cells"] >= 0.15)),
        bad(s["word_ends"] >= 0.25),
        bad(~s["wide"] & ((s["word_length"] < 2) | (s["word_length"] > 14))),
        np.where(s["units"] >= 30, either((s["sentences"] > 0.005) & (s["sentences"] < 0.4), ~s["wide"] | (s["sentences"] >= 0.4)), 0),
        np.where(n >= 5, either(s["letters"] >= 0.85, s["letters"] < 0.7), 0),
    ], 1)
    v[n == 0] = 0
    return v.astype(np.int8)


def posteriors(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation: the probability of good for each pattern (rows of votes) with its count.

    Labellers are taken as independent given the class, with a vote of nothing as a third outcome. The maximum is
    that of the posterior: the PRIOR_ shares count as PRIOR_SHARE of the corpus, and are where it starts. That says
    which class is the good one, and keeps a corpus without junk from being split into two kinds of clean text.
    Without patterns the result is empty.
    """
    if not len(patterns):
        return np.zeros(0)
    total = weights.sum()
    cast = np.stack([patterns == vote for vote in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, outcome
    told = PRIOR_SHARE * total
    share, of_good, of_bad = PRIOR_CLASS, np.tile(PRIOR_GOOD, (patterns.shape[1], 1)), np.tile(PRIOR_BAD, (patterns.shape[1], 1))
    good = None
    for _ in range(rounds):
        logit = np.log(share / (1 - share)) + (cast * np.log(of_good / of_bad)).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if good is not None and np.abs(new - good).max() < 1e-9:
            break
        good, w, b = new, weights * new, weights * (1 - new)
        share = (w.sum() + told * PRIOR_CLASS) / (total + told)
        of_good = (np.tensordot(w, cast, 1) + told * np.array(PRIOR_GOOD)) / (w.sum() + told)
        of_bad = (np.tensordot(b, cast, 1) + told * np.array(PRIOR_BAD)) / (b.sum() + told)
    return good


def _trigrams(buf: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigram and the shape trigram at each position; the lower half is for shapes."""
    b, s = buf.astype(np.uint32), _SHAPE[buf]
    raw = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    shape = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
    half = buckets // 2
    fold = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(half)
    return fold(raw) + np.uint32(half), fold(shape ^ np.uint32(0x5BD1E9))


def _spans(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First trigram of each text and one past its last."""
    return off[:-1], np.maximum(off[1:] - 2, off[:-1])


def scores(buf: np.ndarray, off: np.ndarray, w: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Probability of good per text by weights w: the buckets', that of repeated words, and the bias."""
    total = np.zeros(max(len(buf) - 1, 1))
    if len(buf) > 2:
        raw, shape = _trigrams(buf, len(w) - 2)
        np.cumsum(w[raw] + w[shape], out=total[1:])
    a, b = _spans(off)
    b = np.minimum(b, len(total) - 1)
    a = np.minimum(a, b)
    z = (total[b] - total[a]) / np.maximum(b - a, 1) + w[-2] * repeats + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[bytes, bytes, float, float]], buckets: int = BUCKETS, steps: int = 150, rate: float = 2.0) -> np.ndarray:
    """Logistic regression of soft labels on rows of (bucket numbers, shares, repeats, label), by Adam."""
    w = np.zeros(buckets + 2)
    if not rows:
        return w
    idx = [np.frombuffer(r[0], np.uint16).astype(np.int64) for r in rows]
    col, val = np.concatenate(idx), np.concatenate([np.frombuffer(r[1], np.float32) for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(i) for i in idx])
    rep, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = np.bincount(row, w[col] * val, len(rows)) + w[-2] * rep + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.concatenate([np.bincount(col, err[row] * val, buckets), [(err * rep).sum(), err.sum()]]) + 1e-7 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8) * np.sqrt(1 / k)
    return w


class Model:
    """Posteriors by vote pattern and the scorer's weights: small, whatever the data."""

    def __init__(self, good: dict[int, float], weights: np.ndarray, threshold: float):
        self.good, self.weights, self.threshold = good, weights, threshold

    def judge(self, buf: np.ndarray, off: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(posteriors, scores, kept) of texts."""
        inked = counts(_INK[buf], off) > 0
        found = signals(buf, off)
        s = np.where(inked, scores(buf, off, self.weights, found["repeats"]), 0.0)
        post = [self.good.get(c) if k else None for c, k in zip(_codes(votes(found)).tolist(), inked.tolist(), strict=True)]
        return post, s, inked & (s >= self.threshold)


def _codes(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, buckets: int = BUCKETS, seed: int = 5) -> Model:
    """Fits labellers on all docs and the scorer on at most fit_rows of them."""
    scratch = Scratch(docs.sparkSession)
    narrow = spread(docs.selectExpr("xxhash64(cast(doc_id as long), text) doc", "text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch):
                v = votes(signals(buf, off))
                code = _codes(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code), pa.array(counts(_INK[buf], off) > 0)], ["doc", "pattern", "inked"])

    voted = scratch.save(narrow.mapInArrow(vote, "doc long, pattern long, inked boolean"), "votes")
    seen = voted.where("inked").groupBy("pattern").count().collect()  # one row per pattern: 3 ** labellers at most
    codes = np.array([r[0] for r in seen], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    good = dict(zip(codes.tolist(), posteriors(patterns, np.array([r[1] for r in seen], float)).tolist(), strict=True))

    # doc tells rows by id and text, so that repeated rows are one and the choice is the same in each run
    chosen = voted.where("inked").select("doc", "pattern").distinct().orderBy(F.xxhash64(F.lit(seed), "doc"), "doc").limit(fit_rows)
    picked = scratch.save(chosen, "sample")  # fit_rows narrow rows at most: safe to broadcast

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch):
                rep = signals(buf, off)["repeats"]
                idx, val = [], []
                for i in range(part.num_rows):
                    one = buf[off[i] : off[i + 1]]
                    c = np.bincount(np.concatenate(_trigrams(one, buckets)), minlength=buckets) if len(one) > 2 else np.zeros(buckets, np.int64)
                    at = np.nonzero(c)[0]
                    idx.append(at.astype(np.uint16).tobytes())
                    val.append((c[at] / max(len(one) - 2, 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), pa.array(rep)], ["doc", "pattern", "idx", "val", "rep"])

    sample = narrow.join(F.broadcast(picked), "doc").select("doc", "text", "pattern").mapInArrow(featurise, "doc long, pattern long, idx binary, val binary, rep double")
    rows = sorted(sample.dropDuplicates(["doc"]).collect(), key=lambda r: r.doc)  # fit_rows at most
    scratch.drop()
    return Model(good, fit([(r.idx, r.val, r.rep, good[r.pattern]) for r in rows], buckets), threshold)


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, posterior, score, kept.

    posterior is the labellers' verdict, score the scorer's probability of good; kept where score reaches the
    threshold. Null, empty and blank texts are never kept and score 0. Equal seeds give equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch):
                post, s, kept = shared.value.judge(buf, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(post, pa.float64()), pa.array(s), pa.array(kept)], ["doc_id", "posterior", "score", "kept"])

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(judge, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that classify() would keep, with all their columns."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model or train(docs)), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, text):
                yield part.filter(pa.array(shared.value.judge(buf, off)[2]))

    return spread(docs).mapInArrow(judge, docs.schema)
