"""Cut lists, captions, envelopes and grading."""

import math
import random
import re

import pytest

from cueforge.operators import signal, timeline

TOK = "source string, pos int, type string, text string, start double, end double, speaker string"
RNG = "edl string, rid int, source string, start double, end double"


def toks(spark, words, source="a"):
    return spark.createDataFrame([(source, i, "word", *w, None) for i, w in enumerate(words)], TOK)


def cues(spark, words, ranges, n, upper=False):
    rows = spark.createDataFrame([("e", i, *r) for i, r in enumerate(ranges)], RNG)
    return [(x.out_start, x.out_end, x.text) for x in timeline.cues(rows, toks(spark, words), n, upper, 0.4).orderBy("cue").collect()]


WORDS = [("hello", 0.0, 0.3), ("world", 0.35, 0.6), ("again", 0.65, 0.9)]


def test_caption_sizes(spark):
    assert [c[2] for c in cues(spark, WORDS, [("a", 0.0, 1.0)], 2, True)] == ["HELLO WORLD", "AGAIN"]
    assert [c[2] for c in cues(spark, WORDS, [("a", 0.0, 1.0)], 10)] == ["hello world again"]


def test_caption_clamp_offset_and_least_length(spark):
    assert cues(spark, [("x", 0.8, 1.1), ("y", 1.9, 2.3)], [("a", 1.0, 2.0)], 10) == [(0.0, 1.0, "x y")]
    got = cues(spark, WORDS, [("a", 0.0, 1.0), ("none", 0.0, 2.0), ("a", 0.0, 0.5)], 10)
    assert [c[0] for c in got] == [0.0, 3.0]
    zero = cues(spark, [("x", 0.5, 0.9), ("y", 0.7, 0.55)], [("a", 0.5, 1.0)], 10)
    assert zero[0][1] - zero[0][0] == pytest.approx(0.05) or zero[0][1] - zero[0][0] == pytest.approx(0.4)


def test_chunks_equal_a_fold(spark):
    r = random.Random(1)
    words = [(r.choice(("a", "b,", "c.", "d", " ", "e!", "f:")), float(i), i + 0.5) for i in range(200)]
    for n in (2, 3, 10):
        want, cur = [], []
        for t, _, _ in words:
            if not t.strip():
                continue
            cur.append(t)
            if len(cur) >= n or t[-1] in ".,!?;:":
                want.append(" ".join(cur))
                cur = []
        want += [" ".join(cur)] if cur else []
        got = [re.sub(r"[,;:]+$", "", w) for w in want]
        assert [c[2] for c in cues(spark, words, [("a", 0.0, 500.0)], n)] == got


def test_a_word_in_two_ranges_has_two_cues(spark):
    assert len(cues(spark, WORDS, [("a", 0.0, 0.5), ("a", 0.4, 1.0)], 1)) == 4


def test_srt_lines(spark):
    rows = spark.createDataFrame([("e", 0, "a", 0.0, 1.0)], RNG)
    lines = timeline.srt_lines(timeline.cues(rows, toks(spark, WORDS), 10, False, 0.4), 1000).orderBy("cue", "line").collect()
    assert [x.text for x in lines] == ["1", "00:00:00,000 --> 00:00:00,900", "hello world again", ""]


def test_cut_checks(spark):
    rows = spark.createDataFrame([("e", 0, "a", 0.1, 0.62), ("e", 1, "a", 0.3, 0.9)], RNG)
    got = [(x.rid, x.edge, x.pos) for x in timeline.cuts_inside_words(rows, toks(spark, WORDS)).collect()]
    assert got == [(0, "start", 0)]
    pad = timeline.cut_padding(rows, toks(spark, WORDS), 0.0, 0.2).orderBy("rid").collect()
    assert [x.padded for x in pad] == [False, True]
    b = spark.createDataFrame([("e", 1.0)], "edl string, budget double")
    assert timeline.over_budget(rows, b).first().over


def test_overlays_are_closed_intervals(spark):
    o = spark.createDataFrame([("e", 0, 1.0, 2.0), ("e", 1, 3.0, 1.0)], "edl string, idx int, start double, duration double")
    t = spark.createDataFrame([("e", x) for x in (0.9, 1.0, 3.0, 4.0, 4.1)], "edl string, t double")
    got = {x.t: (x.n_active, x.top) for x in timeline.overlays_at(o, t).collect()}
    assert got == {1.0: (1, 0), 3.0: (2, 1), 4.0: (1, 1)}


def test_envelope(spark):
    r = random.Random(2)
    clips = {"n64": [r.random() - 0.5 for _ in range(64)], "n5": [0.1, -0.2, 0.3, 0.0, 0.4], "n0": [], "quiet": [0.0] * 40}
    df = spark.createDataFrame(list(clips.items()) + [("null", None)], "clip string, pcm array<double>")
    got = {}
    for x in signal.envelope(df, 10).orderBy("clip", "bucket").collect():
        got.setdefault(x.clip, []).append(x.rms)
    assert all(len(v) == 10 for v in got.values())
    raw = [math.sqrt(sum(x * x for x in clips["n64"][6 * b : 6 * b + 6]) / 6) for b in range(10)]
    assert got["n64"] == pytest.approx([x / max(raw) for x in raw])
    assert got["n5"][5:] == [0.0] * 5 and max(got["n5"]) == 1.0
    assert got["n0"] == got["quiet"] == got["null"] == [0.0] * 10


def test_peaks(spark):
    df = spark.createDataFrame([("a", 0), ("b", -32768), ("b", 5), ("c", 16384)], "clip string, sample short")
    got = {x.clip: x.dbfs for x in signal.peak_dbfs(df).collect()}
    assert got["a"] == float("-inf") and got["b"] == 0.0 and got["c"] == pytest.approx(-6.0206, abs=1e-4)


@pytest.mark.parametrize(("stats", "filter"), [((0.5, 0.7, 0.25), "eq=contrast=1.030:saturation=0.980"), ((0.30, 0.50, 0.10), "eq=contrast=1.080:gamma=1.100:saturation=1.040"), ((0.7, 0.7, 0.5), "eq=contrast=1.030:gamma=0.970:saturation=0.960")])
def test_auto_grade(spark, stats, filter):
    df = spark.createDataFrame([("c", *stats)], "clip string, y_mean double, y_range double, sat_mean double")
    assert signal.auto_grade(df).first()["filter"] == filter


def test_clip_stats_defaults(spark):
    df = spark.createDataFrame([("a", 8, 127.5, 0.0, 255.0, 51.0), ("none", 8, None, None, None, None), ("part", 10, 511.5, None, None, None)], "clip string, depth int, yavg double, ymin double, ymax double, satavg double")
    got = {x.clip: (x.y_mean, x.y_range, x.sat_mean) for x in signal.clip_stats(df).collect()}
    assert got == {"a": (0.5, 1.0, 0.2), "none": (0.5, 0.72, 0.25), "part": (0.5, 0.7, 0.25)}
