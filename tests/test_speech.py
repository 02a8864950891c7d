"""Phrases, gaps, silences and labels: stated cases, and random tokens against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from cueforge import catalog
from cueforge.functions import formats
from cueforge.operators import speech

SCHEMA = "source string, pos int, type string, text string, start double, end double, speaker string"


def frame(spark, rows, source="a"):
    return spark.createDataFrame([(source, i, *r) for i, r in enumerate(rows)], SCHEMA)


def word(text, start, end, speaker=None):
    return ("word", text, start, end, speaker)


def fold(tokens, threshold):
    """A sequential pass that says the same as the windows."""
    out, cur, prev = [], [], None

    def flush():
        said = [x for x in (part(t) for t in cur) if x]
        if said:
            text = " ".join(said)
            for m in ",.?!":
                text = text.replace(" " + m, m)
            last = cur[-1]
            out.append((cur[0][2], last[3] if last[3] is not None else last[2], text, cur[0][4]))
        cur.clear()

    def part(t):
        s = (t[1] or "").strip()
        return f"({s})" if s and t[0] == "audio_event" and not s.startswith("(") else s

    for t in tokens:
        kind, _, start, end, speaker = t
        if kind == "spacing":
            if start is not None and end is not None and end - start >= threshold:
                flush()
            continue
        if start is None:
            continue
        if cur and cur[0][4] is not None and speaker is not None and speaker != cur[0][4]:
            flush()
        if prev is not None and start - prev >= threshold:
            flush()
        cur.append(t)
        prev = end if end is not None else start
    flush()
    return out


def phrases(spark, rows, threshold=0.5):
    return [(r.start, r.end, r.text, r.speaker) for r in speech.phrases(frame(spark, rows), threshold).orderBy("phrase").collect()]


CASES = {
    "gap at threshold": ([word("a", 0.0, 0.5, "A"), word("b", 1.0, 1.2, "A")], 2),
    "gap below": ([word("a", 0.0, 0.6, "A"), word("b", 1.0, 1.2, "A")], 1),
    "long spacing, words touch": ([word("a", 0.0, 0.2), ("spacing", None, 0.2, 0.8, None), word("b", 0.3, 0.5)], 2),
    "speaker change": ([word("a", 0.0, 0.2, "A"), word("b", 0.2, 0.4, "A"), word("c", 0.4, 0.6, "B")], 2),
    "null between speakers": ([word("a", 0.0, 0.2, "A"), word("b", 0.2, 0.4), word("c", 0.4, 0.6, "B")], 2),
    "null leader": ([word("a", 0.0, 0.2), word("b", 0.2, 0.4, "A"), word("c", 0.4, 0.6, "B")], 1),
    "overlap ends with the last": ([word("a", 0.0, 2.0), word("b", 0.5, 0.7)], 1),
    "blank only": ([word("  ", 0.0, 0.2)], 0),
    "blank moves the end": ([word("a", 0.0, 0.2), word(" ", 0.4, 0.8), word("b", 1.0, 1.1)], 1),
    "events": ([("audio_event", "laughter", 0.0, 0.2, None), ("audio_event", "(x)", 0.3, 0.4, None)], 1),
    "null start": ([word("a", None, 0.2), word("b", 0.0, 0.2)], 1),
    "marks": ([word("hi", 0.0, 0.1), word(",", 0.1, 0.2), word("you", 0.2, 0.3), word("?", 0.3, 0.4), word(";", 0.4, 0.5)], 1),
    "missing type": ([(None, "a", 0.0, 0.1, None)], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_phrase_cases(spark, name):
    rows, n = CASES[name]
    got = phrases(spark, rows)
    assert len(got) == n and got == fold(rows, 0.5)
    if name == "overlap ends with the last":
        assert got[0][1] == 0.7
    if name == "events":
        assert got[0][2] == "(laughter) (x)"
    if name == "marks":
        assert got[0][2] == "hi, you? ;"


def random_tokens(r, n):
    t, rows = 0.0, []
    for _ in range(n):
        gap = r.choice((0.0, 0.1, 0.25, 0.5, 0.75, -0.25))
        length = r.choice((0.125, 0.25, 0.5))
        if r.random() < 0.15:
            rows.append(("spacing", None, t, t + abs(gap), None))
        start = max(0.0, t + gap)
        rows.append((r.choice(("word", "word", "audio_event")), r.choice(("a", "b", " ", "c.", ",", None)), None if r.random() < 0.05 else start, start + length, r.choice((None, "A", "A", "B"))))
        t = start + length
    return rows


def test_phrases_equal_a_fold(spark):
    r = random.Random(1)
    lists = {f"s{k}": random_tokens(r, r.randint(0, 40)) for k in range(60)}
    df = spark.createDataFrame([(s, i, *x) for s, rows in lists.items() for i, x in enumerate(rows)], SCHEMA)
    got = {}
    for x in speech.phrases(df, 0.5).orderBy("source", "phrase").collect():
        got.setdefault(x.source, []).append((x.start, x.end, x.text, x.speaker))
    for s, rows in lists.items():
        assert got.get(s, []) == fold(rows, 0.5)


def test_raising_the_threshold_never_adds_phrases(spark):
    df = frame(spark, random_tokens(random.Random(2), 200))
    counts = [speech.phrases(df, t).count() for t in (0.1, 0.25, 0.5, 0.75, 2.0)]
    assert counts == sorted(counts, reverse=True)


def test_spacing_and_flattening(spark):
    w = "struct<word: string, start: double, end: double>"
    rows = [("a", [([("one", 0.1, 0.45), ("two", 0.5, 0.95)], "S0"), ([("three", 1.6, 1.9), (",", None, None)], None)])]
    segs = spark.createDataFrame(rows, f"source string, segments array<struct<words: array<{w}>, speaker: string>>")
    got = [(x.type, x.text, x.start, x.end, x.speaker) for x in speech.flatten_segments(segs).orderBy("pos").collect()]
    assert [g[0] for g in got] == ["word", "spacing", "word", "spacing", "word"]
    assert got[3][2:4] == (0.95, 1.6) and got[0][4] == "S0" and got[4][4] is None
    who = spark.createDataFrame([("a", 1, "S9")], "source string, seg_idx int, speaker string")
    got = [x.speaker for x in speech.flatten_segments(segs, who).where("type = 'word'").orderBy("pos").collect()]
    assert got == [None, None, "S9"]


def test_silences(spark):
    views = spark.createDataFrame([("a", 0.0, 5.0), ("quiet", 0.0, 1.0)], "source string, lo double, hi double")
    words = frame(spark, [word("x", 0.0, 2.0), word("y", 0.5, 1.0), word("z", 2.4, 3.0)])
    got = lambda df, v, t, **k: sorted((r.source, r.start, r.end) for r in speech.silences(df, v, t, **k).collect())
    assert got(words, views, 0.4) == [("a", 3.0, 5.0), ("quiet", 0.0, 1.0)]
    assert got(words, views, 0.4, only_heard=True) == [("a", 3.0, 5.0)]
    ms = words.withColumns({c: (F.col(c) * 1000).cast("long") for c in ("start", "end")})
    mv = views.where("source = 'a'").withColumns({c: (F.col(c) * 1000).cast("long") for c in ("lo", "hi")})
    assert got(ms, mv, 400) == [("a", 2000, 2400), ("a", 3000, 5000)]


def test_silence_and_speech_fill_the_view(spark):
    rows = random_tokens(random.Random(3), 120)
    rows = sorted((x for x in rows if x[0] != "spacing" and x[2] is not None), key=lambda x: x[2])
    view = spark.createDataFrame([("a", 5.0, 30.0)], "source string, lo double, hi double")
    gaps = [(x.start, x.end) for x in speech.silences(frame(spark, rows), view, 1e-9).collect()]
    covered = sum(1 for k in range(5000, 30000) if any(x[2] <= k / 1000 < x[3] for x in rows))
    assert sum(b - a for a, b in gaps) * 1000 + covered == pytest.approx(25_000, abs=200)


def test_labels_equal_a_fold(spark):
    r = random.Random(4)
    rows, t = [], 0
    for _ in range(300):
        rows.append(("word", r.choice(("a", " ", "b")), float(t), float(t + r.choice((20, 60, 200))), None))
        t += r.choice((30, 90, 300))
    view = spark.createDataFrame([("a", 0.0, float(t))], "source string, lo double, hi double")
    px = lambda s: int(50 + s / t * 1400)
    want, last = [], -9999
    for i, (_, text, s, e, _) in enumerate(rows):
        if text.strip() and e - s >= 50 and e > 0 and s < t and (px(s) + px(e)) // 2 - last >= 28:
            last = (px(s) + px(e)) // 2
            want.append((i, last))
    assert sorted((x.pos, x.x) for x in speech.labels(frame(spark, rows), view).collect()) == want


def test_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for x in (0.125, 2.675, 0.615, 100.005, 1.005, 1234.5, 0.375, 7.0):
        assert one(formats.format_time(F.lit(x))) == f"{x:06.2f}"
        assert one(formats.fixed(F.lit(x), 3)) == f"{x:.3f}"
    assert [one(formats.format_duration(F.lit(x))) for x in (59.94, 60.0, 119.97)] == ["59.9s", "1m 00.0s", "1m 60.0s"]
    assert [one(formats.srt_timestamp(formats.to_ms(F.lit(x)))) for x in (0.0005, 0.0015, 3661.5)] == ["00:00:00,000", "00:00:00,002", "01:01:01,500"]
    assert one(formats.caption_text(F.lit("  a \u00a0 b,;:"))) == "a b" and one(formats.caption_text(F.lit("end."))) == "end."
    assert one(formats.speaker_tag(F.lit("speaker_0"))) == " S0" and one(formats.speaker_tag(F.lit(None).cast("string"))) == ""
    assert one(formats.transcript_path(F.lit("/x/take.1.mp4"), F.lit(0))) == "take.1.json"
    assert one(formats.transcript_path(F.lit("take.mp4"), F.lit(2))) == "take.track2.json"
    assert one(formats.graph_path(F.lit("C:\\it's"))) == "C\\:\\it\\'s"


def test_packed_lines(spark):
    rows = [word("hi", 0.0, 0.2, "speaker_1")]
    sources = spark.createDataFrame([("a",), ("b",)], "source string")
    lines = speech.packed_lines(speech.phrases(frame(spark, rows), 0.5), sources, 1).orderBy("source", "line").collect()
    assert [x.text for x in lines] == ["## a  (duration: 0.2s, 1 phrases)", "  [000.00-000.20] S1 hi", "", "## b  (duration: 0.0s, 0 phrases)", "  _no speech detected_", ""]


def test_one_exchange_for_phrases(spark):
    plan = speech.phrases(frame(spark, random_tokens(random.Random(5), 20)), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_shouted_captions_are_whole(spark, tmp_path):
    long = "straße one,  two three " * 20
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(1, long + ";:"), (2, None), (3, "")], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.origin, r.id): (r.text, r.shout) for r in catalog.QUERIES["caption_shout"](spark, str(tmp_path)).collect()}
    clean = " ".join(long.split()) + " "
    for origin in ("documents", "benchmark"):
        assert got[origin, 1] == (clean, clean.upper()) and got[origin, 2] == (None, None) and got[origin, 3] == ("", "")
    assert len(got) == 6


def test_tasks_follow_the_bytes_of_text(spark, tmp_path, monkeypatch):
    from cueforge.sources import adapters

    rows = [(k, turn, "user" if turn % 2 else "system", f"a, b{k} c. " * 40) for k in range(60) for turn in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    size = sum(len(r[3]) for r in rows)
    got = {}
    for share in (1, 40):
        monkeypatch.setattr(adapters, "TASK_BYTES", size // share)
        p = catalog.phrases_spacing(spark, str(tmp_path))
        got[share] = (p.rdd.getNumPartitions(), sorted(map(tuple, p.collect())))
    assert got[1][0] <= 9 and got[40][0] > 40 and got[1][1] == got[40][1] and len(got[1][1]) > 60
    assert p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_spacing_sorts_once(spark):
    plan = speech.with_spacing(frame(spark, [word("a", 0.0, 0.1), word("b", 0.2, 0.3)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") == 1


@pytest.mark.parametrize("name", ["phrases_speaker_null", "packed_lines", "phrases"])
def test_a_task_takes_no_more_of_a_larger_table(spark, tmp_path, monkeypatch, name):
    from cueforge.sources import adapters

    largest, rows = {}, {}
    for n in (60, 480):
        made = [(k, turn, "user" if turn % 2 else "system", f"a, b{k} c. " * 40) for k in range(n) for turn in range(3)]
        spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        for size in (8192, 1 << 30):
            monkeypatch.setattr(adapters, "TASK_BYTES", size, raising=False)
            p = catalog.QUERIES[name](spark, f"{tmp_path}/{n}").withColumn("task", F.spark_partition_id())
            largest[n, size] = max(r["count"] for r in p.groupBy("task").count().collect())
            rows[n, size] = sorted(map(tuple, p.drop("task").collect()), key=repr)
        assert rows[n, 8192] == rows[n, 1 << 30] and len({r[0] for r in rows[n, 8192]}) == n
    assert largest[480, 8192] <= 2 * largest[60, 8192]


def test_a_source_of_very_many_words(spark, tmp_path):
    from cueforge.sources import adapters

    n, source = 280_000, 3
    spark.createDataFrame([(source, turn, "user", "a " * (n // 4)) for turn in range(4)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    gaps = [700 if (p * 7919 + source * 104729) % 11 == 0 else 500 if (p * 31 + source) % 5 == 0 else 80 for p in range(1, n + 1)]
    got = adapters.tokens(spark, str(tmp_path)).agg(F.count("pos"), F.max("pos"), F.sum("start"), F.max("end")).first()
    ends = [0]
    for g in gaps:
        ends.append(ends[-1] + 100 + g)
    assert tuple(got) == (n, n, sum(ends[1:]) - 100 * n, ends[-1])


def test_takes_and_lines_deal_the_text_once(spark, tmp_path):
    rows = [(None, 1, "user", "one two, three"), (2, 1, "user", " "), (3, 1, "speaker_1", "four")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    lines, takes = catalog.packed_lines(spark, str(tmp_path)), catalog.take_summary(spark, str(tmp_path))
    for df in (lines, takes):
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    assert sorted(((r.source or 0, r.line, r.text) for r in lines.collect()), key=lambda r: r[:2]) == [
        (0, 0, None), (0, 1, "  [000.08-001.08] Suser one two, three"), (0, 2, ""),
        (3, 0, "## 3  (duration: 0.3s, 1 phrases)"), (3, 1, "  [000.08-000.36] S1 four"), (3, 2, ""),
    ]
    assert sorted((r.source or 0, r.n_phrases, r.duration) for r in takes.collect()) == [(0, 1, 1000), (3, 1, 280)]


def test_silent_sources_have_a_row(spark):
    rows = [word("hi", 0.0, 0.2, "speaker_1"), word(" ", 9.0, 9.1), word("ho", 20.0, 20.1)]
    p = speech.phrases(frame(spark, rows).union(frame(spark, [word("", 0.0, 0.1), word(None, 5.0, 5.1)], "b")), 0.5, silent=True)
    assert [tuple(r)[:5] for r in p.orderBy("source", "phrase").collect()] == [("a", 1, 0.0, 0.2, "hi"), ("a", 2, 20.0, 20.1, "ho"), ("b", None, None, None, None)]
    assert [r.text for r in speech.packed_lines(p, per_second=1).where("source = 'b'").orderBy("line").collect()] == ["## b  (duration: 0.0s, 0 phrases)", "  _no speech detected_", ""]
    assert sorted(map(tuple, speech.takes(p).collect()))[1] == ("b", 0, 0.0)
