"""Plans, readers, sinks, streaming, and the driver's contract."""

import json
import wave
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cueforge import catalog
from cueforge.plans import media
from cueforge.sources import sinks, transcripts, wav
from cueforge.streaming import incremental

WORDS = [{"type": "word", "text": "hello", "start": 0.0, "end": 0.3}, {"type": "word", "text": "there", "start": 1.0, "end": 1.2, "extra": 1}]


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


#: Texts that are no rates, by what is wrong with them, around any number.
NO_RATE = {
    "sign": lambda n: [f"+{n}", f"-{n}", f"{n}/-1", f"-{n}/1"], "zero": lambda n: [f"{n}/0", f"0/{n}", "0.0", "00"], "exponent": lambda n: [f"{n}e0", f"{n}E2", f"1/{n}e1"],
    "separator": lambda n: [f"{n},5", f"{n}:1", f"{n}//1", f"{n}/1/1", f"{n}.", f".{n}", f"{n}.5/2", f"{n} / 1", f"{n}'000"], "length": lambda n: [str(n) * 20, f"{n}/{'7' * 32}", f"{n}.{'3' * 31}"], "words": lambda n: [f"{n}fps", f"x{n}", "ntsc", "", " "],
    "size": lambda n: [str(2**31 + n), f"1/{2**31 + n}"], "digits of other scripts": lambda n: ["\u0662\u0664", f"{n}\u0665"],
}


def test_rates(one):
    for n, d in ((7, 1), (24000, 1001), (50, 20), (119, 7), (1, 3), (2**31 - 1, 2)):
        f = Fraction(n, d)
        for text in (f"{n}/{d}", f"\t{n}/{d} ", f"{3 * n}/{3 * d}" if n < 10**6 else f"{n}/{d}"):
            assert one(media.canonical_rate(F.lit(text))) == f"{f.numerator}/{f.denominator}"
    for text in ("12.5", "23.976", "0.04", "100.000", "015"):
        f = Fraction(text)
        assert one(media.canonical_rate(F.lit(text))) == f"{f.numerator}/{f.denominator}"
    probe = lambda a, n: one(media.probed_rate(F.lit(a).cast("string"), F.lit(n).cast("string")))
    assert [probe("48/2", "9/1"), probe("0/0", "15/3"), probe("x", "15/3"), probe(None, None), probe("0/0", "0/0")] == ["24/1", "5/1", "5/1", None, None]


@pytest.mark.parametrize("kind", NO_RATE)
def test_texts_that_are_no_rates(spark, kind):
    texts = [t for n in (5, 24, 30) for t in NO_RATE[kind](n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", media.canonical_rate(F.col("t")).alias("r")).where("r is not null").collect()
    assert got == []


def test_one_rate_per_list(spark):
    r = spark.createDataFrame([("e", 0, "a"), ("e", 1, "b"), ("f", 0, "zzz")], "edl string, rid int, source string")
    p = spark.createDataFrame([("a", "60/1", "0/0"), ("b", "30/1", "0/0")], "clip string, avg_rate string, nominal_rate string")
    assert {x.edl: x.rate for x in media.resolve_rates(r, p).collect()} == {"e": "60/1", "f": "24"}
    assert {x.rate for x in media.resolve_rates(r, p, "30").collect()} == {"30/1"}


def test_orientation(one):
    cases = [((1080, 1920, None), True), ((1920, 1080, None), False), ((1920, 1080, -90.0), True), ((1080, 1920, 90.0), False), ((1920, 1080, 270.4), True), ((None, 1080, 0.0), False)]
    for (w, h, rot), want in cases:
        assert one(media.is_portrait(F.lit(w).cast("int"), F.lit(h), F.lit(rot).cast("double"))) == want


def test_presets(spark):
    for v in ("vertical-reel", "square-feed", None):
        styles = {x.name: x.force_style for x in media.force_style(media.caption_presets(spark), F.lit(v).cast("string")).collect()}
        assert styles["bold-overlay"].endswith("MarginV=90" if v == "vertical-reel" else "MarginV=34")
    for p in media.caption_presets(spark).collect():
        assert 0.28 <= p.margin_vertical / 288 < 0.45 and p.margin_vertical > p.margin_horizontal
    t = media.format_targets(spark)
    for strategy in ("crop", "blur-pad"):
        assert all(x.f for x in t.select(media.reframe(F.col("width"), F.col("height"), F.lit(strategy)).alias("f")).collect())
    with pytest.raises(PySparkException):
        t.select(media.reframe(F.col("width"), F.col("height"), F.lit("stretch"))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(media.strict(F.lit(None).cast("string"), "target", F.lit("x"))).collect()


def test_grades(spark):
    f = spark.createDataFrame([(1, None), (2, ""), (3, "auto"), (4, "subtle"), (5, "my_look"), (6, "eq=gamma=1.1"), (7, "none")], "id int, grade string")
    got = {x.id: x["filter"] for x in media.resolve_grades(f, media.grade_presets(spark)).collect()}
    assert got == {1: "", 2: "", 3: media.AUTO, 4: "eq=contrast=1.03:saturation=0.98", 5: "my_look", 6: "eq=gamma=1.1", 7: ""}


def test_composite(spark):
    o = spark.createDataFrame([("a", 0, 1.5, 2.0), ("a", 1, 4.0, 1.0)], "edl string, idx int, start double, duration double")
    lists = spark.createDataFrame([("a", "crop=9", "s.srt"), ("b", None, None), ("c", None, "x.srt"), ("d", "crop=9", None)], "edl string, reframe string, subtitles string")
    got = {x.edl: x for x in media.composite_graph(o, lists, "S").collect()}
    assert got["a"].graph == "[0:v]crop=9[reframed];[1:v]setpts=PTS-STARTPTS+1.5/TB[a1];[2:v]setpts=PTS-STARTPTS+4.0/TB[a2];[reframed][a1]overlay=enable='between(t,1.500,3.500)'[v1];[v1][a2]overlay=enable='between(t,4.000,5.000)'[v2];[v2]subtitles='s.srt':force_style='S'[outv]"
    assert got["b"].graph is None and got["b"].out_label == "[0:v]"
    assert got["c"].graph == "[0:v]subtitles='x.srt':force_style='S'[outv]"
    assert got["d"].graph == "[0:v]crop=9[reframed];[reframed]null[outv]"


def test_loudness(spark):
    full = json.dumps({k: "1" for k in transcripts.LOUDNESS_KEYS})
    rows = [(1, f"log {{x}} {full} end"), (2, '{"input_i": "1"}'), (3, "none"), (4, None), (5, "} {")]
    got = {x.clip: x.measured for x in transcripts.loudness(spark.createDataFrame(rows, "clip int, stderr string")).collect()}
    assert got[1] == {k: "1" for k in transcripts.LOUDNESS_KEYS}
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4


def test_paths(one):
    at = lambda p, a, b: one(transcripts.resolved_path(F.lit(p), F.lit("/v/edit"), F.lit(a), F.lit(b)))
    assert [at("/x", False, True), at("f", True, True), at("f", False, True), at("f", False, False)] == ["/x", "/v/edit/f", "/v/f", "/v/edit/f"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "take.json").write_text(json.dumps({"words": WORDS, "engine": "x"}, indent=1))
    (tmp_path / "t" / "empty.json").write_text("{}")
    t = transcripts.transcripts(spark, str(tmp_path / "t"))
    assert [(x.source, x.pos, x.text) for x in t.orderBy("pos").collect()] == [("take", 0, "hello"), ("take", 1, "there")]
    assert {x.source for x in transcripts.transcript_sources(spark, str(tmp_path / "t")).collect()} == {"take", "empty"}
    back = json.loads(sinks.transcript_json(t, "x").first().json)
    assert [w["text"] for w in back["words"]] == ["hello", "there"] and back["engine"] == "x"
    sinks.write_lines(t, str(tmp_path / "lines"), ["pos"])
    assert [x.value for x in spark.read.text(str(tmp_path / "lines")).collect()] == ["hello", "there"]
    edl = {"sources": {"a": "raw/a.mov"}, "ranges": [{"source": "a", "start": 0, "end": 1, "beat": "", "note": "n"}], "overlays": [{"file": "o.mp4", "start_in_output": 1.0, "duration": 2.0}]}
    (tmp_path / "cut.json").write_text(json.dumps(edl))
    r = transcripts.edl_ranges(spark, str(tmp_path / "cut.json")).first()
    assert (r.edl, r.rid, r.path, r.note) == ("cut", 0, "raw/a.mov", "n")
    assert transcripts.edl_overlays(spark, str(tmp_path / "cut.json")).first().file == "o.mp4"
    (tmp_path / "bad.json").write_text(json.dumps(edl | {"sources": {}}))
    with pytest.raises(PySparkException):
        transcripts.edl_ranges(spark, str(tmp_path / "bad.json")).collect()
    assert [x.source for x in transcripts.transcript_listing(spark, str(tmp_path / "t")).collect()] == ["empty", "take"]
    (tmp_path / "none").mkdir()
    for folder in ("none", "missing"):
        with pytest.raises(FileNotFoundError):
            transcripts.transcript_listing(spark, str(tmp_path / folder))
    for name in ("a.mp4", "b.MOV", "c.M4V", "d.txt"):
        (tmp_path / "t" / name).write_bytes(b"x")
    assert [x.path.split("/")[-1] for x in transcripts.videos(spark, str(tmp_path / "t")).collect()] == ["a.mp4", "b.MOV"]


def test_wav(spark, tmp_path):
    for name, channels, width in (("x", 1, 2), ("stereo", 2, 2), ("bytes", 1, 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(16000)
            w.writeframes(b"\x00\x40\x00\xc0")
    (tmp_path / "text.wav").write_bytes(b"no sound")
    got = {x.clip.split("/")[-1]: x for x in wav.wav_clips(spark, str(tmp_path)).collect()}
    assert got["x.wav"].pcm == [0.5, -0.5] and got["x.wav"].fault is None
    assert all(got[f"{n}.wav"].pcm is None and got[f"{n}.wav"].fault for n in ("stereo", "bytes", "text"))


def test_strict_lookups_tell_what_there_is(spark):
    names = spark.createDataFrame([("none",), ("own",)], "name string")
    own = media.grade_presets(spark, spark.createDataFrame([("own", "eq=x"), ("subtle", "eq=y")], "name string, filter string"))
    assert {x.name: x["filter"] for x in media.looked_up(names, "name", own, "filter", "preset").collect()} == {"none": "", "own": "eq=x"}
    assert own.where("name = 'subtle'").first()["filter"] == "eq=y" and own.count() == 5
    with pytest.raises(PySparkException, match="unknown preset own. Available: neutral_punch, none, subtle, warm_cinematic"):
        media.looked_up(names, "name", media.grade_presets(spark), "filter", "preset").collect()


def test_ascii_json_reads_back(spark):
    text = 'é"\\漢\U0001f642\x7f \n'
    row = spark.createDataFrame([(text,)], "t string").select(sinks.ascii_json(F.to_json(F.struct("t"))).alias("j")).first().j
    assert row.isascii() and json.loads(row) == {"t": text} and row == json.dumps({"t": text}, separators=(",", ":"))


def test_paths_are_normal(one):
    assert [one(transcripts.normal_path(F.lit(p))) for p in ("/a/./b//c", "/a/../b", "/../a/b/..", "/")] == ["/a/b/c", "/b", "/a", "/"]


def test_the_last_depth_counts(spark):
    from cueforge.operators import signal

    rows = [("a", 1, 10, 100.0), ("a", 3, 8, 155.0), ("a", 2, 10, 0.0), ("a", 4, None, 255.0), ("b", 1, None, 51.0)]
    f = spark.createDataFrame(rows, "clip string, frame int, depth int, yavg double").selectExpr("*", "yavg ymin", "yavg ymax", "cast(null as double) satavg")
    assert {x.clip: round(x.y_mean, 9) for x in signal.clip_stats(f).collect()} == {"a": 0.5, "b": 0.2}


def test_stream_packs_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"take{k}.json").write_text(json.dumps({"words": WORDS}))
        incremental.packed_stream(spark, src, out, ck).awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert sorted(r.source for r in rows) == [f"take{i}" for i in range(k + 1) for _ in range(2)]


def test_a_batch_of_files_is_listed_by_few_tasks(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for k in range(60):  # Spark lists up to 32 paths without tasks
        (tmp_path / "in" / f"take{k}.json").write_text(json.dumps({"words": WORDS}))
    q = incremental.packed_stream(spark, src, out, ck)
    q.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(q.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) <= incremental.LISTING_TASKS
    assert spark.read.parquet(out).select("source").distinct().count() == 60


def test_written_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from cueforge import catalog_files

    rows = [(k, 0, "user", "a b c d e " * 50) for k in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(catalog_files, "BATCH_BYTES", "50000")
    seen = []

    def written(files, folder):
        seen.extend(r.n for r in files.select("content").coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect())
        return put(files, folder)

    put = catalog_files.sinks.write_files
    monkeypatch.setattr(catalog_files.sinks, "write_files", written)
    assert catalog_files.read_transcripts(spark, str(tmp_path)).count() == 30 * 250
    assert sum(seen) > 500_000 and max(seen) < 150_000


def test_keyed_lines_stay_where_they_are_dealt(spark, tmp_path):
    rows = [(k, n, f"{k} {n}") for k in range(40) for n in (2, 0, 1)]
    t = spark.createDataFrame(rows, "source long, line int, text string").repartition(23, "source").select("source", "line", F.concat(F.spark_partition_id().cast("string"), F.lit(" "), "text").alias("text"))
    sinks.write_lines(t.withColumn("text", F.concat_ws(" ", "text", F.spark_partition_id().cast("string"))), str(tmp_path / "x"), ["line"], key="source")
    got = spark.read.text(str(tmp_path / "x"), wholetext=True).collect()
    assert len(got) == 40 and all([x.split()[2] for x in r.value.splitlines()] == ["0", "1", "2"] for r in got)
    names = [p.name for p in (tmp_path / "x").rglob("part-*")]
    assert len({n.split("-")[1] for n in names}) > 4  # the session has 4 shuffle partitions


def test_entry_and_catalog(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) <= set(q)
    assert set(o) <= set(q)
