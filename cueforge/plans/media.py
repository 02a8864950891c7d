"""Media plans as strings: every plan is a projection over cut lists, probes and the preset tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import fixed, graph_path

# Presets, chains, targets and argument templates that plans must spell exactly.
CAPTIONS = [
    ("natural-sentence", 10, False, 90, 30, "FontName=Arial,FontSize=13,PrimaryColour=&H00FFFFFF,OutlineColour=&H00000000,BorderStyle=1,Outline=1.6,Shadow=0.6,Alignment=2"),
    ("bold-overlay", 3, True, 90, 34, "FontName=Arial,FontSize=18,PrimaryColour=&H00FFFFFF,OutlineColour=&H00000000,BorderStyle=1,Outline=2.5,Shadow=0,Bold=1,Alignment=2"),
    ("minimal-clean", 8, False, 85, 28, "FontName=Arial,FontSize=11,PrimaryColour=&H00E6E6E6,OutlineColour=&H00000000,BorderStyle=3,BackColour=&H80000000,Outline=0,Shadow=0,Alignment=2"),
    ("karaoke-word", 2, True, 90, 34, "FontName=Arial,FontSize=18,PrimaryColour=&H0000D7FF,OutlineColour=&H00000000,BorderStyle=1,Outline=2.5,Shadow=0,Bold=1,Alignment=2"),
]
TARGETS = [("vertical-reel", 1080, 1920), ("vertical-story", 1080, 1920), ("horizontal-youtube", 1920, 1080), ("square-feed", 1080, 1080)]
VERTICAL = ("vertical-reel", "vertical-story")
GRADES = [
    ("subtle", "eq=contrast=1.03:saturation=0.98"),
    ("neutral_punch", "eq=contrast=1.06:brightness=0.0:saturation=1.0,curves=master='0/0 0.25/0.23 0.75/0.77 1/1'"),
    ("warm_cinematic", "eq=contrast=1.12:brightness=-0.02:saturation=0.88,colorbalance=rs=0.02:gs=0.0:bs=-0.03:rm=0.04:gm=0.01:bm=-0.02:rh=0.08:gh=0.02:bh=-0.05,curves=master='0/0 0.25/0.22 0.75/0.78 1/1'"),
    ("none", ""),
]
HDR = ("smpte2084", "arib-std-b67")
TONEMAP = "zscale=t=linear:npl=100,format=gbrpf32le,zscale=p=bt709,tonemap=tonemap=hable:desat=0,zscale=t=bt709:m=bt709:r=tv,format=yuv420p"
LOUDNORM = "loudnorm=I=-14.0:TP=-1.0:LRA=11.0"
MEASURE = f"{LOUDNORM}:print_format=json"
AUTO = "__AUTO__"
DESCRIPTIONS = [
    ("natural-sentence", "Frase completa, legivel, discreta. Padrao seguro para qualquer conteudo — tutoriais, palestras, videos institucionais."),
    ("bold-overlay", "Legenda grande, poucas palavras por vez, alto contraste. Padrao do formato short-form de alta retencao (Reels/TikTok/Shorts)."),
    ("minimal-clean", "Discreta, caixa semitransparente em vez de contorno grosso. Para conteudo visual denso onde a legenda nao pode competir por atencao."),
    ("karaoke-word", "Chunks curtissimos em ambar — aproxima o efeito 'karaoke' usando SRT comum. Karaoke real palavra a palavra exige tags \\k em .ass, que build_master_srt ainda nao gera; este preset e a aproximacao compativel."),
]
LISTING_HEAD = "estilos de legenda disponiveis (MarginV relativo a PlayResY=288):"
LISTING_NAME = "  %s  (max %d palavras/tela, %s)"
LISTING_MARGINS = "    rodape: %s%% da altura no vertical, %s%% no horizontal"
CASES = ("MAIUSCULA", "caixa natural")
QUALITIES = {"draft": (1280, "ultrafast", "28", "clips_draft"), "preview": (1920, "medium", "22", "clips_preview"), "final": (1920, "fast", "20", "clips_graded")}
FIT_SCALE, FIT_CROP = ":force_original_aspect_ratio=increase,crop=", ":force_original_aspect_ratio=decrease[fgscaled];[bgblur][fgscaled]overlay=(W-w)/2:(H-h)/2"
BLUR_HEAD, BLUR_MID = "split=2[bg][fg];[bg]", ",gblur=sigma=30[bgblur];[fg]scale="
FADE_HEAD, FADE_TAIL = "afade=t=in:st=0:d=0.03,afade=t=out:st=", ":d=0.03"
SEGMENT_SOUND = "-c:a aac -b:a 192k -ar 48000 -movflags +faststart"
DUCK = "sidechaincompress=threshold=0.05:ratio=%s:attack=5:release=300[ducked];[1:a][ducked]amix=inputs=2:duration=first:dropout_transition=0[aout]"
QUIET = "ffmpeg -y -hide_banner -nostats -i"
GRADE_VIDEO = "-c:v libx264 -preset fast -crf 18 -pix_fmt yuv420p -c:a copy -movflags +faststart"
PLAY_RES_Y = 288
DEFAULT_STYLE = "FontName=Helvetica,FontSize=18,Bold=1,PrimaryColour=&H00FFFFFF,OutlineColour=&H00000000,BackColour=&H00000000,BorderStyle=1,Outline=2,Shadow=0,Alignment=2,MarginV=90"


def _registry(spark: SparkSession, rows: list[tuple], schema: str, extra: DataFrame | None) -> DataFrame:
    """The rows as a table, with those of extra (the same columns) added; a name of extra replaces ours."""
    own = spark.createDataFrame(rows, schema)
    return own if extra is None else own.join(F.broadcast(extra.select("name")), "name", "left_anti").unionByName(extra)


def caption_presets(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    return _registry(spark, CAPTIONS, "name string, max_words int, uppercase boolean, margin_vertical int, margin_horizontal int, style string", extra)


def format_targets(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    return _registry(spark, TARGETS, "name string, width int, height int", extra)


def grade_presets(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    return _registry(spark, GRADES, "name string, filter string", extra)


def strict(found: Column, what: str, name: Column, available: Column | None = None) -> Column:
    """found, or an error that names what is unknown, and what there is."""
    there = F.concat(F.lit(". Available: "), available) if available is not None else F.lit("")
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(name, F.lit("null")), there))).otherwise(found)


def looked_up(rows: DataFrame, key: str, registry: DataFrame, value: str, what: str) -> DataFrame:
    """rows with the registry's value of the name in key. An unknown name is an error when read; it tells the sorted names there are."""
    r = registry.select(F.col("name").alias(key), F.col(value).alias("_v"))
    names = registry.agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))
    return rows.join(F.broadcast(r), key, "left").withColumn("_names", names.scalar()).withColumn(value, strict(F.col("_v"), what, F.col(key), F.col("_names"))).drop("_v", "_names")


def unknown_names(rows: DataFrame, key: str, registry: DataFrame, what: str) -> DataFrame:
    """(key, message) of the names that the registry lacks: what looked_up() would fail with."""
    names = registry.agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))
    gone = rows.select(key).distinct().join(F.broadcast(registry.select(F.col("name").alias(key))), key, "left_anti")
    return gone.select(key, F.concat(F.lit(f"unknown {what} "), F.col(key), F.lit(". Available: "), names.scalar()).alias("message"))


def force_style(presets: DataFrame, target: Column, *keep: str) -> DataFrame:
    """(name, columns to keep, force_style): vertical targets take the high margin, everything else, null too, the low one."""
    margin = F.when(F.coalesce(target.isin(*VERTICAL), F.lit(False)), F.col("margin_vertical")).otherwise(F.col("margin_horizontal"))
    return presets.select("name", *keep, F.concat(F.col("style"), F.lit(",MarginV="), margin.cast("string")).alias("force_style"))


def preset_lines(presets: DataFrame) -> DataFrame:
    """The listing as lines (name, line, text) of each preset (with description): name, margins, description, blank. The head is LISTING_HEAD and a blank."""
    share = lambda c: fixed(F.col(c) / PLAY_RES_Y * 100, 0)
    case = F.when(F.col("uppercase"), CASES[0]).otherwise(CASES[1])
    lines = F.array(F.format_string(LISTING_NAME, "name", "max_words", case), F.format_string(LISTING_MARGINS, share("margin_vertical"), share("margin_horizontal")), F.concat(F.lit("    "), F.col("description")), F.lit(""))
    return presets.select("name", F.posexplode(lines).alias("line", "text"))


def described(presets: DataFrame) -> DataFrame:
    spark = presets.sparkSession
    return presets.join(F.broadcast(spark.createDataFrame(DESCRIPTIONS, "name string, description string")), "name", "left").fillna("", ["description"])


def reframe(width: Column, height: Column, strategy: Column) -> Column:
    """The filter that brings a picture to width x height; an unknown strategy is an error."""
    w, h = width.cast("string"), height.cast("string")
    cover = F.concat(F.lit("scale="), w, F.lit(":"), h, F.lit(FIT_SCALE), w, F.lit(":"), h)
    blur = F.concat(F.lit(BLUR_HEAD), cover, F.lit(BLUR_MID), w, F.lit(":"), h, F.lit(FIT_CROP))
    return F.when(strategy == "crop", cover).when(strategy == "blur-pad", blur).otherwise(F.raise_error(F.concat(F.lit("unknown strategy "), F.coalesce(strategy, F.lit("null")))))


def resolve_grades(fields: DataFrame, presets: DataFrame) -> DataFrame:
    """fields (id, grade) with filter: empty is none, auto a mark, a preset's filter, anything else as it stands."""
    g = F.col("grade")
    f = fields.join(F.broadcast(presets.select(F.col("name").alias("_n"), F.col("filter").alias("_f"))), (g == F.col("_n")) & g.rlike(r"^[a-zA-Z0-9_\-]+$"), "left")
    return f.withColumn("filter", F.when(F.coalesce(g, F.lit("")) == "", F.lit("")).when(g == "auto", F.lit(AUTO)).otherwise(F.coalesce("_f", "grade"))).drop("_n", "_f")


def resolve_auto(segments: DataFrame, graded: DataFrame) -> DataFrame:
    """segments (edl, rid, filter ...) with the auto mark replaced by what was found for that segment (edl, rid, filter); one without findings gets none."""
    g = graded.select("edl", "rid", F.col("filter").alias("_own"))
    s = segments.join(g, ["edl", "rid"], "left")
    return s.withColumn("filter", F.when(F.col("filter") == AUTO, F.coalesce("_own", F.lit(""))).otherwise(F.col("filter"))).drop("_own")


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(*HDR), F.lit(False))


def is_portrait(width: Column, height: Column, rotation: Column) -> Column:
    """Higher than wide as shown; quarter turns swap the sides, rotations are rounded half to even."""
    turned = F.pmod(F.rint(F.coalesce(rotation, F.lit(0.0))).cast("int"), F.lit(360)).isin(90, 270)
    return F.coalesce(F.when(turned, width > height).otherwise(height > width), F.lit(False))


def _gcd(a: Column, b: Column, digits: Column) -> Column:
    """Euclid's steps as a fold: at most five for each digit of the smaller number."""
    zero = F.struct(a.cast("decimal(38,0)").alias("a"), b.cast("decimal(38,0)").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("decimal(38,0)").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), (5 * digits + 2).cast("int")), zero, step)["a"]


def canonical_rate(text: Column) -> Column:
    """A frame rate as a reduced fraction n/d; null unless it is a positive number or fraction that fits 32 bits."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    whole = t.rlike(r"^[0-9]+(\.[0-9]+)?$|^[0-9]+/[0-9]+$") & (F.length(t) <= 32)
    scale = F.length(F.regexp_extract(t, r"\.([0-9]+)$", 1))
    big = lambda s: s.try_cast("decimal(38,0)")
    num = F.when(F.contains(t, F.lit("/")), big(F.substring_index(t, "/", 1))).otherwise(big(F.replace(t, F.lit("."), F.lit(""))))
    den = F.when(F.contains(t, F.lit("/")), big(F.substring_index(t, "/", -1))).otherwise(big(F.rpad(F.lit("1"), (scale + 1).cast("int"), F.lit("0"))))
    digits = F.coalesce(F.least(F.length(num.cast("string")), F.length(den.cast("string"))), F.lit(0))
    none = F.lit(0).cast("decimal(38,0)")
    part = lambda x, g: (x / F.nullif(g, none)).cast("decimal(38,0)")
    # one-element arrays bind the divisor and the reduced parts, so that each is computed once
    reduced = F.transform(F.array(_gcd(num, den, digits)), lambda g: F.struct(part(num, g).alias("n"), part(den, g).alias("d")))
    shown = F.transform(reduced, lambda r: F.when((r["n"] > 0) & (r["d"] > 0) & (r["n"] <= 2147483647) & (r["d"] <= 2147483647), F.concat(r["n"].cast("string"), F.lit("/"), r["d"].cast("string"))))
    return F.when(whole & (num > 0) & (den > 0), F.element_at(shown, 1))


def probed_rate(avg: Column, nominal: Column) -> Column:
    """The average rate if it is one, else the nominal."""
    return F.coalesce(canonical_rate(F.when(avg != "0/0", avg)), canonical_rate(F.when(nominal != "0/0", nominal)))


def resolve_rates(ranges: DataFrame, probes: DataFrame, forced: str | None = None) -> DataFrame:
    """(edl, rate): one rate for all of a list's segments. The forced one, else that of its first range's source, else 24."""
    first = ranges.groupBy("edl").agg(F.min_by("source", "rid").alias("source"))
    p = probes.select(F.col("clip").alias("source"), probed_rate(F.col("avg_rate"), F.col("nominal_rate")).alias("rate"))
    return first.join(p, "source", "left").select("edl", F.coalesce(canonical_rate(F.lit(forced)) if forced else F.lit(None).cast("string"), "rate", F.lit("24")).alias("rate"))


def segment_plan(segments: DataFrame, quality: str = "final") -> DataFrame:
    """Arguments per segment (edl, rid, source, path, start, end in seconds, portrait, hdr, grade, rate)."""
    side, preset, crf, folder = QUALITIES[quality]
    scale = F.when(F.col("portrait"), f"scale=-2:{side}").otherwise(f"scale={side}:-2")
    vf = F.concat_ws(",", F.when(F.col("hdr"), F.lit(TONEMAP)), scale, F.when(F.col("grade") != "", F.col("grade")))
    length = F.col("end") - F.col("start")
    af = F.concat(F.lit(FADE_HEAD), fixed(F.greatest(F.lit(0.0), length - 0.03), 3), F.lit(FADE_TAIL))
    out = F.concat(F.lit(f"{folder}/seg_"), F.format_string("%02d", F.col("rid")), F.lit("_"), F.col("source").cast("string"), F.lit(".mp4"))
    args = F.concat_ws(" ", F.lit("ffmpeg -y -ss"), fixed(F.col("start"), 3), F.lit("-i"), F.col("path"), F.lit("-t"), fixed(length, 3), F.lit("-vf"), vf, F.lit("-af"), af, F.lit(f"-c:v libx264 -preset {preset} -crf {crf} -pix_fmt yuv420p -r"), F.col("rate"), F.lit(SEGMENT_SOUND), out)
    return segments.select("edl", "rid", out.alias("out"), args.alias("args"))


def concat_args(list_path: Column, out: Column) -> Column:
    return F.concat_ws(" ", F.lit("ffmpeg -y -f concat -safe 0 -i"), list_path, F.lit("-c copy -movflags +faststart"), out)


def _float_text(x: Column) -> Column:
    """A float as its shortest decimal, at least one place."""
    return x.cast("double").cast("string")


def composite_graph(overlays: DataFrame, lists: DataFrame, style: str = DEFAULT_STYLE) -> DataFrame:
    """(edl, graph, out_label) per list of lists (edl, reframe, subtitles), either may be null: reframe first, overlays in order, subtitles last.

    overlays has (edl, idx, start, duration) in seconds. Lists with nothing to do have a null graph: a copy will do.
    """
    n = F.row_number().over(Window.partitionBy("edl").orderBy("idx"))
    o = overlays.withColumn("n", n).groupBy("edl").agg(F.array_sort(F.collect_list(F.struct("n", F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration")))).alias("os"))
    c = lists.join(o, "edl", "left").withColumn("os", F.coalesce("os", F.array().cast("array<struct<n:int,start:double,duration:double>>")))
    framed, titled = F.coalesce(F.col("reframe") != "", F.lit(False)), F.col("subtitles").isNotNull()
    base = F.when(framed, "[reframed]").otherwise("[0:v]")
    some = F.size("os") > 0
    num = lambda x: x["n"].cast("string")
    shift = F.transform("os", lambda x: F.concat(F.lit("["), num(x), F.lit(":v]setpts=PTS-STARTPTS+"), _float_text(x["start"]), F.lit("/TB[a"), num(x), F.lit("]")))
    chain = F.transform("os", lambda x: F.concat(F.when(x["n"] == 1, base).otherwise(F.concat(F.lit("[v"), (x["n"] - 1).cast("string"), F.lit("]"))), F.lit("[a"), num(x), F.lit("]overlay=enable='between(t,"), fixed(x["start"], 3), F.lit(","), fixed(x["start"] + x["duration"], 3), F.lit(")'[v"), num(x), F.lit("]")))
    last = F.when(some, F.concat(F.lit("[v"), F.size("os").cast("string"), F.lit("]"))).otherwise(base)
    end = F.when(titled, F.concat(last, F.lit("subtitles='"), graph_path(F.col("subtitles")), F.lit("':force_style='"), F.lit(style), F.lit("'[outv]"))).when(some | framed, F.concat(last, F.lit("null[outv]")))
    parts = F.array_compact(F.concat(F.array(F.when(framed, F.concat(F.lit("[0:v]"), F.col("reframe"), F.lit("[reframed]")))), shift, chain, F.array(end)))
    return c.select("edl", F.when(F.size(parts) > 0, F.array_join(parts, ";")).alias("graph"), F.when(end.isNotNull(), "[outv]").otherwise("[0:v]").alias("out_label"))


def loudnorm_filter(measured: Column) -> Column:
    """The second pass with a measurement's values; without one, the single pass."""
    m = lambda k: F.element_at(measured, F.lit(k))
    two = F.concat(F.lit(f"{LOUDNORM}:measured_I="), m("input_i"), F.lit(":measured_TP="), m("input_tp"), F.lit(":measured_LRA="), m("input_lra"), F.lit(":measured_thresh="), m("input_thresh"), F.lit(":offset="), m("target_offset"), F.lit(":linear=true"))
    return F.coalesce(two, F.lit(LOUDNORM))


def measure_args(path: Column) -> Column:
    """The measuring pass: its JSON comes on the error stream."""
    return F.concat_ws(" ", F.lit(QUIET), path, F.lit(f"-af {MEASURE} -vn -f null -"))


def loudnorm_args(path: Column, measured: Column, out: Column) -> Column:
    """The normalising pass, by a measurement or, without one, in a single pass."""
    return F.concat_ws(" ", F.lit(QUIET), path, F.lit("-c:v copy -af"), loudnorm_filter(measured), F.lit(SEGMENT_SOUND), out)


def soundtrack_args(video: Column, music: Column, duration: Column, out: Column, music_db: float = -20.0, ratio: float = 6.0, fade: float = 1.5) -> Column:
    """Looped music under a video's own sound, as long as the video."""
    graph = soundtrack_graph(duration, music_db, ratio, fade)
    return F.concat_ws(" ", F.lit("ffmpeg -y -i"), video, F.lit("-i"), video, F.lit("-stream_loop -1 -i"), music, F.lit("-filter_complex"), graph, F.lit("-map 0:v:0 -map [aout] -c:v copy -c:a aac -shortest"), out)


def argv_head(args: Column, most: int = 6) -> Column:
    """What a log shows of arguments: the first so many, and a mark if there are more."""
    words = F.split(args, " ")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, F.lit(" \u2026")).otherwise(F.lit("")))


def text_head(text: Column, most: int = 120) -> Column:
    """What a log shows of a text: its beginning, and dots if there is more."""
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, F.lit("...")).otherwise(F.lit("")))


def soundtrack_graph(duration: Column, music_db: float = -20.0, ratio: float = 6.0, fade: float = 1.5) -> Column:
    at = fixed(F.greatest(duration - fade, F.lit(0.0)), 2)
    return F.concat(F.lit(f"[2:a]volume={music_db}dB,afade=t=out:st="), at, F.lit(f":d={fade}[music_low];[music_low][1:a]" + DUCK % ratio))


def narration_args(video: Column, voice: Column, bed: Column, out: Column, duck_db: float = -18.0) -> Column:
    """The voice in place of a video's sound, or over a ducked bed if there is one."""
    graph = f"[2:a]volume={duck_db}dB[music_low];[music_low][1:a]" + DUCK % 8
    head = F.concat_ws(" ", F.lit("ffmpeg -y -i"), video, F.lit("-i"), voice)
    plain = F.concat_ws(" ", head, F.lit("-map 0:v:0 -map 1:a:0 -c:v copy -c:a aac -shortest"), out)
    return F.when(bed.isNull(), plain).otherwise(F.concat_ws(" ", head, F.lit("-i"), bed, F.lit(f"-filter_complex {graph} -map 0:v:0 -map [aout] -c:v copy -c:a aac -shortest"), out))


def grade_args(path: Column, grade: Column, out: Column) -> Column:
    head = F.concat_ws(" ", F.lit("ffmpeg -y -i"), path)
    return F.when(grade == "", F.concat_ws(" ", head, F.lit("-c copy"), out)).otherwise(F.concat_ws(" ", head, F.lit("-vf"), grade, F.lit(GRADE_VIDEO), out))


def graph_order_ok(graph: Column) -> Column:
    """Reframing comes first and subtitles last, where a graph has them."""
    first = ~F.contains(graph, F.lit("[reframed]")) | graph.rlike(r"^\[0:v\]")
    return first & (~F.contains(graph, F.lit("subtitles=")) | graph.rlike(r"subtitles=[^;]*(;[^\[])?.*\[outv\]$"))
