"""Registered queries of the engine and the SQL that says the same. Times are whole milliseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import signal, speech, timeline
from .plans import media
from .sources import adapters, sinks, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PHRASE_GAP, SILENCE_GAP = 500, 400

# --- SQL pieces

_TOK = r"""w AS (SELECT conv_id AS source, turn, role, generate_subscripts(a, 1) AS i, unnest(a) AS text FROM (SELECT *, regexp_split_to_array(text, '[ \n]+') AS a FROM conversations)),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, i)::INTEGER AS pos FROM w WHERE text <> ''),
g AS (SELECT *, 60 * length(text) + 40 AS dur, CASE WHEN (pos::BIGINT * 7919 + source * 104729) % 11 = 0 THEN 700 WHEN (pos * 31 + source) % 5 = 0 THEN 500 ELSE 80 END AS gap FROM n),
plain AS (SELECT source, pos, 'word' AS type, text, (sum(dur + gap) OVER k - dur)::BIGINT AS "start", (sum(dur + gap) OVER k)::BIGINT AS "end", role AS speaker FROM g WINDOW k AS (PARTITION BY source ORDER BY pos)),
sparse AS (SELECT source, pos, CASE WHEN pos % 13 = 0 THEN 'audio_event' ELSE 'word' END AS type, text, "start", "end", CASE WHEN pos % 7 <> 0 THEN speaker END AS speaker FROM plain)"""
_SPACED = """lagged AS (SELECT *, lag("end") OVER (PARTITION BY source ORDER BY pos) AS pe FROM plain),
both_rows AS (SELECT source, pos AS op, 0 AS o, 'spacing' AS type, NULL::VARCHAR AS text, pe AS "start", "start" AS "end", NULL::VARCHAR AS speaker FROM lagged WHERE "start" > pe
  UNION ALL SELECT source, pos, 1, type, text, "start", "end", speaker FROM plain),
spaced AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY op, o)::INTEGER AS pos, type, text, "start", "end", speaker FROM both_rows)"""
_RANGES = """mx AS (SELECT source, max("end") AS mx FROM plain GROUP BY source),
ranges AS (SELECT source AS edl, rid::INTEGER AS rid, source, (3 * rid * mx) // 10 AS "start", ((3 * rid + 2) * mx) // 10 AS "end" FROM mx, range(0, 3) r(rid))"""
_VIEWS = """views AS (SELECT source, max("end") // 4 AS lo, 3 * max("end") // 4 AS hi FROM plain GROUP BY source),
seen AS (SELECT p.*, lo, hi FROM plain p JOIN views USING (source) WHERE "end" > lo AND "start" < hi)"""
_OFFSETS = """rebased AS (SELECT *, coalesce(sum("end" - "start") OVER (PARTITION BY edl ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ranges)"""
_RANGED = """ranged AS (SELECT r.*, p.pos, p.text, p."start" AS ws, p."end" AS we FROM rebased r JOIN plain p ON p.source = r.source AND p."end" > r."start" AND p."start" < r."end")"""


def _phrases_sql(tokens: str, gap: int = PHRASE_GAP) -> str:
    return rf"""t1 AS (SELECT *, sum(CASE WHEN type = 'spacing' AND "end" - "start" >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS sp FROM {tokens}),
t2 AS (SELECT *, coalesce("end", "start") AS e FROM t1 WHERE coalesce(type, 'word') <> 'spacing' AND "start" IS NOT NULL),
t3 AS (SELECT *, CASE WHEN "start" - lag(e) OVER q >= {gap} OR sp <> lag(sp) OVER q THEN 1 ELSE 0 END AS b FROM t2 WINDOW q AS (PARTITION BY source ORDER BY pos)),
t4 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY pos) AS isl FROM t3),
t5 AS (SELECT *, first_value(speaker) OVER (PARTITION BY source, isl ORDER BY pos) AS ld, last_value(speaker IGNORE NULLS) OVER (PARTITION BY source, isl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM t4),
t6 AS (SELECT *, sum(CASE WHEN ld IS NOT NULL AND speaker IS NOT NULL AND pv IS NOT NULL AND speaker <> pv THEN 1 ELSE 0 END) OVER (PARTITION BY source, isl ORDER BY pos) AS part,
  CASE WHEN type = 'audio_event' AND text NOT LIKE '(%' THEN '(' || trim(text) || ')' ELSE trim(text) END AS said FROM t5),
p AS (SELECT source, isl, part, min(pos) AS fp, arg_min("start", pos) AS "start", arg_max(e, pos) AS "end", replace(replace(replace(replace(string_agg(said, ' ' ORDER BY pos), ' ,', ','), ' .', '.'), ' ?', '?'), ' !', '!') AS text, first(speaker ORDER BY pos) AS speaker FROM t6 GROUP BY source, isl, part),
phr AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY fp)::INTEGER AS phrase, "start", "end", text, speaker FROM p WHERE text <> '')"""


def _sql(select: str, *parts: str) -> str:
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- speech

_PHR = 'SELECT source, phrase, "start", "end", text, speaker FROM phr'


@query("phrases", _sql(_PHR, _TOK, _phrases_sql("plain")))
def phrases(spark, d):
    return speech.phrases(adapters.tokens(spark, d), PHRASE_GAP)


@query("phrases_speaker_null", _sql(_PHR, _TOK, _phrases_sql("sparse")))
def phrases_speaker_null(spark, d):
    return speech.phrases(adapters.tokens(spark, d, "sparse"), PHRASE_GAP)


@query("phrases_spacing", _sql(_PHR, _TOK, _SPACED, _phrases_sql("spaced", 80)))
def phrases_spacing(spark, d):
    return speech.phrases(speech.with_spacing(adapters.tokens(spark, d)), 80)


@query("take_summary", _sql("""SELECT source, count(*)::BIGINT AS n_phrases, (arg_max("end", phrase) - arg_min("start", phrase))::BIGINT AS duration, CASE WHEN (arg_max("end", phrase) - arg_min("start", phrase)) / 1000 < 60 THEN printf('%.1fs', (arg_max("end", phrase) - arg_min("start", phrase)) / 1000.0::DOUBLE)
ELSE printf('%dm %04.1fs', ((arg_max("end", phrase) - arg_min("start", phrase)) // 60000)::INTEGER, (arg_max("end", phrase) - arg_min("start", phrase)) / 1000.0::DOUBLE - 60 * ((arg_max("end", phrase) - arg_min("start", phrase)) // 60000)) END AS shown FROM phr GROUP BY source""", _TOK, _phrases_sql("plain")))
def take_summary(spark, d):
    return speech.takes(speech.phrases(adapters.tokens(spark, d), PHRASE_GAP, silent=True)).withColumn("shown", formats.format_duration(F.col("duration") / 1000))


@query("pack_totals", _sql("""SELECT count(*)::BIGINT AS n_sources, sum(n)::BIGINT AS n_phrases, sum(d)::BIGINT AS duration FROM (SELECT count(*) AS n, arg_max("end", phrase) - arg_min("start", phrase) AS d FROM phr GROUP BY source)""", _TOK, _phrases_sql("plain")))
def pack_totals(spark, d):
    return sinks.summary(speech.phrases(adapters.tokens(spark, d), PHRASE_GAP))


@query("packed_lines", _sql("""SELECT source, phrase AS line, printf('  [%06.2f-%06.2f]', "start" / 1000.0::DOUBLE, "end" / 1000.0::DOUBLE) || coalesce(' S' || regexp_replace(speaker, '^speaker_', ''), '') || ' ' || text AS text FROM phr
UNION ALL SELECT source, 0, '## ' || source || '  (duration: ' || CASE WHEN d < 60000 THEN printf('%.1fs', d / 1000.0::DOUBLE) ELSE printf('%dm %04.1fs', (d // 60000)::INTEGER, d / 1000.0::DOUBLE - 60 * (d // 60000)) END || ', ' || n || ' phrases)' FROM s
UNION ALL SELECT source, (n + 1)::INTEGER, '' FROM s""", _TOK, _phrases_sql("sparse"), """s AS (SELECT source, count(*) AS n, arg_max("end", phrase) - arg_min("start", phrase) AS d FROM phr GROUP BY source)"""))
def packed_lines(spark, d):
    return speech.packed_lines(speech.phrases(adapters.tokens(spark, d, "sparse"), PHRASE_GAP, silent=True))


@query("spacing_synthesis", _sql('SELECT source, pos, type, text, "start", "end", speaker FROM spaced', _TOK, _SPACED))
def spacing_synthesis(spark, d):
    return speech.with_spacing(adapters.tokens(spark, d))


_SIL = """h AS (SELECT source, pos, greatest(lo, "start") AS s, "end", lo FROM seen UNION ALL SELECT source, 2147483647, hi, hi, lo FROM views),
prev AS (SELECT *, greatest(lo, coalesce(max("end") OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS pe FROM h),
sil AS (SELECT source, pe AS "start", s AS "end" FROM prev WHERE s - pe >= """


@query("silences", _sql('SELECT * FROM sil', _TOK, _VIEWS, _SIL + f"{SILENCE_GAP})"))
def silences(spark, d):
    t = adapters.tokens(spark, d)
    return speech.silences(t, adapters.views(t), SILENCE_GAP)


@query("silence_classes", _sql("""SELECT CASE WHEN "end" - "start" >= 400 THEN 'clean' WHEN "end" - "start" >= 150 THEN 'usable' ELSE 'unsafe' END AS class, count(*)::BIGINT AS n, sum("end" - "start")::BIGINT AS total FROM sil GROUP BY 1""", _TOK, _VIEWS, _SIL + "1)"))
def silence_classes(spark, d):
    t = adapters.tokens(spark, d)
    s = speech.silences(t, adapters.views(t), 1, only_heard=True)
    length = F.col("end") - F.col("start")
    return s.groupBy(speech.silence_class(length).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total"))


@query("view_words", _sql('SELECT source, pos, type, text, "start", "end" FROM seen', _TOK, _VIEWS))
def view_words(spark, d):
    t = adapters.tokens(spark, d)
    return speech.in_view(t, adapters.views(t)).select("source", "pos", "type", "text", "start", "end")


@query("label_declutter", "WITH RECURSIVE " + ",\n".join([_TOK, _VIEWS, """lab AS (SELECT source, pos, (trunc(50 + ("start" - lo) / greatest((hi - lo)::DOUBLE, 1e-6) * 1400)::BIGINT + trunc(50 + ("end" - lo) / greatest((hi - lo)::DOUBLE, 1e-6) * 1400)::BIGINT) AS x2, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM seen WHERE "end" - "start" >= 50),
px AS (SELECT source, pos, k, floor(x2 / 2)::INTEGER AS x FROM lab),
step AS (SELECT source, pos, k, x, true AS kept, x AS last FROM px WHERE k = 1 UNION ALL SELECT p.source, p.pos, p.k, p.x, p.x - s.last >= 28, CASE WHEN p.x - s.last >= 28 THEN p.x ELSE s.last END FROM step s JOIN px p ON p.source = s.source AND p.k = s.k + 1)"""]) + "\nSELECT source, pos, x FROM step WHERE kept")
def label_declutter(spark, d):
    t = adapters.tokens(spark, d)
    return speech.labels(t, adapters.views(t))


@query("ruler_ticks", _sql("SELECT source, i::INTEGER AS i, (50 + trunc(i / 6 * 1400))::INTEGER AS x, lo + i / 6 * (hi - lo) AS t FROM views, range(0, 7) r(i)", _TOK, _VIEWS))
def ruler_ticks(spark, d):
    return speech.ruler(adapters.views(adapters.tokens(spark, d)))


@query("frame_times", _sql("SELECT source, i::INTEGER AS i, lo::DOUBLE + i * ((hi::DOUBLE - lo) / 9) AS t FROM views, range(0, 10) r(i)", _TOK, _VIEWS))
def frame_times(spark, d):
    return speech.frame_times(adapters.views(adapters.tokens(spark, d)), 10)


@query("strip_layout", """WITH f AS (SELECT p_partkey // 12 AS source, p_partkey AS i, trunc(180 * (p_size * 10 / 100.0::DOUBLE))::INTEGER AS w FROM part),
t AS (SELECT *, sum(w) OVER (PARTITION BY source) + (count(*) OVER (PARTITION BY source) - 1) * 4 AS total_width FROM f),
s AS (SELECT *, CASE WHEN total_width > 1300 THEN 1300 / total_width ELSE 1.0::DOUBLE END AS sc FROM t),
q AS (SELECT *, trunc(w * sc)::INTEGER AS drawn, CASE WHEN sc < 1 THEN greatest(2, trunc(4 * sc)::INTEGER) ELSE 4 END AS st FROM s)
SELECT source, i, drawn, total_width::BIGINT AS total_width, (50 + coalesce(sum(drawn + st) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x FROM q""")
def strip_layout(spark, d):
    p = adapters.table(spark, d, "part")
    return speech.strip_layout(p.select(F.floor(F.col("p_partkey") / 12).alias("source"), F.col("p_partkey").alias("i"), (F.col("p_size") * 10).alias("width"), F.lit(100.0).alias("height")))


# --- timeline


def _cut(spark, d):
    t = adapters.tokens(spark, d)
    return t, adapters.ranges(t)


@query("segment_offsets", _sql('SELECT edl, rid, source, "start", "end", "offset" FROM rebased', _TOK, _RANGES, _OFFSETS))
def segment_offsets(spark, d):
    return timeline.offsets(_cut(spark, d)[1])


_LARGE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query("segment_offsets_large", f"""SELECT l_orderkey AS edl, {", ".join(_LARGE)}, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LARGE)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lineitem""")
def segment_offsets_large(spark, d):
    r = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edl"), *_LARGE, F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"))
    return timeline.offsets(r, _LARGE).drop("start", "end")


@query("output_duration", _sql('SELECT edl, sum("end" - "start")::BIGINT AS length, count(*)::BIGINT AS n_ranges FROM ranges GROUP BY edl', _TOK, _RANGES))
def output_duration(spark, d):
    return timeline.output_length(_cut(spark, d)[1])


@query("words_in_ranges", _sql("SELECT edl, rid, pos, text, ws, we FROM ranged", _TOK, _RANGES, _OFFSETS, _RANGED))
def words_in_ranges(spark, d):
    t, r = _cut(spark, d)
    return timeline.words_in_ranges(r, t).select("edl", "rid", "pos", "text", "ws", "we")


def _chunks_sql(n: int) -> str:
    return f"""c1 AS (SELECT *, CASE WHEN strpos('.,!?;:', right(text, 1)) > 0 THEN 1 ELSE 0 END AS fin FROM ranged),
c2 AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY edl, rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c1),
c3 AS (SELECT *, (row_number() OVER (PARTITION BY edl, rid, run ORDER BY pos) - 1) // {n} AS part FROM c2),
c4 AS (SELECT edl, rid, run, part, min(pos) AS fp, arg_min(ws, pos) AS ws, arg_max(we, pos) AS we, string_agg(text, ' ' ORDER BY pos) AS text, count(*)::BIGINT AS n_words, any_value("start") AS "start", any_value("end") AS "end", any_value("offset") AS "offset" FROM c3 GROUP BY edl, rid, run, part),
chunks AS (SELECT *, row_number() OVER (PARTITION BY edl, rid ORDER BY fp)::INTEGER AS chunk FROM c4)"""


def _chunk_query(n: int) -> None:
    @query(f"caption_chunks_{n}", _sql("SELECT edl, rid, chunk, ws, we, text, n_words FROM chunks", _TOK, _RANGES, _OFFSETS, _RANGED, _chunks_sql(n)))
    def chunks(spark, d):
        t, r = _cut(spark, d)
        return timeline.caption_chunks(timeline.words_in_ranges(r, t), n).select("edl", "rid", "chunk", "ws", "we", "text", "n_words")


for _n in (2, 3, 8, 10):
    _chunk_query(_n)

_CUES = """m1 AS (SELECT *, greatest(0, greatest("start", ws) - "start") + "offset" AS os, greatest(0, least("end", we) - "start") + "offset" AS oe, upper(replace(regexp_replace(text, '[,;:]+$', ''), 'ß', 'SS')) AS said FROM chunks),
cues AS (SELECT edl, row_number() OVER (PARTITION BY edl ORDER BY os, rid, chunk)::INTEGER AS cue, os::BIGINT AS out_start, (CASE WHEN oe <= os THEN os + 400 ELSE oe END)::BIGINT AS out_end, said AS text FROM m1)"""
_SRT = ", ".join(f"lpad(({c} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({c} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({c} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({c} % 1000)::VARCHAR, 3, '0') AS {a}" for c, a in (("out_start", "a"), ("out_end", "b")))


def _cued(spark, d):
    t, r = _cut(spark, d)
    return timeline.cues(r, t, 3, True)


@query("srt_cues", _sql(f"SELECT edl, cue, out_start, out_end, text, {_SRT} FROM cues", _TOK, _RANGES, _OFFSETS, _RANGED, _chunks_sql(3), _CUES))
def srt_cues(spark, d):
    at = lambda c: formats.srt_timestamp(F.col(c))
    return _cued(spark, d).withColumns({"out_start": F.col("out_start").cast("long"), "out_end": F.col("out_end").cast("long"), "a": at("out_start"), "b": at("out_end")})


_MANY = """many AS (SELECT source // 3 AS edl, ((source % 3) * 3 + rid)::INTEGER AS rid, source, "start", "end" FROM ranges)"""


def _many(spark, d):
    t, r = _cut(spark, d)
    return t, r.select(F.floor(F.col("source") / 3).alias("edl"), ((F.col("source") % 3) * 3 + F.col("rid")).cast("int").alias("rid"), "source", "start", "end")


@query("cues_missing_transcripts", _sql("SELECT edl, cue, out_start, out_end, text FROM cues", _TOK, _RANGES, _MANY, _OFFSETS.replace("FROM ranges", "FROM many"), _RANGED.replace("JOIN plain p", "JOIN (SELECT * FROM plain WHERE source % 3 <> 1) p"), _chunks_sql(3), _CUES))
def cues_missing_transcripts(spark, d):
    """Lists of several sources, some without a transcript: no cues there, but what follows keeps its place."""
    t, r = _many(spark, d)
    return timeline.cues(r, t.where("source % 3 <> 1"), 3, True).withColumns({c: F.col(c).cast("long") for c in ("out_start", "out_end")})


@query("range_faults", _sql("""SELECT edl, rid, CASE WHEN source % 5 = 0 THEN 'video not found: raw/' || source || '.mov' ELSE 'end must be > start' END AS reason FROM ranges WHERE source % 5 = 0 OR (source % 7 = 0 AND rid = 2) OR "end" <= "start" """, _TOK, _RANGES))
def range_faults(spark, d):
    path = F.concat(F.lit("raw/"), F.col("source").cast("string"), F.lit(".mov"))
    r = _cut(spark, d)[1].withColumn("path", path)
    swapped = (F.col("source") % 7 == 0) & (F.col("rid") == 2)
    asked = r.select("edl", "rid", "path", F.when(swapped, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(swapped, F.col("start")).otherwise(F.col("end")).alias("end"))
    return timeline.range_faults(asked, r.where("source % 5 <> 0").select("path"))


@query("srt_file", _sql(f"SELECT edl, cue, line::INTEGER AS line, CASE line WHEN 0 THEN cue::VARCHAR WHEN 1 THEN a || ' --> ' || b WHEN 2 THEN text ELSE '' END AS text FROM (SELECT *, {_SRT} FROM cues), range(0, 4) r(line)", _TOK, _RANGES, _OFFSETS, _RANGED, _chunks_sql(3), _CUES))
def srt_file(spark, d):
    return timeline.srt_lines(_cued(spark, d))


_EDGES = """edges AS (SELECT edl, rid, source, 'start' AS edge, "start" AS "at" FROM ranges UNION ALL SELECT edl, rid, source, 'end', "end" FROM ranges)"""


@query("cuts_mid_word", _sql('SELECT edl, rid, edge, "at", pos FROM edges e JOIN plain p ON p.source = e.source AND "at" > p."start" AND "at" < p."end"', _TOK, _RANGES, _EDGES))
def cuts_mid_word(spark, d):
    t, r = _cut(spark, d)
    return timeline.cuts_inside_words(r, t)


@query("cut_padding", _sql("""SELECT edl, rid, head, tail, head BETWEEN 30 AND 200 AND tail BETWEEN 30 AND 200 AS padded FROM (SELECT edl, rid, min(ws) - "start" AS head, "end" - max(we) AS tail FROM ranged GROUP BY edl, rid, "start", "end")""", _TOK, _RANGES, _OFFSETS, _RANGED))
def cut_padding(spark, d):
    t, r = _cut(spark, d)
    return timeline.cut_padding(r, t)


@query("duration_check", _sql("""SELECT edl, length, 60000::BIGINT AS budget, length > 60000 AS over FROM (SELECT edl, sum("end" - "start")::BIGINT AS length FROM ranges GROUP BY edl)""", _TOK, _RANGES))
def duration_check(spark, d):
    r = _cut(spark, d)[1]
    return timeline.over_budget(r, r.select("edl").distinct().withColumn("budget", F.lit(60000).cast("long")))


@query("pending_sources", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_sources(spark, d):
    return timeline.pending(adapters.table(spark, d, "documents").select("doc_id", "source"), adapters.table(spark, d, "labels"), "doc_id")


@query("cache_summary", "SELECT source, count(*)::BIGINT AS n, count(l.doc_id)::BIGINT AS cached, (count(*) - count(l.doc_id))::BIGINT AS pending FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def cache_summary(spark, d):
    done = adapters.table(spark, d, "labels").select("doc_id", F.lit(1).alias("c")).distinct()
    j = adapters.table(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("cached"), (F.count(F.lit(1)) - F.count("c")).alias("pending"))


_OV = "ov AS (SELECT user_id AS edl, event_id AS idx, (event_id * 7919) % 60000 AS s, floor(value * 10)::BIGINT AS dur FROM events WHERE event_type = 'purchase')"


@query("overlay_active", _sql("SELECT edl, t, count(*)::BIGINT AS n_active, max(idx) AS top FROM ov JOIN (SELECT DISTINCT edl AS e2, t * 5000 AS t FROM ov, range(0, 13) r(t)) x ON edl = e2 AND t >= s AND t <= s + dur GROUP BY edl, t", _OV))
def overlay_active(spark, d):
    o = adapters.overlays(spark, d)
    times = o.select("edl").distinct().select("edl", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60000).cast("long"), F.lit(5000).cast("long"))).alias("t"))
    return timeline.overlays_at(o, times)


@query("caption_text", r"""SELECT item_id, text, upper(replace(text, 'ß', 'SS')) AS shout FROM (SELECT item_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[,;:]+$', '') AS text FROM benchmark)""")
def caption_text(spark, d):
    return adapters.table(spark, d, "benchmark").select("item_id", formats.caption_text(F.col("text")).alias("text")).withColumn("shout", F.upper("text"))


_SHOUT = r"""t AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
c AS (SELECT origin, id, regexp_replace(trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')), '[,;:]+$', '') AS text FROM t)"""


@query("caption_shout", _sql("SELECT origin, id, text, upper(replace(text, 'ß', 'SS')) AS shout FROM c", _SHOUT))
def caption_shout(spark, d):
    """Whole cleaned texts of both tables and their upper case."""
    rows = lambda name, key: adapters.table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), formats.caption_text(F.col("text")).alias("text"))
    both = rows("documents", "doc_id").unionByName(rows("benchmark", "item_id"))
    return both.withColumn("shout", F.upper("text"))


@query("easing", "SELECT i::INTEGER AS i, round(1 - power(1 - i / 20, 3), 9) AS ease_out, round(CASE WHEN i / 20 < 0.5 THEN 4 * power(i / 20, 3) ELSE 1 - power(-2 * (i / 20) + 2, 3) / 2 END, 9) AS ease_in_out FROM range(0, 21) r(i)")
def easing(spark, d):
    t = F.col("i") / 20
    return spark.range(21).select(F.col("id").cast("int").alias("i")).select("i", F.round(timeline.ease_out_cubic(t), 9).alias("ease_out"), F.round(timeline.ease_in_out_cubic(t), 9).alias("ease_in_out"))


# --- signal

_FRAMES = """fr AS (SELECT user_id AS clip, (CASE WHEN user_id % 2 = 0 THEN 255.0 ELSE 1023.0 END)::DOUBLE AS top FROM events),
st AS (SELECT clip, (0.25::DOUBLE + 0.005::DOUBLE * (clip % 90)) * top AS y, (0.45::DOUBLE + 0.004::DOUBLE * (clip % 80)) * top AS sp, (0.10::DOUBLE + 0.004::DOUBLE * (clip % 90)) * top AS sa, top FROM fr),
cs AS (SELECT clip, avg(y) / any_value(top) AS y_mean, (avg(y + sp / 2) - avg(y - sp / 2)) / any_value(top) AS y_range, avg(sa) / any_value(top) AS sat_mean FROM st GROUP BY clip)"""


@query("clip_stats", _sql("SELECT clip, round(y_mean, 6) AS y_mean, round(y_range, 6) AS y_range, round(sat_mean, 6) AS sat_mean FROM cs", _FRAMES))
def clip_stats(spark, d):
    s = signal.clip_stats(adapters.frame_stats(spark, d))
    return s.select("clip", *[F.round(c, 6).alias(c) for c in ("y_mean", "y_range", "sat_mean")])


_GRADED = """graded AS (SELECT clip, contrast, gamma, saturation, CASE WHEN terms = '' THEN '' ELSE 'eq=' || terms END AS filter FROM (SELECT *, concat_ws(':',
  CASE WHEN abs(contrast - 1) > 0.005 THEN 'contrast=' || printf('%.3f', contrast) END, CASE WHEN abs(gamma - 1) > 0.005 THEN 'gamma=' || printf('%.3f', gamma) END, CASE WHEN abs(saturation - 1) > 0.005 THEN 'saturation=' || printf('%.3f', saturation) END) AS terms FROM (SELECT clip,
CASE WHEN y < 0.65::DOUBLE THEN 1.08::DOUBLE - 0.05::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (y - 0.50::DOUBLE) / 0.15::DOUBLE)) ELSE 1.03::DOUBLE END AS contrast,
CASE WHEN m < 0.42::DOUBLE THEN 1.10::DOUBLE - 0.08::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (m - 0.30::DOUBLE) / 0.12::DOUBLE)) WHEN m > 0.60::DOUBLE THEN 0.97::DOUBLE ELSE 1.0::DOUBLE END AS gamma,
CASE WHEN s < 0.18::DOUBLE THEN 1.04::DOUBLE WHEN s > 0.38::DOUBLE THEN 0.96::DOUBLE ELSE 0.98::DOUBLE END AS saturation FROM found)))"""


@query("auto_grade", _sql("SELECT clip, round(contrast, 6) AS contrast, round(gamma, 6) AS gamma, saturation, filter FROM graded", _FRAMES, "found AS (SELECT clip, round(y_range, 6) AS y, round(y_mean, 6) AS m, round(sat_mean, 6) AS s FROM cs)", _GRADED))
def auto_grade(spark, d):
    return signal.auto_grade(clip_stats(spark, d)).select("clip", F.round("contrast", 6).alias("contrast"), F.round("gamma", 6).alias("gamma"), "saturation", "filter")


#: Statistics lines of clips, a clip for each user and a frame for each event: depths are mixed, some values malformed, some series missing.
_LINES = """series AS (SELECT user_id AS clip, avg(CASE WHEN user_id % 9 <> 0 AND event_id % 7 <> 0 THEN (20 + event_id % 180)::DOUBLE END) AS y, avg(CASE WHEN user_id % 5 <> 0 THEN (event_id % 30)::DOUBLE END) AS lo, avg((150 + event_id % 100)::DOUBLE) AS hi,
  avg(CASE WHEN user_id % 4 <> 0 THEN (10 + event_id % 110)::DOUBLE END) AS s, pow(2, arg_max(CASE WHEN event_id % 2 = 0 THEN 8 ELSE 10 END, event_id)) - 1 AS top FROM events GROUP BY user_id),
found AS (SELECT clip, CASE WHEN y IS NULL THEN 0.72::DOUBLE ELSE coalesce((hi - lo) / top, 0.7::DOUBLE) END AS y, CASE WHEN y IS NULL THEN 0.5::DOUBLE ELSE y / top END AS m, CASE WHEN y IS NULL THEN 0.25::DOUBLE ELSE coalesce(s / top, 0.25::DOUBLE) END AS s FROM series)"""


def _line_stats(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    line = lambda key, value: F.concat(F.lit(f"lavfi.signalstats.{key}="), value.cast("string"))
    lines = F.array_compact(F.array(
        line("YBITDEPTH", F.when(e % 2 == 0, 8).otherwise(10)), F.when(u % 9 != 0, line("YAVG", F.when(e % 7 == 0, F.lit("n/a")).otherwise((20 + e % 180).cast("string")))), F.when(u % 5 != 0, line("YMIN", e % 30)),
        line("YMAX", 150 + e % 100), F.when(u % 4 != 0, line("SATAVG", 10 + e % 110)), F.lit("frame:1 pts:2"),
    ))
    rows = adapters.table(spark, d, "events").select(u.alias("clip"), e.alias("frame"), F.posexplode(lines).alias("k", "line"))
    return signal.line_stats(transcripts.frame_values(rows.select("clip", (F.col("frame") * 10 + F.col("k")).alias("line_no"), "line")))


@query("auto_grade_lines", _sql("SELECT f.clip, round(m, 9) AS y_mean, round(y, 9) AS y_range, round(s, 9) AS sat_mean, filter FROM found f JOIN graded g ON f.clip = g.clip", _LINES, _GRADED))
def auto_grade_lines(spark, d):
    """From statistics lines to the filter of each clip."""
    return signal.auto_grade(_line_stats(spark, d)).select("clip", *[F.round(c, 9).alias(c) for c in ("y_mean", "y_range", "sat_mean")], "filter")


@query("segment_grades", _sql(f"""SELECT (clip // 3)::BIGINT AS edl, (clip % 3)::BIGINT AS rid, CASE clip % 4 WHEN 0 THEN '' WHEN 1 THEN 'eq=contrast=1.03:saturation=0.98' WHEN 2 THEN 'eq=gamma=1.1' ELSE coalesce(filter, '') END AS filter FROM (SELECT DISTINCT user_id AS clip FROM events) u LEFT JOIN graded g USING (clip)""", _LINES, _GRADED))
def segment_grades(spark, d):
    """A list's grade field resolved for each of its segments: the auto mark by the segment's own frames."""
    at = [F.floor(F.col("clip") / 3).alias("edl"), (F.col("clip") % 3).alias("rid")]
    clips = adapters.table(spark, d, "events").select(F.col("user_id").alias("clip")).distinct()
    field = F.element_at(F.array(F.lit(""), F.lit("subtle"), F.lit("eq=gamma=1.1"), F.lit("auto")), (F.col("clip") % 4 + 1).cast("int"))
    segments = media.resolve_grades(clips.select(F.col("clip").alias("id"), "clip", field.alias("grade")), media.grade_presets(spark)).select(*at, "filter")
    return media.resolve_auto(segments, signal.auto_grade(_line_stats(spark, d)).select(*at, "filter"))


@query("sample_rates", "SELECT p_partkey AS clip, greatest(0.5::DOUBLE, least(10 / greatest(CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE ELSE p_size / 2.0::DOUBLE END, 0.1::DOUBLE), 10.0::DOUBLE)) AS rate FROM part")
def sample_rates(spark, d):
    length = F.when(F.col("p_partkey") % 10 == 0, 0.0).otherwise(F.col("p_size") / 2.0)
    return adapters.table(spark, d, "part").select(F.col("p_partkey").alias("clip"), signal.sample_rate(F.lit(10.0), length).alias("rate"))


@query("rms_envelope", """WITH c AS (SELECT vec_id AS clip, list_transform(embedding, lambda x: x::DOUBLE) AS pcm, greatest(1, len(embedding) // 10) AS w FROM embeddings),
e AS (SELECT clip, b, CASE WHEN b < len(pcm) // w THEN sqrt(list_sum(list_transform(pcm[b * w + 1 : b * w + w], lambda x: x * x)) / w) ELSE 0.0::DOUBLE END AS v FROM c, range(0, 10) r(b)),
m AS (SELECT *, max(v) OVER (PARTITION BY clip) AS top FROM e)
SELECT clip, b::INTEGER AS bucket, round(CASE WHEN top > 0 THEN v / top ELSE v END, 6) AS rms FROM m""")
def rms_envelope(spark, d):
    return signal.envelope(adapters.pcm(spark, d), 10).withColumn("rms", F.round("rms", 6))


_PEAK = """sm AS (SELECT vec_id AS clip, round(x::DOUBLE * 20000)::BIGINT AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)),
pk AS (SELECT clip, greatest(max(s), -min(s))::INTEGER AS peak FROM sm GROUP BY clip)"""


def _peaks(spark, d):
    s = adapters.pcm(spark, d).select("clip", F.explode("pcm").alias("x")).select("clip", F.round(F.col("x") * 20000).cast("int").alias("sample"))
    return signal.peak_dbfs(s)


@query("peak_dbfs", _sql("SELECT clip, peak, round(20 * log10(peak / 32768.0::DOUBLE), 6) AS dbfs FROM pk", _PEAK))
def peak_dbfs(spark, d):
    return _peaks(spark, d).withColumn("dbfs", F.round("dbfs", 6))


@query("silent_tracks", _sql("""SELECT clip, track, coalesce((SELECT string_agg(t.track::VARCHAR, ',' ORDER BY t.track::VARCHAR) FROM tr t WHERE t.clip = tr.clip AND t.quiet = false), '') AS others FROM tr WHERE quiet""", _PEAK, "tr AS (SELECT clip // 4 AS clip, clip % 4 AS track, 20 * log10(peak / 32768.0::DOUBLE) < -15 AS quiet FROM pk)"))
def silent_tracks(spark, d):
    p = _peaks(spark, d).select(F.floor(F.col("clip") / 4).alias("clip"), (F.col("clip") % 4).cast("string").alias("track"), "dbfs")
    return signal.silent_tracks(p, -15.0).withColumn("track", F.col("track").cast("long"))


# --- plans

_PROBE = """pb AS (SELECT p_partkey AS clip, 120 AS width, 100 + p_size AS height, ((p_partkey % 4) * 90 - 180)::DOUBLE AS rotation,
  CASE WHEN p_type LIKE 'PROMO%' THEN 'smpte2084' WHEN p_type LIKE 'ECONOMY%' THEN 'arib-std-b67' ELSE 'bt709' END AS transfer,
  ['30000/1001', '0/0', '25', '60/1', '29.97', '24000/1001', 'junk'][(p_partkey % 7 + 1)::INTEGER] AS avg_rate, CASE WHEN p_partkey % 3 = 0 THEN '50/2' ELSE '0/0' END AS nominal_rate FROM part)"""
_PORTRAIT = "CASE WHEN ((round_even(rotation, 0)::INTEGER % 360) + 360) % 360 IN (90, 270) THEN width > height ELSE height > width END"
_RATE = """coalesce(CASE avg_rate WHEN '30000/1001' THEN '30000/1001' WHEN '25' THEN '25/1' WHEN '60/1' THEN '60/1' WHEN '29.97' THEN '2997/100' WHEN '24000/1001' THEN '24000/1001' END, CASE nominal_rate WHEN '50/2' THEN '25/1' END)"""


@query("portrait", _sql(f"SELECT clip, {_PORTRAIT} AS portrait FROM pb", _PROBE))
def portrait(spark, d):
    return adapters.stream_probes(spark, d).select("clip", media.is_portrait(F.col("width"), F.col("height"), F.col("rotation")).alias("portrait"))


@query("hdr", _sql("SELECT clip, transfer IN ('smpte2084', 'arib-std-b67') AS hdr FROM pb", _PROBE))
def hdr(spark, d):
    return adapters.stream_probes(spark, d).select("clip", media.is_hdr(F.col("transfer")).alias("hdr"))


@query("fps_canonical", _sql("""SELECT n, d, CASE WHEN d > 0 AND n > 0 THEN (n // gcd(n, d)) || '/' || (d // gcd(n, d)) END AS rate FROM (SELECT DISTINCT p_size * 1000 AS n, p_partkey % 60 AS d FROM part)"""))
def fps_canonical(spark, d):
    x = adapters.table(spark, d, "part").select((F.col("p_size") * 1000).alias("n"), (F.col("p_partkey") % 60).alias("d")).distinct()
    return x.select("n", "d", media.canonical_rate(F.concat_ws("/", F.col("n").cast("string"), F.col("d").cast("string"))).alias("rate"))


@query("fps_resolve", _sql(f"SELECT edl, coalesce({_RATE}, '24') AS rate FROM (SELECT l_orderkey AS edl, arg_min(l_partkey, l_linenumber * 100000000::BIGINT + l_partkey) AS source FROM lineitem GROUP BY l_orderkey) LEFT JOIN pb ON clip = source", _PROBE))
def fps_resolve(spark, d):
    r = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edl"), F.col("l_partkey").alias("source"), (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.col("l_partkey")).alias("rid"))
    return media.resolve_rates(r, adapters.stream_probes(spark, d))


@query("rate_uniform", _sql(f"SELECT edl, count(DISTINCT coalesce({_RATE}, '24'))::BIGINT AS n_rates, count(DISTINCT coalesce({_RATE}, '24')) = 1 AS uniform FROM (SELECT l_orderkey AS edl, l_partkey AS source FROM lineitem) LEFT JOIN pb ON clip = source GROUP BY edl", _PROBE))
def rate_uniform(spark, d):
    p = adapters.stream_probes(spark, d).select(F.col("clip").alias("source"), media.probed_rate(F.col("avg_rate"), F.col("nominal_rate")).alias("rate"))
    r = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edl"), F.col("l_partkey").alias("source")).join(p, "source", "left")
    n = F.count_distinct(F.coalesce("rate", F.lit("24")))
    return r.groupBy("edl").agg(n.alias("n_rates"), (n == 1).alias("uniform"))


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


_GRADE_CASE = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'auto' WHEN 2 THEN 'subtle' WHEN 3 THEN 'warm_cinematic' WHEN 4 THEN 'my_look' ELSE 'eq=gamma=1.1' END"
_GRADE_SQL = f"gr AS (SELECT id, grade, CASE WHEN grade = '' THEN '' WHEN grade = 'auto' THEN '{media.AUTO}' ELSE coalesce(v.filter, grade) END AS filter FROM (SELECT p_partkey AS id, {_GRADE_CASE} AS grade FROM part) LEFT JOIN {_values(media.GRADES, 'name, filter')} ON grade = name)"


def _grades(spark, d):
    return media.resolve_grades(adapters.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_GRADE_CASE).alias("grade")), media.grade_presets(spark))


@query("grade_resolve", _sql("SELECT id, grade, filter FROM gr", _GRADE_SQL))
def grade_resolve(spark, d):
    return _grades(spark, d)


@query("grade_apply", _sql("SELECT id, CASE WHEN filter = '' THEN 'ffmpeg -y -i in.mp4 -c copy out.mp4' ELSE 'ffmpeg -y -i in.mp4 -vf ' || filter || ' -c:v libx264 -preset fast -crf 18 -pix_fmt yuv420p -c:a copy -movflags +faststart out.mp4' END AS args FROM gr", _GRADE_SQL))
def grade_apply(spark, d):
    return _grades(spark, d).select("id", media.grade_args(F.lit("in.mp4"), F.col("filter"), F.lit("out.mp4")).alias("args"))


_CAPS = _values(media.CAPTIONS, "name, max_words, uppercase, mv, mh, style")
_GOALS = _values([(t[0],) for t in media.TARGETS] + [(None,)], "target")


@query("force_style", f"SELECT c.name, target, style || ',MarginV=' || CASE WHEN target IN ('vertical-reel', 'vertical-story') THEN mv ELSE mh END AS force_style FROM (SELECT * FROM {_CAPS}) c, (SELECT * FROM {_GOALS}) g")
def force_style(spark, d):
    names = F.array(*[F.lit(t[0]) for t in media.TARGETS], F.lit(None).cast("string"))
    return media.force_style(media.caption_presets(spark).withColumn("target", F.explode(names)), F.col("target"), "target")


_TOLD = _values(media.DESCRIPTIONS, "name, description")


@query("preset_lines", f"""SELECT c.name, line::INTEGER AS line, CASE line WHEN 0 THEN '  ' || c.name || '  (max ' || max_words || ' palavras/tela, ' || CASE WHEN uppercase THEN 'MAIUSCULA' ELSE 'caixa natural' END || ')'
WHEN 1 THEN '    rodape: ' || printf('%.0f', mv / 288 * 100) || '% da altura no vertical, ' || printf('%.0f', mh / 288 * 100) || '% no horizontal' WHEN 2 THEN '    ' || description ELSE '' END AS text
FROM (SELECT * FROM {_CAPS}) c JOIN (SELECT * FROM {_TOLD}) t ON c.name = t.name, range(0, 4) r(line)""")
def preset_lines(spark, d):
    return media.preset_lines(media.described(media.caption_presets(spark)))


_ASKED = "CASE page_id % 6 WHEN 0 THEN 'natural-sentence' WHEN 1 THEN 'bold-overlay' WHEN 2 THEN 'minimal-clean' WHEN 3 THEN 'karaoke-word' WHEN 4 THEN 'house-style' ELSE 'no-' || (page_id % 18) END"
_HOUSE = ("house-style", 5, True, 80, 20, "FontName=Own")


@query("preset_lookup", f"""SELECT page_id, p.name, max_words FROM (SELECT page_id, {_ASKED} AS name FROM pages) p JOIN (SELECT * FROM {_values([*media.CAPTIONS, _HOUSE], 'name, max_words, uppercase, mv, mh, style')}) c ON p.name = c.name""")
def preset_lookup(spark, d):
    """Strict lookup in a registry with a row of the user's own."""
    registry = media.caption_presets(spark, spark.createDataFrame([_HOUSE], media.caption_presets(spark).schema))
    asked = adapters.table(spark, d, "pages").select("page_id", F.expr(_ASKED).alias("name")).where("name not like 'no-%'")
    return media.looked_up(asked, "name", registry, "max_words", "caption style").select("page_id", "name", "max_words")


@query("unknown_presets", f"""SELECT DISTINCT {_ASKED} AS name, 'unknown caption style ' || {_ASKED} || '. Available: bold-overlay, karaoke-word, minimal-clean, natural-sentence' AS message FROM pages WHERE page_id % 6 >= 4""")
def unknown_presets(spark, d):
    asked = adapters.table(spark, d, "pages").select(F.expr(_ASKED).alias("name"))
    return media.unknown_names(asked, "name", media.caption_presets(spark), "caption style")


@query("grade_override", f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '{media.AUTO}' WHEN 2 THEN 'eq=gamma=1.01' WHEN 3 THEN v.filter WHEN 4 THEN 'eq=gamma=1.2' ELSE 'eq=gamma=1.1' END AS filter FROM part, (SELECT filter FROM {_values(media.GRADES, 'name, filter')} WHERE name = 'warm_cinematic') v""")
def grade_override(spark, d):
    """Rows of the user's own replace and extend the registry of grades."""
    presets = media.grade_presets(spark, spark.createDataFrame([("subtle", "eq=gamma=1.01"), ("my_look", "eq=gamma=1.2")], "name string, filter string"))
    return media.resolve_grades(adapters.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_GRADE_CASE).alias("grade")), presets).select("id", "filter")


_COVER = "'scale=' || w || ':' || h || ':force_original_aspect_ratio=increase,crop=' || w || ':' || h"


@query("reframe_filter", f"""SELECT name, strategy, CASE strategy WHEN 'crop' THEN {_COVER} ELSE 'split=2[bg][fg];[bg]' || {_COVER} || ',gblur=sigma=30[bgblur];[fg]scale=' || w || ':' || h || ':force_original_aspect_ratio=decrease[fgscaled];[bgblur][fgscaled]overlay=(W-w)/2:(H-h)/2' END AS filter
FROM (SELECT * FROM {_values(media.TARGETS, 'name, w, h')}) t, (SELECT unnest(['crop', 'blur-pad']) AS strategy) s""")
def reframe_filter(spark, d):
    t = media.format_targets(spark).withColumn("strategy", F.explode(F.array(F.lit("crop"), F.lit("blur-pad"))))
    return t.select("name", "strategy", media.reframe(F.col("width"), F.col("height"), F.col("strategy")).alias("filter"))


_SEG = f"""sg AS (SELECT r.edl, r.rid, r.source, 'raw/' || r.source || '.mov' AS path, r."start" / 1000.0::DOUBLE AS s, r."end" / 1000.0::DOUBLE AS e, {_PORTRAIT} AS portrait, transfer IN ('smpte2084', 'arib-std-b67') AS hdr, coalesce({_RATE}, '24') AS rate FROM ranges r JOIN pb ON clip = r.source % 100 + 1)"""


def _segments(spark, d):
    r = _cut(spark, d)[1].withColumn("_c", F.col("source") % 100 + 1)
    p = adapters.stream_probes(spark, d).select(F.col("clip").alias("_c"), media.is_portrait(F.col("width"), F.col("height"), F.col("rotation")).alias("portrait"), media.is_hdr(F.col("transfer")).alias("hdr"), F.coalesce(media.probed_rate(F.col("avg_rate"), F.col("nominal_rate")), F.lit("24")).alias("rate"))
    s = r.join(p, "_c").withColumn("path", F.concat(F.lit("raw/"), F.col("source").cast("string"), F.lit(".mov")))
    return s.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000, "grade": F.lit("eq=gamma=1.1")})


def _segment_sql(quality: str) -> str:
    side, preset, crf, folder = media.QUALITIES[quality]
    return _sql(f"""SELECT edl, rid, out, 'ffmpeg -y -ss ' || printf('%.3f', s) || ' -i ' || path || ' -t ' || printf('%.3f', e - s) || ' -vf ' || CASE WHEN hdr THEN '{media.TONEMAP},' ELSE '' END || CASE WHEN portrait THEN 'scale=-2:{side}' ELSE 'scale={side}:-2' END || ',eq=gamma=1.1 -af afade=t=in:st=0:d=0.03,afade=t=out:st=' || printf('%.3f', greatest(0.0::DOUBLE, e - s - 0.03::DOUBLE)) || ':d=0.03 -c:v libx264 -preset {preset} -crf {crf} -pix_fmt yuv420p -r ' || rate || ' -c:a aac -b:a 192k -ar 48000 -movflags +faststart ' || out AS args
FROM (SELECT *, '{folder}/seg_' || printf('%02d', rid) || '_' || source || '.mp4' AS out FROM sg)""", _TOK, _RANGES, _PROBE, _SEG)


@query("segment_plan", _segment_sql("final"))
def segment_plan(spark, d):
    return media.segment_plan(_segments(spark, d))


@query("segment_plan_draft", _segment_sql("draft"))
def segment_plan_draft(spark, d):
    return media.segment_plan(_segments(spark, d), "draft")


@query("segment_plan_preview", _segment_sql("preview"))
def segment_plan_preview(spark, d):
    return media.segment_plan(_segments(spark, d), "preview")


@query("log_heads", _sql("""SELECT edl, rid, array_to_string(string_split(args, ' ')[1:6], ' ') || ' …' AS command, substr(args, 1, 120) || '...' AS text FROM planned""", f"planned AS ({_segment_sql('final')})"))
def log_heads(spark, d):
    """What logs show of a plan: the first six arguments, the first 120 characters."""
    return media.segment_plan(_segments(spark, d)).select("edl", "rid", media.argv_head(F.col("args")).alias("command"), media.text_head(F.col("args")).alias("text"))


@query("concat_plan", _sql("SELECT DISTINCT edl, 'ffmpeg -y -f concat -safe 0 -i edit/' || edl || '/_concat.txt -c copy -movflags +faststart edit/' || edl || '/base.mp4' AS args FROM ranges", _TOK, _RANGES))
def concat_plan(spark, d):
    at = lambda name: F.concat(F.lit("edit/"), F.col("edl").cast("string"), F.lit(f"/{name}"))
    return _cut(spark, d)[1].select("edl").distinct().select("edl", media.concat_args(at("_concat.txt"), at("base.mp4")).alias("args"))


@query("concat_list", _sql("""SELECT edl, rid, 'file ''clips_graded/seg_' || printf('%02d', rid) || '_' || source || '.mp4''' AS text FROM ranges""", _TOK, _RANGES))
def concat_list(spark, d):
    return sinks.concat_list(media.segment_plan(_segments(spark, d)).select("edl", "rid", F.col("out").alias("path")))


_COMP = rf"""ov2 AS (SELECT edl, s / 1000.0::DOUBLE AS s, dur / 1000.0::DOUBLE AS dur, row_number() OVER (PARTITION BY edl ORDER BY idx) AS n FROM ov),
ls AS (SELECT DISTINCT edl, CASE WHEN edl % 3 = 0 THEN 'crop=1:1' END AS reframe, CASE WHEN edl % 2 = 0 THEN 'C:\it''s.srt' END AS subs FROM ov),
bs AS (SELECT *, CASE WHEN reframe IS NOT NULL THEN '[reframed]' ELSE '[0:v]' END AS base FROM ls),
ch AS (SELECT o.edl, string_agg('[' || n || ':v]setpts=PTS-STARTPTS+' || s || '/TB[a' || n || ']', ';' ORDER BY n) AS sh, string_agg(CASE WHEN n = 1 THEN base ELSE '[v' || (n - 1) || ']' END || '[a' || n || ']overlay=enable=''between(t,' || printf('%.3f', s) || ',' || printf('%.3f', s + dur) || ')''[v' || n || ']', ';' ORDER BY n) AS cn, max(n) AS k FROM ov2 o JOIN bs b ON o.edl = b.edl GROUP BY o.edl)"""
_COMP_SELECT = f"""SELECT bs.edl, CASE WHEN reframe IS NOT NULL THEN '[0:v]' || reframe || '[reframed];' ELSE '' END || sh || ';' || cn || ';' || CASE WHEN subs IS NOT NULL THEN '[v' || k || ']subtitles=''' || replace(replace(subs, ':', '\\:'), '''', '\\''') || ''':force_style=''{media.DEFAULT_STYLE}''[outv]' ELSE '[v' || k || ']null[outv]' END AS graph, '[outv]' AS out_label FROM bs JOIN ch ON bs.edl = ch.edl"""


def _composites(spark, d):
    o = adapters.overlays(spark, d).withColumns({"start": F.col("start") / 1000, "duration": F.col("duration") / 1000})
    lists = o.select("edl").distinct().withColumns({"reframe": F.when(F.col("edl") % 3 == 0, F.lit("crop=1:1")), "subtitles": F.when(F.col("edl") % 2 == 0, F.lit("C:\\it's.srt"))})
    return media.composite_graph(o, lists)


@query("composite_plan", _sql(_COMP_SELECT, _OV, _COMP))
def composite_plan(spark, d):
    return _composites(spark, d)


_ORDER = """parts AS (SELECT edl, turned, CASE WHEN turned THEN list_reverse(string_split(graph, ';')) ELSE string_split(graph, ';') END AS p FROM composed, (SELECT unnest([false, true]) AS turned) x)"""


@query("graph_order", _sql("""SELECT edl, turned, (len(list_filter(p, lambda x: contains(x, '[reframed]'))) = 0 OR (p[1] LIKE '[0:v]%' AND p[1] LIKE '%[reframed]')) AND (len(list_filter(p, lambda x: contains(x, 'subtitles='))) = 0 OR contains(p[-1], 'subtitles=')) AS ok FROM parts""", _OV, _COMP, f"composed AS ({_COMP_SELECT})", _ORDER))
def graph_order(spark, d):
    """The graphs as composed, and with their parts turned round, which breaks the rule wherever it says something."""
    turned = _composites(spark, d).select("edl", F.col("graph"), F.explode(F.array(F.lit(False), F.lit(True))).alias("turned"))
    graph = F.when(F.col("turned"), F.array_join(F.reverse(F.split("graph", ";")), ";")).otherwise(F.col("graph"))
    return turned.select("edl", "turned", media.graph_order_ok(graph).alias("ok"))


def _measured(spark, d):
    u = adapters.table(spark, d, "events").select(F.col("user_id").alias("clip")).distinct()
    body = F.concat(F.lit('frame= 1 {x}\n{"input_i": "-'), (F.col("clip") % 40).cast("string"), F.lit('.5", "input_tp": "-1.2", "input_lra": "7.0", "input_thresh": "-30.1"'), F.when(F.col("clip") % 5 == 0, F.lit("}")).otherwise(F.lit(', "target_offset": "0.3"}\n')))
    return transcripts.loudness(u.select("clip", body.alias("stderr")))


@query("loudnorm_plan", f"""SELECT user_id AS clip, CASE WHEN user_id % 5 = 0 THEN '{media.LOUDNORM}' ELSE '{media.LOUDNORM}:measured_I=-' || (user_id % 40) || '.5:measured_TP=-1.2:measured_LRA=7.0:measured_thresh=-30.1:offset=0.3:linear=true' END AS filter FROM (SELECT DISTINCT user_id FROM events)""")
def loudnorm_plan(spark, d):
    return _measured(spark, d).select("clip", media.loudnorm_filter(F.col("measured")).alias("filter"))


@query("loudnorm_passes", f"""SELECT clip, 'ffmpeg -y -hide_banner -nostats -i in.mp4 -af {media.LOUDNORM}:print_format=json -vn -f null -' AS measuring, 'ffmpeg -y -hide_banner -nostats -i in.mp4 -c:v copy -af {media.LOUDNORM}' || CASE WHEN clip % 5 = 0 THEN '' ELSE ':measured_I=-' || (clip % 40) || '.5:measured_TP=-1.2:measured_LRA=7.0:measured_thresh=-30.1:offset=0.3:linear=true' END || ' -c:a aac -b:a 192k -ar 48000 -movflags +faststart out.mp4' AS normalising FROM (SELECT DISTINCT user_id AS clip FROM events)""")
def loudnorm_passes(spark, d):
    """Both passes; where the first measured nothing, the second is the single one."""
    path, out = F.lit("in.mp4"), F.lit("out.mp4")
    return _measured(spark, d).select("clip", media.measure_args(path).alias("measuring"), media.loudnorm_args(path, F.col("measured"), out).alias("normalising"))


@query("soundtrack_args", """SELECT clip, 'ffmpeg -y -i v.mp4 -i v.mp4 -stream_loop -1 -i m.mp3 -filter_complex [2:a]volume=-20.0dB,afade=t=out:st=' || printf('%.2f', greatest(du - 1.5::DOUBLE, 0)) || ':d=1.5[music_low];[music_low][1:a]sidechaincompress=threshold=0.05:ratio=6.0:attack=5:release=300[ducked];[1:a][ducked]amix=inputs=2:duration=first:dropout_transition=0[aout] -map 0:v:0 -map [aout] -c:v copy -c:a aac -shortest o.mp4' AS args FROM (SELECT p_partkey AS clip, p_size / 8.0::DOUBLE AS du FROM part)""")
def soundtrack_args(spark, d):
    return adapters.table(spark, d, "part").select(F.col("p_partkey").alias("clip"), media.soundtrack_args(F.lit("v.mp4"), F.lit("m.mp3"), F.col("p_size") / 8.0, F.lit("o.mp4")).alias("args"))


@query("soundtrack_plan", """SELECT clip, '[2:a]volume=-20.0dB,afade=t=out:st=' || printf('%.2f', greatest(du - 1.5::DOUBLE, 0)) || ':d=1.5[music_low];[music_low][1:a]sidechaincompress=threshold=0.05:ratio=6.0:attack=5:release=300[ducked];[1:a][ducked]amix=inputs=2:duration=first:dropout_transition=0[aout]' AS graph FROM (SELECT p_partkey AS clip, p_size / 8.0::DOUBLE AS du FROM part)""")
def soundtrack_plan(spark, d):
    return adapters.table(spark, d, "part").select(F.col("p_partkey").alias("clip"), media.soundtrack_graph(F.col("p_size") / 8.0).alias("graph"))


@query("narration_plan", """SELECT p_partkey AS clip, 'ffmpeg -y -i v.mp4 -i n.wav' || CASE WHEN p_partkey % 2 = 0 THEN ' -i bed.mp3 -filter_complex [2:a]volume=-18.0dB[music_low];[music_low][1:a]sidechaincompress=threshold=0.05:ratio=8:attack=5:release=300[ducked];[1:a][ducked]amix=inputs=2:duration=first:dropout_transition=0[aout] -map 0:v:0 -map [aout]' ELSE ' -map 0:v:0 -map 1:a:0' END || ' -c:v copy -c:a aac -shortest o.mp4' AS args FROM part""")
def narration_plan(spark, d):
    bed = F.when(F.col("p_partkey") % 2 == 0, F.lit("bed.mp3"))
    return adapters.table(spark, d, "part").select(F.col("p_partkey").alias("clip"), media.narration_args(F.lit("v.mp4"), F.lit("n.wav"), bed, F.lit("o.mp4")).alias("args"))


@query("path_resolve", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/abs' || page_id ELSE CASE WHEN page_id % 2 <> 0 AND page_id % 3 = 0 THEN '/videos' ELSE '/videos/edit' END || '/f' || page_id END AS path FROM pages""")
def path_resolve(spark, d):
    k = F.col("page_id")
    p = F.concat(F.when(k % 5 == 0, "/abs").otherwise("f"), k.cast("string"))
    return adapters.table(spark, d, "pages").select("page_id", transcripts.resolved_path(p, F.lit("/videos/edit"), k % 2 == 0, k % 3 == 0).alias("path"))


@query("transcript_path", r"""SELECT page_id, regexp_replace(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-1], '(.)\.[^.]*$', '\1') || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.track' || (page_id % 3) END || '.json' AS path FROM pages""")
def transcript_path(spark, d):
    plain = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return adapters.table(spark, d, "pages").select("page_id", formats.transcript_path(plain, F.col("page_id") % 3).alias("path"))


@query("signalstats_parse", """SELECT event_id AS clip, CASE event_id % 3 WHEN 0 THEN 'YAVG' WHEN 1 THEN 'YBITDEPTH' ELSE 'SATAVG' END AS key, value FROM events WHERE event_id % 7 <> 0""")
def signalstats_parse(spark, d):
    e = adapters.table(spark, d, "events")
    key = F.when(F.col("event_id") % 3 == 0, "YAVG").when(F.col("event_id") % 3 == 1, "YBITDEPTH").otherwise("SATAVG")
    line = F.concat(F.lit("lavfi.signalstats."), key, F.lit("="), F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")))
    return transcripts.frame_values(e.select(F.col("event_id").alias("clip"), line.alias("line")))


@query("loudness_parse", """SELECT user_id AS clip, CASE WHEN user_id % 5 <> 0 THEN '-' || (user_id % 40) || '.5' END AS input_i FROM (SELECT DISTINCT user_id FROM events)""")
def loudness_parse(spark, d):
    u = adapters.table(spark, d, "events").select(F.col("user_id").alias("clip")).distinct()
    body = F.concat(F.lit('log {"input_i": "-'), (F.col("clip") % 40).cast("string"), F.lit('.5", "input_tp": "0", "input_lra": "1", "input_thresh": "2"'), F.when(F.col("clip") % 5 == 0, F.lit("}")).otherwise(F.lit(', "target_offset": "3"} end')))
    return transcripts.loudness(u.select("clip", body.alias("stderr"))).select("clip", F.element_at("measured", F.lit("input_i")).alias("input_i"))


_SHAPE = """CASE p_partkey % 7 WHEN 0 THEN 100 + p_size > 120 WHEN 1 THEN 120 > 100 + p_size WHEN 2 THEN 100 + p_size > 120 ELSE false END"""


@query("probe_outputs", f"""SELECT p_partkey AS clip, {_SHAPE} AS portrait, p_partkey % 3 = 0 AS hdr, CASE WHEN p_partkey % 4 = 0 THEN 10.0::DOUBLE ELSE p_size / 4.0::DOUBLE END AS duration FROM part""")
def probe_outputs(spark, d):
    """Probe outputs as text: dimensions and rotation from JSON, whole, without side data, empty, malformed; transfer; duration with its fallback."""
    k, dims = F.col("p_partkey"), F.concat(F.lit('"width": 120, "height": '), (100 + F.col("p_size")).cast("string"))
    stream = lambda rest: F.concat(F.lit('{"streams": [{'), dims, F.lit(rest), F.lit("}]}"))
    probes = [stream(""), stream(', "side_data_list": [{"side_data_type": "x"}, {"rotation": -90}]'), stream(', "tags": {"rotate": "90"}'), F.lit('{"streams": []}'), F.lit("not json"), stream(', "side_data_list": [{"rotation": "abc"}]'), F.lit('{"streams": [{"width": 120}]}')]
    shape = transcripts.stream_shape(F.element_at(F.array(*probes), (k % 7 + 1).cast("int")))
    transfer = transcripts.probed_transfer(F.when(k % 3 == 0, F.lit(" smpte2084\n")).when(k % 3 == 1, F.lit("bt709\n")))
    length = transcripts.probed_duration(F.when(k % 4 == 0, F.lit("N/A\n")).otherwise(F.concat((F.col("p_size") / 4.0).cast("string"), F.lit("\n"))))
    return adapters.table(spark, d, "part").select(k.alias("clip"), media.is_portrait(shape["width"], shape["height"], shape["rotation"]).alias("portrait"), media.is_hdr(transfer).alias("hdr"), length.alias("duration"))


@query("path_listing", """SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN '/abs/' || page_id WHEN page_id % 2 <> 0 AND page_id % 3 = 0 THEN '/videos/f' || page_id ELSE '/videos/edit/f' || page_id END AS resolved FROM pages""")
def path_listing(spark, d):
    """Paths resolved against a listing of the files there are."""
    k, name = F.col("page_id"), F.concat(F.lit("f"), F.col("page_id").cast("string"))
    p = adapters.table(spark, d, "pages").select("page_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("/abs/"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("./"), name)).when(k % 5 == 2, F.concat(F.lit("x/../"), name)).otherwise(name)
    there = p.where("page_id % 2 = 0").select(F.concat(F.lit("/videos/edit/"), name).alias("path")).union(p.where("page_id % 3 = 0").select(F.concat(F.lit("/videos/"), name)))
    return transcripts.resolve_paths(p.select(k.alias("id"), path.alias("path"), F.lit("/videos/edit").alias("base")), there).select("id", "resolved")


@query("audio_tracks", "SELECT user_id AS clip, (user_id % 4)::INTEGER AS n FROM (SELECT DISTINCT user_id FROM events)")
def audio_tracks(spark, d):
    u = adapters.table(spark, d, "events").select(F.col("user_id").alias("clip")).distinct()
    listing = F.concat(F.lit("\n"), F.repeat(F.lit("audio\n \n"), (F.col("clip") % 4).cast("int")))
    return u.select("clip", transcripts.track_count(listing).alias("n"))


_FLAT = _SPACED.replace('"start", "end", speaker FROM plain', """"start", "end", CASE WHEN ((pos - 1) // 4) % 3 <> 0 THEN 'S' || (((pos - 1) // 4) % 2) END FROM plain""")


@query("segments_flatten", _sql('SELECT source, pos, type, text, "start" / 1000.0::DOUBLE AS "start", "end" / 1000.0::DOUBLE AS "end", speaker FROM spaced', _TOK, _FLAT))
def segments_flatten(spark, d):
    """Words in segments of four, with speakers of segments from a table of their own."""
    t = adapters.tokens(spark, d).withColumn("seg", F.floor((F.col("pos") - 1) / 4).cast("int"))
    word = F.struct("pos", F.struct(F.col("text").alias("word"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end")).alias("w"))
    segs = t.groupBy("source", "seg").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    rows = segs.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "words"))), lambda x: F.struct(x["words"].alias("words"), F.lit("nobody").alias("speaker"))).alias("segments"))
    speakers = segs.where("seg % 3 <> 0").select("source", F.col("seg").alias("seg_idx"), F.concat(F.lit("S"), (F.col("seg") % 2).cast("string")).alias("speaker"))
    return speech.flatten_segments(rows, speakers)
