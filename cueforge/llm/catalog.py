"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, mixing, quality, repeats, shingle_join, topk, url_filter, warc
from .common import Scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    scratch = Scratch(spark)
    archives = scratch.save(warc.write_archives(warc.mark_revisits(pages)), "archives")
    found = scratch.save(warc.read_archives(archives, with_payload=False), "found")
    warc.log_gaps(found, f"{scratch.root}/gaps")
    scratch.drop("archives")
    return found.where("gap_from is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(urls, url_filter.fit(url_filter.labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_topk": op4_topk,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_shingle_join": op8_shingle_join,
    "op9_html_extract": op9_html_extract,
    "op10_bpe": op10_bpe,
}

_OP1 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
w AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
q AS (SELECT p.*, first_id, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) > 1 AS again FROM p JOIN w USING (h))
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM q
"""

_OP4 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM p),
o AS (SELECT *, sum(source_size) OVER () - 3 * (sum(source_size) OVER k - source_size) AS lft, sum(weight) OVER () - (sum(weight) OVER k - weight) AS lw
  FROM w WINDOW k AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lft * weight >= 3 * source_size * lw AS capped FROM o),
f AS (SELECT *, sum(source_size) OVER () - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () AS free,
  sum(weight) OVER () - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS fw FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (free * weight)::DOUBLE / fw END AS target FROM f),
t AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, r - floor(r) AS fr FROM t),
z AS (SELECT source, i, abs(sum(size * (u + i / {mixing.OFFSETS} - floor(u + i / {mixing.OFFSETS}) < fr)::BIGINT) - any_value(source_size) * any_value(fr)) AS miss
  FROM k, range(0, {mixing.OFFSETS}) x(i) GROUP BY source, i),
b AS (SELECT source, first(i ORDER BY miss, i) / {mixing.OFFSETS} AS off FROM z GROUP BY source)
SELECT doc_id, size, source_size, target, ((floor(r)::BIGINT + (u + off - floor(u + off) < fr)::BIGINT) * size)::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""

#: Bytes as pairs of hex digits, so that strings of bytes are substrings.
_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, sha256(substr(h, (2 * i + 1)::BIGINT, 200)) AS k FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM s) WHERE rn > 1),
b AS (SELECT d.doc_id, j, substr(h, (2 * j + 1)::BIGINT, 2) AS x FROM d, LATERAL (SELECT unnest(range(0, n)) AS j)),
m AS (SELECT b.doc_id, j, x, max(i) OVER (PARTITION BY b.doc_id ORDER BY j) AS last_start FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = b.j),
g AS (SELECT doc_id, j, x, coalesce(j - last_start < 100, false) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_spans, coalesce(string_agg(x, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
f AS (SELECT a, min(b) AS r FROM t GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(f.r, d.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op6_suffix_dedup": _OP6, "op8_shingle_join": _OP8, "op1_warc": _OP1, "op4_topk": _OP4, "op5_exact_dedup": _OP5, "op7_mixing": _OP7}
