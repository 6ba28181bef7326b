"""The queries op1 to op10 over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, langid, line_dedup, mixing, packing, quality, sharding, simhash, substring_dedup, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.decisions(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_lines", F.array_join("kept_lines", ","))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "is_kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_features(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "duration", "segments")


def op9_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    places = [F.round(F.get("positions", F.lit(k)), 9).alias(f"position_{k + 1}") for k in range(2)]  # most_epochs is 2
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", *places)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_substring_dedup, op4_quality_rules, op5_simhash_near_dedup, op6_language_id, op7_sharding, op8_audio_features, op9_warc_converter, op10_source_mixing)}


_STOP = ", ".join(f"'{x}'" for w in sorted(set(quality.STOP_WORDS)) for x in (w, w[0].upper() + w[1:], f"{w},", f"{w}."))

_OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.01
       AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM f
"""


_OP1 = r"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
u AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM p),
l AS (SELECT doc_id, i, list_filter(regexp_split_to_array(p[i + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM u),
n AS (SELECT doc_id, i, w, array_to_string(w, ' ') AS k FROM l WHERE len(w) > 0),
f AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS o FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) = 1),
j AS (SELECT o, w, k, unnest(range(len(w) + 1)) AS j FROM f WHERE len(w) >= 8),
v AS (SELECT o, j, CASE WHEN j = 0 THEN k ELSE array_to_string(list_concat(w[1 : j - 1], w[j + 1 :]), ' ') END AS v FROM j),
m AS (
  SELECT o, j, min(o) OVER (PARTITION BY v, j) AS same, min(CASE WHEN j = 0 THEN o END) OVER (PARTITION BY v) AS whole,
         min(CASE WHEN j > 0 THEN o END) OVER (PARTITION BY v) AS cut
  FROM v),
near AS (SELECT DISTINCT o FROM m WHERE same < o OR j > 0 AND whole < o OR j = 0 AND cut < o),
r AS (
  SELECT doc_id, count(near.o) AS n_near, count(*) FILTER (near.o IS NULL) AS n_kept, string_agg(i, ',' ORDER BY i) FILTER (near.o IS NULL) AS kept_lines
  FROM f LEFT JOIN near ON f.o = near.o GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n_kept, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id > first),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1)), 'string_agg', '') AS d
  FROM x)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5('=' || doc_id || '|' || coalesce(text, '')), 1, 15))::BIGINT AS draw
  FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
s AS (
  SELECT source, words, 2.0::DOUBLE * words AS most, ([3, 1, 2])[k + 1]::DOUBLE AS weight,
         ([1.0, 1.5, 0.5])[k + 1]::DOUBLE AS first, ([1.0, 0.5, 1.5])[k + 1]::DOUBLE AS last
  FROM n),
l AS (  -- the level rises until no more sources are full
  SELECT 0 AS i, 1.5::DOUBLE * sum(words) / sum(weight) AS level FROM s
  UNION ALL
  SELECT i + 1, (1.5::DOUBLE * sum(words) - coalesce(sum(CASE WHEN weight * level > most THEN most END), 0)) / sum(CASE WHEN weight * level <= most THEN weight END)
  FROM l, s WHERE i < 50 GROUP BY i, level),
t AS (SELECT s.*, least(most, weight * (SELECT max(level) FROM l)) AS target FROM s),
a AS (
  SELECT doc_id, size, words, target, first, last,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS passes FROM a),
c AS (SELECT *, (passes + CASE WHEN a + size / 2 < target - passes * words THEN 1 ELSE 0 END)::INT AS copies FROM p),
w AS (
  SELECT *, CASE WHEN target > 0 THEN least((a + size / 2) / target, 1) ELSE 0 END AS x, CASE WHEN target > 0 THEN least((a + words + size / 2) / target, 1) ELSE 0 END AS y
  FROM c),
q AS (
  SELECT *, CASE WHEN first = last THEN x ELSE (sqrt(first * first + (last - first) * (first + last) * x) - first) / (last - first) END AS u,
         CASE WHEN first = last THEN y ELSE (sqrt(first * first + (last - first) * (first + last) * y) - first) / (last - first) END AS v
  FROM w)
SELECT doc_id, size, words AS source_size, target, copies * size AS taken, copies,
       CASE WHEN copies >= 1 THEN round(u, 9) END AS position_1, CASE WHEN copies >= 2 THEN round(v, 9) END AS position_2
FROM q
"""


#: A directory level by level: a cell is a shard at the first depth from the starting one at which it fits.
_OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, md5('=' || doc_id || '|' || coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, n, lpad(bin(('0x' || substr(h, 1, 15))::BIGINT), 60, '0') AS b FROM d),
s AS (SELECT greatest(0, ceil(log2(greatest(sum(n), 1) / {sharding.SHARD_BYTES}.0)))::INT AS start FROM b),
l AS (
  SELECT doc_id, n, b, start AS depth, sum(n) OVER (PARTITION BY left(b, start)) AS bytes, count(*) OVER (PARTITION BY left(b, start)) AS rows FROM b, s
  UNION ALL
  SELECT doc_id, n, b, depth + 1, sum(n) OVER (PARTITION BY left(b, depth + 1)), count(*) OVER (PARTITION BY left(b, depth + 1))
  FROM l WHERE bytes > {sharding.SHARD_BYTES} AND rows > 1)
SELECT doc_id, n AS n_bytes, left(b, depth) AS shard, depth::INT AS depth, bytes::BIGINT AS shard_bytes, rows::BIGINT AS shard_rows
FROM l WHERE bytes <= {sharding.SHARD_BYTES} OR rows = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op3_substring_dedup": _OP3, "op4_quality_rules": _OP4, "op7_sharding": _OP7, "op9_warc_converter": _OP9, "op10_source_mixing": _OP10}
