"""The registered queries of the operators over the given tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import bpe, byte_bpe, crf_quality, decontaminate, filter_audit, langid, line_dedup, media, minhash, paragraph_dedup, ring_shards, runs, suffix_dedup


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.report(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.report(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_table(spark, sf_dir, "documents"))


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(_table(spark, sf_dir, "embeddings"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.report(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_bpe": op2_bpe,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_ring_shards": op4_ring_shards,
        "op5_line_dedup": op5_line_dedup,
        "op6_paragraph_dedup": op6_paragraph_dedup,
        "op7_minhash": op7_minhash,
        "op8_crf_quality": op8_crf_quality,
        "op9_langid": op9_langid,
        "op10_media": op10_media,
        "op11_runs": op11_runs,
        "op12_filter_audit": op12_filter_audit,
        "op13_byte_bpe": op13_byte_bpe,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, rn, w, len(w) AS k
  FROM (SELECT doc_id, row_number() OVER () AS rn, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents)
), grams AS (
  SELECT rn, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT rn, w, n, unnest(range(1, k - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE k >= n)
), hits AS (
  SELECT g.rn, g.p, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.s = win.s
), words AS (
  SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(p, p + n)) AS p FROM hits) GROUP BY rn
), items AS (
  SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rn
)
SELECT doc_id, CAST(k AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (rn) LEFT JOIN items USING (rn)
"""

OP5_SQL = rf"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, p, ls[p] AS line, regexp_extract_all({_LOWER.format("ls[p]")}, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM raw)
), d AS (
  SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min(struct_pack(d := doc_id, p := p)) AS f FROM l WHERE len(w) > 0 GROUP BY 1
), v AS (
  SELECT s, f, g, CASE WHEN g = 0 THEN s ELSE array_to_string(list_concat(w[1 : g - 1], w[g + 1 : len(w)]), ' ') END AS t
  FROM (SELECT s, f, w, unnest(range(0, len(w) + 1)) AS g FROM d WHERE len(w) >= 6)
), gone AS (
  SELECT DISTINCT a.s FROM v a JOIN v b ON a.t = b.t AND b.f < a.f AND (a.g = b.g OR a.g = 0 OR b.g = 0)
), stay AS (
  SELECT f.d AS doc_id, f.p AS p FROM d WHERE s NOT IN (SELECT s FROM gone)
), cut AS (
  SELECT l.doc_id, count(*) FILTER (len(w) > 0 AND stay.p IS NULL) AS n_removed, string_agg(line, chr(10) ORDER BY l.p) FILTER (len(w) = 0 OR stay.p IS NOT NULL) AS kept
  FROM l LEFT JOIN stay ON l.doc_id = stay.doc_id AND l.p = stay.p GROUP BY l.doc_id
)
SELECT raw.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') END AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM met JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * m >= 85 * (a.n + b.n - m)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u
), least_of AS (
  SELECT u, min(v) AS c FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least_of ON d.doc_id = u
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (
  SELECT t, min(doc_id) AS least FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN least < d.doc_id THEN 'E' ELSE '' END) AS failed
  FROM d JOIN first USING (t) LEFT JOIN marks ON d.doc_id = marks.doc_id
), combos AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), c AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS o FROM c v, c w, c x, c y, c z
  WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5
), steps AS (
  SELECT o, step, o[step] AS own, o[1 : step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
  SELECT part, o, step, own, n, good, toxic, failed, contains(failed, own) AS fails, len(translate(failed, earlier, '')) < len(failed) AS gone FROM combos, steps
), counted AS (
  SELECT part, o, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
         sum(n) FILTER (failed = own) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM judged GROUP BY part, o, step, own
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op5_line_dedup": OP5_SQL, "op7_minhash": OP7_SQL, "op12_filter_audit": OP12_SQL}
