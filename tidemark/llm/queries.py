"""The queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, jaccard_join, language_id, media, packing, quality, repair_store, substring_dedup, suffix_dedup, token_counts, warc, whitening
from .common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = repair_store.write_blocks(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return repair_store.read_documents(blocks)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(read_table(spark, sf_dir, "documents"))
    return media.describe(media.store_pcm(stored))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.learn(language_id.training_rows(docs))
    return language_id.predict(docs.withColumn("held_out", language_id.held_out()), model, keep=("doc_id", "held_out"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(read_table(spark, sf_dir, "pages")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    left = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_repair_token_ids,
        op3_substring_dedup,
        op4_decontamination,
        op5_jaccard_join,
        op6_media_columns,
        op7_best_fit_packing,
        op8_language_id,
        op9_warc,
        op10_token_counts,
        op11_suffix_dedup,
        op12_embedding_whitening,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN p.n >= 100 AND p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN p.n >= 100 AND p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
""",
    "op11_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
p AS (SELECT doc_id, bytes, unnest(range(0, greatest(len(bytes) // 2 - 99, 0))) AS start FROM d),
k AS (SELECT doc_id, start, substring(bytes, 2 * start + 1, 200) AS string FROM p),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY string ORDER BY doc_id, start) AS n FROM k) WHERE n > 1),
g AS (SELECT doc_id, start, CASE WHEN start <= lag(start) OVER w + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
n AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM g),
s AS (SELECT doc_id, span, min(start) AS a, max(start) + 100 AS b FROM n GROUP BY doc_id, span),
l AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT l.doc_id, string_agg(substring(bytes, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(b) AS last, sum(b - a) AS removed, count(*) AS spans
      FROM l JOIN d ON l.doc_id = d.doc_id GROUP BY l.doc_id)
SELECT d.doc_id, len(bytes) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(front, '') || substring(bytes, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
""",
    "op13_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
v AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM w),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM v),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
e AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, x.i] AS idx FROM e a, e b, e c, e d, e x WHERE len(list_distinct([a.i, b.i, c.i, d.i, x.i])) = 5),
s AS (SELECT idx, e.i AS step FROM o, e),
q AS (SELECT part, idx, step, n, good, toxic, fails[idx[step]] AS now, list_bool_or([false] || list_transform(idx[1:step - 1], lambda k: fails[k])) AS gone,
    len(list_filter(fails, lambda b: b)) AS n_fails FROM s, m),
a AS (SELECT part, list_aggregate(list_transform(idx, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') AS filter_order, substr('ABCDE', idx[step], 1) AS filter, step,
    coalesce(sum(n) FILTER (WHERE NOT now AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE now AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE now AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE now AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE now AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE now AND NOT gone), 0) AS toxic_lost
    FROM q GROUP BY part, idx, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM a
""",
}
