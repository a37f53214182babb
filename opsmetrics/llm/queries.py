"""The operators with production parameters over their whole tables, and DuckDB statements of those SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    langid,
    licenses,
    manifest,
    mixing,
    ngram_join,
    packing,
    pii,
    pu_quality,
    rlz_dedup,
    suffix_dedup,
)
from opsmetrics.llm.common import crc_bucket, read_table


#: The registered query's key; a production run passes its own secret.
PII_KEY = "check-key"


def tokenizer_file() -> str:
    """The public vocabulary that the packing query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = langid.learn_languages(docs.where(~held_out))
    return langid.identify_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.passage_blocks(read_table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), blocks)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), PII_KEY)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = pu_quality.learn_quality(docs.where(~held_out), labels.where(~held_out))
    return pu_quality.score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    joined_lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    held = F.when(crc_bucket(F.col("doc_id"), 2) == 0, joined_lines).otherwise(F.col("text"))
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    proved = manifest.build_manifest(docs, values, claimed={"text": held})
    return proved.withColumn("folded_root", manifest.fold(F.col("claimed_leaf"), F.col("proof"))).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), weights=[5, 2, 1])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, {leaf_text} AS leaf, {claimed_text} AS claimed
  FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS held FROM documents)),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS many FROM d),
t AS (
  SELECT source, 0 AS level, idx, leaf AS digest, many FROM l
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), max((many + 2) // 3)
  FROM t WHERE many > 1 GROUP BY source, level, idx // 3),
s AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS many
  FROM t WHERE many = 1),
u AS (
  SELECT 0 AS level, idx, digest, many FROM s
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), max((many + 2) // 3)
  FROM u WHERE many > 1 GROUP BY level, idx // 3),
ts AS (
  SELECT source, level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM t WHERE many > 1 WINDOW w AS (PARTITION BY source, level, idx // 3 ORDER BY idx)),
us AS (
  SELECT level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM u WHERE many > 1 WINDOW w AS (PARTITION BY level, idx // 3 ORDER BY idx)),
p AS (
  SELECT l.source, l.idx, ts.level, ts.step FROM l JOIN ts
    ON l.source IS NOT DISTINCT FROM ts.source AND ts.idx = l.idx // CAST(pow(3, ts.level) AS BIGINT)
  UNION ALL
  SELECT l.source, l.idx, 1000 + us.level, us.step FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
    JOIN us ON us.idx = s.idx // CAST(pow(3, us.level) AS BIGINT)),
g AS (SELECT source, idx, list(step ORDER BY level) AS steps FROM p GROUP BY source, idx),
f AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM u WHERE many = 1) AS root, coalesce(g.steps, []) AS steps,
         list_reduce(list_concat([l.claimed], coalesce(g.steps, [])),
                     lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  LEFT JOIN g ON l.source IS NOT DISTINCT FROM g.source AND l.idx = g.idx)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM f
"""
_fields = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "TEXT")
) + ")"
#: CRC-32 of the decimal id, bit by bit.
_crc = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), "
    "lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), "
    "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
OP11_SQL = OP11_SQL.format(
    leaf_text=_fields.replace("TEXT", "text"), claimed_text=_fields.replace("TEXT", "held"), crc=f"CASE WHEN doc_id IS NULL THEN 0 ELSE {_crc} END"
)

OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic FROM w),
o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY part, fails),
x AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, toxic, list_sum(list_transform(fails, lambda b: CAST(b AS INT))) AS n_fails,
         fails[ascii(substr(filter_order, step, 1)) - 64] AS failed,
         list_bool_or(list_concat([false], list_transform(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64]))) AS gone
  FROM c, o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_ngram_join": op8_ngram_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_mixing": op13_source_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": OP6_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
