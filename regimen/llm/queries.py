"""The registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from regimen.llm import (bitsliced, decontaminate, infill, language, lines, ngrams, packing, pii, quality, resample, substrings, suffixes,
                         toxicity)
from regimen.llm.frames import id_remainder, table


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and n_generalised, n_removed) for every document."""
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and n_near_items) for every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return substrings.repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"),
                         "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, removed_sha256 for every document."""
    return lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, offset, sequence_id for every piece of every document."""
    return packing.sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("t")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, group_id, kept for every document."""
    return ngrams.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("t")


def op9_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best rows of every row whose vec_id is divisible by 50."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("id", F.lit(50)) == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return language.identify(docs).select("doc_id", held_out, "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (and n_toxic_spans, toxic_spans) for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    tagged = toxicity.tag(docs, table(spark, sf_dir, "labels"))
    return tagged.select("doc_id", held_out, "score", "predicted", "n_toxic_spans", "toxic_spans")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every document."""
    return infill.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_sanitisation": op1_pii_sanitisation,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_exact_topk_search": op9_exact_topk_search,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: DuckDB SQL of those that SQL can express on whole tables
ORACLE: dict[str, str] = {
    "op11_importance_resampling": rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
       FROM range(256) r(i))),
     lowered AS (SELECT 'd' AS side, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
       UNION ALL SELECT 'b', NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
     found AS (SELECT side, doc_id, unnest(regexp_extract_all(x, '{_WORDS}')) AS w FROM lowered),
     counted AS (SELECT side, doc_id, w, count(*) AS n FROM found GROUP BY ALL),
     bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b
       FROM (SELECT DISTINCT w FROM counted)),
     bucket AS (SELECT w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 10000 AS k
       FROM bytes, crc),
     sums AS (SELECT k, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
       FROM counted JOIN bucket USING (w) GROUP BY k),
     total AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
     gain AS (SELECT k, floor(1000 * ln((sums.t + 1) * (total.s + 10000) / ((sums.s + 1) * (total.t + 10000)))) AS g FROM sums, total),
     weighed AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM counted JOIN bucket USING (w) JOIN gain USING (k)
       WHERE side = 'd' GROUP BY doc_id),
     scored AS (SELECT d.doc_id, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight, coalesce(w.weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
       FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
         count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= total * 10 // 100 THEN r END AS rank FROM ranked""",
    "op13_fill_in_middle": r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || doc_id) AS h FROM documents),
     told AS (SELECT doc_id, x, u, len(u) AS n, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS h FROM cut),
     formed AS (SELECT doc_id, x, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM told),
     parts AS (SELECT doc_id, x, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM parts""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
