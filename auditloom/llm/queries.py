"""The queries of the llm operators, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import leakage, lookalikes, packing, residue, scanned, sentences, spans
from auditloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of papers whose texts look the same and are stored differently."""
    return lookalikes.look_pairs(lookalikes.same_look(table(spark, folder, "prepared_papers"), "paper_id", ["raw_text", "analysis_text"]), "paper_id")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each paper and field: the look that it has, and how many papers and stored texts share it."""
    return lookalikes.look_classes(lookalikes.same_look(table(spark, folder, "prepared_papers"), "paper_id", ["raw_text", "analysis_text"]))


def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.consistent_texts(table(spark, folder, "prepared_papers"), "paper_id", ["raw_text", "analysis_text"])


def _markdown_papers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prepared_papers").where("media_type = 'text/markdown'")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(_markdown_papers(spark, folder), "paper_id", "analysis_text").drop("sentence")


def p3_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of all papers, also of those converted from PDF, which p3_found leaves out."""
    return sentences.sentences(table(spark, folder, "prepared_papers"), "paper_id", "analysis_text")


def _repair(spark: SparkSession, folder: str) -> scanned.Repair:
    papers = table(spark, folder, "prepared_papers")
    pages = table(spark, folder, "pdf_conversions").select(F.lit("markdown").alias("field_name"), F.col("conversion_id").alias("record_id"), F.col("markdown").alias("text"))
    prepared = papers.where("media_type = 'application/pdf'").select(F.lit("analysis_text").alias("field_name"), F.col("paper_id").alias("record_id"), F.col("analysis_text").alias("text"))
    return scanned.Repair(pages.unionByName(prepared), papers.where("media_type = 'text/markdown'").select(F.col("analysis_text").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repair(spark, folder).findings()


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return _repair(spark, folder).paragraphs()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.affected(table(spark, folder, "prepared_papers"), "paper_id", "analysis_text")


def p5_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "prepared_papers"), "paper_id", "analysis_text")


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    return residue.excluded(table(spark, folder, "prepared_papers"), "paper_id", "analysis_text").select("paper_id", "media_type").dropDuplicates(["paper_id"])


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), table(spark, folder, "context_windows"))


def p6_usage(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "context_windows")
    return packing.usage(packing.containers(table(spark, folder, "documents"), windows), windows)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), leakage.Items(table(spark, folder, "eval_items")))


def p7_asked_again(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.asked_again(table(spark, folder, "documents"), leakage.Items(table(spark, folder, "eval_items")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_amounts(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_texts": p1_texts, "p1_classes": p1_classes,
        "p3_found": p3_found, "p3_sentences": p3_sentences,
        "p4_found": p4_found, "p4_paragraphs": p4_paragraphs,
        "p5_found": p5_found, "p5_residue": p5_residue, "p5_kept": p5_kept,
        "p6_containers": p6_containers, "p6_usage": p6_usage,
        "p7_found": p7_found, "p7_asked_again": p7_asked_again,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    """By brute force: all windows of words, and all windows of characters."""
    return {
        "p7_found": r"""WITH w AS (SELECT DISTINCT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE passage IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(ws[k:k+12], ' ') AS gram FROM w, unnest(range(1, len(ws) - 11)) u(k)),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k+12], ' ') AS gram FROM t, unnest(range(1, len(ws) - 11)) u(k))
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)""",
        "p8_found": """WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE length(text) >= 240 AND doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT doc_id, i, hash(substr(text, i, 240)) AS h FROM d, unnest(range(1, length(text) - 238)) u(i)),
s AS (SELECT h FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)), p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w JOIN s USING (h))
SELECT doc_id, sum(least(240, coalesce(n - i, 240)))::BIGINT AS shared_chars FROM p GROUP BY 1""",
    }
