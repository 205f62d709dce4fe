"""Repairs of text that came out of page extraction, and of prose in reviews; all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P


def without_picture_text(text: Column) -> Column:
    """Text read from pictures dropped, where 200 characters of other text remain."""
    bare = F.regexp_replace(text, P.PICTURE_TEXT, "")
    tidy = F.concat(F.trim(F.regexp_replace(F.regexp_replace(bare, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")), F.lit("\n"))
    return F.when(~text.contains("<!-- Start of picture text -->"), text).when(F.length(F.regexp_replace(bare, "^\\s+|\\s+$", "")) < 200, text).otherwise(tidy)


def numbers_without_emphasis(text: Column) -> Column:
    """28 _._ 4 becomes 28.4."""
    return F.regexp_replace(text, P.NUMERIC_EMPHASIS, "$1")


def cells_without_emphasis(line: Column) -> Column:
    """Bold and paired italic marks dropped from a table row, however they are nested."""
    row = line.rlike("^\\s*\\|.*\\|\\s*$")
    bare = F.replace(line, F.lit("**"), F.lit(""))
    pairs = F.regexp_count(bare, F.lit("_")) / 2  # no more passes than pairs of marks can change it
    out = F.aggregate(F.sequence(F.lit(1), F.greatest(pairs.cast("int"), F.lit(1))), bare, lambda done, _: F.regexp_replace(done, "_([^_\\n]+?)_", "$1"))
    return F.when(row & line.contains("_"), out).when(row, bare).otherwise(line)


def leading_boilerplate(lines: DataFrame) -> DataFrame:
    """(doc_id, line, boilerplate): copyright lines before the first heading or the first line of more than 40 characters."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    plate = F.col("text").rlike(P.BOILERPLATE)
    begun = F.col("text").rlike("^\\s*#") | (F.length(F.trim("text")) > 40)
    rows = lines.select("doc_id", "line", plate.alias("plate"), (begun & ~plate).alias("begun"), begun.alias("long"))
    return rows.withColumn("before", F.coalesce(F.max("begun").over(order), F.lit(False))).select("doc_id", "line", (F.col("plate") & ~F.col("before")).alias("boilerplate"))


def margin_numbers(papers: DataFrame, run: int = 6, total: int = 30) -> DataFrame:
    """(doc_id, value): the line numbers printed in a margin: three-digit values in runs of consecutive ones, enough of them in all."""
    values = papers.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(P.MARGIN_ANY), F.lit(0)))).alias("v")).select("doc_id", F.col("v").cast("int").alias("value"))
    island = values.withColumn("island", F.col("value") - F.row_number().over(Window.partitionBy("doc_id").orderBy("value")))
    kept = island.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "island"))).where(F.col("n") >= run)
    return kept.withColumn("all", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("all") >= total).select("doc_id", "value")


def without_margin_numbers(papers: DataFrame) -> DataFrame:
    """(doc_id, text) with the margin's numbers taken out where they stand between spaces."""
    found = margin_numbers(papers).groupBy("doc_id").agg(F.collect_set(F.format_string("%03d", "value")).alias("found"))
    parts = F.regexp_extract_all("text", F.lit("(?<!\\S)\\d{3}(?!\\S)|\\S+|\\s+"), F.lit(0))
    kept = F.array_join(F.transform(parts, lambda p: F.when(F.array_contains("found", p), "").otherwise(p)), "")
    return papers.join(found, "doc_id", "left").select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(F.regexp_replace(kept, "[ \\t]{2,}", " ")).alias("text"))


def plain_voice(text: Column) -> Column:
    """Review prose without the reviewer: no identity, process talk, stance, intensifiers and flourish; articles, spaces and capitals put right."""
    out = F.regexp_replace(F.regexp_replace(text, P.META_LINE, ""), P.META_PHRASE, "")
    for pattern in P.STANCE:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, P.INTENSIFIER, "")
    for pattern, by in P.FLOURISH:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(F.regexp_replace(out, "\\b([Aa])n[ \\t]+(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])", "$1 "), "\\b([Aa])[ \\t]+(?=[aeiouAEIOU])", "$1n ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+([,.;:)])", "$1"), "[ \\t]{2,}", " ")
    parts = F.regexp_extract_all(out, F.lit("(?s)[.!?]\\s+[a-z]|^[a-z]|."), F.lit(0))
    raised = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("(?s)^[.!?]\\s+[a-z]$|^[a-z]$") & ((F.length(p) > 1)), F.concat(F.left(p, F.length(p) - 1), F.upper(F.right(p, F.lit(1))))).otherwise(p)), "")
    first = F.concat(F.upper(F.left(raised, F.lit(1))), F.substring(raised, F.lit(2), F.length(raised)))
    return F.when(text.rlike("\\S"), F.regexp_replace(first, "^\\s+|\\s+$", "")).otherwise(text)
