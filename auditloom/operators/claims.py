"""Claims, their types and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P
from auditloom.operators import manuscript as M


def is_junk(text: Column) -> Column:
    """A remnant of a table, or fewer than three words."""
    return (F.length(F.regexp_replace(text, "[^|]", "")) >= 2) | (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) < 3)


def claim_type(text: Column, title: Column, table: Column, checkbox: Column, numbered: Column) -> Column:
    low, head = F.lower(text), F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(table, "result")
        .when(checkbox | head.rlike("self[- ]review"), "self_review")
        .when(low.contains("falsifiable hypothesis") | head.contains("hypothesis"), "hypothesis")
        .when(text.rlike(P.ARITHMETIC), "arithmetic")
        .when(head.contains("limitation") | low.contains("limitation"), "limitation")
        .when(head.contains("result") | text.rlike(P.RESULT) | (numbered & text.rlike(P.STATE_OF_THE_ART)), "result")
        .when(low.contains("baseline") | head.contains("method") | head.contains("experiment"), "method")
        .otherwise("general")
    )


def claims(placed: DataFrame, tables: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, claim_no, text, type, line, column_start, column_end, section, table_no, numbers, refs).

    Table rows with a number are claims, and so are the sentences of other lines, but for headings, references, bare links and junk."""
    by_line = numbers.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("column_start", "number_no"))).alias("n"))
    lines = placed.where(F.col("text").rlike("\\S") & ~F.col("text").rlike(P.HEADING_LINE) & ~F.col("text").rlike(P.DELIMITER_LINE) & ~F.coalesce(F.col("title"), F.lit("")).rlike(P.REFERENCE_SECTION))
    inside = tables.select("doc_id", "line", "table_no", "kind", "cells")
    rows = lines.join(inside, ["doc_id", "line"], "left").join(by_line, ["doc_id", "line"], "left").withColumn("n", F.coalesce("n", F.array().cast("array<struct<column_start:int,number_no:int>>")))
    none = F.lit(None).cast("int")
    table_rows = rows.where("kind = 'row' AND size(n) > 0").select(
        "doc_id", "line", F.lit(1).alias("column_start"), F.length("text").alias("column_end"), "section", "title", "table_no", F.array_join("cells", " | ").alias("text"),
        F.transform("n", lambda x: x["number_no"]).alias("numbers"), F.lit(True).alias("is_row"), F.lit(False).alias("checkbox"),
    )
    prose = rows.where("table_no IS NULL").withColumn("lead", F.length(F.regexp_extract("text", "^\\s*", 0)))
    prose = prose.withColumn("lead", F.col("lead") + F.length(F.regexp_extract(F.substring("text", F.col("lead") + 1, F.length("text")), P.LIST_PREFIX, 0)))
    prose = prose.select("*", F.explode(M.matches(F.substring("text", F.col("lead") + 1, F.length("text")), P.CLAIM_SENTENCE)).alias("m"))
    start, end = F.col("lead") + F.col("m.column_start"), F.col("lead") + F.col("m.column_end")
    sentences = prose.where(~F.col("m.token").rlike(P.CITATION_ONLY) & ~is_junk(F.col("m.token"))).select(
        "doc_id", "line", start.alias("column_start"), end.alias("column_end"), "section", "title", none.alias("table_no"),
        F.trim(F.regexp_replace("m.token", "^\\[[ xX]\\]\\s*", "")).alias("text"),
        F.transform(F.filter("n", lambda x: x["column_start"].between(start, end)), lambda x: x["number_no"]).alias("numbers"), F.lit(False).alias("is_row"), F.col("text").rlike(P.CHECKBOX_ITEM).alias("checkbox"),
    )
    every = table_rows.unionByName(sentences)
    return every.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "column_start")).alias("claim_no"), "text",
        claim_type(F.col("text"), F.col("title"), F.col("is_row"), F.col("checkbox"), F.size("numbers") > 0).alias("type"),
        "line", "column_start", "column_end", "section", "table_no", "numbers", F.regexp_extract_all("text", F.lit(P.CITATION_MARK), F.lit(0)).alias("refs"),
    )


#: Which kinds of claims a finding of a check can contradict.
CONTRADICTS = {
    "ledger-trace": ("result", "arithmetic"),
    "internal-consistency": ("result", "arithmetic"),
    "arithmetic": ("arithmetic", "result"),
    "baseline-fairness": ("result", "arithmetic"),
    "citation-existence": ("general", "method", "result", "arithmetic", "hypothesis"),
}


def verdicts(claims_: DataFrame, findings: DataFrame, ledger_traces: DataFrame, arithmetic_traces: DataFrame) -> DataFrame:
    """(doc_id, claim_no, type, label, evidence, reason): contradicted by a finding that overlaps it, supported by traces that all match, else unverifiable.

    findings: evaluation.numbered; ledger_traces: (doc_id, number_no, matched, evidence); arithmetic_traces: (doc_id, line, metric, matched).
    A finding on a whole line meets all its claims; one with both columns only those that it overlaps.
    evidence: the numbers of the findings, the places in the ledger and in the text that support it, or the line."""
    spark = claims_.sparkSession
    kinds = spark.createDataFrame([(c, t) for c, ts in CONTRADICTS.items() for t in ts], "check string, type string")
    hits = claims_.select("doc_id", "claim_no", "type", "line", F.col("column_start").alias("a"), F.col("column_end").alias("b"), F.size("refs").alias("refs"))
    overlap = F.col("column_start").isNull() | F.col("column_end").isNull() | (F.greatest("column_start", "a") <= F.least("column_end", "b"))
    hits = findings.join(F.broadcast(kinds), "check").join(hits, ["doc_id", "line", "type"]).where(overlap & ((F.col("check") != "citation-existence") | (F.col("refs") > 0)))
    contradicted = hits.groupBy("doc_id", "claim_no").agg(F.transform(F.array_sort(F.collect_set("finding_no")), lambda n: F.format_string("finding-%03d", n)).alias("against"))
    traced = claims_.select("doc_id", "claim_no", F.explode("numbers").alias("number_no")).join(ledger_traces, ["doc_id", "number_no"]).groupBy("doc_id", "claim_no").agg(
        F.bool_and("matched").alias("ledger_ok"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("logged")
    )
    by_line = arithmetic_traces.groupBy("doc_id", "line").agg(F.bool_and("matched").alias("arithmetic_ok"), F.array_sort(F.collect_set("metric")).alias("metrics"))
    judged = claims_.join(contradicted, ["doc_id", "claim_no"], "left").join(traced, ["doc_id", "claim_no"], "left").join(by_line, ["doc_id", "line"], "left")
    none = F.array().cast("array<string>")
    bearing = F.col("type").isin("result", "arithmetic")
    by_ledger = F.when(F.coalesce("ledger_ok", F.lit(False)) & bearing, F.col("logged")).otherwise(none)
    by_sum = F.when((F.col("type") == "arithmetic") & F.coalesce("arithmetic_ok", F.lit(False)), F.transform("metrics", lambda m: F.format_string("arithmetic %s at paper:%d", m, F.col("line")))).otherwise(none)
    support = F.concat(by_ledger, by_sum)
    told = (
        F.when(F.col("against").isNotNull(), F.struct(F.lit("contradicted").alias("label"), F.col("against").alias("evidence"), F.lit("a finding lies on this passage").alias("reason")))
        .when(F.size(support) > 0, F.struct(F.lit("supported").alias("label"), support.alias("evidence"), F.lit("every value of it that a check traces is matched").alias("reason")))
        .otherwise(F.struct(F.lit("unverifiable").alias("label"), F.array(F.format_string("paper:%d", F.col("line"))).alias("evidence"), F.lit("no check decides on it").alias("reason")))
    )
    return judged.select("doc_id", "claim_no", "type", told.alias("t")).select("doc_id", "claim_no", "type", "t.*")
