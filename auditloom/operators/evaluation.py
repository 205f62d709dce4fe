"""Found against expected, selection of samples, checks of manifests and digests of what was judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detection(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """One row (expected, identified, localized, false_positives). gold: (paper, flaw, line, checks); findings: (paper, finding, check, line).

    A flaw is identified by a finding of an expected check, localized by one on its line; a finding that localizes nothing is false."""
    met = gold.withColumnRenamed("line", "gold_line").join(findings, "paper").where(F.array_contains("checks", F.col("check")))
    flaws = met.groupBy("paper", "flaw").agg(F.bool_or(F.col("line") == F.col("gold_line")).alias("localized"))
    totals = flaws.agg(F.count("*").alias("identified"), F.count_if("localized").alias("localized"))
    right = met.where("line = gold_line").select("paper", "finding").distinct()
    false = findings.join(right, ["paper", "finding"], "left_anti").agg(F.count("*").alias("false_positives"))
    one = lambda d: d.withColumn("k", F.lit(1))  # noqa: E731  (each has one row)
    return one(gold.agg(F.count("*").alias("expected"))).join(one(totals), "k").join(one(false), "k").drop("k")


def twins_agree(scores: DataFrame, twins: DataFrame) -> DataFrame:
    """(attack, clean, equal). scores: (paper, dimension, value); twins: (attack, clean)."""
    digest = scores.groupBy("paper").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dimension", "value")))).alias("d"))
    a = digest.select(F.col("paper").alias("attack"), F.col("d").alias("da"))
    b = digest.select(F.col("paper").alias("clean"), F.col("d").alias("db"))
    return twins.join(a, "attack", "left").join(b, "clean", "left").select("attack", "clean", F.col("da").eqNullSafe(F.col("db")).alias("equal"))


def diverse(papers: DataFrame, count: int, seed: int) -> DataFrame:
    """A sample that goes round the categories: (id, category, turn). papers: (id, category); the order within a category comes from the seed."""
    order = Window.partitionBy("category").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    dealt = papers.dropDuplicates(["id"]).withColumn("turn", F.row_number().over(order))
    return dealt.orderBy("turn", F.xxhash64("category", F.lit(seed)), "category").limit(count).select("id", "category", "turn")


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """(arxiv_id, error): rows of a manifest that break its rules. manifest: (arxiv_id, title, category, pdf_url, sha256)."""
    fields = ["arxiv_id", "title", "category", "pdf_url"]
    bad = F.array_compact(F.array(
        *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in fields],
        F.when(~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"), F.lit("sha256 is no digest")),
        F.when(F.col("times") > 1, F.lit("arxiv_id is repeated")),
    ))
    counted = manifest.withColumn("times", F.count("*").over(Window.partitionBy("arxiv_id")))
    return counted.select("arxiv_id", F.explode(bad).alias("error"))


def identity(content: Column) -> Column:
    """sha256 of a text's bytes."""
    return F.sha2(F.encode(content, "UTF-8"), 256)


def verdict_digest(verdicts: DataFrame) -> DataFrame:
    """(doc_id, digest) over (claim, label) in order."""
    each = F.array_sort(F.collect_list(F.struct("claim_no", "label")))
    return verdicts.groupBy("doc_id").agg(F.concat(F.lit("sha256:"), F.sha2(F.to_json(each), 256)).alias("digest"))


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc_id) of the digests that differ from those frozen before."""
    old = previous.select("doc_id", F.col("digest").alias("frozen"))
    return current.join(old, "doc_id").where("digest != frozen").select("doc_id")


def leads(findings: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, leads): the first findings of each check as JSON, for a reader; what an injected instruction said is left out."""
    order = Window.partitionBy("doc_id", "check").orderBy(F.coalesce("line", F.lit(1_000_000_000)), "column_start", "observed", "expected", "evidence_path")
    kept = findings.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    each = F.array_sort(F.collect_list(F.struct("check", "n", "line")))
    return kept.groupBy("doc_id").agg(F.to_json(each).alias("leads"))


def numbered(findings: DataFrame) -> DataFrame:
    """The findings with finding_no, by line, then check; those of a whole document last."""
    further = [c for c in ("observed", "expected", "evidence_path") if c in findings.columns]
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("line", F.lit(1_000_000_000)), "check", "column_start", *further)
    return findings.withColumn("finding_no", F.row_number().over(order))


def grounded(comments: DataFrame, verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, comment_no, stance): comments that rest on something; praise on a supported claim, criticism on a finding or a contradicted claim.

    A criticism of a claim that is known but not contradicted becomes a question; what rests on nothing is dropped.
    comments: (doc_id, comment_no, stance, claim_no, finding_no); findings: numbered."""
    judged = comments.join(verdicts.select("doc_id", "claim_no", "label"), ["doc_id", "claim_no"], "left").join(findings.select("doc_id", "finding_no", F.lit(True).alias("found")), ["doc_id", "finding_no"], "left")
    stance = (
        F.when((F.col("stance") == "praise") & (F.col("label") == "supported"), "praise")
        .when((F.col("stance") == "criticism") & (F.col("found") | (F.col("label") == "contradicted")), "criticism")
        .when((F.col("stance") == "criticism") & F.col("label").isNotNull(), "question").when((F.col("stance") == "question") & (F.col("found") | F.col("label").isNotNull()), "question")
    )
    return judged.select("doc_id", "comment_no", stance.alias("stance")).where("stance IS NOT NULL")
