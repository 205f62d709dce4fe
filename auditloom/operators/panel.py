"""Reviews in Markdown: sections and scores, the target they are about, and what a panel agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P

#: Sections of a review, and the bounds of its scores; fixed values.
SECTIONS = ("Summary", "Strengths", "Weaknesses", "Questions for the Authors", "Scores", "Ethics and Limitations", "Comment")
BOUNDS = {"Soundness": (1, 4), "Presentation": (1, 4), "Significance": (1, 4), "Originality": (1, 4), "Overall recommendation": (1, 6), "Confidence": (1, 5)}


def section_body(markdown: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(markdown, rf"(?ims)^#{{2,3}}\s*{name}\s*$(.*?)(?=^#{{1,3}}\s|\z)", 1), "^\\s+|\\s+$", "")


def scores(reviews: DataFrame) -> DataFrame:
    """(doc_id, role, dimension, value): the scores of each review that lie within bounds. reviews: (doc_id, role, markdown)."""
    found = F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.regexp_extract("markdown", rf"(?im)^[-*]?\s*\*{{0,2}}{n}\*{{0,2}}\s*:\s*(\d+)\s*/\s*\d+", 1).try_cast("int").alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        for n, (a, b) in BOUNDS.items()
    ])
    return reviews.select("doc_id", "role", F.inline(found)).where("value BETWEEN a AND b").drop("a", "b")


def parsed(reviews: DataFrame) -> DataFrame:
    """(doc_id, role, title, missing): the review's title, and the sections and scores that it lacks."""
    title = F.trim(F.regexp_replace(F.regexp_extract("markdown", P.REVIEW_TITLE, 1), '^"|"$', ""))
    lacks = F.array_compact(F.array(F.when(title == "", F.lit("title")), *[F.when(section_body(F.col("markdown"), n) == "", F.lit(n)) for n in SECTIONS]))
    own = scores(reviews).groupBy("doc_id", "role").agg(F.collect_set("dimension").alias("have"))
    all_scores = F.array(*map(F.lit, BOUNDS))
    joined = reviews.select("doc_id", "role", title.alias("title"), lacks.alias("lacks")).join(own, ["doc_id", "role"], "left")
    unscored = F.transform(F.array_except(all_scores, F.coalesce("have", F.array().cast("array<string>"))), lambda n: F.concat(F.lit("score:"), n))
    return joined.select("doc_id", "role", "title", F.array_join(F.concat("lacks", unscored), ",").alias("missing"))


def on_target(review_title: Column, paper_title: Column) -> Column:
    """Half of the shorter title's words shared; true where a title is missing."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    a, b = words(review_title), words(paper_title)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)) >= 0.5)


def median_scores(scores_: DataFrame) -> DataFrame:
    """(doc_id, dimension, value): the lower median of a panel."""
    return scores_.groupBy("doc_id", "dimension").agg(F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS int)").alias("value"))


def closest_review(reviews: DataFrame, scores_: DataFrame) -> DataFrame:
    """(doc_id, role): the review whose overall score is nearest to the panel's median; ties go to the first role."""
    name = "Overall recommendation"
    overall = scores_.where(F.col("dimension") == name).select("doc_id", "role", "value")
    middle = median_scores(scores_).where(F.col("dimension") == name).select("doc_id", F.col("value").alias("middle"))
    order = Window.partitionBy("doc_id").orderBy("far", "role")
    return reviews.select("doc_id", "role").join(overall, ["doc_id", "role"]).join(middle, "doc_id").withColumn("far", F.abs(F.col("value") - F.col("middle"))).withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "role")


def capped(value: Column, dimension: Column, breaches: Column) -> Column:
    """Soundness and the overall score end at 2 where a breach is proven."""
    return F.when((breaches > 0) & dimension.isin("Soundness", "Overall recommendation"), F.least(value, F.lit(2))).otherwise(value)
