"""Claims of improvement, silence about failures, and claims wider than the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import patterns as P
from auditloom.operators.ledger import label


def improvement_claims(sentences: DataFrame) -> DataFrame:
    """Loose sentences that assert an improvement: not planned, not negated, not a bare percentage."""
    s = F.col("sentence")
    return sentences.where(s.rlike(P.IMPROVEMENT) & ~s.rlike(P.NON_CLAIM) & ~s.rlike(P.NEGATED_IMPROVEMENT) & ~s.rlike(P.BOUNDED_IMPROVEMENT))


def fairness(sentences: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, line, column_start, column_end, named_baseline, metrics, confirmed, supported): each improvement claim against baseline, candidate and confirmation records.

    values: ledger.metric_values. "Some candidate, every confirmation" is a comparison of minima and maxima."""
    one = lambda role, f: f(F.when(F.col("role") == role, F.col("number")))
    by_metric = values.groupBy("doc_id", "metric").agg(
        one("baseline", F.min).alias("b_low"), one("baseline", F.max).alias("b_high"), one("candidate", F.min).alias("c_low"), one("candidate", F.max).alias("c_high"),
        one("confirmation", F.min).alias("r_low"), one("confirmation", F.max).alias("r_high"),
    ).where("b_low IS NOT NULL AND c_low IS NOT NULL")
    claims = improvement_claims(sentences).join(values.select("doc_id").distinct(), "doc_id", "left_semi")
    padded = F.concat(F.lit("_"), label(F.col("sentence")), F.lit("_"))
    met = claims.join(by_metric, "doc_id", "left").withColumn("named", F.contains(padded, F.concat(F.lit("_"), F.col("metric"), F.lit("_"))) | F.contains(padded, F.concat(F.lit("_"), F.replace(F.col("metric"), F.lit("_"), F.lit("")), F.lit("_"))))
    key = ["doc_id", "line", "column_start", "column_end", "sentence"]
    grouped = met.groupBy(*key).agg(F.collect_list(F.struct("metric", "named", "b_low", "b_high", "c_low", "c_high", "r_low", "r_high")).alias("m"))
    known = F.filter("m", lambda x: x["metric"].isNotNull())
    mentioned = F.filter(known, lambda x: x["named"])
    eligible = F.when(F.size(mentioned) > 0, mentioned).otherwise(known)
    rows = grouped.withColumn("m", eligible).withColumn("only", F.when(F.size("m") == 1, F.try_element_at("m", F.lit(1))))
    s = F.col("sentence")
    direction = (
        F.when(s.rlike("(?i)\\blower\\s+than\\b"), "lower").when(s.rlike("(?i)\\bhigher\\s+than\\b"), "higher")
        .when(F.col("only.metric").isin(*P.LOWER_IS_BETTER), "lower").when(F.col("only.metric").isin(*P.HIGHER_IS_BETTER), "higher")
    )
    confirmed = F.col("only").isNotNull() & F.col("only.r_low").isNotNull()
    supported = (
        F.when(~confirmed | direction.isNull(), F.lit(None).cast("boolean"))
        .when(direction == "lower", (F.col("only.c_low") < F.col("only.b_high")) & (F.col("only.r_high") < F.col("only.b_low")))
        .otherwise((F.col("only.c_high") > F.col("only.b_low")) & (F.col("only.r_low") > F.col("only.b_high")))
    )
    return rows.select("doc_id", "line", "column_start", "column_end", s.rlike(P.BASELINE_REFERENCE).alias("named_baseline"), F.size("m").alias("metrics"), F.coalesce(confirmed, F.lit(False)).alias("confirmed"), supported.alias("supported"))


def spoken(text):
    """Words with one separator between and around them, in lower case: a name is told where its spoken form is contained."""
    return F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", ""), F.lit("_"))


def omitted_failures(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc_id, path, line, identity, mentions, disclosed): discarded and crashed records, and whether a line of the paper names them with a word for failure."""
    own = leaves.where("parent = '' AND kind = 'STRING'").where(F.col("field").isin("status", *P.IDENTITY_FIELDS))
    first = F.array_compact(F.array(*[F.max(F.when((F.col("field") == f) & (F.trim("value") != ""), F.trim("value"))) for f in P.IDENTITY_FIELDS]))
    records = own.groupBy("doc_id", "path", "line").agg(F.lower(F.trim(F.max(F.when(F.col("field") == "status", F.col("value"))))).alias("status"), F.try_element_at(first, F.lit(1)).alias("identity"))
    failed = records.where(F.col("status").isin(*P.NEGATIVE_STATUSES) & F.col("identity").isNotNull()).withColumn("name", spoken(F.col("identity"))).where("name != '__'")
    # lines meet the records of their document through the first word of the name, so that no line is paired with every record
    words = lines.where(F.col("text").rlike("\\S")).select("doc_id", "text", spoken(F.col("text")).alias("told")).withColumn("word", F.explode(F.array_distinct(F.split("told", "_")))).where("word != ''")
    named = failed.withColumn("word", F.try_element_at(F.split("name", "_"), F.lit(2)))
    hits = named.join(words, ["doc_id", "word"]).where(F.contains("told", "name")).groupBy("doc_id", "path", "line").agg(F.count("*").alias("mentions"), F.bool_or(F.col("text").rlike(P.NEGATIVE_LANGUAGE)).alias("disclosed"))
    return failed.join(hits, ["doc_id", "path", "line"], "left").select("doc_id", "path", "line", "status", "identity", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("disclosed", F.lit(False)).alias("disclosed"))


def _dimension(text):
    low = F.lower(text)
    return F.when(low.rlike("^(benchmark|dataset|task|domain)"), "benchmark_count").when(low.startswith("metric"), "metric_count").when(low.startswith("seed"), "seed_count").when(low.rlike("^(run|trial)"), "trial_count").otherwise("gpu_type_count")


def scope_requirements(sentences: DataFrame) -> DataFrame:
    """(doc_id, line, column_start, dimension, required): how much a general claim needs of each dimension; "all" needs more than there can be."""
    s = F.col("sentence")
    general = sentences.where(s.rlike(P.GENERALIZED) & ~s.rlike(P.NON_ASSERTION) & ~s.rlike(P.NEGATED_SCOPE))
    every = lambda p, n: F.regexp_extract_all(s, F.lit(p), F.lit(n))
    need = F.concat(
        F.transform(F.arrays_zip(every(P.COUNTED_SCOPE, 1).alias("n"), every(P.COUNTED_SCOPE, 2).alias("d")), lambda x: F.struct(_dimension(x["d"]).alias("dimension"), x["n"].cast("double").alias("required"))),
        F.transform(F.arrays_zip(every(P.QUALIFIED_SCOPE, 1).alias("q"), every(P.QUALIFIED_SCOPE, 2).alias("d")), lambda x: F.struct(_dimension(x["d"]).alias("dimension"), F.when(F.lower(x["q"]).isin("all", "every"), F.lit(float("inf"))).otherwise(2.0).alias("required"))),
        F.transform(every(P.BARE_SCOPE, 1), lambda d: F.struct(_dimension(d).alias("dimension"), F.lit(2.0).alias("required"))),
    )
    fallback = F.when(s.rlike("(?i)\\b(?:generaliz(?:e[sd]?|able|ation)|broadly\\s+(?:applicable|effective)|universal(?:ly)?)\\b"), "benchmark_count").when(s.rlike("(?i)\\bconsistently\\s+(?:outperform|improv|perform)"), "seed_count")
    some = F.when(F.size(need) > 0, need).when(fallback.isNotNull(), F.array(F.struct(fallback.alias("dimension"), F.lit(2.0).alias("required"))))
    return general.select("doc_id", "line", "column_start", F.explode(some).alias("r")).groupBy("doc_id", "line", "column_start", "r.dimension").agg(F.max("r.required").alias("required"))


def scope_weaknesses(sentences: DataFrame, scope: DataFrame) -> DataFrame:
    """(doc_id, line, column_start): general claims that need more than the ledger covers."""
    long = scope.unpivot("doc_id", ["benchmark_count", "metric_count", "seed_count", "trial_count", "gpu_type_count"], "dimension", "available")
    return scope_requirements(sentences).join(long, ["doc_id", "dimension"]).where("required > available").select("doc_id", "line", "column_start").distinct()
