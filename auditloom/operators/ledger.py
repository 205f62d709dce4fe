"""Experiment ledgers: JSON lines of any shape as leaves, records, roles and scope.

Ledger lines come as (doc_id, path, line, raw). Lines that are no JSON object are set
apart; values nested deeper than DEPTH levels are reached in Arrow batches, so every depth is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import patterns as P

#: Levels of nesting that the plan itself unfolds.
DEPTH = 6


def label(text: Column) -> Column:
    """Lower case, anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def last_name(path: Column) -> Column:
    """The last name of a dotted path, without an index."""
    return F.regexp_replace(F.regexp_extract(path, "([^.]*)$", 1), "(\\[\\d+\\])+$", "")


def parsed(ledger: DataFrame) -> DataFrame:
    """(doc_id, path, line, v, problem): problem is null for objects; blank lines are skipped."""
    ledger.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # the reader stops at the end of a value; as the one element of an array and the one member of an object nothing follows it
    alone = F.try_parse_json(F.concat(F.lit("["), "raw", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), "raw", F.lit("}"))).isNotNull()
    rows = ledger.where("raw IS NOT NULL AND trim(raw) != ''").withColumn("v", F.when(alone, F.try_parse_json("raw")))
    object_ = F.expr("schema_of_variant(v) LIKE 'OBJECT%'")
    return rows.select("doc_id", "path", "line", "v", F.when(F.col("v").isNull(), "invalid JSON").when(~object_, "not an object").alias("problem"))


def malformed(ledger: DataFrame) -> DataFrame:
    """(doc_id, path, line, problem) of the lines that hold no record."""
    return parsed(ledger).where("problem IS NOT NULL").drop("v")


def _deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scalars of values that are still nested, each as JSON."""
    for batch in batches:
        rows = []
        for doc, path, line, field, parent, name, text in zip(*[batch[c] for c in batch.columns]):
            todo = [(field, parent, name, json.loads(text, parse_float=_Raw, parse_int=_Raw))]
            while todo:
                field_, parent_, name_, value = todo.pop()
                if isinstance(value, dict):
                    todo += [(f"{field_}.{k}", name_, k, v) for k, v in value.items()]
                elif isinstance(value, list):
                    todo += [(f"{field_}[{i}]", name_, name_, v) for i, v in enumerate(value)]
                else:
                    rows.append((doc, path, line, field_, parent_, name_, value.text if isinstance(value, _Raw) else json.dumps(value, ensure_ascii=False)))
        yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(batch.columns)}, columns=batch.columns)


class _Raw:
    """A number as it is written."""

    def __init__(self, text: str) -> None:
        self.text = text


def leaves(ledger: DataFrame) -> DataFrame:
    """(doc_id, path, line, field, parent, name, kind, value, number): every scalar of every record, by dotted path."""
    key = ["doc_id", "path", "line"]
    spark = ledger.sparkSession
    level = parsed(ledger).where("problem IS NULL").select(*key, F.lit("").alias("field"), F.lit("").alias("parent"), F.lit("").alias("name"), "v")
    kind = F.expr("schema_of_variant(v)")

    def scalars(rows: DataFrame) -> DataFrame:
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.expr("try_variant_get(v, '$', 'double')"))
        return rows.select(*key, "field", "parent", "name", kind.alias("kind"), F.expr("try_variant_get(v, '$', 'string')").alias("value"), number.alias("number"))

    out = None
    for _ in range(DEPTH):
        level = level.select(*key, F.col("field").alias("f"), F.col("name").alias("p"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce("key", F.col("p"))
        field = F.when(F.col("key").isNull(), F.concat("f", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("f") == "", F.col("key")).otherwise(F.concat_ws(".", "f", "key"))
        parent = F.when(F.col("key").isNull(), F.col("p")).otherwise(F.regexp_replace(F.regexp_extract("f", "([^.]*)$", 1), "(\\[\\d+\\])+$", ""))
        level = level.select(*key, field.alias("field"), parent.alias("parent"), name.alias("name"), F.col("value").alias("v"))
        nested = kind.rlike("^(OBJECT|ARRAY)")
        scalar = scalars(level.where(~nested))
        out = scalar if out is None else out.unionByName(scalar)
        level = level.where(nested)
    types = {f.name: f.dataType.simpleString() for f in ledger.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in key) + ", field string, parent string, name string, j string"
    deep = level.select(*key, "field", "parent", "name", F.to_json("v").alias("j")).mapInPandas(_deep, schema)
    out = out.unionByName(scalars(deep.select(*key, "field", "parent", "name", F.try_parse_json("j").alias("v"))))
    return out.where("number IS NULL OR (NOT isnan(number) AND abs(number) < double('infinity'))")


def records(ledger: DataFrame) -> DataFrame:
    """(doc_id, path, line, trial, status, role): the trial's name, the status in lower case, and baseline, confirmation, candidate or failed."""
    get = lambda n: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(v, '$.{n}', 'variant')) = 'STRING' THEN try_variant_get(v, '$.{n}', 'string') END")
    rows = parsed(ledger).where("problem IS NULL").select("doc_id", "path", "line", F.coalesce(get("trial"), get("run_type"), get("role"), F.lit("")).alias("trial"), F.lower(F.trim(F.coalesce(get("status"), F.lit("")))).alias("status"))
    failed = F.col("status").isin(*P.FAILED_STATUSES)
    any_failed = failed | F.col("status").rlike("^(?:" + "|".join(P.FAILED_STATUSES) + ")ed")
    baseline = F.replace(F.col("trial"), F.lit("_"), F.lit("-")).rlike("(?i)\\bbaseline\\b")
    confirmation = F.col("trial").rlike(P.CONFIRMATION) & ~any_failed
    return rows.withColumn("role", F.when(baseline, "baseline").when(confirmation, "confirmation").when(~failed, "candidate").otherwise("failed"))


def metric_values(ledger: DataFrame, leaves_: DataFrame | None = None, records_: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, line, metric, number, trial, status, role): numeric leaves by name, but for fields that are no metrics."""
    numeric = (leaves(ledger) if leaves_ is None else leaves_).where("number IS NOT NULL").select("doc_id", "path", "line", label(F.col("name")).alias("metric"), "number")
    return numeric.where(~F.col("metric").isin(*P.NON_METRIC_FIELDS) & (F.col("metric") != "")).join(records(ledger) if records_ is None else records_, ["doc_id", "path", "line"])


def scope(ledger: DataFrame) -> DataFrame:
    """(doc_id, trial_count, seed_count, gpu_type_count, benchmark_count, metric_count, confirmation_runs): what the records cover."""
    every = leaves(ledger).select("doc_id", label(F.col("name")).alias("name"), label(F.col("parent")).alias("parent"), "kind", "number", F.trim("value").alias("value"))
    filled = (F.col("value") != "") & ~F.col("kind").isin("BOOLEAN", "VOID")
    canonical = F.when(F.col("number").isNotNull() & (F.col("number") == F.floor("number")), F.col("number").cast("bigint").cast("string")).when(F.col("value").rlike("^[+-]?\\d+$"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value"))
    one = lambda names: F.when(filled & F.col("name").isin(*names), canonical)
    metric = F.when(F.col("number").isNotNull() & (F.col("name") != "") & ~F.col("name").isin(*P.SCOPE_NON_METRICS) & ((F.col("parent") == "") | F.col("parent").isin(*P.METRIC_CONTAINERS)), F.col("name"))
    named = F.when(filled & F.col("name").isin("metric", "metric_name", "measure", "measure_name"), label(F.col("value")))
    counts = every.groupBy("doc_id").agg(
        F.count_distinct(one(P.SEED_FIELDS)).alias("seed_count"), F.count_distinct(one(P.GPU_FIELDS)).alias("gpu_type_count"),
        F.count_distinct(one(P.BENCHMARK_FIELDS)).alias("benchmark_count"), F.count_distinct(F.coalesce(metric, named)).alias("metric_count"),
    )
    runs = records(ledger).groupBy("doc_id").agg(F.count("*").alias("trial_count"), F.count_if(F.col("trial").rlike(P.CONFIRMATION) & ~F.col("status").isin(*P.FAILED_STATUSES)).alias("confirmation_runs"))
    return runs.join(counts, "doc_id", "left").select("doc_id", "trial_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seed_count", "gpu_type_count", "benchmark_count", "metric_count")], "confirmation_runs")
