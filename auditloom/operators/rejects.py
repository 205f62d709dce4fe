"""Rows that fail to parse: typed rows apart from rejects with the reason.

Ledger lines come unparsed. A line of a delimited file is cut into cells, a JSON
line is read as a variant; the cells are exploded into (row, column, value), a
rule table is joined on the column name, the broken rules are aggregated to the
first reason of each row, and the valid rows are what an anti-join leaves.

Defined results
* null raw_line: rejected as ``syntax``; an empty line is one empty field.
* null ledger_path, or an extension other than csv/tsv: read as JSON.
* a delimited file without a header line: its lines are rejected as ``columns``.
* a header with broken quoting names no columns: its lines fail as ``columns``.
* several deliveries of a header line: the smallest line_id counts.
* null line_no: not a header. An empty table gives empty results.
* further columns of the input are ignored; a line delivered twice under two
  line_ids is two lines, the same line_id twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import checkpoint_dir

REASONS = ("syntax", "columns", "value")
FIELDS = ("trial", "status", "accuracy")
STATUSES = ("keep", "discard", "crash")
#: A header is copied this often, and lines pick a copy, so that one huge file spreads over tasks.
SALTS = 16
_MARK = "\ue001"  # with b behind it stands for a separator inside quotes while a line is cut, with a for a mark of the line's own

_DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def quoting_ok(line: Column, sep: Column) -> Column:
    """Whether RFC 4180 quoting holds: quotes open after a separator, close before one, and are doubled inside."""
    parts = F.split(line, '"', -1)
    n = F.size(parts)
    last = n - 1

    def fits(part: Column, i: Column) -> Column:
        opens = (i == last) | part.endswith(sep) | ((part == "") & (i >= 0))
        closes = (i == 0) | part.startswith(sep) | (part == "")
        return (i % 2 == 1) | (opens & closes)

    return F.when(n == 1, F.lit(True)).otherwise((n % 2 == 1) & F.forall(F.transform(parts, fits), lambda ok: ok))


def cells_of(line: Column, sep: Column) -> Column:
    """The fields of a line whose quoting holds, unquoted and without surrounding spaces."""
    shielded = F.array_join(
        F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit(_MARK), F.lit(_MARK + "a")), sep, F.lit(_MARK + "b"))).otherwise(p)), '"'
    )

    def bare(cell: Column) -> Column:
        inner = F.replace(F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')), F.lit(_MARK + "b"), sep)
        inner = F.replace(inner, F.lit(_MARK + "a"), F.lit(_MARK))
        return F.trim(F.when(cell.startswith('"'), inner).otherwise(cell))

    plain = F.transform(F.split(line, F.concat(F.lit("["), sep, F.lit("]")), -1), lambda c: F.trim(c))
    quoted = F.transform(F.split(shielded, F.concat(F.lit("["), sep, F.lit("]")), -1), bare)
    return F.when(F.instr(line, '"') == 0, plain).otherwise(quoted)


def _delimited(lines: DataFrame) -> DataFrame:
    """line_id, reason so far, cells (row, column, value) of csv and tsv lines, as name/value/kind arrays."""
    sep = F.when(F.col("kind") == "tsv", F.lit("\t")).otherwise(F.lit(","))
    parsed = lines.where(F.col("kind") != "json").withColumn("sep", sep).withColumn("ok", F.coalesce(quoting_ok(F.col("raw_line"), F.col("sep")), F.lit(False)))
    head = (
        parsed.where(F.col("line_no") == 1)
        .groupBy("ledger_path")
        .agg(F.min_by(F.struct("raw_line", "sep", "ok"), "line_id").alias("h"))
        .select("ledger_path", F.when(F.col("h.ok"), cells_of(F.col("h.raw_line"), F.col("h.sep"))).alias("names"))
        .select("ledger_path", "names", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    body = parsed.where(~F.coalesce(F.col("line_no") == 1, F.lit(False))).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int"))
    joined = body.join(head, ["ledger_path", "salt"], "left")
    cells = F.when(F.col("ok"), cells_of(F.col("raw_line"), F.col("sep")))
    return joined.withColumn("cells", cells).select(
        "line_id",
        F.when(~F.col("ok"), "syntax")
        .when(F.col("names").isNull() | (F.size("cells") != F.size("names")) | ~F.forall(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(F.col("names"), f)), "columns")
        .alias("gate"),
        F.transform(
            F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("v")),
            lambda x: F.struct(x["n"].alias("column"), x["v"].alias("value"), F.when(x["v"] == "", "empty").otherwise("text").alias("kind")),
        ).alias("cells"),
    )


def _json(lines: DataFrame) -> DataFrame:
    """The same for lines that hold one JSON value each.

    A line is one strict JSON value if it still parses as the only element of an array
    and as the only member of an object. Repeated names in an object are no syntax
    error; the last one counts, for which the session must let variants hold them.
    """
    raw = F.col("raw_line")
    parsed = lines.where(F.col("kind") == "json").select(
        "line_id",
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).alias("a"),
        F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).alias("o"),
    )
    one = F.col("a").isNotNull() & F.col("o").isNotNull()

    def field(path: str, name: str) -> Column:
        kind = F.expr(f"schema_of_variant(try_variant_get(o, '{path}', 'variant'))")
        value = F.expr(f"try_variant_get(o, '{path}', 'string')")
        return F.when(
            kind.isNotNull(),
            F.struct(
                F.lit(name).alias("column"),
                value.alias("value"),
                F.when(kind == "VOID", "empty").when(kind == "STRING", "string").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("other").alias("kind"),
            ),
        )

    return (
        parsed.withColumn("one", one)
        .withColumn(
            "cells",
            F.when(
                F.col("one") & F.expr("schema_of_variant(try_variant_get(o, '$.v', 'variant')) LIKE 'OBJECT%'"),
                F.array_compact(F.array(field("$.v.trial", "trial"), field("$.v.status", "status"), F.coalesce(field("$.v.accuracy", "accuracy"), field("$.v.metrics.accuracy", "accuracy")))),
            ),
        )
        .select(
            "line_id",
            F.when(~F.col("one"), "syntax").when(F.col("cells").isNull() | (F.size("cells") < 3), "columns").alias("gate"),
            "cells",
        )
    )


def rule_table(spark) -> DataFrame:
    """One rule per (column, kind of value); three columns and five kinds bound it."""
    rows = [(c, k, r) for c, k, r in (
        ("trial", "text", "filled"), ("trial", "string", "filled"), ("trial", "empty", "never"), ("trial", "number", "never"), ("trial", "other", "never"),
        ("status", "text", "status"), ("status", "string", "status"), ("status", "empty", "never"), ("status", "number", "never"), ("status", "other", "never"),
        ("accuracy", "text", "percent"), ("accuracy", "empty", "always"), ("accuracy", "number", "percent"), ("accuracy", "string", "never"), ("accuracy", "other", "never"),
    )]
    return spark.createDataFrame(rows, "column string, kind string, rule string")


def parse_lines(ledger: DataFrame) -> DataFrame:
    """(line_id, gate, cells) for every line but headers; gate is null where the cells may be validated."""
    ledger.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    path = F.lower(F.coalesce("ledger_path", F.lit("")))
    lines = ledger.select(
        "line_id", "ledger_path", "line_no", "raw_line",
        F.when(path.endswith(".csv"), "csv").when(path.endswith(".tsv"), "tsv").otherwise("json").alias("kind"),
    )
    return _delimited(lines).unionByName(_json(lines))


def checked(ledger: DataFrame) -> DataFrame:
    """(line_id, column, value, kind, reason): every parsed line as its cells, each with the reason that it gives, or null;
    a line whose cells can't be judged is one row with its reason and no column. The lines are parsed once."""
    each = parse_lines(ledger).select("line_id", "gate", F.explode_outer(F.when(F.col("gate").isNull(), F.col("cells"))).alias("c")).select("line_id", "gate", "c.*")
    ruled = each.join(F.broadcast(rule_table(ledger.sparkSession)), ["column", "kind"], "left")
    return ruled.select("line_id", "column", "value", "kind", F.coalesce("gate", F.when(F.col("rule").isNotNull() & ~_holds(), "value")).alias("reason"))


def first_reason(reason: Column) -> Column:
    """The first reason of a group that applies; null where none does."""
    return F.min_by(reason, F.when(reason.isNotNull(), F.array_position(F.array(*map(F.lit, REASONS)), reason)))


def rejected(ledger: DataFrame) -> DataFrame:
    """(line_id, reason): one row per line that fails, with the first reason that applies."""
    return checked(ledger).where("reason IS NOT NULL").groupBy("line_id").agg(first_reason(F.col("reason")).alias("reason"))


def _holds() -> Column:
    value, rule = F.col("value"), F.col("rule")
    number = F.when(value.rlike(_DECIMAL), value.try_cast("double"))
    return F.coalesce(
        F.when(rule == "always", F.lit(True))
        .when(rule == "filled", ~value.rlike(r"^\s*$"))
        .when(rule == "status", F.lower(value).isin(*STATUSES))
        .when(rule == "percent", number.between(0.0, 100.0))
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def experiments(ledger: DataFrame) -> DataFrame:
    """(line_id, trial, status, accuracy) of the valid lines, typed; the lines that an anti-join with the rejects leaves.

    Cells and rejects come from one parse, written to the shared folder of checkpoints."""
    checkpoint_dir(ledger.sparkSession)
    cells = checked(ledger).where(F.col("reason").isNotNull() | F.col("column").isin(*FIELDS)).checkpoint()
    wrong = cells.where("reason IS NOT NULL").select("line_id").distinct()
    one = lambda name: F.max(F.when(F.col("column") == name, F.col("value")))
    wide = cells.where("reason IS NULL").join(wrong, "line_id", "left_anti").groupBy("line_id").agg(*[one(n).alias(n) for n in FIELDS])
    return wide.select("line_id", F.trim("trial").alias("trial"), F.lower("status").alias("status"), F.col("accuracy").try_cast("double").alias("accuracy"))
