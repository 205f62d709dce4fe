"""Numbers of a manuscript against its ledger, its tables and its own arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P
from auditloom.operators.ledger import label, last_name
from auditloom.operators import manuscript as M
from auditloom.session import merged

_DECIMAL = "decimal(30,12)"


def tolerance(normalized: Column) -> Column:
    """Half a unit in the last place that is shown."""
    low = F.lower(normalized)
    mantissa = F.substring_index(low, "e", 1)
    exponent = F.coalesce(F.regexp_extract(low, "e([+-]?\\d+)$", 1).try_cast("int"), F.lit(0))
    decimals = F.when(mantissa.contains("."), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
    return F.lit(0.5) * F.pow(F.lit(10.0), exponent - decimals)


def agrees(normalized: Column, value: Column) -> Column:
    """Whether a shown number rounds to the value; the edge counts."""
    # both sides carry binary noise far below any shown place
    return F.coalesce(F.abs(normalized.try_cast("double") - value) <= tolerance(normalized) * (1 + 1e-9), F.lit(False))


def trial_of(context: Column) -> Column:
    low = F.replace(F.lower(context), F.lit("_"), F.lit("-"))
    numbered = F.regexp_extract(low, "\\bcandidate-(\\d+)\\b", 1)
    return (
        F.when(numbered != "", F.concat(F.lit("candidate-"), numbered)).when(low.rlike("\\bwinner[- ]confirmation\\b"), "winner-confirmation")
        .when(low.rlike("\\bbaseline\\b"), "baseline").when(low.rlike("\\bcandidate\\b"), "candidate").when(low.rlike("\\bconfirmation\\b"), "winner-confirmation")
    )


def same_trial(shown: Column, logged: Column) -> Column:
    return shown.isNull() | (logged.isNotNull() & F.when(shown == "candidate", logged.startswith("candidate")).otherwise(shown == logged))


def aliases(name: Column) -> Column:
    """How a metric may be written: with underscores, spaces or hyphens; a percentage also without the word."""
    plain = label(name)
    base = F.regexp_replace(plain, "_percent$", "")
    ways = F.array(plain, F.replace(plain, F.lit("_"), F.lit(" ")), F.replace(plain, F.lit("_"), F.lit("-")))
    return F.array_distinct(F.when(plain.endswith("_percent"), F.concat(ways, F.array(base, F.concat(base, F.lit(" percent")), F.concat(base, F.lit(" percentage"))))).otherwise(ways))


#: A number and a mention are within NEAR characters of each other, or have nothing to do with one another; the width of a piece of a line.
NEAR, PIECE = 32, 64


def mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, line, field, at, size): where a line names a metric. lines: (doc_id, line, text); names: (doc_id, field, alias).

    Words of a line meet the names that begin with them; what follows is compared at that place."""
    words = lines.select("doc_id", "line", F.lower("text").alias("low")).select("doc_id", "line", "low", F.explode(M.matches(F.col("low"), "[a-z0-9]+")).alias("m"))
    longest = names.groupBy("doc_id").agg(F.max(F.length("alias")).alias("longest"))
    ahead = words.join(longest, "doc_id").select("doc_id", "line", F.col("m.token").alias("word"), F.col("m.column_start").alias("at"), F.substring("low", F.col("m.column_start"), F.col("longest") + 1).alias("ahead"))
    met = ahead.join(names.withColumn("word", F.regexp_extract("alias", "^[a-z0-9]+", 0)), ["doc_id", "word"]).where(F.startswith("ahead", F.col("alias")))
    free = ~F.substring("ahead", F.length("alias") + 1, F.lit(1)).rlike("[a-z0-9]")
    return met.where(free).select("doc_id", "line", "field", "at", F.length("alias").alias("size"))


def names_of(fields: DataFrame) -> DataFrame:
    return merged(fields.select("doc_id", "field", F.explode(aliases(last_name(F.col("field")))).alias("alias")).distinct())


def result_mentions(placed: DataFrame, fields: DataFrame) -> DataFrame:
    """The mentions in lines with numbers that tell of results."""
    text = F.col("text")
    told = placed.where(text.rlike("\\d") & ~text.rlike(P.NON_RESULT_CONTEXT) & (F.coalesce(F.col("title"), F.lit("")).rlike(P.RESULT_SECTION) | text.rlike(P.RESULT_LANGUAGE)))
    return mentions(told.select("doc_id", "line", "text"), names_of(fields))


def labelled(numbers: DataFrame, placed: DataFrame, tables: DataFrame, fields: DataFrame, spoken: DataFrame) -> DataFrame:
    """(doc_id, number_no, metric, source, trial, normalized, kind, line, column_start, column_end): numbers that a metric names.

    fields: (doc_id, field), the metrics that each document may name; spoken: result_mentions of these or more. In a table the column's
    header names it, in prose of results the nearest mention within NEAR characters."""
    usable = numbers.where("NOT ordinal").select("doc_id", "number_no", "normalized", "kind", "line", "column_start", "column_end", "table_no")
    names = names_of(fields)
    cells = M.table_cells(tables).select("doc_id", "table_no", "line", "column_no", "header", "cell")
    row = tables.where("kind = 'row'").select("doc_id", "table_no", "line", trial_of(F.array_join("cells", " ")).alias("row_trial"), F.lit(True).alias("in_row"))
    own = usable.where("table_no IS NOT NULL").join(cells, ["doc_id", "table_no", "line"]).where(F.replace(F.translate("cell", "−", "-"), F.lit(","), F.lit("")).contains(F.col("normalized")))
    first = own.groupBy("doc_id", "number_no").agg(F.min_by("header", "column_no").alias("header"))
    known = names.select("doc_id", F.col("alias").alias("metric")).distinct()
    by_table = first.withColumn("metric", label(last_name(F.col("header")))).join(known, ["doc_id", "metric"], "left_semi").select("doc_id", "number_no", "metric", F.lit("table").alias("source"))
    text = F.col("text")
    spoken = spoken.join(fields, ["doc_id", "field"], "left_semi")
    prose = usable.join(by_table.select("doc_id", "number_no"), ["doc_id", "number_no"], "left_anti")
    piece = lambda c: F.floor(c / PIECE).cast("int")
    a = prose.withColumn("piece", F.explode(F.sequence(piece(F.col("column_start") - NEAR), piece(F.col("column_end") + NEAR))))
    b = spoken.withColumn("piece", F.explode(F.sequence(piece(F.col("at")), piece(F.col("at") + F.col("size")))))
    gap = F.greatest(F.col("at") - 1 - F.col("column_end"), F.col("column_start") - F.col("at") - F.col("size"), F.lit(0))
    near = merged(a).join(b, ["doc_id", "line", "piece"]).withColumn("gap", gap).where(F.col("gap") <= NEAR)
    by_prose = near.groupBy("doc_id", "number_no").agg(F.min_by("field", F.struct("gap", "field")).alias("field")).select("doc_id", "number_no", label(last_name(F.col("field"))).alias("metric"), F.lit("prose").alias("source"))
    both = by_table.unionByName(by_prose).where(~F.col("metric").isin(*P.DERIVED_LABELS)).join(usable, ["doc_id", "number_no"]).join(row, ["doc_id", "table_no", "line"], "left")
    of_line = placed.where(text.rlike("\\d")).select("doc_id", "line", trial_of(text).alias("line_trial")).where("line_trial IS NOT NULL")
    return both.join(of_line, ["doc_id", "line"], "left").select(
        "doc_id", "number_no", "metric", "source", F.when(F.col("in_row"), F.col("row_trial")).otherwise(F.col("line_trial")).alias("trial"), "normalized", "kind", "line", "column_start", "column_end"
    )


def default_fields(papers: DataFrame) -> DataFrame:
    return merged(papers.select("doc_id", F.explode(F.array(*map(F.lit, P.DEFAULT_METRICS))).alias("field")).distinct())


def ledger_fields(leaves: DataFrame) -> DataFrame:
    """(doc_id, field) of the numeric leaves that may be results."""
    return leaves.where(F.col("number").isNotNull() & ~label(F.col("name")).isin(*P.NON_RESULT_FIELDS)).select("doc_id", F.col("name").alias("field")).distinct()


def ledger_trace(labelled_: DataFrame, leaves: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, number_no, metric, trial, normalized, line, column_start, column_end, candidates, matches, evidence, matched): each number against the values that its ledger has for metric and trial."""
    values = leaves.where("number IS NOT NULL").join(records.select("doc_id", "path", "line", F.when(F.col("trial") != "", F.col("trial")).alias("logged")), ["doc_id", "path", "line"])
    values = values.select("doc_id", F.explode(aliases(F.col("name"))).alias("metric"), "path", F.col("line").alias("ledger_line"), "field", "number", "logged")
    met = labelled_.join(values, ["doc_id", "metric"], "left").withColumn("fits", F.col("number").isNotNull() & same_trial(F.col("trial"), F.col("logged")))
    keys = ["doc_id", "number_no", "metric", "trial", "normalized", "line", "column_start", "column_end"]
    hit = F.col("fits") & agrees(F.col("normalized"), F.col("number"))
    shown = F.concat(F.col("path"), F.lit(":"), F.col("ledger_line").cast("string"), F.lit("#"), F.col("field"))
    return met.groupBy(*keys).agg(F.count_if("fits").alias("candidates"), F.count_if(hit).alias("matches"), F.sort_array(F.collect_set(F.when(hit, shown))).alias("evidence")).withColumn("matched", F.col("matches") > 0)


def consistency(labelled_: DataFrame) -> DataFrame:
    """(doc_id, number_no, metric, trial, line, column_start, column_end, shown, in_tables, matched): prose values that name a trial against the table values of the same metric and trial."""
    usable = labelled_.where("kind != 'percentage' AND trial IS NOT NULL")
    prose = usable.where("source = 'prose'")
    table = usable.where("source = 'table'").select("doc_id", "metric", "trial", F.col("normalized").alias("in_table"))
    met = prose.join(table, ["doc_id", "metric", "trial"])
    value = F.col("in_table").try_cast("double")
    either = agrees(F.col("normalized"), value) | agrees(F.col("in_table"), F.col("normalized").try_cast("double"))
    key = ["doc_id", "number_no", "metric", "trial", "line", "column_start", "column_end"]
    return met.groupBy(*key).agg(F.first("normalized").alias("shown"), F.sort_array(F.collect_set("in_table")).alias("in_tables"), F.bool_or(either).alias("matched"))


def pairs(labelled_: DataFrame, means: bool = False) -> DataFrame:
    """(doc_id, metric, baseline, candidate): the one baseline and the one candidate of a metric, or their means where both are repeated."""
    role = F.when(F.col("trial") == "baseline", "b").when(F.col("trial").startswith("candidate") | ((F.col("trial") == "winner-confirmation") & F.lit(not means)), "c")
    rows = labelled_.where("source = 'table' AND kind != 'percentage'").withColumn("role", role).withColumn("x", F.col("normalized").try_cast(_DECIMAL)).where("role IS NOT NULL AND x IS NOT NULL")
    both = rows.groupBy("doc_id", "metric").agg(
        F.count_if(F.col("role") == "b").alias("nb"), F.count_if(F.col("role") == "c").alias("nc"),
        F.avg(F.when(F.col("role") == "b", F.col("x"))).cast("double").alias("baseline"), F.avg(F.when(F.col("role") == "c", F.col("x"))).cast("double").alias("candidate"),
    )
    return both.where("nb >= 2 AND nc >= 2" if means else "nb = 1 AND nc = 1").select("doc_id", "metric", "baseline", "candidate")


def better_when_lower(placed: DataFrame, pairs_: DataFrame) -> DataFrame:
    """(doc_id, metric, lower): whether the text, or else custom, wants a metric low."""
    text = placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    alias = F.replace(F.col("metric"), F.lit("_"), F.lit("[ _-]"))
    down = F.expr("body rlike concat('(?i)(?:lower(?:s|ed|ing)?|reduce[sd]?|decrease[sd]?)\\\\s+`?', alias, '`?')")
    up = F.expr("body rlike concat('(?i)(?:higher|increase[sd]?|raise[sd]?)\\\\s+`?', alias, '`?')")
    custom = F.when(F.col("metric").isin(*P.LOWER_IS_BETTER), True).when(F.col("metric").isin(*P.HIGHER_IS_BETTER), False)
    return pairs_.join(text, "doc_id").withColumn("alias", alias).select("doc_id", "metric", F.when(down, True).when(up, False).otherwise(custom).alias("lower"))


def stated_changes(placed: DataFrame) -> DataFrame:
    """(doc_id, line, place, label, display, percent, line_text, column_start, column_end): deltas and improvements that the prose states."""
    rows = placed.where(~F.col("text").contains("|")).select("doc_id", "line", "text", F.posexplode(F.arrays_zip(
        M.matches(F.col("text"), P.ARITHMETIC_CLAIM).alias("t"), F.regexp_extract_all("text", F.lit(P.ARITHMETIC_CLAIM), F.lit(1)).alias("l"), F.regexp_extract_all("text", F.lit(P.ARITHMETIC_CLAIM), F.lit(2)).alias("v"))).alias("place", "m"))
    raw = F.trim(F.replace(F.translate("m.v", "−", "-"), F.lit(","), F.lit("")))
    start = F.col("m.t.column_end") - F.length("m.v") + 1  # the value ends what is stated
    return rows.select("doc_id", "line", "place", label(F.col("m.l")).alias("label"), F.trim(F.regexp_replace(raw, "%$", "")).alias("display"), raw.endswith("%").alias("percent"), F.col("text").alias("line_text"), start.cast("int").alias("column_start"), F.col("m.t.column_end").alias("column_end"))


def arithmetic(placed: DataFrame, labelled_: DataFrame) -> DataFrame:
    """(doc_id, line, place, metric, label, display, expected, column_start, column_end, matched): stated changes against the only pair they can mean, and ratios that a sentence states itself."""
    stated = stated_changes(placed)
    direct, mean = pairs(labelled_), pairs(labelled_, means=True)
    has = direct.select("doc_id").distinct().withColumn("direct", F.lit(True))
    offered = stated.join(has, "doc_id", "left")
    by_pair = offered.where("direct").join(direct, "doc_id").unionByName(
        offered.where(F.col("direct").isNull() & F.col("line_text").rlike("(?i)\\b(?:averag(?:e|ed|es|ing)|mean)\\b")).join(mean, "doc_id")
    )
    key = Window.partitionBy("doc_id", "line", "place")
    named = F.exists(aliases(F.col("metric")), lambda a: F.contains(F.lower("line_text"), a))
    many = by_pair.withColumn("n", F.count("*").over(key)).where((F.col("n") == 1) | named).withColumn("n", F.count("*").over(key)).where("n = 1")
    wanted = better_when_lower(placed, direct.unionByName(mean).select("doc_id", "metric").distinct())
    judged = many.join(wanted, ["doc_id", "metric"], "left")
    relative = F.col("percent") | F.col("label").rlike("relative|percent|improvement")
    change = F.col("candidate") - F.col("baseline")
    sign = F.when(F.col("label").contains("improvement") & F.col("lower"), -1.0).otherwise(1.0)
    expected = F.when(~relative, change).when(F.col("baseline") != 0, sign * change / F.abs("baseline") * F.when(F.col("percent"), 100.0).otherwise(1.0))
    own = judged.withColumn("expected", expected).where("expected IS NOT NULL").select("doc_id", "line", "place", "metric", "label", "display", "expected", "column_start", "column_end")
    return own.unionByName(stated_ratios(placed)).withColumn("matched", agrees(F.col("display"), F.col("expected")))


def paragraphs(placed: DataFrame) -> DataFrame:
    """(doc_id, text, lines): lines of prose that follow each other, joined by spaces; lines: array of (line, n), the length of each."""
    order = Window.partitionBy("doc_id").orderBy("line")
    breaks = ~F.col("text").rlike("\\S") | F.col("text").contains("|")
    grouped = placed.withColumn("gap", F.sum(breaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~breaks)
    each = grouped.groupBy("doc_id", "gap").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return each.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.transform("l", lambda x: F.struct(x["line"].alias("line"), F.length(x["text"]).alias("n"))).alias("lines"))


def stated_ratios(placed: DataFrame) -> DataFrame:
    """Changes "from a to b ... of z%" within a paragraph, where z stands; the columns of stated changes."""
    get = lambda n: F.regexp_extract_all("text", F.lit(P.FROM_TO), F.lit(n))
    zipped = F.arrays_zip(M.matches(F.col("text"), P.FROM_TO).alias("t"), get(1).alias("a"), get(2).alias("b"), get(3).alias("k"), get(4).alias("z"))
    rows = paragraphs(placed).where(F.col("text").rlike(P.FROM_TO)).select("doc_id", "lines", F.posexplode(zipped).alias("place", "m"))
    z = F.col("m.t.column_end") - F.length(F.regexp_extract("m.t.token", "(\\d[\\d,]*(?:\\.\\d+)?)\\s*%$", 0))
    begun = lambda d, x: F.struct((d["to"] + x["n"] + 1).alias("to"), F.when(d["to"] <= F.col("z"), x["line"]).otherwise(d["line"]).alias("line"), F.when(d["to"] <= F.col("z"), d["to"]).otherwise(d["start"]).alias("start"))
    rows = rows.withColumn("z", z).withColumn("at", F.aggregate("lines", F.struct(F.lit(0).alias("to"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("start")), begun))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double")
    expected = F.when(number("m.a") != 0, F.abs(number("m.b") - number("m.a")) / F.abs(number("m.a")) * 100.0)
    start = (F.col("z") - F.col("at.start") + 1).cast("int")
    return rows.select(
        "doc_id", F.col("at.line").alias("line"), (F.col("place") + 1000).alias("place"), F.lit("prose-ratio").alias("metric"), label(F.col("m.k")).alias("label"),
        F.replace(F.col("m.z"), F.lit(","), F.lit("")).alias("display"), expected.alias("expected"), start.alias("column_start"), (start + F.length("m.z") - 1).cast("int").alias("column_end"),
    ).where("expected IS NOT NULL")
