"""The manuscript as tables: lines, headings, sections, tables with their cells, numbers.

Papers come as (doc_id, text); every table is keyed by doc_id and line. One window per
document over its lines gives offsets, sections and islands; nothing is joined by range.
Null texts have no lines; a final line break ends no further line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P


def _before(offset: int = -1) -> Window:
    return Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, offset)


def fence_spans(lines: Column) -> Column:
    """Pairs (from, to) of 1-based lines in fenced code: opened by three or more marks, closed by as many of the same."""
    marks = F.filter(
        F.transform(lines, lambda t, i: F.named_struct(F.lit("at"), i + 1, F.lit("mark"), F.regexp_extract(t, P.FENCE, 1))), lambda m: m["mark"] != ""
    )
    state_ = lambda at, mark, spans: F.named_struct(F.lit("open"), at, F.lit("mark"), mark, F.lit("spans"), spans)
    span = lambda a, b: F.array(F.named_struct(F.lit("a"), a, F.lit("b"), b))
    start = state_(F.lit(0), F.lit(""), F.array().cast("array<struct<a:int,b:int>>"))

    def step(state: Column, m: Column) -> Column:
        opens = state_(m["at"], m["mark"], state["spans"])
        closes = state_(F.lit(0), F.lit(""), F.concat(state["spans"], span(state["open"], m["at"])))
        same = (F.left(m["mark"], F.lit(1)) == F.left(state["mark"], F.lit(1))) & (F.length(m["mark"]) >= F.length(state["mark"]))
        return F.when(state["open"] == 0, opens).when(same, closes).otherwise(state)

    def done(state: Column) -> Column:
        return F.when(state["open"] > 0, F.concat(state["spans"], span(state["open"], F.size(lines)))).otherwise(state["spans"])

    return F.aggregate(marks, start, step, done)


def lines(papers: DataFrame) -> DataFrame:
    """(doc_id, line, text, offset, fenced): 1-based lines with 0-based code-point offsets."""
    text = F.col("text")
    bare = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    split = papers.where("text IS NOT NULL").select("doc_id", F.split(bare, "\n", -1).alias("l"))
    inside = lambda x, i: F.exists(x["spans"], lambda s: (i + 1).between(s["a"], s["b"]))
    # an array of one binds lines and spans, so that the spans are found once for a text and not once for a line
    each = F.transform(F.array(F.struct("l", fence_spans(F.col("l")).alias("spans"))), lambda x: F.transform(x["l"], lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), inside(x, i).alias("fenced"))))
    rows = split.select("doc_id", F.inline(F.flatten(each)))
    offset = F.coalesce(F.sum(F.length("text") + 1).over(_before()), F.lit(0))
    return rows.withColumn("offset", offset.cast("long")).withColumn("text", F.regexp_replace("text", "\\r$", ""))


def headings(lines_: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, content_line): ATX headings, and lines underlined by = or -."""
    order = Window.partitionBy("doc_id").orderBy("line")
    seen = lines_.select(
        "doc_id", "line", "text", "fenced", F.lead("text").over(order).alias("next"), F.coalesce(F.lead("fenced").over(order), F.lit(True)).alias("next_fenced")
    )
    atx = ~F.col("fenced") & F.col("text").rlike(P.ATX_HEADING)
    under = ~F.col("fenced") & ~atx & ~F.col("next_fenced") & F.col("text").rlike("\\S") & F.coalesce(F.col("next").rlike(P.SETEXT_HEADING), F.lit(False))
    marked = seen.withColumn("atx", atx).withColumn("under", under)
    free = ~F.coalesce(F.lag("under").over(order), F.lit(False))  # an underline is no heading of its own
    found = marked.withColumn("free", free).where("atx OR (under AND free)")
    return found.select(
        "doc_id", "line",
        F.when(F.col("atx"), F.length(F.regexp_extract("text", P.ATX_HEADING, 2))).when(F.col("next").rlike("^ {0,3}="), 1).otherwise(2).alias("level"),
        F.trim(F.when(F.col("atx"), F.regexp_extract("text", P.ATX_HEADING, 3)).otherwise(F.col("text"))).alias("title"),
        (F.col("line") + F.when(F.col("atx"), 1).otherwise(2)).alias("content_line"),
    )


def sections(lines_: DataFrame) -> DataFrame:
    """(doc_id, section, parent, level, title, heading_line, line_start, line_end): section 0 is what stands before the first heading."""
    order = Window.partitionBy("doc_id").orderBy("line")
    heads = headings(lines_)
    last = lines_.groupBy("doc_id").agg(F.max("line").alias("last"))
    first = lines_.join(heads.groupBy("doc_id").agg(F.min("line").alias("first")), "doc_id", "left").where("first IS NULL OR line < first")
    opening = first.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike("\\S")).alias("filled"), F.max("line").alias("line_end"), F.max("first").alias("first")).where("filled OR first IS NULL")
    opening = opening.select(
        "doc_id", F.lit(0).alias("section"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("level"),
        F.when(F.col("first").isNull(), "Document").otherwise("Preamble").alias("title"), F.lit(None).cast("int").alias("heading_line"), F.lit(1).alias("line_start"), "line_end",
    )
    ranked = heads.join(opening.select("doc_id", F.lit(1).alias("shift")), "doc_id", "left").join(last, "doc_id")
    ranked = ranked.withColumn("section", (F.row_number().over(order) - 1 + F.coalesce("shift", F.lit(0))).cast("int"))
    # a heading has one of six levels: the nearest of a higher rank is the latest of the last ones of those ranks
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("section"))).over(before)) for k in range(1, 6)]
    nested = ranked.select(
        "doc_id", "section", F.greatest(*last_of).alias("parent"), "level", "title", F.col("line").alias("heading_line"),
        F.col("content_line").alias("line_start"), (F.coalesce(F.lead("line").over(order), F.col("last") + 1) - 1).alias("line_end"),
    )
    return opening.unionByName(nested)


def section_of_lines(lines_: DataFrame, sections_: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, text, offset, fenced, section, title): the last section that began at or before the line."""
    starts = (sections(lines_) if sections_ is None else sections_).select("doc_id", F.coalesce("heading_line", F.lit(1)).alias("line"), F.struct("section", "title").alias("s"))
    return lines_.join(starts, ["doc_id", "line"], "left").withColumn("s", F.last("s", True).over(_before(0))).select(*lines_.columns, F.col("s.section").alias("section"), F.col("s.title").alias("title"))


def row_cells(line: Column) -> Column:
    """The cells of a table row: bars split, but not escaped ones and not those in inline code."""
    inner = F.regexp_replace(F.trim(line), "^\\||(?<!\\\\)\\|$", "")
    hidden = F.array_join(
        F.transform(F.regexp_extract_all(inner, F.lit("`[^`]*(?:`|$)|\\\\.|[^`\\\\]+|\\\\$"), F.lit(0)), lambda t: F.when(t.rlike("^[`\\\\]"), F.replace(t, F.lit("|"), F.lit("\ue003"))).otherwise(t)), ""
    )
    plain = F.transform(F.split(inner, "\\|", -1), lambda c: F.trim(c))
    careful = F.transform(F.split(hidden, "\\|", -1), lambda c: F.replace(F.trim(F.replace(c, F.lit("\ue003"), F.lit("|"))), F.lit("\\|"), F.lit("|")))
    return F.when(inner.contains("`") | inner.contains("\\"), careful).otherwise(plain)


def table_lines(lines_: DataFrame) -> DataFrame:
    """(doc_id, table_no, line, kind, cells): header, delimiter and row lines of every table."""
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = lines_.select("doc_id", "line", "text", "fenced", F.when(F.col("text").contains("|"), row_cells(F.col("text"))).alias("cells"))
    delimiter = F.coalesce(F.forall("cells", lambda c: c.rlike(P.DELIMITER_CELL)) & ~F.col("fenced"), F.col("text").rlike("^\\s*:?-{3,}:?\\s*$") & ~F.col("fenced"))
    rows = rows.withColumn("delimiter", delimiter).withColumn("next_delimiter", F.lead("delimiter").over(order)).withColumn("next_cells", F.lead("cells").over(order))
    head = F.coalesce(F.col("next_delimiter") & ~F.col("fenced") & F.col("cells").isNotNull() & (F.size("cells") == F.size(F.coalesce("next_cells", F.array(F.lit(""))))), F.lit(False))
    rows = rows.withColumn("head", head & ~F.coalesce(F.lag(head).over(order), F.lit(False)))
    since = F.last(F.when(F.col("head"), F.struct("line", F.size("cells").alias("n"))), True).over(_before(0))
    rows = rows.withColumn("h", since).where("h IS NOT NULL")
    fits = (F.col("line") <= F.col("h.line") + 1) | (F.col("cells").isNotNull() & ~F.col("fenced") & (F.size("cells") == F.col("h.n")))
    inside = Window.partitionBy("doc_id", "h.line").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("ok", F.min(fits.cast("int")).over(inside)).where("ok = 1")
    numbered = kept.withColumn("table_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("h.line")) - 1)
    kind = F.when(F.col("line") == F.col("h.line"), "header").when(F.col("line") == F.col("h.line") + 1, "delimiter").otherwise("row")
    return numbered.select("doc_id", "table_no", "line", kind.alias("kind"), "cells")


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, line, column_no, header, alignment, cell) of the rows."""
    key = ["doc_id", "table_no"]
    heads = tables.where("kind = 'header'").select(*key, F.col("cells").alias("header"))
    left, right = lambda c: c.startswith(":"), lambda c: c.endswith(":")
    sides = tables.where("kind = 'delimiter'").select(
        *key, F.transform("cells", lambda c: F.when(left(c) & right(c), "center").when(left(c), "left").when(right(c), "right").otherwise("default")).alias("alignment")
    )
    rows = tables.where("kind = 'row'").join(heads, key).join(sides, key)
    zipped = rows.select(*key, "line", F.posexplode(F.arrays_zip("header", "alignment", "cells")).alias("column_no", "z"))
    return zipped.select(*key, "line", "column_no", F.col("z.header").alias("header"), F.col("z.alignment").alias("alignment"), F.col("z.cells").alias("cell"))


def matches(text: Column, pattern: str) -> Column:
    """Every match with its 1-based first and last column: array of (token, column_start, column_end); one pass from left to right."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    none = F.array().cast("array<struct<token:string,column_start:int,column_end:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = (start + F.length(x["token"])).cast("int")
        one = F.array(F.struct(x["token"].alias("token"), (start + 1).cast("int").alias("column_start"), end.alias("column_end")))
        return F.when(x["token"].isNull(), done).otherwise(F.struct(end.alias("at"), F.concat(done["found"], one).alias("found")))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda done: done["found"])


def numbers(placed: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, number_no, token, normalized, kind, line, column_start, column_end, offset_start, section, table_no, ordinal). placed: section_of_lines.

    ordinal: whether the number is the tail of a name such as "A-3"."""
    inside = tables.groupBy("doc_id", "line").agg(F.min("table_no").alias("table_no"))
    at = F.col("m.column_start")
    ordinal = (at >= 3) & F.coalesce(F.substring("text", at - 2, F.lit(2)).rlike("^[\\p{L}\\p{N}][-–—]$"), F.lit(False))
    rows = placed.where(F.col("text").rlike("\\d")).select("doc_id", "line", "text", "offset", "section", F.explode(matches(F.col("text"), P.NUMBER)).alias("m"))
    rows = rows.select("doc_id", "line", "offset", "section", "m", ordinal.alias("ordinal"))
    compact = F.translate(F.trim("m.token"), "−", "-")
    rows = rows.join(inside, ["doc_id", "line"], "left")
    return rows.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "m.column_start")) - 1).alias("number_no"), "m.token",
        F.replace(F.rtrim(F.regexp_replace(compact, "%$", "")), F.lit(","), F.lit("")).alias("normalized"), F.when(compact.endswith("%"), "percentage").otherwise("number").alias("kind"),
        "line", "m.column_start", "m.column_end", (F.col("offset") + F.col("m.column_start") - 1).alias("offset_start"), "section", "table_no", "ordinal",
    )


def loose_sentences(placed: DataFrame) -> DataFrame:
    """(doc_id, line, section, title, sentence, column_start, column_end) of lines without bars, cut at every mark."""
    rows = placed.where(F.col("text").rlike("\\S") & ~F.col("text").contains("|")).select("doc_id", "line", "section", "title", F.explode(matches(F.col("text"), P.LOOSE_SENTENCE)).alias("m"))
    lead = F.length(F.regexp_extract("m.token", "^\\s*", 0))
    return rows.select("doc_id", "line", "section", "title", F.regexp_replace("m.token", "^\\s+|\\s+$", "").alias("sentence"), (F.col("m.column_start") + lead).alias("column_start"), "m.column_end").where("sentence != ''")
