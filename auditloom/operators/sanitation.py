"""Hidden content: blanked without moving a column, and scanned for instructions to reviewers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import patterns as P

#: Nested hidden elements are blanked so deep.
PASSES = 4
_ELEMENT = r"(?is)<([a-z][\w:-]*)\b[^>]*>.*?</\1\s*>"


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\r\\n]", " ")


def without_comments(text: Column) -> Column:
    """Comments become spaces; line breaks stay."""
    parts = F.regexp_extract_all(text, F.lit(P.HTML_COMMENT + "|[^<]+|<"), F.lit(0))
    return F.when(text.contains("<!--"), F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<!--"), _blank(p)).otherwise(p)), "")).otherwise(text)


def without_hidden_elements(text: Column) -> Column:
    """Elements that a style hides become spaces, nested ones as well."""
    for _ in range(PASSES):
        parts = F.regexp_extract_all(text, F.lit(_ELEMENT + "|[^<]+|<"), F.lit(0))
        hidden = lambda p: (F.length(p) > 1) & F.regexp_extract(p, "^<[^>]*>", 0).rlike(P.HIDDEN_STYLE)
        text = F.when(text.rlike(P.HIDDEN_STYLE), F.array_join(F.transform(parts, lambda p: F.when(hidden(p), _blank(p)).otherwise(p)), "")).otherwise(text)
    return text


def sanitized(text: Column) -> Column:
    """The text without hidden content and format characters."""
    return F.regexp_replace(without_hidden_elements(without_comments(text)), "\\p{Cf}", "")


def hidden_fragments(papers: DataFrame) -> DataFrame:
    """(doc_id, kind, line, fragment): comments and hidden elements with the line they begin on."""
    text = F.col("text")
    parts = F.regexp_extract_all(text, F.lit("(?is)<!--.*?-->|<([a-z][\\w:-]*)\\b[^>]*>.*?</\\1\\s*>|[^<]+|<"), F.lit(0))
    none = F.array().cast("array<struct<kind:string,line:int,fragment:string>>")

    def step(done: Column, x: Column) -> Column:
        comment = x.startswith("<!--")
        element = (F.length(x) > 1) & ~comment & x.startswith("<") & F.regexp_extract(x, "^<[^>]*>", 0).rlike(P.HIDDEN_STYLE)
        one = F.array(F.struct(F.when(comment, "comment").otherwise("element").alias("kind"), done["line"].alias("line"), x.alias("fragment")))
        line = (done["line"] + F.length(F.regexp_replace(x, "[^\\n]", ""))).cast("int")
        return F.struct(line.alias("line"), F.when(comment | element, F.concat(done["found"], one)).otherwise(done["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(1).alias("line"), none.alias("found")), step, lambda done: done["found"])
    return papers.where(text.contains("<")).select("doc_id", F.inline(found))


def compatible(text: Column) -> Column:
    """Normal form NFKC; only texts beyond ASCII go through Python."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def instructions(papers: DataFrame) -> DataFrame:
    """(doc_id, line, pattern_no, phrase): instructions to reviewers, in the open or hidden."""
    lines = papers.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "t")).select("doc_id", (F.col("at") + 1).alias("line"), "t")
    both = lines.unionByName(hidden_fragments(papers).select("doc_id", "line", F.col("fragment").alias("t"))).withColumn("t", compatible(F.col("t")))
    shown = F.regexp_replace(F.regexp_replace(F.col("t"), "\\p{Cf}", ""), "<!--|-->", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(shown, "<[^>]+>", " "), "\\s+", " "))
    found = F.concat(*[F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), lambda m, n=n: F.struct(F.lit(n).alias("pattern_no"), m.alias("phrase"))) for n, p in enumerate(P.INSTRUCTIONS)])
    return both.select("doc_id", "line", F.explode(found).alias("f")).select("doc_id", "line", "f.pattern_no", "f.phrase").distinct()


def traces(papers: DataFrame) -> DataFrame:
    """(doc_id, line, invisible, hidden, phrases): lines with format characters, hidden content or instructions."""
    lines = papers.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "t"))
    cf = lines.select("doc_id", (F.col("at") + 1).alias("line"), F.regexp_count("t", F.lit("\\p{Cf}")).alias("invisible"), F.lit(0).alias("hidden"), F.lit(0).alias("phrases")).where("invisible > 0")
    hid = hidden_fragments(papers).select("doc_id", "line", F.lit(0).alias("invisible"), F.lit(1).alias("hidden"), F.lit(0).alias("phrases"))
    ins = instructions(papers).select("doc_id", "line", F.lit(0).alias("invisible"), F.lit(0).alias("hidden"), F.lit(1).alias("phrases"))
    return cf.unionByName(hid).unionByName(ins).groupBy("doc_id", "line").agg(*[F.sum(c).cast("int").alias(c) for c in ("invisible", "hidden", "phrases")])
