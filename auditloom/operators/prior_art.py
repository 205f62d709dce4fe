"""Topics, similar work and what is cited of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P


def tokens(text: Column) -> Column:
    """Content words in lower case, with repeats."""
    stop = F.array(*map(F.lit, P.TOPIC_STOPWORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(P.TOPIC_WORD), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def topic_terms(sections: DataFrame, placed: DataFrame, limit: int = 8) -> DataFrame:
    """(doc_id, rank, term): words of the title, then those of the abstract by frequency."""
    titles = sections.where("heading_line IS NOT NULL").groupBy("doc_id").agg(F.min_by("title", F.struct("level", "heading_line")).alias("title"))
    first = titles.select("doc_id", F.posexplode(F.array_distinct(tokens(F.col("title")))).alias("n", "term")).select("doc_id", "term", F.lit(0).alias("part"), F.col("n").cast("long").alias("n"))
    abstract = placed.where(F.lower("title").contains("abstract")).select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    both = first.unionByName(abstract.select("doc_id", "term", F.lit(1).alias("part"), (-F.col("n")).alias("n")))
    best = both.groupBy("doc_id", "term").agg(F.min(F.struct("part", "n")).alias("k"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("k.part", "k.n", "term")))
    return ranked.where(F.col("rank") <= limit).select("doc_id", "rank", "term")


def similar(left: DataFrame, right: DataFrame, least: float, top: int) -> DataFrame:
    """(left_id, right_id, similarity, rank): the most similar right sets of each left one. left, right: (id, words).

    Prefix filtering: words are ordered from rare to frequent, and two sets of the wanted similarity share one of the
    first words of both, as many as may differ and one more. Only these meet; sets too different in size don't; the
    share is counted on the whole sets."""

    def prefixed(sets: DataFrame, side: str) -> DataFrame:
        each = sets.where(F.size("words") > 0).select(F.col("id").alias(f"{side}_id"), F.explode("words").alias("w")).join(times, "w", "left")
        listed = each.groupBy(f"{side}_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))), lambda x: x["w"]).alias(f"{side}_words"))
        n = F.size(f"{side}_words")
        return listed.select("*", F.explode(F.slice(f"{side}_words", F.lit(1), n - F.ceil(F.lit(least) * n).cast("int") + 1)).alias("w"))

    times = right.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    met = prefixed(left, "left").join(prefixed(right, "right"), "w")
    small, large = F.least(F.size("left_words"), F.size("right_words")), F.greatest(F.size("left_words"), F.size("right_words"))
    pairs = met.where(small >= F.lit(least) * large).groupBy("left_id", "right_id").agg(F.first("left_words").alias("a"), F.first("right_words").alias("b"))
    scored = pairs.select("left_id", "right_id", F.round(jaccard(F.col("a"), F.col("b")), 4).alias("similarity")).where(F.col("similarity") >= least)
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("left_id", "right_id", "similarity", "rank")


def uncited(similar_: DataFrame, cited: DataFrame) -> DataFrame:
    """Similar work that isn't cited. cited: (left_id, right_id)."""
    return similar_.join(cited, ["left_id", "right_id"], "left_anti")


def from_atom(feeds: DataFrame) -> DataFrame:
    """(id, title, summary, published) of Atom payloads in a column xml; entries without id or title are left out, versions cut off."""
    schema = "entry ARRAY<STRUCT<id: STRING, title: STRING, summary: STRING, published: STRING>>"
    rows = feeds.select(F.from_xml("xml", schema).alias("f")).select(F.explode("f.entry").alias("e")).select("e.*")
    ident = F.regexp_replace(F.regexp_extract("id", "(?i)arxiv\\.org/abs/([^\\s<]+)", 1), "v\\d+$", "")
    squeezed = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    out = rows.select(ident.alias("id"), squeezed("title").alias("title"), squeezed("summary").alias("summary"), F.substring("published", 1, 10).try_cast("date").alias("published"))
    return out.where("id != '' AND title != ''")


def papers_from_atom(feeds: DataFrame) -> DataFrame:
    """(arxiv_id, title, category, pdf_url) of Atom payloads in a column xml; what an entry lacks is taken from its id, an id that comes again is dropped."""
    entry = "STRUCT<id: STRING, title: STRING, category: ARRAY<STRUCT<_term: STRING>>, link: ARRAY<STRUCT<_href: STRING, _title: STRING, _type: STRING>>>"
    rows = feeds.select(F.from_xml("xml", f"entry ARRAY<{entry}>").alias("f")).select(F.posexplode("f.entry").alias("n", "e"))
    ident = F.regexp_replace(F.regexp_extract("e.id", "(?i)/abs/([^\\s<]+)", 1), "v\\d+$", "")
    pdf = F.filter("e.link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    out = rows.select(
        "n", ident.alias("arxiv_id"), F.trim(F.regexp_replace("e.title", "\\s+", " ")).alias("title"), F.try_element_at("e.category", F.lit(1))["_term"].alias("category"),
        F.coalesce(F.try_element_at(pdf, F.lit(1))["_href"], F.concat(F.lit("https://arxiv.org/pdf/"), ident)).alias("pdf_url"),
    )
    first = Window.partitionBy("arxiv_id").orderBy("n")
    return out.where("arxiv_id != ''").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "n")


def text_of_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>", " "), "<[^>]+>", " "), "\\s+", " "))
