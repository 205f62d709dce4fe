"""Citations, sections, references, promises, self-reviews and positioning of manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import patterns as P
from auditloom.operators.sanitation import compatible
from auditloom.session import merged


def citations(lines: DataFrame) -> DataFrame:
    """(doc_id, provider, identifier, line, expected_title, column_start, column_end): every persistent identifier once per document, at its first line,
    and the title that the label of a link to it there gives, or null."""
    t = F.col("text")
    versionless = lambda x: F.regexp_replace(x, "(?i)v\\d+$", "")
    item = lambda provider, order, p, f: lambda m, i: F.struct(F.lit(provider).alias("provider"), f(F.regexp_extract(m, p, 1)).alias("identifier"), (F.lit(order) + i).alias("rank"), m.alias("token"))
    one = lambda provider, order, p, f=lambda x: x: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), item(provider, order, p, f))
    found = F.concat(
        one("arxiv", 0, P.ARXIV, versionless), one("arxiv", 1000, P.BRACKET_ARXIV, versionless), one("s2", 2000, P.S2_URL),
        one("s2", 3000, P.CORPUS_ID, lambda x: F.concat(F.lit("CorpusId:"), x)), one("s2", 4000, P.DOI, lambda x: F.concat(F.lit("DOI:"), F.regexp_replace(x, "[.,;)]+$", ""))),
        one("registry", 5000, P.REGISTRY_MARK),
    )
    rows = lines.where(t.rlike("(?i)arxiv|doi|semanticscholar|corpusid|\\[[a-z0-9]+[:.]")).select("doc_id", "line", "text", F.explode(found).alias("f"))
    order = Window.partitionBy("doc_id", "f.provider", F.lower("f.identifier")).orderBy("line", "f.rank")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("doc_id", "f.provider", "f.identifier", "line", expected_title(F.col("text"), F.col("f.token")).alias("expected_title"), F.instr("text", F.col("f.token")).alias("column_start"), (F.instr("text", F.col("f.token")) + F.length("f.token") - 1).alias("column_end"))


def expected_title(line: Column, token: Column) -> Column:
    """The label of the line's first link whose address holds the token, if the label may be a title."""
    bare = F.lower(F.regexp_replace(token, "\\)+$", ""))
    label = lambda link: F.trim(F.regexp_extract(link, P.MARKDOWN_LINK, 1))
    title = lambda link: ~F.lower(label(link)).isin(*P.GENERIC_LABELS) & (F.regexp_count(label(link), F.lit("[A-Za-z][A-Za-z'-]+")) >= 3)
    fits = lambda link: F.contains(F.lower(F.regexp_extract(link, P.MARKDOWN_LINK, 2)), bare) & title(link)
    return label(F.get(F.filter(F.regexp_extract_all(line, F.lit(P.MARKDOWN_LINK), F.lit(0)), fits), F.lit(0)))


def title_words(title: Column) -> Column:
    """Its words in small letters, in normal form NFKC."""
    title = compatible(title)
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^\\p{L}\\p{N}_]+"), lambda w: w != ""))


def titles_agree(expected: Column, observed: Column) -> Column:
    """Nine in ten words shared."""
    a, b = title_words(expected), title_words(observed)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) >= 0.9)


def citation_status(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, provider, identifier, line, status, title, expected_title): what the registry knows; what it lacks is unavailable. registry: (cite_key, cite_status, cite_title)."""
    known = registry.groupBy("cite_key").agg(F.max_by("cite_status", F.struct("cite_status", "cite_title")).alias("status"), F.max_by("cite_title", F.struct("cite_status", "cite_title")).alias("title"))
    return cited.join(known, F.col("identifier") == F.col("cite_key"), "left").select("doc_id", "provider", "identifier", "line", F.coalesce("status", F.lit("unavailable")).alias("status"), "title", "expected_title", "column_start", "column_end")


#: The providers that know all of their own identifiers; that others lack one proves nothing.
AUTHORITATIVE = ("arxiv", "registry")


def wrong_citations(status: DataFrame) -> DataFrame:
    """Citations of what an authority does not have, or under the title of another work."""
    other = (F.col("status") == "verified") & ~titles_agree(F.col("expected_title"), F.col("title"))
    return status.where(((F.col("status") == "not-found") & F.col("provider").isin(*AUTHORITATIVE)) | (F.col("expected_title").isNotNull() & F.col("title").isNotNull() & other))


def section_groups(sections: DataFrame) -> DataFrame:
    """(doc_id, section_group, present): the parts that a short paper must have."""
    flags = sections.groupBy("doc_id").agg(*[F.bool_or(F.col("title").rlike(p)).alias(n) for n, p in P.CORE_SECTIONS.items()])
    return flags.unpivot("doc_id", [F.col(f"`{n}`") for n in P.CORE_SECTIONS], "section_group", "present")


def wrapper_missing(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id): papers in the official wrapper that lack the section which goes with it."""
    wrapped = lines.where(F.col("text").rlike(P.OFFICIAL_MARKER)).select("doc_id").distinct()
    return wrapped.join(sections.where(F.col("title").rlike(P.WRAPPER_SECTION)).select("doc_id"), "doc_id", "left_anti")


def page_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, page_count, declarations, conflicting): the first declared number of pages."""
    told = lines.select("doc_id", "line", F.regexp_extract("text", P.PAGE_COUNT, 1).alias("n")).where("n != ''")
    return told.groupBy("doc_id").agg(F.min_by(F.col("n").cast("int"), "line").alias("page_count"), F.count("*").alias("declarations"), (F.count_distinct("n") > 1).alias("conflicting"))


def checkboxes(placed: DataFrame) -> DataFrame:
    """(doc_id, line, marker, label, valid, in_self_review) of check-box items."""
    return placed.where(F.col("text").rlike(P.ANY_CHECKBOX)).select(
        "doc_id", "line", F.regexp_extract("text", P.ANY_CHECKBOX, 1).alias("marker"), F.regexp_extract("text", P.ANY_CHECKBOX, 2).alias("label"),
        F.regexp_extract("text", P.ANY_CHECKBOX, 1).isin(" ", "x", "X").alias("valid"), F.coalesce(F.col("title").rlike(P.SELF_REVIEW_TITLE), F.lit(False)).alias("in_self_review"),
    )


def template_findings(papers: DataFrame, lines: DataFrame, sections: DataFrame, placed: DataFrame, logged: DataFrame) -> DataFrame:
    """(doc_id, line, expected, observed): what the event's template asks for and a paper of the event lacks.

    A paper is of the event if it has a ledger, or both a research spec and a self-review section.
    Its length comes from a declaration, else from form feeds. logged: (doc_id)."""
    title = F.lower("title")
    both = sections.groupBy("doc_id").agg(F.bool_or(title.contains("research spec")).alias("a"), F.bool_or(title.rlike("self[- ]review")).alias("b")).where("a AND b").select("doc_id")
    event = logged.select("doc_id").unionByName(both).distinct()
    lacking = section_groups(sections).where("NOT present").select("doc_id", F.lit(1).alias("line"), F.concat(F.lit("section "), "section_group").alias("expected"), F.lit("absent").alias("observed"))
    wrapper = wrapper_missing(lines, sections).select("doc_id", F.lit(1).alias("line"), F.lit("section of the official wrapper").alias("expected"), F.lit("absent").alias("observed"))
    told = lines.select("doc_id", "line", F.regexp_extract("text", P.PAGE_COUNT, 1).alias("n")).where("n != ''").withColumn("n", F.col("n").cast("int"))
    declared = told.groupBy("doc_id").agg(F.min_by("n", "line").alias("pages"), F.min("line").alias("line"), F.count_distinct("n").alias("kinds"), F.try_element_at(F.array_sort(F.collect_list("line")), F.lit(2)).alias("second"))
    fed = papers.where(F.contains("text", F.lit("\f"))).select("doc_id", (F.regexp_count("text", F.lit("\f")) + 1).alias("fed"))
    sized = declared.join(fed, "doc_id", "full").select("doc_id", F.coalesce("pages", "fed").alias("pages"), F.coalesce("line", F.lit(1)).alias("line"), "kinds", "second")
    wrong = F.when(F.col("kinds") > 1, F.struct(F.col("second").alias("line"), F.lit("one declared length").alias("expected"), F.lit("several").alias("observed"))).when(
        ~F.col("pages").between(2, 4), F.struct("line", F.lit("2 to 4 pages").alias("expected"), F.col("pages").cast("string").alias("observed"))
    )
    pages = sized.select("doc_id", wrong.alias("w")).where("w IS NOT NULL").select("doc_id", "w.*")
    boxes = checkboxes(placed).where("in_self_review AND NOT valid").select("doc_id", "line", F.lit("a space or x in the box").alias("expected"), F.col("marker").alias("observed"))
    return lacking.unionByName(wrapper).unionByName(pages).unionByName(boxes).join(merged(event), "doc_id", "left_semi")


def self_review_items(placed: DataFrame) -> DataFrame:
    """(doc_id, line, label, checked): items of self-reviews, the box before or behind."""
    lead = F.col("text").rlike(P.LEADING_CHECKBOX)
    mark = F.when(lead, F.regexp_extract("text", P.LEADING_CHECKBOX, 1)).otherwise(F.regexp_extract("text", P.TRAILING_CHECKBOX, 2))
    text = F.when(lead, F.regexp_extract("text", P.LEADING_CHECKBOX, 2)).otherwise(F.regexp_extract("text", P.TRAILING_CHECKBOX, 1))
    rows = placed.where(F.col("title").rlike(P.SELF_REVIEW_TITLE) & (lead | F.col("text").rlike(P.TRAILING_CHECKBOX)))
    return rows.select("doc_id", "line", F.regexp_replace(F.trim(text), ":$", "").alias("label"), (F.lower(mark) == "x").alias("checked"))


def self_review_audit(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, line, checked, families, contradicted): items whose checks have findings. findings: (doc_id, check)."""
    families = F.flatten(F.array(*[F.when(F.col("label").rlike(p), F.array(*map(F.lit, f))).otherwise(F.array().cast("array<string>")) for p, f in P.ITEM_FAMILIES]))
    long = items.withColumn("families", families).withColumn("check", F.explode_outer("families"))
    counted = findings.groupBy("doc_id", "check").agg(F.count("*").alias("n"))
    return long.join(counted, ["doc_id", "check"], "left").groupBy("doc_id", "line", "checked").agg(F.count("check").alias("families"), F.count_if(F.col("n") > 0).alias("contradicted"))


def broken_references(lines: DataFrame) -> DataFrame:
    """(doc_id, line, kind, snippet): the first kind of broken reference on a line."""
    t = F.col("text")
    kind = F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for k, p in P.BROKEN_REFERENCES])
    snippet = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 0)) for _, p in P.BROKEN_REFERENCES])
    return lines.select("doc_id", "line", kind.alias("kind"), F.regexp_replace(snippet, "\\s+", " ").alias("snippet")).where("kind IS NOT NULL")


def artifacts(lines: DataFrame) -> DataFrame:
    """(doc_id, line, snippet): leftovers of building and writing."""
    return lines.where(F.col("text").rlike(P.ARTIFACT)).select("doc_id", "line", F.regexp_replace(F.regexp_extract("text", P.ARTIFACT, 0), "\\s+", " ").alias("snippet"))


def broken_promises(lines: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, line, marker, tokens): announced results whose words never come again; the first of a document.

    A word comes again where a later line has it, also inside a longer word: the distinct words of
    a document are told their last line first, and meet the promise's words by their first five letters."""
    order = Window.partitionBy("doc_id").orderBy("line")
    body = lines.withColumn("ended", F.max(F.col("text").rlike(P.REFERENCES_HEADING).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ended = 0")
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z-]{4,}"), F.lit(0))), F.array(*map(F.lit, P.PROMISE_STOPWORDS)))
    told = body.where(F.col("text").rlike(P.PROMISE)).select("doc_id", "line", F.regexp_extract("text", P.PROMISE, 0).alias("marker"), words.alias("tokens")).where("size(tokens) >= 2")
    runs = body.join(told.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z-]{5,}"), F.lit(0)))).alias("run"))
    last = runs.groupBy("doc_id", "run").agg(F.max("line").alias("last"))
    starts = F.transform(F.sequence(F.lit(1), F.length("run") - 4), lambda i: F.substring("run", i, F.lit(5)))
    grams = last.select("doc_id", "run", "last", F.explode(F.array_distinct(starts)).alias("gram"))
    asked = told.select("doc_id", F.col("line").alias("at"), F.explode("tokens").alias("token")).withColumn("gram", F.left("token", F.lit(5)))
    again = asked.join(grams, ["doc_id", "gram"]).where((F.col("last") > F.col("at")) & F.contains("run", F.col("token"))).select("doc_id", F.col("at").alias("line")).distinct()
    left = told.join(again, ["doc_id", "line"], "left_anti").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return left.select("doc_id", "line", "marker", F.array_join(F.slice("tokens", 1, 8), " ").alias("tokens"))


def positioning(placed: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, has_related_work, citation_count, positioned, claims, loose): how a paper places itself among others.

    claims: live sentences of novelty or of superiority over named work; loose: those that name nothing to compare with."""
    cites = [P.NUMERIC_CITE, P.AUTHOR_YEAR, P.ARXIV, P.BRACKET_ARXIV, P.DOI, P.S2_URL, P.CORPUS_ID, P.REGISTRY_MARK]
    counted = placed.groupBy("doc_id").agg(F.sum(sum((F.regexp_count("text", F.lit(p)) for p in cites), F.lit(0))).alias("citation_count"))
    filled = placed.join(sections.where(F.col("title").rlike(P.RELATED_WORK_TITLE)).select("doc_id", "section", "heading_line"), ["doc_id", "section"]).where(
        (F.col("heading_line").isNull() | (F.col("line") > F.col("heading_line"))) & F.col("text").rlike("[^\\s#>*_\\-\\[\\]()]")
    )
    related = filled.select("doc_id").distinct().withColumn("has_related_work", F.lit(True))
    prose = placed.where(~F.col("text").rlike("^\\s*[|#]") & F.col("text").rlike("\\S")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.LOOSE_SENTENCE), F.lit(0))).alias("s"))
    live = prose.where(~F.col("s").rlike(P.NEGATED_CLAIM) & ~F.col("s").rlike(P.HYPOTHETICAL_CLAIM))
    firm = F.col("s").rlike(P.NOVELTY) | F.col("s").rlike(P.SUPERIORITY)
    claimed = live.groupBy("doc_id").agg(F.count_if(firm).alias("claims"), F.count_if(~firm & F.col("s").rlike(P.LOOSE_SUPERIORITY) & ~F.col("s").rlike(P.COMPARATOR)).alias("loose"))
    out = counted.join(related, "doc_id", "left").join(claimed, "doc_id", "left").withColumn("has_related_work", F.coalesce("has_related_work", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "has_related_work", F.col("citation_count").cast("long"), (F.col("has_related_work") | (F.col("citation_count") > 0)).alias("positioned"), zero("claims"), zero("loose"))


def unpositioned(positioning_: DataFrame) -> DataFrame:
    """(doc_id): papers that claim novelty or superiority and cite nothing."""
    return positioning_.where("claims > 0 AND NOT positioned").select("doc_id")


def unanswered(papers: DataFrame) -> DataFrame:
    """(doc_id, item): checklist items that a text doesn't touch."""
    rows = papers.where("text IS NOT NULL").select("doc_id", F.explode(F.array_compact(F.array(*[F.when(~F.col("text").rlike(p), F.lit(n)) for n, p in P.RIGOR_CHECKLIST.items()]))).alias("item"))
    return rows


def variance_unaddressed(papers: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id): papers with tables and no word on how runs vary."""
    return tables.select("doc_id").distinct().join(papers.where(~F.col("text").rlike(P.VARIANCE)).select("doc_id"), "doc_id", "left_semi")
