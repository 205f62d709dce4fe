"""The whole audit of a corpus as one set of tables, each computed from those before it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import audits, claims, evaluation, evidence, ledger, manuscript, sanitation, tracing
from auditloom.session import kept, merged


class Audit:
    """papers: (doc_id, text), raw or sanitized; ledgers: (doc_id, path, line, raw); registry: (cite_key, cite_status, cite_title).
    raw: (doc_id, text) as delivered, which is scanned for instructions, where papers holds cleaned texts.

    Every stage is a table that is planned when it is asked for. What several stages read is
    written once, as Parquet, to the shared folder of checkpoints, which also keeps the plans short;
    as every stage grows with the corpus, none is broadcast."""

    def __init__(self, papers: DataFrame, ledgers: DataFrame, registry: DataFrame | None = None, sanitize: bool = True, raw: DataFrame | None = None) -> None:
        self.raw = papers if raw is None else raw
        self.papers = papers.select("doc_id", sanitation.sanitized(F.col("text")).alias("text")) if sanitize else papers
        self.ledgers = ledgers
        self.registry = registry

    def _kept(self, frame: DataFrame) -> DataFrame:
        return merged(kept(frame))

    # parsing
    @cached_property
    def lines(self) -> DataFrame:
        return self._kept(manuscript.lines(self.papers))

    @cached_property
    def sections(self) -> DataFrame:
        return self._kept(manuscript.sections(self.lines))

    @cached_property
    def placed(self) -> DataFrame:
        return self._kept(manuscript.section_of_lines(self.lines, self.sections))

    @cached_property
    def tables(self) -> DataFrame:
        return self._kept(manuscript.table_lines(self.lines))

    @cached_property
    def numbers(self) -> DataFrame:
        return self._kept(manuscript.numbers(self.placed, self.tables))

    @cached_property
    def sentences(self) -> DataFrame:
        return self._kept(manuscript.loose_sentences(self.placed))

    @cached_property
    def claims(self) -> DataFrame:
        return self._kept(claims.claims(self.placed, self.tables, self.numbers))

    # evidence
    @cached_property
    def leaves(self) -> DataFrame:
        return self._kept(ledger.leaves(self.ledgers))

    @cached_property
    def records(self) -> DataFrame:
        return self._kept(ledger.records(self.ledgers))

    @cached_property
    def fields(self) -> DataFrame:
        return self._kept(tracing.default_fields(self.papers).unionByName(tracing.ledger_fields(self.leaves)).distinct())

    @cached_property
    def mentions(self) -> DataFrame:
        return self._kept(tracing.result_mentions(self.placed, self.fields))

    @cached_property
    def labelled(self) -> DataFrame:
        return self._kept(tracing.labelled(self.numbers, self.placed, self.tables, self.fields, self.mentions))

    @cached_property
    def result_values(self) -> DataFrame:
        return self._kept(tracing.labelled(self.numbers, self.placed, self.tables, tracing.default_fields(self.papers), self.mentions))

    @cached_property
    def ledger_trace(self) -> DataFrame:
        return self._kept(tracing.ledger_trace(self.labelled, self.leaves, self.records))

    @cached_property
    def arithmetic(self) -> DataFrame:
        return self._kept(tracing.arithmetic(self.placed, self.result_values))

    @cached_property
    def findings(self) -> DataFrame:
        """(doc_id, check, severity, line, column_start, column_end, expected, observed, evidence_path) of all checks.

        Documents without a ledger have no finding of its trace. A finding about a line of a ledger has no line of the
        paper; its evidence_path holds the ledger's."""
        none = F.lit(None).cast("int")
        logged = self.records.select("doc_id").distinct()
        text = F.concat_ws

        def at(rows: DataFrame, check: str, severity: str, expected, observed, path=F.lit("paper"), line=F.col("line"), span: bool = False) -> DataFrame:
            a, b = (F.col("column_start"), F.col("column_end")) if span else (none, none)
            return rows.select(
                "doc_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), line.cast("int").alias("line"), a.cast("int").alias("column_start"), b.cast("int").alias("column_end"),
                expected.alias("expected"), observed.alias("observed"), path.alias("evidence_path"),
            )

        said = text(" ", F.concat("metric", F.lit("="), "normalized"), F.concat(F.lit("for "), "trial"))
        unfair = evidence.fairness(self.sentences, ledger.metric_values(self.ledgers, self.leaves, self.records))
        wrong = F.array_compact(F.array(
            F.when(~F.col("named_baseline"), F.struct(F.lit("the baseline by name").alias("e"), F.lit("none").alias("o"))),
            F.when(F.col("metrics") != 1, F.struct(F.lit("one metric of baseline and candidate").alias("e"), F.concat(F.col("metrics").cast("string"), F.lit(" metrics")).alias("o")))
            .when(~F.col("confirmed"), F.struct(F.lit("a successful confirmation of the metric").alias("e"), F.lit("none").alias("o")))
            .when(~F.col("supported"), F.struct(F.lit("a candidate and confirmations better than the baseline").alias("e"), F.lit("they are not").alias("o"))),
        ))
        unfair = unfair.select("doc_id", "line", "column_start", "column_end", F.explode(wrong).alias("w"))
        parts = [
            at(self.ledger_trace.where("NOT matched").join(logged, "doc_id", "left_semi"), "ledger-trace", "high", F.concat(F.lit("one of "), F.col("candidates").cast("string"), F.lit(" logged values")), said, F.lit("ledger"), span=True),
            at(ledger.malformed(self.ledgers), "ledger-trace", "high", F.lit("one JSON object"), F.col("problem"), text(":", "path", F.col("line").cast("string")), line=none),
            at(tracing.consistency(self.result_values).where("NOT matched"), "internal-consistency", "high", text(", ", "in_tables"), F.concat("metric", F.lit("="), "shown"), F.lit("paper tables"), span=True),
            at(self.arithmetic.where("NOT matched"), "arithmetic", "high", F.col("expected").cast("string"), F.concat("label", F.lit(" "), "display"), F.lit("paper"), span=True),
            at(unfair, "baseline-fairness", "high", F.col("w.e"), F.col("w.o"), F.lit("ledger"), span=True),
            at(sanitation.instructions(self.raw), "injection-scan", "high", F.lit("no instruction to reviewers"), F.col("phrase")),
            at(audits.broken_references(self.lines), "cross-references", "medium", F.lit("a reference that leads somewhere"), F.col("snippet")),
            at(audits.artifacts(self.lines), "manuscript-artifacts", "medium", F.lit("no leftover of writing"), F.col("snippet")),
            at(evidence.omitted_failures(self.lines, self.leaves).where("NOT disclosed"), "negative-evidence", "high", F.lit("a word on failed trials"), F.col("status"), F.lit("ledger"), line=none),
            at(audits.template_findings(self.papers, self.lines, self.sections, self.placed, logged), "template-compliance", "medium", F.col("expected"), F.col("observed")),
        ]
        if self.registry is not None:
            status = audits.citation_status(audits.citations(self.lines), self.registry)
            parts.append(at(audits.wrong_citations(status), "citation-existence", "error", F.coalesce("expected_title", F.concat(F.lit("a record of "), "identifier")), F.coalesce("title", "status"), F.lit("registry"), span=True))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return self._kept(evaluation.numbered(out))

    # results
    @cached_property
    def verdicts(self) -> DataFrame:
        return claims.verdicts(self.claims, self.findings, self.ledger_trace.select("doc_id", "number_no", "matched", "evidence"), self.arithmetic.select("doc_id", "line", "metric", "matched"))

    @cached_property
    def summary(self) -> DataFrame:
        """(doc_id, claims, supported, contradicted, unverifiable, findings)."""
        label = F.col("label")
        judged = self.verdicts.groupBy("doc_id").agg(F.count("*").alias("claims"), *[F.count_if(label == n).alias(n) for n in ("supported", "contradicted", "unverifiable")])
        found = self.findings.groupBy("doc_id").agg(F.count("*").alias("findings"))
        return judged.join(found, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))

    @cached_property
    def digests(self) -> DataFrame:
        return evaluation.verdict_digest(self.verdicts)
