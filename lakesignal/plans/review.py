"""Contradictions, extraction quality and the review report of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.fixed_rules import NEGOTIATION_QUESTIONS
from lakesignal.functions.text import duration_days
from lakesignal.operators.rules import severity_rank

CHECKED_CATEGORIES = ("notice", "renewal")
LOW_TEXT_CHARS = 40


def obligation_days(obligations: DataFrame) -> DataFrame:
    """Days stated by the deadline; a missing or zero value falls through to the obligation text."""
    deadline = duration_days(F.coalesce("deadline", F.lit("")))
    return obligations.withColumn("days", F.coalesce(F.when(deadline != 0, deadline), duration_days(F.col("obligation"))))


def contradictions(obligations: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Grounded notice / renewal obligations of one document that state different durations."""
    stated = obligation_days(obligations.where(F.col("grounded") & F.col("category").isin(*CHECKED_CATEGORIES))).where(F.col("days").isNotNull())
    out = stated.groupBy(*keys, "category").agg(F.array_sort(F.collect_set("days")).alias("values_days"), F.count(F.lit(1)).alias("n_obligations"))
    return out.where(F.size("values_days") > 1)


def page_flags(pages: DataFrame) -> DataFrame:
    return pages.withColumn("char_count", F.length("text")).withColumn("flagged_low_text", F.col("char_count") < LOW_TEXT_CHARS)


def extraction_quality(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Pages, OCR pages and low-text pages per document, with a status line."""
    out = page_flags(pages).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if("used_ocr").alias("ocr_page_count"), F.count_if("flagged_low_text").alias("low_text_page_count")
    )
    ocr, low = F.col("ocr_page_count"), F.col("low_text_page_count")
    # The sentences of the status line.
    parts = F.concat_ws(
        "; ",
        F.when(ocr > 0, F.format_string("%d of %d page(s) required OCR (no native text layer)", ocr, F.col("total_pages"))),
        F.when(low > 0, F.concat(low.cast("string"), F.when(low != 1, " pages").otherwise(" page"), F.lit(" extracted unusually little text -- worth a manual check"))),
    )
    summary = F.when((ocr == 0) & (low == 0), "Extracted cleanly from native text; no quality concerns detected.").otherwise(F.concat(parts, F.lit(".")))
    return out.withColumn("summary", summary)


def document_text(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Pages of a document in order, joined by blank lines; empty pages are skipped."""
    kept = pages.where(F.col("text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def review_items(findings: DataFrame, conflicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """All report lines of every document: section, severity, position, source, title, detail and their evidence.

    Sections: top_issue, negotiable, question, clarification.  ``findings``,
    ``conflicts`` and ``gaps`` are the outputs of scan_rules, contradictions and
    coverage.  Lines of one document sort by (section, severity rank, p1, p2): findings by clause and rule, then
    conflicts, then gaps, these two by category (of gaps as numbered by ``coverage(numbered=True)``, else by id).
    Evidence is the rule, clause and excerpt of a finding, the category and durations of a conflict, the category of a gap.
    """
    evidence = {"rule_id": "string", "chunk_index": "int", "excerpt": "string", "category": "string", "values_days": "array<int>"}
    cols = ["doc_id", "section", "severity", "p1", "p2", "source", "title", "detail", *evidence]
    none = lambda *names: [F.lit(None).cast(evidence[n]).alias(n) for n in names]
    risk = findings.select(
        "doc_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("severity") == "high", F.struct(F.lit("top_issue").alias("section"))),
                    F.when(F.col("severity").isin("high", "medium"), F.struct(F.lit("negotiable").alias("section"))),
                )
            )
        ),
        "severity",
        F.col("chunk_index").cast("bigint").alias("p1"),
        F.col("rule_no").cast("bigint").alias("p2"),
        F.lit("risk").alias("source"),
        F.col("label").alias("title"),
        F.col("explanation").alias("detail"),
        "rule_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "excerpt",
        *none("category", "values_days"),
    )
    # Fixed values from here on: the sentences of titles and details.
    values = F.array_join(F.transform("values_days", lambda v: F.concat(v.cast("string"), F.lit(" days"))), ", ")
    conflict = conflicts.select(
        "doc_id",
        F.lit("top_issue").alias("section"),
        F.lit("high").alias("severity"),
        F.lit(1 << 40).alias("p1"),
        F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CHECKED_CATEGORIES]), F.col("category")), F.lit(0)).cast("bigint").alias("p2"),
        F.lit("contradiction").alias("source"),
        F.concat(F.lit("Potential conflict requiring review: "), "category", F.lit(" durations differ")).alias("title"),
        F.concat(
            F.lit("Found "),
            F.col("n_obligations").cast("string"),
            F.lit(" clause(s) in '"),
            "category",
            F.lit("' stating different durations: "),
            values,
            F.lit(". This may be a genuine drafting inconsistency, or the clauses may legitimately cover different situations -- worth checking which one governs."),
        ).alias("detail"),
        *none("rule_id", "chunk_index", "excerpt"),
        "category",
        F.col("values_days").cast("array<int>").alias("values_days"),
    )
    missing = gaps.where("status = 'not_found'")
    place = F.col("category_no").cast("bigint") if "category_no" in gaps.columns else F.lit(0).cast("bigint")
    base = [F.lit(1 << 41).alias("p1"), place.alias("p2"), F.lit("coverage").alias("source")]
    missed = [*none("rule_id", "chunk_index", "excerpt"), F.col("category_id").alias("category"), *none("values_days")]
    gap = missing.where("importance = 'high'").select(
        "doc_id",
        F.lit("top_issue").alias("section"),
        F.lit("medium").alias("severity"),
        *base,
        F.concat(F.lit("No "), "label", F.lit(" clause found")).alias("title"),
        F.concat(F.lit("A scan for "), F.lower("label"), F.lit(" language found nothing in this document. That does not prove it's absent -- only that this scan didn't find it.")).alias("detail"),
        *missed,
    )
    clarify = missing.select(
        "doc_id",
        F.lit("clarification").alias("section"),
        F.lit("low").alias("severity"),
        *base,
        F.col("category_id").alias("title"),
        F.concat(F.lit("This document doesn't appear to address "), F.lower("label"), F.lit(" -- worth clarifying with the other party before signing.")).alias("detail"),
        *missed,
    )
    asked = F.create_map(*[F.lit(x) for kv in NEGOTIATION_QUESTIONS.items() for x in kv])
    questions = (
        findings.withColumn("detail", F.try_element_at(asked, F.col("rule_id")))
        .where(F.col("detail").isNotNull())
        .groupBy("doc_id", "detail")
        .agg(F.min(F.struct(severity_rank(F.col("severity")).alias("s"), F.col("chunk_index").cast("bigint").alias("c"), F.col("rule_no").cast("bigint").alias("r"), "rule_id", "excerpt")).alias("at"), F.min("severity").alias("severity"))
        .select(
            "doc_id", F.lit("question").alias("section"), "severity", F.col("at.c").alias("p1"), F.col("at.r").alias("p2"), F.lit("risk").alias("source"), F.lit("question").alias("title"), "detail",
            F.col("at.rule_id").alias("rule_id"), F.col("at.c").cast("int").alias("chunk_index"), F.col("at.excerpt").alias("excerpt"), *none("category", "values_days"),
        )
    )
    out = risk.select(*cols)
    for part in (conflict, gap, clarify, questions):
        out = out.unionByName(part.select(*cols))
    return out.withColumn("severity_rank", severity_rank(F.col("severity")))
