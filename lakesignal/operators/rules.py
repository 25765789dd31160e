"""Rule tables over clause chunks: findings, coverage, comparison of documents.

Rules are configuration (a tuple of ``Rule``), so they are compiled into the
projection as literal patterns: chunks stream through once, with no join and no
shuffle until results are grouped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.fixed_rules import COVERAGE_CATEGORIES, RISK_RULES, Category, Rule
from lakesignal.functions.text import collapse, let
from lakesignal.scale import small_rows

#: Case-insensitive, dot matches newline, Unicode classes and word boundaries.
_FLAGS = "(?isU)"
EXCERPT_WIDTH = 260
SEVERITIES = ("high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(9)


def rules_from_table(rules: DataFrame, limit: int = 1000) -> tuple[Rule, ...]:
    """User rules from rows (rule_id, label, severity, pattern_no, pattern[, affects, explanation])."""
    grouped: dict[str, list] = {}
    for r in small_rows(rules.orderBy("rule_id", "pattern_no"), limit):
        grouped.setdefault(r["rule_id"], []).append(r.asDict())
    return tuple(
        Rule(k, v[0]["label"], v[0]["severity"], tuple(r["pattern"] for r in v), v[0].get("affects") or "", v[0].get("explanation") or "")
        for k, v in grouped.items()
    )


def needed_word(pattern: str) -> str:
    """The longest run of plain characters that every match of ``pattern`` holds, in lower case; "" if none is certain.

    Only what stands outside of groups, alternatives, classes and repeats counts.  Patterns with a class inside a class,
    quotes or other signs that Java reads in its own way have none.
    """
    if re.search(r"\[[^\]]*\[|&&|\\[QEvzhHRXGNcep0]|\(\?[a-zA-Z-]", pattern):
        return ""
    try:
        parts = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    runs = [""]
    for kind, value in parts:
        plain = str(kind) == "LITERAL" and value < 128 and (chr(value).isalnum() or chr(value) in " @+-")
        runs = [*runs[:-1], runs[-1] + chr(value).lower()] if plain else [*runs, ""]
    return max(runs, key=lambda r: (len(r), r.strip() != ""))


def folded(text: Column) -> Column:
    """Lower case; the four other characters that Java takes for an ASCII letter when case is ignored become that letter."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def _first_pattern(text: Column, low: Column, patterns: Sequence[str]) -> Column:
    """Index of the first pattern that matches, in pattern order; null for none.  ``low`` is the folded text."""
    out = None
    for i, p in enumerate(patterns):
        hit = text.rlike(_FLAGS + p)
        if word := needed_word(p):
            hit = F.contains(low, F.lit(word)) & hit  # a plain search, many times faster than the pattern
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def scan_rules(chunks: DataFrame, rules: Sequence[Rule] = RISK_RULES) -> DataFrame:
    """One finding per (chunk, rule): ``rule_no, pattern_no`` plus the rule's texts, excerpt and factors."""
    text = F.col("text")
    first = let(folded(text), lambda low: F.array(*[_first_pattern(text, low, r.patterns) for r in rules]))
    hits = F.transform(first, lambda x, i: F.struct(i.alias("rule_no"), x.alias("pattern_no")))
    found = chunks.select("*", F.inline(F.filter(hits, lambda h: h["pattern_no"].isNotNull())))
    names = ("rule_id", "label", "severity", "explanation", "affects")
    texts = F.array(*[F.struct(*[F.lit(getattr(r, n)).alias(n) for n in names], F.array(*[F.lit(_FLAGS + p) for p in r.patterns]).alias("patterns")) for r in rules])
    rule = F.element_at(texts, F.col("rule_no") + 1)
    found = found.withColumn("_rule", rule)
    found = found.withColumns({n: F.col("_rule")[n] for n in names} | {"_pattern": F.element_at(F.col("_rule.patterns"), F.col("pattern_no") + 1)}).drop("_rule")
    start = F.regexp_instr(text, F.col("_pattern")) - 1
    stop = start + F.length(F.regexp_substr(text, F.col("_pattern")))
    found = found.withColumns({"_from": F.greatest(F.lit(0), start - EXCERPT_WIDTH // 3), "_to": F.least(F.length(text), stop + EXCERPT_WIDTH)})
    snippet = collapse(F.substring(text, F.col("_from") + 1, F.col("_to") - F.col("_from")))
    excerpt = F.concat(
        F.when(F.col("_from") > 0, "…").otherwise(""), snippet, F.when(F.col("_to") < F.length(text), "…").otherwise("")
    )
    found = found.withColumn("excerpt", excerpt).withColumn("factors", _factors(text, rules))
    return found.drop("_pattern", "_from", "_to")


def _factors(text: Column, rules: Sequence[Rule]) -> Column:
    """Present flag and quote of every factor of the finding's rule."""
    empty = F.array().cast("array<struct<key:string,label:string,present:boolean,quote:string>>")
    out = empty
    for rule in rules:
        if not rule.factors:
            continue
        items = [
            F.struct(
                F.lit(f.key).alias("key"),
                F.lit(f.label).alias("label"),
                text.rlike(_FLAGS + f.pattern).alias("present"),
                F.when(text.rlike(_FLAGS + f.pattern), collapse(F.regexp_substr(text, F.lit(_FLAGS + f.pattern)))).alias("quote"),
            )
            for f in rule.factors
        ]
        out = F.when(F.col("rule_id") == rule.rule_id, F.array(*items)).otherwise(out)
    return out


def severity_counts(findings: DataFrame, keys: Sequence[str] = ("doc_id",), every: DataFrame | None = None) -> DataFrame:
    """Findings per severity; with ``every`` (a table of the keys) also zero rows for those without a finding."""
    counts = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    if every is None:
        return counts
    return every.select(*keys).distinct().join(counts, list(keys), "left").fillna(0, list(SEVERITIES))


def clause_labels(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Every chunk with its highest severity, ``none`` without a finding."""
    worst = findings.groupBy("doc_id", "chunk_index").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("label"))
    return chunks.join(worst, ["doc_id", "chunk_index"], "left").withColumn("label", F.coalesce("label", F.lit("none")))


def label_clauses(chunks: DataFrame, rules: Sequence[Rule] = RISK_RULES) -> DataFrame:
    """The same labels straight from the rules in one map-only pass (no findings table needed)."""
    out = None
    for s in SEVERITIES:
        hit = F.lit(False)
        for r in rules:
            if r.severity == s:
                for p in r.patterns:
                    hit = hit | F.col("text").rlike(_FLAGS + p)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return chunks.withColumn("label", out.otherwise("none"))


def coverage(chunks: DataFrame, categories: Sequence[Category] = COVERAGE_CATEGORIES, doc_id: str = "doc_id", numbered: bool = False) -> DataFrame:
    """Per document and category: found with the first matching clause, or not_found.

    ``numbered`` adds ``category_no``, the place of the category in the list.

    One map-side combined aggregate over the chunks; every category is a column
    of it until the end, so no join supplies the not_found rows.
    """
    text = F.col("text")
    preview = F.left(collapse(text), F.lit(200))

    def first(c: Category) -> Column:
        hit = F.lit(False)
        for p in c.patterns:
            hit = hit | text.rlike(_FLAGS + p)
        return F.min(F.when(hit, F.struct(F.col("chunk_index"), preview.alias("preview")))).alias(c.category_id)

    wide = chunks.groupBy(doc_id).agg(*[first(c) for c in categories])
    rows = [
        F.struct(
            F.lit(c.category_id).alias("category_id"),
            F.lit(c.label).alias("label"),
            F.lit(c.importance).alias("importance"),
            F.when(F.col(f"`{c.category_id}`").isNotNull(), "found").otherwise("not_found").alias("status"),
            F.col(f"`{c.category_id}`.chunk_index").alias("evidence_chunk_index"),
            F.col(f"`{c.category_id}`.preview").alias("evidence_preview"),
            *([F.lit(i).alias("category_no")] if numbered else []),
        )
        for i, c in enumerate(categories)
    ]
    return wide.select(doc_id, F.inline(F.array(*rows)))


def compare_documents(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules of two documents side by side: ``pairs`` has doc_a, doc_b.

    Columns: doc_a, doc_b, rule_id, label, severity, affects, in_a, in_b, impact.
    """
    rules = findings.groupBy("doc_id", "rule_id").agg(F.first("label").alias("label"), F.first("severity").alias("severity"), F.first("affects").alias("affects"))
    side = lambda col, a: pairs.join(rules, F.col(col) == F.col("doc_id")).drop("doc_id").withColumn("_a", F.lit(a))
    both = side("doc_a", True).unionByName(side("doc_b", False))
    out = both.groupBy("doc_a", "doc_b", "rule_id").agg(
        F.max("label").alias("label"), F.max("severity").alias("severity"), F.max("affects").alias("affects"), F.bool_or("_a").alias("in_a"), F.bool_or(~F.col("_a")).alias("in_b")
    )
    return out.withColumn("impact", impact_text(F.col("in_a"), F.col("in_b"), F.col("affects")))


def impact_text(in_a: Column, in_b: Column, affects: Column) -> Column:
    # The sentences below.
    def only(here: str, there: str) -> Column:
        return F.concat(
            F.lit(f"Present in Document {here} only, absent from Document {there} -- this specific risk to "),
            affects,
            F.lit(f" does not apply under Document {there}'s stated terms."),
        )

    shared = (
        "Appears in both documents. Whether this is actually the same risk depends on the clause wording -- amounts, "
        "durations, and triggers can still differ; open both clauses to compare them directly."
    )
    return F.when(in_a & in_b, F.lit(shared)).when(in_a, only("A", "B")).otherwise(only("B", "A"))
