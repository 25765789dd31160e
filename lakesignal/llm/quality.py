"""Quality rules with thresholds learnt from mergeable quantile sketches per language and source.

Counts of one text are column functions (no shuffle).  KLL sketches of the rates are built map-side per (lang, source),
merged upwards to the language and to the whole corpus, and read as medians and quartiles.  A document fails when a
rate lies further outside the middle half than ``reach`` times its half-width.  A group with fewer than ``enough``
documents is judged by its language, a small language by the corpus, so a rare source has no thresholds of its own.

Defined cases: a null text counts as empty (no words, fails the base rule); null lang or source is a group of its own;
repeated rows are judged alike and all count in the sketches; an empty table gives an empty result; further columns of
the input are kept by ``keep_good`` and not read by ``quality_verdicts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import SPACE_CLASS, SPACES, text_or_empty
from lakesignal.scale import attach_row, pinned, salted_lookup

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``least`` is the half-width assumed at least, so that a rate that hardly varies still has room."""

    name: str
    value: Column
    least: float
    both_sides: bool = False


def counts(text: Column) -> dict[str, Column]:
    """Words and the base counts of a text (a column name or a bound column, used several times)."""
    bare = F.trim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return {
        "_words": words,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
    }


def windows(words: Column) -> Column:
    """(w1, w2, w3, at) for each window of three words."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.arrays_zip(
            F.slice(words, 1, F.greatest(n - 2, F.lit(0))).alias("w1"),
            F.slice(words, 2, F.greatest(n - 2, F.lit(0))).alias("w2"),
            F.slice(words, 3, F.greatest(n - 2, F.lit(0))).alias("w3"),
            F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))).alias("at"),
        ),
    )


def repeat_words(sorted_windows: Column) -> Column:
    """Words that lie in windows found twice or more; the argument is a column, sorted by the three words."""
    n = F.size(sorted_windows)
    pairs = F.arrays_zip(F.slice(sorted_windows, 1, n - 1).alias("a"), F.slice(sorted_windows, 2, n - 1).alias("b"))
    same = F.filter(pairs, lambda p: (p["a"]["w1"] == p["b"]["w1"]) & (p["a"]["w2"] == p["b"]["w2"]) & (p["a"]["w3"] == p["b"]["w3"]))
    at = F.concat(F.transform(same, lambda p: p["a"]["at"]), F.transform(same, lambda p: p["b"]["at"]))
    covered = F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
    return F.when(n >= 2, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, n_upper to (narrow) ``docs``.

    Hashes of the windows tell in linear time that a text repeats none; only the others are sorted and compared word by word.
    """
    step = docs.withColumn("_text", text_or_empty(text))
    step = step.withColumns(counts(F.col("_text"))).drop("_text")
    step = step.withColumn("_windows", windows(F.col("_words")))
    step = step.withColumn("_hashes", F.transform("_windows", lambda w: F.xxhash64(w["w1"], F.lit(0), w["w2"], F.lit(0), w["w3"])))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    step = step.withColumn("_sorted", F.when(again, F.sort_array("_windows")))
    return step.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNotNull(), repeat_words(F.col("_sorted"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_upper",
    )


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def rules() -> list[Rule]:
    return [
        Rule("word_length", _rate("word_chars", "n_words"), 0.2, both_sides=True),
        Rule("symbols", _rate("n_symbols", "word_chars"), 0.005),
        Rule("dup_lines", _rate("n_dup_lines", "n_lines"), 0.06),
        Rule("repeat_words", _rate("n_repeat_words", "n_words"), 0.05),
        Rule("upper", _rate("n_upper", "word_chars"), 0.02),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(measured: DataFrame, lang: str, source: str, k: int, reach: float, enough: int) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high): one row for each pair of language and source that occurs."""
    names = [r.name for r in rules()]
    fit = F.col("base_failed")  # documents that fail the base rule say nothing about the others
    by_source = measured.groupBy(lang, source).agg(
        *[F.kll_sketch_agg_double(F.when(~fit, r.value), k).alias(r.name) for r in rules()], F.count_if(~fit).alias("n")
    )
    merge = lambda df, *keys: df.groupBy(*keys).agg(*[F.kll_merge_agg_double(m, k).alias(m) for m in names], F.sum("n").alias("n"))
    # Small tables from here on: one row per group.
    by_source = by_source.withColumn("_all", F.lit(1))
    by_lang = merge(by_source, "_all", lang)
    overall = merge(by_lang, "_all")
    pick = by_source.drop("_all").alias("s").join(by_lang.drop("_all").alias("l"), F.col(f"s.{lang}").eqNullSafe(F.col(f"l.{lang}")))
    pick = attach_row(pick, overall.select(*[F.col(m).alias(f"_o_{m}") for m in names]))

    def chosen(name: str) -> Column:
        return F.when(F.col("s.n") >= enough, F.col(f"s.{name}")).when(F.col("l.n") >= enough, F.col(f"l.{name}")).otherwise(F.col(f"_o_{name}"))

    sketches = pick.select(F.col(f"s.{lang}").alias(lang), F.col(f"s.{source}").alias(source), *[chosen(m).alias(m) for m in names])
    out = sketches
    for r in rules():
        known = F.kll_sketch_get_n_double(r.name) > 0
        q = [F.when(known, F.kll_sketch_get_quantile_double(r.name, F.lit(p))) for p in (0.25, 0.5, 0.75)]
        low = q[0] - reach * F.greatest(q[1] - q[0], F.lit(r.least)) if r.both_sides else F.lit(0.0)
        out = out.withColumns({f"{r.name}_low": low, f"{r.name}_high": q[2] + reach * F.greatest(q[2] - q[1], F.lit(r.least))})
    return out.drop(*names)


def _judged(measured: DataFrame, lang: str, source: str, k: int, reach: float, enough: int, salts: int) -> DataFrame:
    limits = thresholds(measured, lang, source, k, reach, enough)
    group = F.xxhash64(F.coalesce(F.col(lang), F.lit("")), F.col(lang).isNull(), F.coalesce(F.col(source), F.lit("")), F.col(source).isNull())
    rows = measured.withColumn("_group", F.struct(group.alias("h"), F.col(lang).alias("l"), F.col(source).alias("s")))
    named = limits.select(F.struct(group.alias("h"), F.col(lang).alias("l"), F.col(source).alias("s")).alias("_group"), *[c for c in limits.columns if c not in (lang, source)])
    # Struct keys compare their null fields as equal, so null languages and sources find their own row.
    out = salted_lookup(rows, named, ["_group"], salts, "inner")
    ok = F.lit(True)
    for r in rules():
        ok = ok & (r.value >= F.col(f"{r.name}_low")) & (r.value <= F.col(f"{r.name}_high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))


def quality_verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    k: int = 4096, reach: float = 6.0, enough: int = 200, salts: int = 16,
) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = pinned(with_counts(narrow).drop("text").withColumn("base_failed", base_failed()))
    out = _judged(measured, "lang", "source", k, reach, enough, salts)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
