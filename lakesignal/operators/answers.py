"""Model outputs as a table: JSON salvage, citations, obligations, overview, summary.

``raw`` is the text a model returned.  It is parsed once into a VARIANT column;
everything after that is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.fixed_rules import ANSWER_TEXTS, OBLIGATION_CATEGORIES, OVERVIEW_FIELDS, OVERVIEW_STATUSES
from lakesignal.functions.text import normalize, strip
from lakesignal.operators.grounding import ground_quotes
from lakesignal.operators.quote_index import QuoteIndex


def salvage_json(raw: Column) -> Column:
    """The JSON object in a model output: the whole text, else its outermost {...}; null when neither parses."""
    text = strip(raw)
    whole = F.try_parse_json(text)
    inner = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def with_parsed(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    return outputs.withColumn("data", salvage_json(F.col(raw))).withColumn("parse_error", F.col("data").isNull())


def truthy(v: Column) -> Column:
    """Truth value of a JSON value: false, null, 0, '' and empty containers are false."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def field(data: Column, path: str) -> Column:
    return F.try_variant_get(data, path, "variant")


def text_or(data: Column, path: str, default: str | None) -> Column:
    """Text of a truthy JSON field, else the default."""
    v = field(data, path)
    return F.coalesce(F.when(truthy(v), F.try_variant_get(v, "$", "string")), F.lit(default).cast("string"))


def items(data: Column, path: str) -> Column:
    """Elements of a JSON list; an absent or non-list field is empty."""
    return F.coalesce(F.try_variant_get(data, path, "array<variant>"), F.array().cast("array<variant>"))


def parse_answers(
    outputs: DataFrame, n_hits: str = "n_hits", raw: str = "raw", accept_text_numbers: bool = False, caller: str = "chat", need_context: bool = False
) -> DataFrame:
    """Add answer, grounded, cited (valid 1-based excerpt numbers in order), citations_requested, parse_error.

    Grounded means at least one valid citation, whatever the model claimed.  A
    claim without any becomes a refusal with a fixed text.  Booleans are never
    numbers; ``accept_text_numbers`` also takes numbers written as strings.
    ``caller`` picks the fixed texts (chat, scenario, cross_document).  With
    ``need_context`` a question without any hit gets the no-context answer,
    whatever the output says: such a question is never put to the model.
    """
    texts = ANSWER_TEXTS[caller]
    parsed = with_parsed(outputs, raw)
    asked = items(F.col("data"), "$.cited_excerpts")

    def number(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        whole = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        if accept_text_numbers:
            text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            whole = F.coalesce(whole, F.when(strip(text).rlike(r"^-*\d+$"), strip(text).try_cast("bigint")))
        return whole

    numbers = F.transform(asked, number)
    parsed = parsed.withColumns({"_numbers": numbers, "citations_requested": F.size(asked), "_claims": truthy(field(F.col("data"), "$.grounded"))})
    parsed = parsed.withColumn("cited", F.filter("_numbers", lambda n: n.isNotNull() & (n >= 1) & (n <= F.col(n_hits))))
    grounded = F.size("cited") > 0
    answer = F.coalesce(F.try_variant_get("data", "$.answer", "string"), F.lit(""))
    out = parsed.withColumns(
        {
            "grounded": grounded,
            "answer": F.when(F.col("parse_error"), texts["parse_error"]).when(F.col("_claims") & ~grounded, texts["ungrounded"]).otherwise(answer),
        }
    )
    if need_context:
        bare = F.col(n_hits) == 0
        out = out.withColumns(
            {
                "answer": F.when(bare, texts["no_context"]).otherwise(F.col("answer")),
                "citations_requested": F.when(bare, 0).otherwise(F.col("citations_requested")),
                "parse_error": ~bare & F.col("parse_error"),
            }
        )
    return out.drop("data", "_numbers", "_claims")


def resolve_citations(answers: DataFrame, hits: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Cited excerpt numbers joined to the retrieved chunk at that rank; repeats are kept."""
    cited = answers.select(*keys, F.posexplode("cited").alias("position", "rank"))
    return cited.join(hits.withColumn("rank", F.col("rank").cast("bigint")), [*keys, "rank"])


def citation_score(valid: Column, requested: Column) -> Column:
    return F.when(requested > 0, valid / requested)


# -- obligations ---------------------------------------------------------------


def parse_obligations(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """(doc_id, position, party, obligation, deadline, category, source_quote), first of each repeated pair."""
    parsed = with_parsed(outputs, raw)
    each = parsed.select("doc_id", F.posexplode(items(F.col("data"), "$.obligations")).alias("position", "o")).where(F.schema_of_variant("o").startswith("OBJECT"))
    category = F.try_variant_get("o", "$.category", "string")
    rows = each.select(
        "doc_id",
        "position",
        text_or(F.col("o"), "$.party", "unspecified").alias("party"),
        text_or(F.col("o"), "$.obligation", "").alias("obligation"),
        text_or(F.col("o"), "$.deadline", None).alias("deadline"),
        F.when(category.isin(*OBLIGATION_CATEGORIES), category).otherwise("other").alias("category"),
        text_or(F.col("o"), "$.source_quote", "").alias("source_quote"),
    )
    rest = ["position", "party", "obligation", "deadline", "category", "source_quote"]
    first = rows.groupBy("doc_id", normalize(F.col("party")).alias("_p"), normalize(F.col("obligation")).alias("_o")).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def grounded_obligations(outputs: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return ground_quotes(parse_obligations(outputs), chunks, documents, ["position"], "source_quote")


def obligation_counts(obligations: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return obligations.groupBy(*keys).agg(F.count_if("grounded").alias("grounded_count"), F.count(F.lit(1)).alias("total_count"))


# -- overview ---------------------------------------------------------------------


def overview_fields(outputs: DataFrame, chunks: DataFrame, documents: DataFrame, fields: Sequence[tuple[str, str]] = OVERVIEW_FIELDS) -> DataFrame:
    """One row per document and field; a found / unclear field without a grounded quote becomes insufficient_evidence."""
    parsed = with_parsed(outputs).where(~F.col("parse_error"))
    names = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(lab).alias("label")) for k, lab in fields])
    given = parsed.select("doc_id", F.try_variant_get("data", "$.fields", "map<string,variant>").alias("_given"), F.inline(names))
    entry = given.withColumn("_e", F.try_element_at("_given", F.col("key")))
    status = F.try_variant_get("_e", "$.status", "string")
    rows = entry.select(
        "doc_id",
        "key",
        "label",
        F.when(status.isin(*OVERVIEW_STATUSES), status).otherwise("insufficient_evidence").alias("claimed"),
        text_or(F.col("_e"), "$.value", None).alias("value"),
        text_or(F.col("_e"), "$.source_quote", None).alias("source_quote"),
    )
    checked = ground_quotes(rows.withColumn("_quote", F.coalesce("source_quote", F.lit(""))), chunks, documents, ["key"], "_quote")
    claims = F.col("claimed").isin("found", "unclear")
    kept = claims & F.col("source_quote").isNotNull() & F.col("grounded")
    return checked.select(
        "doc_id",
        "key",
        "label",
        F.when(claims & ~kept, "insufficient_evidence").otherwise(F.col("claimed")).alias("status"),
        F.when(kept, F.col("value")).alias("value"),
        F.when(kept, F.col("source_quote")).alias("source_quote"),
        F.when(kept, F.col("evidence_chunk_index")).alias("evidence_chunk_index"),
    )


def overview_items(outputs: DataFrame, chunks: DataFrame | None, documents: DataFrame | None, name: str, index: QuoteIndex | None = None) -> DataFrame:
    """Entries of a list field (plain texts, or objects with text and source_quote); blank ones are dropped.

    ``index`` is used in place of chunks and documents, so that several lists share one.
    """
    each = with_parsed(outputs).select("doc_id", F.posexplode(items(F.col("data"), f"$.{name}")).alias("position", "o"))
    whole = F.try_variant_get("o", "$", "string")
    is_object = F.schema_of_variant("o").startswith("OBJECT")
    rows = each.select(
        "doc_id",
        "position",
        F.when(is_object, F.coalesce(text_or(F.col("o"), "$.text", None), whole)).otherwise(whole).alias("text"),
        F.when(is_object, text_or(F.col("o"), "$.source_quote", "")).otherwise("").alias("source_quote"),
    ).where(strip(F.col("text")) != "")
    return ground_quotes(rows, chunks, documents, ["position"], "source_quote", index)


SUMMARY_LISTS = ("parties", "key_obligations", "important_dates", "penalty_clauses", "termination_conditions")


def parse_summaries(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """List fields as arrays of text (a single value becomes a list of one, null an empty list) and notice_period."""
    parsed = with_parsed(outputs, raw)

    def as_list(name: str) -> Column:
        v = field(F.col("data"), f"$.{name}")
        empty = F.array().cast("array<string>")
        kind = F.schema_of_variant(v)
        many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.when(v.isNull() | (kind == "VOID"), empty).when(kind.startswith("ARRAY"), many).otherwise(F.array(F.try_variant_get(v, "$", "string")))

    out = parsed.withColumns({n: as_list(n) for n in SUMMARY_LISTS} | {"notice_period": text_or(F.col("data"), "$.notice_period", None)})
    return out.drop("data")
