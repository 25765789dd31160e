"""Is a quoted passage in its document, and in which clause?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.text import CASE_STOPWORDS, distinct_content_words, normalize
from lakesignal.operators.quote_index import QuoteIndex, contained, found_at_once, overlapping, prepared
from lakesignal.scale import pinned, salted_lookup, top_per_key

OVERLAP_THRESHOLD, MIN_CONTENT_WORDS = 0.85, 3


def ground_quotes(
    quotes: DataFrame, chunks: DataFrame | None, documents: DataFrame | None, quote_keys: Sequence[str] = ("quote_id",), quote: str = "quote", index: QuoteIndex | None = None
) -> DataFrame:
    """Add ``grounded`` and ``evidence_chunk_index`` to rows (doc_id, quote keys, quote).

    A quote is grounded by, in order: exact text in a clause (first such
    clause); content-word overlap with a clause (best ratio, first on ties);
    exact text in the document; overlap with the document.  ``index`` is a
    stored index to use in place of chunks and documents.
    """
    keys = ["doc_id", *quote_keys]
    index = index or QuoteIndex.of(chunks, documents, keep=False)
    quotes = pinned(quotes)  # read for what is asked and for the result
    if index.is_stored:
        q = pinned(prepared(quotes, keys, quote))
        exact = pinned(contained(q, index, keys))
        open_ones = q.where(F.size("_w") >= MIN_CONTENT_WORDS).join(exact.where("exact is not null"), keys, "left_anti")
        out = quotes.join(exact, keys, "left").join(overlapping(open_ones, index, keys, OVERLAP_THRESHOLD), keys, "left")
    else:
        asked = quotes.select(*keys, normalize(F.col(quote)).alias("_q")).where("_q <> ''")
        out = quotes.join(found_at_once(asked, index, keys, OVERLAP_THRESHOLD, MIN_CONTENT_WORDS), keys, "left")
    near = F.coalesce(F.col("ratio") >= OVERLAP_THRESHOLD, F.lit(False))
    whole = F.coalesce("in_doc", F.lit(False)) | F.coalesce(F.col("doc_ratio") >= OVERLAP_THRESHOLD, F.lit(False))
    return out.withColumns(
        {
            "grounded": F.col("exact").isNotNull() | near | whole,
            "evidence_chunk_index": F.when(F.col("exact").isNotNull(), F.col("exact")).when(near, -F.col("neg_unit")),
        }
    ).drop("exact", "in_doc", "ratio", "neg_unit", "doc_ratio")


def best_chunks_by_overlap(
    answers: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("case_id",), text: str = "expected_answer", top_n: int = 2, min_overlap: int = 2
) -> DataFrame:
    """Chunks of the case's document sharing most distinct words with the expected answer."""
    words = lambda c: distinct_content_words(F.col(c), CASE_STOPWORDS, 2)
    a = answers.select("doc_id", *keys, words(text).alias("_a"))
    c = chunks.select("doc_id", "chunk_index", words("text").alias("_c"))
    pairs = salted_lookup(c, a, ["doc_id"], 4).select(*keys, "doc_id", "chunk_index", F.size(F.array_intersect("_a", "_c")).alias("overlap"))
    return top_per_key(pairs.where(F.col("overlap") >= min_overlap), [*keys, "doc_id"], [F.desc("overlap"), F.col("chunk_index")], top_n)
