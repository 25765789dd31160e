"""Clause-aware chunking of document texts.

Everything happens inside one row with array functions, so a table of
documents is chunked in a map-only job: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.text import WHITE_SPACE, let, strip

# Line forms that start a clause.
BOUNDARY_PATTERNS = (
    r"^\s*\d{1,2}(?:\.\d{1,2}){0,2}\.?\s+\S",
    r"^\s*\([a-zA-Z0-9]{1,4}\)\s+\S",
    r"(?i)^\s*(ARTICLE|Article|SECTION|Section|Clause|CLAUSE)\s+[IVXLCM\d]+",
    r"^[A-Z][A-Z \-&]{6,60}$",
)
SENTENCE_END = r"(?<=[.!?])\s+"
MAX_CHARS, MIN_CHARS = 1500, 200


def is_boundary(line: Column) -> Column:
    """True for a line that looks like the start of a clause or section."""

    def test(stripped: Column) -> Column:
        hit = F.lit(False)
        for p in BOUNDARY_PATTERNS:
            hit = hit | stripped.rlike(p)
        return (stripped != "") & hit

    return let(strip(line), test)


def boundary_pieces(text: Column) -> Column:
    """Split at boundary lines; the first line always starts a piece; empty pieces are dropped."""

    def cut(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | is_boundary(F.element_at(lines, i)))

        def pieces(s: Column) -> Column:
            def piece(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(s, k + 1), F.size(lines) + 1)
                return strip(F.array_join(F.slice(lines, start, stop - start), "\n"))

            return F.filter(F.transform(s, piece), lambda p: p != "")

        return let(starts, pieces)

    return let(F.split(text, "\n"), cut)


def sentence_packs(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Sentences packed greedily up to ``max_chars``; a longer sentence stays whole.

    With one blank between sentences a pack is the longest run of at most ``max_chars`` characters that stops where a
    sentence does, so one pattern finds all packs; no text is built sentence by sentence.
    """
    spaced = F.regexp_replace(F.ltrim(text, F.lit(WHITE_SPACE)), SENTENCE_END, " ")
    stop = r"(?:(?<=[.!?])(?= )|\z)"
    packs = F.regexp_extract_all(spaced, F.lit(rf"(?s) ?+(.{{1,{max_chars}}}{stop}|.+?{stop})"), F.lit(1))
    # a text of white space only has no pack
    return F.when(text.isNotNull(), F.when(spaced == "", F.array(text)).otherwise(F.transform(packs, strip)))


def merge_small(pieces: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Join short pieces with a blank line while they fit; a short remainder joins the last chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["buf"] != "", strip(F.concat(acc["buf"], F.lit("\n\n"), piece))).otherwise(piece)

        def place(candidate: Column) -> Column:
            fits = F.length(candidate) <= max_chars
            buf = F.when(fits, candidate).otherwise(piece)
            done = F.when(~fits & (acc["buf"] != ""), F.array_append(acc["done"], acc["buf"])).otherwise(acc["done"])
            flush = F.length(buf) >= min_chars
            return F.struct(
                F.when(flush, F.array_append(done, buf)).otherwise(done).alias("done"), F.when(flush, F.lit("")).otherwise(buf).alias("buf")
            )

        return let(joined, place)

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        tail = strip(F.concat(F.get(acc["done"], n - 1), F.lit("\n\n"), acc["buf"]))
        absorbed = F.array_append(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), tail)
        return (
            F.when(acc["buf"] == "", acc["done"])
            .when((n > 0) & (F.length(acc["buf"]) < min_chars), absorbed)
            .otherwise(F.array_append(acc["done"], acc["buf"]))
        )

    return F.aggregate(pieces, start, add, finish)


def chunk_array(text: Column, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    def sized(pieces: Column) -> Column:
        packed = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > max_chars, sentence_packs(p, max_chars)).otherwise(F.array(p))))
        return F.when(F.size(pieces) <= 1, sentence_packs(text, max_chars)).otherwise(packed)

    return merge_small(let(boundary_pieces(text), sized), min_chars, max_chars)


def heading_of(chunk: Column) -> Column:
    """First line of the chunk if it is a boundary line."""
    return let(strip(F.substring_index(chunk, "\n", 1)), lambda first: F.when(is_boundary(first), first))


def chunk_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, chunk_index, text, heading)``, whole texts, in document order."""
    exploded = documents.select(doc_id, F.posexplode(chunk_array(F.col(text), max_chars, min_chars)).alias("chunk_index", "text"))
    return exploded.withColumn("heading", heading_of(F.col("text")))


def clause_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with its boundary flag."""
    lines = documents.select(doc_id, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.withColumn("is_boundary", is_boundary(F.col("line")))


def sentences(text: Column, min_chars: int = 12) -> Column:
    """Sentences of at least ``min_chars`` characters, trimmed: white space at an end of the text goes first, all other before a sentence at the split."""
    return F.filter(F.split(strip(text), SENTENCE_END), lambda s: F.length(s) >= min_chars)
