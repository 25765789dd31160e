"""Benchmark decontamination by spaced-seed hashing, with column functions and joins only.

Every window of a text is hashed through fixed masks that ignore some of its word positions, so a window still agrees
after words at ignored positions were replaced.  Window hashes of the benchmark are joined with those of the documents;
each hit names a document, an item and their offset.  Around every hit the two word sequences are laid over each other
at that offset and compared word by word: equal words earn one point, replaced ones cost ``cost``; the best stretch must
reach ``least`` points, or ``share`` of a shorter item.  The masks are proved to hit each stretch that is accepted: for
the words and points in question, ``missed`` searches all patterns of equal and replaced words for one without a hit,
and ``masks_for`` takes the first masks for which there is none.

Windows of documents meet the benchmark's hashes in the tasks that read them when the counted hashes are within a
limit, and by a shuffled join on the hash beyond it.  Texts are looked at again only for documents with a hit.  Copies
of a text are one row from the first aggregation on.

Defined cases: case, punctuation and white space do not count; a null or empty text or item has no word and no overlap;
items below ``fewest`` words (one, unless asked otherwise) are
never found; repeated documents and items are each reported once per distinct (doc_id, item_id), null ids included;
empty tables give an empty result; ``drop_contaminated`` keeps every column of the documents it keeps.
"""

from __future__ import annotations

import math
from collections import deque
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import bounded_broadcast, fresh_names, text_or_empty
from lakesignal.scale import pinned

# The masks; 1 is a word that counts, 0 one that is ignored.  The runs serve short items and other costs.
MASKS = ("101111", "10111001")
RUNS = ("11111", "1111", "111", "11", "1")


def missed(masks: tuple[str, ...], points: int, cost: int, longest: int | None = None) -> str | None:
    """The shortest pattern of equal (1) and replaced (0) words with ``points`` that no mask hits; None if there is none.

    All patterns of up to ``longest`` words are searched.  What a mask sees of one are its last words and its score; a
    score of zero or less is worth no more than a fresh start.
    """
    full = (1 << max(map(len, masks))) - 1
    bits = [int(m, 2) for m in masks]
    before, todo = {(0, 0): ("", 0)}, deque([(0, 0)])
    while todo:
        state = todo.popleft()
        pattern, n = before[state]
        if longest is not None and n >= longest:
            return None
        for same in (1, 0):
            seen, score = (state[0] << 1 | same) & full, state[1] + (1 if same else -cost)
            if score <= 0 or any(seen & m == m for m in bits):
                continue
            if score >= points:
                return f"{pattern}{same}"
            after = (seen & full >> 1, score)
            if after not in before:
                before[after] = (f"{pattern}{same}", n + 1)
                todo.append(after)
    return None


@lru_cache(maxsize=256)
def masks_for(points: int, cost: int, longest: int | None = None) -> tuple[str, ...]:
    """Masks of which one hits any stretch with ``points``."""
    return next(m for m in (MASKS, *[(run,) for run in RUNS]) if missed(m, max(points, 1), cost, longest) is None)


def words(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))


def _window_hashes(codes: Column, mask: str, seed: int) -> Column:
    """One hash per window of ``codes`` (hashes of words) as wide as ``mask``."""
    n = F.greatest(F.size(codes) - len(mask) + 1, F.lit(0))
    counted = [F.slice(codes, i + 1, n).alias(f"c{i}") for i, bit in enumerate(mask) if bit == "1"]
    return F.transform(F.arrays_zip(*counted), lambda w: F.xxhash64(w, F.lit(seed)))


def window_table(texts: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """(key, hash, at): the windows of each text through each of the masks."""
    step = texts.select(key, F.transform(words(F.col("_text")), lambda w: F.hash(w)).alias("_codes"))
    every = F.concat(*[_window_hashes(F.col("_codes"), m, i + 100 * len(m)) for i, m in enumerate(masks)])
    step = step.select(key, F.size("_codes").alias("_n"), every.alias("_hashes"))
    # The outer form: for the plain one Spark adds a filter on the array's size, which would build every array twice.
    out = step.select(key, "_n", F.posexplode_outer("_hashes").alias("_p", "hash")).where("hash is not null")
    at, first = F.col("_p"), F.lit(0)
    for m in masks[:-1]:  # the windows of a mask follow those of the masks before it
        first = first + F.greatest(F.col("_n") - len(m) + 1, F.lit(0))
        at = F.when(F.col("_p") >= first, F.col("_p") - first).otherwise(at)
    return out.select(key, "hash", at.alias("at"))


def _best_stretch(equal: Column, cost: int) -> Column:
    """(best, begin, end) of the highest-scoring stretch of an array of booleans; the first of equals."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("i", "run", "from", "best", "begin", "end")])

    def step(a: Column, same: Column) -> Column:
        run = a["run"] + F.when(same, 1).otherwise(-cost)
        fresh = F.when(a["run"] <= 0, a["i"]).otherwise(a["from"])
        better = (run > a["best"]) & same
        return F.struct(
            (a["i"] + 1).alias("i"), F.greatest(run, F.lit(0)).alias("run"), fresh.alias("from"),
            F.when(better, run).otherwise(a["best"]).alias("best"),
            F.when(better, fresh).otherwise(a["begin"]).alias("begin"),
            F.when(better, a["i"] + 1).otherwise(a["end"]).alias("end"),
        )

    return F.aggregate(equal, zero, step)


def overlaps(
    docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: int = 13, cost: int = 2, share: float = 0.8, fewest: int = 1, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(_key, item_id, score, doc_begin, doc_end): verified overlaps of texts, ``_key`` the digest of a text, with word positions."""
    texts = docs.select(text_or_empty(doc_text).alias("_text")).withColumn("_key", F.md5("_text"))
    tests = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("_text"))
    tests = pinned(tests.withColumn("_words", words(F.col("_text"))).where(F.size("_words") >= fewest))
    tests = tests.withColumn("_item", F.md5("_text"))
    # Below this many words an item needs fewer points; at most so many numbers are collected.
    n = F.size("_words")
    short = [r[0] for r in tests.where(F.ceil(n * share) < least).select(n).distinct().collect()]
    lengths: dict[tuple[str, ...], list[int | None]] = {masks_for(least, cost): [None]}
    for k in sorted(short):
        lengths.setdefault(masks_for(math.ceil(k * share), cost, k), []).append(k)

    hits = None
    for masks, those in lengths.items():
        wanted = n.isin([k for k in those if k is not None])
        own = tests.where(wanted | (F.ceil(n * share) >= least) if None in those else wanted)
        # Each window of a distinct item once.
        table = pinned(window_table(own.dropDuplicates(["_item"]), "_item", masks).distinct().withColumnRenamed("at", "item_at"))
        table = bounded_broadcast(table, table.count(), broadcast_rows)
        found = window_table(texts, "_key", masks).join(table, "hash").select("_key", "_item", (F.col("at") - F.col("item_at")).alias("shift"))
        hits = found if hits is None else hits.unionByName(found)
    hits = pinned(hits.distinct())
    keys = hits.select("_key").distinct()
    keys = bounded_broadcast(keys, keys.count(), broadcast_rows)
    held = texts.join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select("_key", words(F.col("_text")).alias("_doc"))
    laid = hits.join(held, "_key").join(tests.dropDuplicates(["_item"]).select("_item", "_words"), "_item")
    begin = F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.size("_doc"), F.col("shift") + F.size("_words")) - begin
    pairs = F.arrays_zip(F.slice("_doc", begin + 1, length).alias("a"), F.slice("_words", begin - F.col("shift") + 1, length).alias("b"))
    laid = laid.select("_key", "_item", begin.alias("begin"), F.size("_words").alias("n"), F.transform(pairs, lambda p: p["a"] == p["b"]).alias("equal"))
    best = laid.withColumn("s", _best_stretch(F.col("equal"), cost))
    good = best.where(F.col("s.best") >= F.least(F.lit(least), F.ceil(F.col("n") * share)))
    one = good.groupBy("_key", "_item").agg(
        F.max_by(F.struct(F.col("s.best").alias("score"), (F.col("begin") + F.col("s.begin")).alias("b"), (F.col("begin") + F.col("s.end")).alias("e")), F.struct("s.best", -F.col("begin"))).alias("r")
    )
    one = one.select("_key", "_item", "r.score", F.col("r.b").alias("doc_begin"), F.col("r.e").alias("doc_end"))
    return one.join(tests.select("_item", "item_id").distinct(), "_item").drop("_item")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, score, doc_begin, doc_end): one row per document and item found in it."""
    found = pinned(overlaps(docs, items, text, **how))
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text_or_empty(text)).alias("_key"))
    place = F.struct("score", "doc_begin", "doc_end")
    best = F.max_by(place, F.struct("score", -F.col("doc_begin"), -F.col("doc_end"))).alias("p")  # of rows with one id, a single text's overlap
    return keys.join(found, "_key").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "p.score", "p.doc_begin", "p.doc_end")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without those that hold a benchmark passage."""
    (key,) = fresh_names(docs.columns, "_key")
    found = pinned(overlaps(docs, items, text, **how).select(F.col("_key").alias(key)).distinct())
    found = bounded_broadcast(found, found.count())
    return docs.withColumn(key, F.md5(text_or_empty(text))).join(found, key, "left_anti").select(*docs.columns)
