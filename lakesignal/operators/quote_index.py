"""Positional shingle index of clauses and documents, for finding quoted passages without meeting every clause.

A unit is a clause or, as unit -1, its whole document.  The index has three tables, built in one pass each over the units
and stored, so that later quotes only read what they ask for:

* ``texts`` (doc_id, unit, t): normalised text
* ``grams`` (doc_id, gram, unit, pos): hash of the ``GRAM`` consecutive words from word ``pos`` on
* ``words`` (doc_id, word, unit): each content word of a unit once

All keys go beyond the document, so a document with most quotes or most clauses is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.text import STOPWORDS, content_words, distinct_content_words, normalize
from lakesignal.scale import pinned, salted_lookup

GRAM = 5
WHOLE = -1


def gram_hashes(words: Column) -> Column:
    """Hash of each run of ``GRAM`` words, in order; none for fewer words."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    rolled = lambda h: F.transform(F.slice(h, 1, F.greatest(n - GRAM + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)]))
    return F.transform(F.array(hashed), rolled)[0]


def split_words(normalized: Column) -> Column:
    return F.split(normalized, " ")


@dataclass(frozen=True)
class QuoteIndex:
    texts: DataFrame
    grams: DataFrame
    words: DataFrame
    is_stored: bool = False
    #: (doc_id): documents that come more than once
    again: DataFrame | None = None

    @staticmethod
    def of(chunks: DataFrame, documents: DataFrame, keep: bool = True) -> QuoteIndex:
        """Index of ``chunks`` (doc_id, chunk_index, text) and ``documents`` (doc_id, text).

        The tables are lazy but for the texts, which ``keep=False`` leaves lazy too, for a single use; ``stored`` writes the
        others.  Unstored, the units meet a one-off set of quotes of their document in one pass, which only hits leave.
        """
        whole = documents.select("doc_id", F.lit(WHOLE).alias("unit"), "text")
        units = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("unit"), "text").unionByName(whole)
        texts = units.select("doc_id", "unit", normalize(F.col("text")).alias("t"))
        again = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
        return replace(QuoteIndex.over(pinned(texts) if keep else texts), again=again)

    def stored(self) -> QuoteIndex:
        """The index with all tables written, ordered by document, so that readers skip what they do not ask for.

        Units are dealt by range once; their grams and words are made where they lie, so only texts are shuffled.
        """
        texts = pinned(self.texts.repartitionByRange("doc_id", "unit").sortWithinPartitions("doc_id", "unit"))
        lazy = QuoteIndex.over(texts)
        put = lambda df, *order: pinned(df.sortWithinPartitions(*order))
        return QuoteIndex(texts, put(lazy.grams, "doc_id", "gram"), put(lazy.words, "doc_id", "word"), True)

    @staticmethod
    def over(texts: DataFrame) -> QuoteIndex:
        """The lazy tables over written ``texts``."""
        grams = texts.select("doc_id", "unit", F.posexplode(gram_hashes(split_words(F.col("t")))).alias("pos", "gram"))
        words = texts.select("doc_id", "unit", F.explode(F.array_distinct(distinct_content_words(F.col("t")))).alias("word"))
        return QuoteIndex(texts, grams.select("doc_id", "gram", "unit", "pos"), words.select("doc_id", "word", "unit"))

    def word_units(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, word, unit): the units of the ``wanted`` (doc_id, word)."""
        wanted = wanted.select("doc_id", "word").distinct()
        return self.words.join(wanted, ["doc_id", "word"], "left_semi")


def asked_of_documents(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(doc_id, _asked): the rows of a document as structs, in arrays of about ``most`` at most, for a join that does not sort texts."""
    parts = rows.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    dealt = rows.join(parts, "doc_id").withColumn("_part", F.pmod(F.xxhash64(*columns), F.col("_parts")))
    return dealt.groupBy("doc_id", "_part").agg(F.collect_list(F.struct(*columns)).alias("_asked")).drop("_part").hint("shuffle_hash")


def contained(quotes: DataFrame, index: QuoteIndex, keys: list[str]) -> DataFrame:
    """(keys, exact, in_doc): the first clause whose text contains the quote ``_q``, and whether the whole document does.

    The words of a quote but the first and the last stand in the text as they are.  A probe is the run of ``GRAM`` such
    words in the quote's middle: only units with it are compared, each once.  Quotes with fewer words are compared with
    all units of their document.
    """
    w = split_words(F.col("_q"))
    inner = F.size(w) - 2
    middle = F.slice(w, F.floor((inner - GRAM) / 2).cast("int") + 2, GRAM)
    probed = quotes.select(*keys, "_q", F.when(inner >= GRAM, gram_hashes(middle)[0]).alias("gram"))
    probes = pinned(probed)  # a hash a quote: its size decides how the index is joined
    long = probes.where("gram is not null")
    # first the index by the wanted grams, then quotes: equal probes do not repeat index rows before they are compared
    hits = index.grams.select("doc_id", "gram", "unit").join(long.select("doc_id", "gram").distinct(), ["doc_id", "gram"], "left_semi").distinct()
    near = long.join(hits, ["doc_id", "gram"]).select(*keys, "_q", "unit")
    near = near.join(index.texts, ["doc_id", "unit"])
    short = salted_lookup(index.texts, probes.where("gram is null").select(*keys, "_q"), ["doc_id"], 4)
    found = near.select(*keys, "unit", "_q", "t").unionByName(short.select(*keys, "unit", "_q", "t")).where(F.contains("t", "_q"))
    return _places(found, keys)


def _places(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.min(F.when(F.col("unit") != WHOLE, F.col("unit"))).alias("exact"), F.bool_or(F.col("unit") == WHOLE).alias("in_doc"))


def _hits(rest: list[str], threshold: float, least_words: int):
    """For each unit the asked quotes that it contains, or of whose words it has a share of ``threshold``; no shares for documents that come again."""
    word, stop = re.compile("[a-z0-9]+"), frozenset(STOPWORDS)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column("t").to_pylist(), batch.column("_asked").offsets.to_pylist()
            asked = batch.column("_asked").values
            quotes, again = asked.field("qs").to_pylist(), asked.field("_again").to_pylist()
            known: dict[str, tuple] = {}

            def parts(q: str, known: dict[str, tuple] = known) -> tuple:
                if q not in known:
                    # the words of a quote but the first and the last stand in the text as they are
                    known[q] = [w for w in word.findall(q) if len(w) > 1 and w not in stop], max(q.split(" ")[1:-1], key=len, default=None)
                return known[q]

            found = []
            for i, text in enumerate(texts):
                held = set(word.findall(text))
                # few quotes are compared at once, which is quicker than taking the text apart
                whole = set(text.split(" ")) if of[i + 1] - of[i] > 16 else None
                for j in range(of[i], of[i + 1]):
                    exact, words = False, {}
                    for q in quotes[j]:
                        own, probe = parts(q)
                        words[len(own)] = words.get(len(own), []) + own if len(quotes[j]) > 1 else own
                        exact = exact or ((whole is None or probe is None or probe in whole) and q in text)
                    # quotes of one key with as many words count as one
                    share = max((sum(map(held.__contains__, w)) / n for n, w in words.items() if n >= least_words), default=0.0)
                    near = share >= threshold and not again[j]
                    if exact or near:
                        found.append((i, j, exact, share if near else None))
            row, at, exact, share = map(list, zip(*found, strict=True)) if found else [[] for _ in range(4)]
            row, at = pa.array(row, pa.int64()), pa.array(at, pa.int64())
            keys = [batch.column("doc_id").take(row), *[asked.field(k).take(at) for k in rest]]
            yield pa.record_batch([*keys, batch.column("unit").take(row), pa.array(exact, pa.bool_()), pa.array(share, pa.float64())], ["doc_id", *rest, "unit", "holds", "share"])

    return hits


def found_at_once(quotes: DataFrame, index: QuoteIndex, keys: list[str], threshold: float, least_words: int) -> DataFrame:
    """(keys, exact, in_doc, ratio, neg_unit, doc_ratio): ``contained`` and ``overlapping`` in one pass over the texts.

    A text is dealt once, to the quotes (keys, _q) of its document, which come in bounded arrays; only hits leave a row.
    """
    rest = [k for k in keys if k != "doc_id"]
    again = pinned(index.again)
    # dealt by document once: the quotes of a key, and then the keys of a document, meet where they lie
    parts = quotes.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / 512).alias("_parts")).join(again.withColumn("_again", F.lit(True)), "doc_id", "left")
    dealt = quotes.select(*keys, "_q").join(parts, "doc_id").withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_parts")))
    dealt = dealt.groupBy("doc_id", "_part", *rest, "_again").agg(F.collect_set("_q").alias("qs"))
    asked = dealt.groupBy("doc_id", "_part").agg(F.collect_list(F.struct(*rest, "qs", "_again")).alias("_asked")).hint("shuffle_hash")
    held = index.texts.where("t is not null").join(asked, "doc_id").select("doc_id", "unit", "t", "_asked")
    types = dict(quotes.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in ["doc_id", *rest]) + "unit int, holds boolean, share double"
    found = held.mapInArrow(_hits(rest, threshold, least_words), schema)
    clause = F.col("unit") != WHOLE
    best = found.groupBy(*keys).agg(
        F.min(F.when(clause & F.col("holds"), F.col("unit"))).alias("exact"),
        F.bool_or(~clause & F.col("holds")).alias("in_doc"),
        F.max(F.when(clause & F.col("share").isNotNull(), F.struct(F.col("share").alias("ratio"), (-F.col("unit")).alias("neg_unit")))).alias("best"),
        F.max(F.when(~clause, F.col("share"))).alias("doc_ratio"),
    )
    best = best.select(*keys, "exact", "in_doc", "best.ratio", "best.neg_unit", "doc_ratio")
    if not again.limit(1).count():
        return best
    # the words of a document's copies add up, as in an index of them
    copies = QuoteIndex.over(pinned(index.texts.join(again, "doc_id", "left_semi")))
    asked = quotes.select(*keys, "_q", content_words(F.col("_q")).alias("_w")).distinct().where(F.size("_w") >= least_words).join(again, "doc_id", "left_semi")
    far = overlapping(asked, copies, keys, threshold).withColumnsRenamed({"ratio": "_ratio", "neg_unit": "_neg_unit", "doc_ratio": "_doc_ratio"})
    return best.join(far, keys, "full").select(*keys, "exact", "in_doc", *[F.coalesce(c, f"_{c}").alias(c) for c in ("ratio", "neg_unit", "doc_ratio")])


def overlapping(quotes: DataFrame, index: QuoteIndex, keys: list[str], threshold: float) -> DataFrame:
    """(keys, ratio, neg_unit, doc_ratio): the best share of a quote's content words ``_w`` in one clause, and in the document.

    Shares below ``threshold`` are not all found.  Counting filter: a unit with enough of the words holds one of any
    choice of words that together occur more often than words may be missing; the rarest in the document are chosen.
    Only units that hold one of these are counted.
    """
    counted = quotes.select(*keys, F.size("_w").alias("n"), F.explode("_w").alias("word")).groupBy(*keys, "n", "word").agg(F.count(F.lit(1)).alias("times"))
    asked = pinned(counted)
    places = pinned(index.word_units(asked))
    common = places.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("units"))
    ranked = asked.join(common, ["doc_id", "word"], "left").groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("units", F.lit(0)).alias("units"), "word", "times"))).alias("ws"))
    spare = F.col("n") - F.floor(threshold * F.col("n"))  # so many may be missing, or one less
    before = F.transform("ws", lambda x, i: F.aggregate(F.slice("ws", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["times"]))
    chosen = ranked.select(*keys, F.explode(F.filter(F.arrays_zip("ws", before.alias("before")), lambda z: z["before"] <= spare)).alias("z")).select(*keys, F.col("z.ws.word").alias("word"))
    candidates = chosen.join(places, ["doc_id", "word"]).select(*keys, "unit").distinct()
    matched = candidates.join(asked, keys).join(places, ["doc_id", "word", "unit"])
    ratios = matched.groupBy(*keys, "unit", "n").agg((F.sum("times") / F.col("n")).alias("ratio"))
    in_clause = F.col("unit") != WHOLE
    best = ratios.groupBy(*keys).agg(
        F.max(F.when(in_clause, F.struct("ratio", (-F.col("unit")).alias("neg_unit")))).alias("best"), F.max(F.when(~in_clause, F.col("ratio"))).alias("doc_ratio")
    )
    return best.select(*keys, "best.ratio", "best.neg_unit", "doc_ratio")


def prepared(quotes: DataFrame, keys: list[str], quote: str) -> DataFrame:
    """(keys, _q, _w): the normalised quote and its content words, without empty ones."""
    return quotes.select(*keys, normalize(F.col(quote)).alias("_q"), content_words(F.col(quote)).alias("_w")).where(F.col("_q") != "").distinct()
