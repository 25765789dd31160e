"""Ranked lexical search: best-first document intervals bounded by range-maximum tables of the posting lists.

1. Whole texts are read once.  A task keeps, per document, its number of terms and the frequencies of those terms that an
   item asks for.  N, L and the document frequencies are sums over all documents.
2. A shard is a bounded number of postings of one task, documents ordered by id.  Each posting list carries its impacts
   (weight times saturated frequency) and a sparse table: the place of the largest impact in every window of a power of
   two, so that the largest impact of any range takes two look-ups.
3. For an item, an interval of documents is bounded by the sum, over its terms, of the largest impact in the interval.
   Intervals with the highest bounds go first: the document that holds the largest of these impacts is scored in full, and
   the intervals on its two sides get bounds of their own.  The search ends when no bound can reach the k-th best score.
   As nothing but intervals that cannot contribute is left out, the answer is exact.
4. A small share of the documents, chosen by hash, is searched first.  Its k-th score is a lower limit of the final one, so
   all other shards start with it.  The shards' answers are merged per item, k per sub-group before they meet.

Items are taken in blocks with a bounded size, and only a block's terms and weights are broadcast; documents are never
paired with items in a shuffle, no matter how frequent a word is.

Defined cases: a null text has no term; a document without terms counts for nothing and is never found; an item without
terms has no row; documents with equal ids are ranked each; null ids come after all others; equal rows of items are one
item, different texts under one item id are ranked each; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import pinned
from lakesignal.scale import top_per_key

#: Bytes of item text that are searched for at once.
BLOCK_BYTES = 8 << 20
#: Postings of a shard; a posting takes about 120 bytes with its tables.
SHARD_POSTINGS = 1_000_000
#: One of so many documents is searched first.
SEED_SHARE = 32
#: Intervals that are split together at most.
WIDEST = 2048

_WORD = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
_TABLE = bytes(ord(chr(c).lower()) if c < 0x80 and c in _WORD else c if c in _WORD else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other code points from U+0080 on; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def frequencies(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, codes, tfs): documents with a term, the number of all their terms and the frequencies of the asked ones."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.get
        for batch in batches:
            keep, lengths, codes, tfs = [], [], [], []
            for at, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                found = [c for c in map(code, words) if c is not None]
                which, times = np.unique(np.array(found, np.int32), return_counts=True)
                keep.append(at)
                lengths.append(len(words))
                codes.append(which)
                tfs.append(times)
            ids = batch.column(0).take(pa.array(keep, pa.int32()))
            lists = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(codes, lists[0]), pa.array(tfs, lists[1])], ["doc", "n", "codes", "tfs"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).mapInArrow(count, f"doc {kind}, n long, codes array<int>, tfs array<long>")


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents in order, each with its impacts and their range-maximum tables."""

    def __init__(self, n: np.ndarray, codes: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, weights: np.ndarray, total: int, length: int):
        self.docs = len(n)
        doc = np.repeat(np.arange(self.docs, dtype=np.int64), sizes)
        key = codes.astype(np.int64) * self.docs + doc
        order = np.argsort(key)
        self.key, doc, codes, tf = key[order], doc[order], codes[order], tfs[order]
        m = 75 + (25 * n * total) // length
        self.doc = doc.astype(np.int32)
        self.impact = weights[codes] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        self.start = np.searchsorted(codes, np.arange(len(weights) + 1))
        longest = int(np.diff(self.start).max(initial=0))
        # places[j][i]: where the largest of the 2**j impacts from i on is; windows that leave a list are never asked for
        self.places = [np.arange(len(doc), dtype=np.int32)]
        while 2 << (len(self.places) - 1) <= longest:
            low, half = self.places[-1], 1 << (len(self.places) - 1)
            a, b = low[:-half], low[half:]
            here = low.copy()
            here[: len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.places.append(here)
        self.places = np.stack(self.places)

    def peaks(self, left: np.ndarray, right: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, split) per interval: the sum of the largest impacts of its ranges, and the document with the largest."""
        size = right - left
        level = np.frexp(np.maximum(size, 1))[1] - 1
        last = len(self.impact) - 1
        a = self.places[level, np.minimum(left, last)]
        b = self.places[level, np.clip(right - (1 << level), 0, last)]
        x, y = self.impact[a], self.impact[b]
        most = np.where(size > 0, np.maximum(x, y) * times, 0)
        best = most.argmax(axis=1)
        row = np.arange(len(best))
        place = np.where(x[row, best] >= y[row, best], a[row, best], b[row, best])
        return most.sum(axis=1), self.doc[place]

    def search(self, codes: np.ndarray, times: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, document) with at least ``floor``, best first; ``times`` is how often the item has a term."""
        here = self.start[codes + 1] > self.start[codes]
        codes, times = codes[here], times[here]
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(codes):
            return scores, found
        left, right = self.start[codes][None, :], self.start[codes + 1][None, :]
        bound, split = self.peaks(left, right, times)
        low = np.zeros(1, np.int64)  # first document of the interval
        offset, width = codes.astype(np.int64) * self.docs, 1
        last = len(self.key) - 1
        while True:
            theta, worst = (scores[-1], found[-1]) if len(scores) == k else (floor, self.docs)
            theta = max(theta, floor)
            alive = (bound > theta) | (bound == theta) & (low <= worst)
            if not alive.any():
                return scores, found
            if not alive.all():
                left, right, bound, split, low = left[alive], right[alive], bound[alive], split[alive], low[alive]
            take = np.zeros(len(bound), bool)
            take[np.argpartition(-bound, width - 1)[:width] if len(bound) > width else slice(None)] = True
            width = min(2 * width, WIDEST)
            l, r, doc = left[take], right[take], split[take].astype(np.int64)
            wanted = offset + doc[:, None]
            at = np.clip(np.searchsorted(self.key, wanted), l, r)
            spot = np.minimum(at, last)
            has = (at < r) & (self.key[spot] == wanted)
            full = np.where(has, self.impact[spot] * times, 0).sum(axis=1)
            good = full >= theta
            scores, found = np.concatenate([scores, full[good]]), np.concatenate([found, doc[good]])
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]
            # the two sides of the document, each with its own ranges
            sides_l, sides_r = np.concatenate([l, at + has]), np.concatenate([at, r])
            sides_low = np.concatenate([low[take], doc + 1])
            some = (sides_r > sides_l).any(axis=1)
            sides_l, sides_r, sides_low = sides_l[some], sides_r[some], sides_low[some]
            b, s = self.peaks(sides_l, sides_r, times)
            rest = ~take
            left, right = np.concatenate([left[rest], sides_l]), np.concatenate([right[rest], sides_r])
            bound, split, low = np.concatenate([bound[rest], b]), np.concatenate([split[rest], s]), np.concatenate([low[rest], sides_low])


def _answers(forward: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, total: int, length: int, k: int, floors: np.ndarray) -> DataFrame:
    """(item, doc, score): the k best of every shard that may be among the k best of all."""
    kind = forward.schema["doc"].dataType.simpleString()
    shared = forward.sparkSession.sparkContext.broadcast((asked, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, floors = shared.value
        held: list[pa.RecordBatch] = []

        def answer() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, [("doc", "ascending")]))  # nulls at the end
            lists = table["codes"].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            shard = Shard(
                table["n"].to_numpy(), lists.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy(), sizes, weights, total, length
            )
            items, places, scores = [], [], []
            for i, (codes, times) in enumerate(asked):
                s, d = shard.search(codes, times, k, int(floors[i]))
                items.append(np.full(len(s), i, np.int32))
                places.append(d)
                scores.append(s)
            ids = table["doc"].combine_chunks().take(pa.array(np.concatenate(places)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids, pa.array(np.concatenate(scores))], ["item", "doc", "score"])

        postings = 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= SHARD_POSTINGS:
                yield answer()
                held, postings = [], 0
        if postings:
            yield answer()

    return forward.mapInArrow(run, f"item int, doc {kind}, score long")


def _merged(answers: DataFrame, k: int) -> DataFrame:
    return top_per_key(answers, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], k)


def _search_block(docs: DataFrame, block: list, doc_id: str, text: str, k: int, item_kind: str, doc_kind: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for a bounded list of (item id, text)."""
    spark = docs.sparkSession
    words = [terms(t) for _, t in block]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    asked = []
    for ws in words:
        codes, times = np.unique(np.array([vocabulary[w] for w in ws], np.int64), return_counts=True)
        asked.append((codes, times.astype(np.int64)))
    forward = pinned(frequencies(docs, doc_id, text, vocabulary))
    sums = forward.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("length")).first()
    total, length = sums["total"], sums["length"] or 1
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for r in forward.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row per term of the block
        weights[r["code"]] = weight(total, r["count"])
    asked = [(c[weights[c] > 0], t[weights[c] > 0]) for c, t in asked]
    weights = weights[:-1]
    first = forward.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SEED_SHARE)) == 0)
    seeds = _merged(_answers(first, asked, weights, total, length, k, np.ones(len(asked), np.int64)), k)
    floors = np.ones(len(asked), np.int64)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    best = _merged(_answers(forward, asked, weights, total, length, k, floors), k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_kind}")
    return best.join(names, "item").select("item_id", "rank", F.col("doc").cast(doc_kind).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item, best first."""
    item_kind, doc_kind = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    asked = pinned(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length(F.trim("text")) > 0).distinct())
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = _search_block(docs, [tuple(r) for r in block], doc_id, text, k, item_kind, doc_kind) if block else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long") if out is None else out
