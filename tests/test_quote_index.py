"""Quote grounding through the positional index against comparing every quote with every clause."""

import random
import re

import pytest

from lakesignal.functions.text import STOPWORDS
from lakesignal.operators.grounding import ground_quotes
from lakesignal.operators.quote_index import QuoteIndex

WORDS = ["rent", "the", "tenant", "owner", "of", "roof", "pay", "month", "notice", "a", "days", "x", "Tax", "tax's", "deposit", "a1", "to", "clause"]


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def content(t):
    return [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOPWORDS and len(w) > 1]


def plain(quote, chunks, document):
    q, words = norm(quote), content(quote)
    if not q:
        return False, None
    for i, c in chunks:
        if q in norm(c):
            return True, i
    share = lambda t: sum(w in set(content(t)) for w in words) / len(words) if words else 0
    if len(words) >= 3:
        best = max(((share(c), -i) for i, c in chunks), default=(0, 0))
        if best[0] >= 0.85:
            return True, -best[1]
    return q in norm(document) or len(words) >= 3 and share(document) >= 0.85, None


def corpus(seed, documents=12):
    rng = random.Random(seed)
    chunks, docs, quotes = [], [], []
    for d in range(documents):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 6, 20, 45]))) for _ in range(rng.choice([1, 3, 9]))]
        parts += parts[:1]  # a repeated clause: the first one counts
        text = "\n ".join(parts)
        chunks += [(d, i, p) for i, p in enumerate(parts)]
        docs.append((d, text))
        flat = norm(text)
        for k in range(25):
            at, size = rng.randrange(len(flat)), rng.choice([2, 9, 30, 70, 160])
            piece = flat[at : at + size]
            if k % 3 == 0:
                piece = " ".join(w if rng.random() > 0.1 else "zzz" for w in piece.split())
            quotes.append(((d + (k % 7 == 6)) % documents, f"{d}-{k}", rng.choice([piece, piece.upper(), f"  {piece}\n"])))
    quotes += [(0, "none", None), (0, "blank", " \n"), (99, "no document", "rent of roof"), (0, "stop", "the of a to the of a to"), (1, "long", "rent " * 300)]
    return chunks, docs, quotes


@pytest.mark.parametrize("seed, stored", [(1, False), (2, True)])
def test_index_equals_every_pair(spark, seed, stored):
    chunks, docs, quotes = corpus(seed)
    c = spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string")
    d = spark.createDataFrame(docs + [(50, None)], "doc_id long, text string")
    q = spark.createDataFrame(quotes + quotes[:3], "doc_id long, quote_id string, quote string")
    out = ground_quotes(q, None, None, index=QuoteIndex.of(c, d).stored()) if stored else ground_quotes(q, c, d)
    got = {(r["doc_id"], r["quote_id"]): (r["grounded"], r["evidence_chunk_index"]) for r in out.collect()}
    texts = dict(docs)
    want = {(i, k): plain(t or "", [(n, p) for j, n, p in chunks if j == i], texts.get(i, "")) for i, k, t in quotes}
    assert got == want and out.count() == len(quotes) + 3
    assert sum(1 for g, i in want.values() if g and i is not None) > 20 and sum(1 for g, i in want.values() if g and i is None) > 5


def test_index_is_built_without_carrying_texts(spark):
    chunks, docs, quotes = corpus(3, 3)
    index = QuoteIndex.of(spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    for table in (index.grams, index.words):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" in plan
        assert not [line for line in plan.splitlines() if "Generate" in line and re.search(r"\[doc_id#\d+L?, unit#\d+, t#", line)]
    empty = ground_quotes(spark.createDataFrame([], "doc_id long, quote_id string, quote string"), None, None, index=index)
    assert empty.count() == 0 and empty.columns == ["doc_id", "quote_id", "quote", "grounded", "evidence_chunk_index"]
