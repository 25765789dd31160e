"""Quotes found in one pass over the texts: texts are dealt once, and copies of a document count as in an index of them."""

from lakesignal.operators.grounding import ground_quotes
from lakesignal.operators.quote_index import QuoteIndex
from tests.test_quote_index import corpus


def frames(spark, seed, copies=1):
    chunks, docs, quotes = corpus(seed, 6)
    return (
        spark.createDataFrame(quotes, "doc_id long, quote_id string, quote string"),
        spark.createDataFrame(chunks + [c for c in chunks if c[0] < 3] * (copies - 1), "doc_id long, chunk_index int, text string"),
        spark.createDataFrame(docs + docs[:3] * (copies - 1), "doc_id long, text string"),
    )


def test_texts_are_dealt_once(spark):
    quotes, chunks, docs = frames(spark, 5)
    plan = ground_quotes(quotes, chunks, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Union") == 1


def test_copies_of_documents_as_by_a_stored_index(spark):
    for seed, copies in ((6, 1), (7, 2)):
        quotes, chunks, docs = frames(spark, seed, copies)
        once = sorted(map(tuple, ground_quotes(quotes, chunks, docs).collect()), key=repr)
        stored = sorted(map(tuple, ground_quotes(quotes, None, None, index=QuoteIndex.of(chunks, docs).stored()).collect()), key=repr)
        assert once == stored and sum(r[3] for r in once) > 20
