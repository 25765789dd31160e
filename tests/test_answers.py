import json

from pyspark.sql import functions as F

from lakesignal.functions.fixed_rules import PARSE_ERROR_ANSWER, UNGROUNDED_ANSWER
from lakesignal.operators.answers import grounded_obligations, overview_fields, overview_items, parse_answers, parse_obligations, parse_summaries, resolve_citations
from lakesignal.operators.trace import answer_claims, evidence_of, evidence_sentences, grounding_scores, retrieval_entries, verify_claims, verify_claims_lexical


def test_parse_answers(spark):
    raws = [
        ("good", '{"grounded": true, "answer": "A", "cited_excerpts": [2, 9, 1]}'),
        ("wrapped", 'Sure! {"grounded": false, "answer": "B", "cited_excerpts": [1]} bye'),
        ("claimed", '{"grounded": true, "answer": "C", "cited_excerpts": []}'),
        ("odd", '{"grounded": "yes", "answer": "D", "cited_excerpts": [true, "2", 1.0, " 3 "]}'),
        ("refused", '{"grounded": false, "answer": "E"}'),
        ("broken", '{"grounded": tru'),
        ("text", "no json"),
        ("number", "12"),
    ]
    df = spark.createDataFrame([(k, 3, r) for k, r in raws], "k string, n_hits int, raw string")
    got = {r["k"]: r for r in parse_answers(df).collect()}
    pick = lambda k: (got[k]["grounded"], got[k]["cited"], got[k]["citations_requested"], got[k]["parse_error"], got[k]["answer"])
    assert pick("good") == (True, [2, 1], 3, False, "A") and pick("wrapped") == (True, [1], 1, False, "B")
    assert pick("claimed") == (False, [], 0, False, UNGROUNDED_ANSWER) and pick("odd") == (False, [], 4, False, UNGROUNDED_ANSWER)
    assert pick("refused") == (False, [], 0, False, "E")
    assert all(pick(k)[3:] == (True, PARSE_ERROR_ANSWER) for k in ("broken", "text", "number"))
    assert {r["k"]: r["cited"] for r in parse_answers(df, accept_text_numbers=True).collect()}["odd"] == [2, 3]
    hits = spark.createDataFrame([("good", 1, 10), ("good", 2, 20)], "k string, rank int, chunk_index int")
    assert sorted((r["position"], r["chunk_index"]) for r in resolve_citations(parse_answers(df), hits, ["k"]).collect()) == [(0, 20), (1, 10)]


DOC = "The tenant shall pay the monthly rent before the fifth day. The owner keeps the deposit until the end."


def sources(spark):
    return spark.createDataFrame([(1, 0, DOC)], "doc_id int, chunk_index int, text string"), spark.createDataFrame([(1, DOC)], "doc_id int, text string")


def test_obligations(spark):
    raw = json.dumps({"obligations": [
        {"party": "Tenant", "obligation": "Pay rent", "deadline": "fifth day", "category": "payment", "source_quote": "pay the monthly rent"},
        {"party": " TENANT", "obligation": "pay  rent", "category": "notice", "source_quote": ""},
        {"party": None, "obligation": "Keep", "deadline": "", "category": "weird", "source_quote": "repair the broken roof"},
        "not an object",
    ]})
    out = spark.createDataFrame([(1, raw), (2, "nothing")], "doc_id int, raw string")
    assert parse_obligations(out).count() == 2
    got = {r["position"]: r for r in grounded_obligations(out, *sources(spark)).collect()}
    assert (got[0]["grounded"], got[0]["evidence_chunk_index"], got[0]["deadline"]) == (True, 0, "fifth day")
    assert (got[2]["party"], got[2]["category"], got[2]["deadline"], got[2]["grounded"]) == ("unspecified", "other", None, False)


def test_overview(spark):
    raw = json.dumps({
        "fields": {
            "duration": {"status": "found", "value": "v", "source_quote": "pay the monthly rent"},
            "liability": {"status": "unclear", "value": "v", "source_quote": "not in the text at all"},
            "jurisdiction": {"status": "found", "value": "v", "source_quote": None},
            "renewal_terms": {"status": "not_found", "value": "v", "source_quote": None},
            "governing_law": {"status": "strange"},
        },
        "parties": ["Owner: A", "", {"text": "Tenant: B", "source_quote": "the tenant shall pay"}],
    })
    out = spark.createDataFrame([(1, raw), (2, "broken")], "doc_id int, raw string")
    got = {r["key"]: (r["status"], r["value"], r["evidence_chunk_index"]) for r in overview_fields(out, *sources(spark)).collect()}
    assert len(got) == 15 and got["duration"] == ("found", "v", 0)
    assert got["liability"] == got["jurisdiction"] == got["governing_law"] == got["effective_date"] == ("insufficient_evidence", None, None)
    assert got["renewal_terms"] == ("not_found", None, None)
    parts = {r["text"]: (r["grounded"], r["evidence_chunk_index"]) for r in overview_items(out, *sources(spark), "parties").collect()}
    assert parts == {"Owner: A": (False, None), "Tenant: B": (True, 0)}


def test_summary(spark):
    raw = '{"parties": ["A", 2], "key_obligations": "one", "important_dates": null, "notice_period": "", "penalty_clauses": 5}'
    r = parse_summaries(spark.createDataFrame([(1, raw)], "doc_id int, raw string")).first()
    assert (r["parties"], r["key_obligations"], r["important_dates"], r["penalty_clauses"], r["termination_conditions"], r["notice_period"]) == (["A", "2"], ["one"], [], ["5"], [], None)


def test_trace_entries(spark):
    hits = [(7, "", "x" * 250, 0.25), (3, "H", "short", 1.5)]
    df = spark.createDataFrame([(hits, [3])], "hits array<struct<chunk_index:int,heading:string,text:string,distance:double>>, cited array<int>")
    a, b = df.select(retrieval_entries(F.col("hits"), F.col("cited"))).first()[0]
    assert (a["rank"], a["heading"], len(a["text_preview"]), a["similarity"], a["cited"]) == (1, None, 201, 0.75, False)
    assert (b["rank"], b["heading"], b["similarity"], b["cited"]) == (2, "H", 0.0, True)


def test_claims(spark):
    answers = spark.createDataFrame([("t", "Rent is paid monthly. Unicorns are purple animals.", True, [1]), ("r", "No answer here today.", False, [])], "trace_id string, answer string, grounded boolean, cited array<bigint>")
    hits = spark.createDataFrame([("t", 1, 4, "Rent is paid monthly. Deposit is returned later."), ("t", 2, 5, "Unicorns are purple animals.")], "trace_id string, rank int, chunk_index int, text string")
    evidence = evidence_sentences(evidence_of(answers, hits))
    claims = answer_claims(answers)
    assert claims.count() == 2 and {r["chunk_index"] for r in evidence.collect()} == {4}
    got = {r["claim_no"]: r for r in verify_claims_lexical(claims, evidence).collect()}
    assert got[0]["status"] == "supported" and abs(got[0]["best_similarity"] - 1) < 1e-9
    assert got[1]["status"] == "unsupported" and got[1]["best_evidence_chunk_index"] == 4 and got[1]["best_evidence_preview"] == "Rent is paid monthly."
    assert [r["grounding_score"] for r in grounding_scores(verify_claims_lexical(claims, evidence)).collect()] == [0.5]
    cv = claims.withColumn("vector", F.when(F.col("claim_no") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    ev = evidence.withColumn("vector", F.when(F.col("sentence_no") == 0, F.array(F.lit(0.4), F.lit(0.9))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    got = {r["claim_no"]: (r["status"], r["best_evidence_preview"]) for r in verify_claims(cv, ev).collect()}
    assert got == {0: ("partial", "Rent is paid monthly."), 1: ("unsupported", "Rent is paid monthly.")}
