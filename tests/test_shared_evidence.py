"""Claims against evidence that several requests share: the same result as with a copy of the evidence for each request."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesignal.functions.text import first_words
from lakesignal.operators import trace
from lakesignal.operators.chunking import sentence_packs
from lakesignal.operators.trace import answer_claims, evidence_of, evidence_sentences, verify_claims_lexical

KEYS, SCOPE = ["doc_id", "quote_id"], ["doc_id"]


def rows(seed, copies=False):
    r = random.Random(seed)
    text = lambda n: " ".join(" ".join(r.choice(["the", "a", "rent", "tenant", "pays", "x", f"w{r.randrange(40)}", f"rare{r.randrange(10**6)}"]) for _ in range(r.randint(3, 9))) + r.choice(".!?") for _ in range(n))
    chunks = [(d, c, c + 1, text(r.randint(1, 6))) for d in range(4) for c in range(r.randint(1, 4))]
    chunks += [(9, 0, 1, "")]
    answers = []
    for d in (0, 1, 2, 3, 7, 9):
        for q in range(1 if d else 9):
            held = [s for x in chunks if x[0] == d for s in x[3].split(". ") if s]
            said = (r.choice(held) + ". " if held and r.random() < 0.7 else "") + text(1) + " !!!!!!!!!!!!!!."
            answers.append((d, f"q{q}", said, True, r.choice([[], [], [1], [2, 3]])))
    return (answers * 2, chunks * 2) if copies else (answers, chunks)


def frames(spark, seed, copies=False):
    answers, chunks = rows(seed, copies)
    return (
        spark.createDataFrame(answers, "doc_id long, quote_id string, answer string, grounded boolean, cited array<bigint>"),
        spark.createDataFrame(chunks, "doc_id long, chunk_index int, rank int, text string"),
    )


def found(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*KEYS, "claim_no", "claim", "status", "best_similarity", "best_evidence_chunk_index", "best_evidence_preview").collect())


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("known, together", [(1 << 17, 64), (5, 2)])
def test_shared_evidence_is_scored_like_copies(spark, monkeypatch, copies, known, together):
    monkeypatch.setattr(trace, "KNOWN_TERMS", known)
    monkeypatch.setattr(trace, "TOGETHER", together)
    answers, chunks = frames(spark, 3, copies)
    claims = answer_claims(answers, KEYS)
    hits = answers.select(*KEYS).join(chunks, "doc_id")
    plain = verify_claims_lexical(claims, evidence_sentences(evidence_of(answers, hits, KEYS), KEYS), KEYS)
    shared = verify_claims_lexical(claims, evidence_sentences(evidence_of(answers, chunks, KEYS, SCOPE), KEYS, scope=SCOPE), KEYS, scope=SCOPE)
    assert found(shared) == found(plain) and len(found(plain)) > 15


def test_similarity_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trace, "KNOWN_TERMS", 3)
    answers, chunks = frames(spark, 5)
    claims = answer_claims(answers, KEYS)
    sentences = evidence_sentences(evidence_of(answers, answers.select(*KEYS).join(chunks, "doc_id"), KEYS), KEYS)
    words = lambda t: Counter(re.findall(r"\w{2,}", t.lower()))
    held, asked = sentences.collect(), claims.collect()
    texts = [words(r["sentence"]) for r in held] + [words(r["claim"]) for r in asked]
    df = Counter(t for x in texts for t in x)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    length = lambda x: math.sqrt(sum((n * idf[t]) ** 2 for t, n in x.items()))
    want = {}
    for c in asked:
        a = words(c["claim"])
        near = []
        for s in held:
            if [s[k] for k in KEYS] == [c[k] for k in KEYS]:
                b = words(s["sentence"])
                dot = sum(n * b[t] * idf[t] ** 2 for t, n in a.items())
                near.append((-round(dot / (length(a) * length(b)), 12) if dot else 0.0, s["chunk_index"], s["sentence_no"], s["sentence"]))
        best = min(near, default=(0.0, None, None, None))
        want[(*[c[k] for k in KEYS], c["claim_no"])] = (round(-best[0], 9), best[1], best[3])
    got = verify_claims_lexical(claims, evidence_sentences(evidence_of(answers, chunks, KEYS, SCOPE), KEYS, scope=SCOPE), KEYS, scope=SCOPE).collect()
    assert {(*[r[k] for k in KEYS], r["claim_no"]): (round(r["best_similarity"], 9), r["best_evidence_chunk_index"], r["best_evidence_preview"]) for r in got} == want


def test_a_chunk_is_held_once_for_all_its_requests(spark):
    answers, chunks = frames(spark, 7)
    held = evidence_sentences(evidence_of(answers, chunks, KEYS, SCOPE), KEYS, scope=SCOPE).collect()
    assert len(held) == len({(r["doc_id"], r["chunk_index"]) for r in held}) and max(len(r["requests"]) for r in held) > 1
    plain = evidence_sentences(evidence_of(answers, answers.select(*KEYS).join(chunks, "doc_id"), KEYS), KEYS).collect()
    assert sum(len(r["requests"]) * len(r["sentences"]) for r in held) == len(plain)


def _packs(text, most):
    """Sentence by sentence, as the packs are defined."""
    done, cur = [], ""
    for s in re.split(r"(?<=[.!?])[ \t\n\x0b\x0c\r]+", text):
        if cur and len(cur) + len(s) + 1 > most:
            done.append(cur.strip(" \t\n\x0b\x0c\r"))
            cur = s
        else:
            cur = (cur + " " + s).strip(" \t\n\x0b\x0c\r")
    rest = cur.strip(" \t\n\x0b\x0c\r")
    return (done + [rest] if rest else done) or [text]


def test_sentence_packs_and_first_words(spark):
    r = random.Random(4)
    pieces = ["a", "bb", ". ", "! ", "?\n", ".", "  ", "\n", "\x0b", "é", "😀", "Zz zz", "x" * 7, ""]
    texts = ["", " ", ".", "a. ", "a" * 31, "a" * 300_000, *["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(400)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for got in df.select("text", sentence_packs(F.col("text"), 30).alias("p"), first_words(F.col("text"), 3).alias("w")).collect():
        assert got["p"] == _packs(got["text"], 30)
        every = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", got["text"]).strip(" ").split(" ")
        assert got["w"][:3] == every[:3] and len(got["w"]) <= 3
