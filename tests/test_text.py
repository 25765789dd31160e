import re

from pyspark.sql import functions as F

from lakesignal.functions.fixed_rules import QUESTION_CATEGORIES, RISK_RULES, Rule
from lakesignal.functions.text import content_words, duration_days, html_text, keyword_category
from lakesignal.operators.chunking import BOUNDARY_PATTERNS, chunk_documents, sentences
from lakesignal.operators.grounding import best_chunks_by_overlap, ground_quotes
from lakesignal.operators.rules import clause_labels, compare_documents, coverage, label_clauses, needed_word, scan_rules, severity_counts
from lakesignal.plans.review import contradictions, document_text, extraction_quality, review_items


def brute_chunks(text, hi, lo):
    """Line by line, the slow way."""
    starts = lambda line: bool(line.strip()) and any(re.match(p.replace("(?i)", ""), line.strip(), re.I if "(?i)" in p else 0) for p in BOUNDARY_PATTERNS)
    groups = []
    for n, line in enumerate(text.split("\n")):
        if n == 0 or starts(line):
            groups.append([])
        groups[-1].append(line)
    parts = [p for p in ("\n".join(g).strip() for g in groups) if p]

    def packed(t):
        out, cur = [], ""
        for s in re.split(r"(?<=[.!?])\s+", t):
            if cur and len(cur) + len(s) + 1 > hi:
                out.append(cur.strip())
                cur = s
            else:
                cur = (cur + " " + s).strip()
        return out + [cur.strip()] if cur.strip() else (out or [t])

    sized = packed(text) if len(parts) <= 1 else [x for p in parts for x in (packed(p) if len(p) > hi else [p])]
    done, held = [], ""
    for p in sized:
        both = (held + "\n\n" + p).strip() if held else p
        if len(both) > hi and held:
            done.append(held)
        held = both if len(both) <= hi else p
        if len(held) >= lo:
            done.append(held)
            held = ""
    if held and done and len(held) < lo:
        done[-1] = (done[-1] + "\n\n" + held).strip()
    elif held:
        done.append(held)
    return done


CONTRACT = """RENTAL AGREEMENT TERMS
This is made today. It binds both.

1. Rent. The tenant pays rent monthly. Late payment costs more! Is that fair? Yes.
(a) First part of the clause which is rather long and goes on for a while. Then more. And more.
2.1 Deposit
The deposit shall be forfeit if the tenant leaves early.
Section 4: Notice
Either side gives notice of 30 days.
ARTICLE IX
End."""


def test_chunker_against_a_line_by_line_version(spark):
    texts = [CONTRACT, "one line only", "A. B. C. " * 60, "", "   ", "no end " * 80, CONTRACT.replace("\n", "\n\n") * 3, "1. x\n2. y\n3. z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for hi, lo in ((1500, 200), (120, 40), (60, 10)):
        got = {}
        for r in chunk_documents(df, max_chars=hi, min_chars=lo).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        assert {i: c for i, c in ((i, brute_chunks(t, hi, lo)) for i, t in enumerate(texts)) if c} == got


def test_headings(spark):
    df = spark.createDataFrame([(1, CONTRACT)], "doc_id int, text string")
    heads = [r["heading"] for r in chunk_documents(df, max_chars=120, min_chars=20).orderBy("chunk_index").collect()]
    assert heads[0] == "RENTAL AGREEMENT TERMS" and any(h and h.startswith("Section 4") for h in heads)


def test_sentences(spark):
    got = spark.createDataFrame([("Short. This one is long enough! And so is this one?  ",)], "t string").select(sentences(F.col("t"))).first()[0]
    assert got == ["This one is long enough!", "And so is this one?"]


CLAUSES = [
    (1, 0, "The Company has the right to terminate this agreement at any time.", None),
    (1, 1, "The employee shall not engage in a similar business for a period of 2 years within a radius of 10 km. Non-compete applies.", "5. Non-compete"),
    (1, 2, "Nothing unusual here.", None),
    (1, 3, "In case of breach, liquidated damages apply. The deposit shall be forfeited. Either party gives notice of 30 days. Rent is due.", None),
    (2, 0, "The tenant shall not sublet. Disputes go to arbitration. Governing law: the laws of India.", None),
]


def clauses(spark):
    return spark.createDataFrame(CLAUSES, "doc_id int, chunk_index int, text string, heading string")


def test_rules_fire_once_per_clause(spark):
    got = scan_rules(clauses(spark)).collect()
    assert sorted((r["doc_id"], r["chunk_index"], r["rule_id"]) for r in got) == [
        (1, 0, "unilateral_termination"),
        (1, 1, "non_compete"),
        (1, 3, "deposit_forfeiture"),
        (1, 3, "liquidated_damages"),
        (2, 0, "assignment_restriction"),
    ]
    factors = {f["key"]: (f["present"], f["quote"]) for r in got if r["rule_id"] == "non_compete" for f in r["factors"]}
    assert factors["duration_specified"] == (True, "for a period of 2 years")
    assert factors["geographic_scope_specified"] == (True, "within a radius of") and factors["consideration_mentioned"] == (False, None)
    assert all(not r["factors"] for r in got if r["rule_id"] != "non_compete")


def test_excerpt_window(spark):
    text = "x " * 100 + "liquidated   damages" + " y" * 300
    row = scan_rules(spark.createDataFrame([(1, 0, text, None)], "doc_id int, chunk_index int, text string, heading string")).first()
    at = text.index("liquidated")
    want = " ".join(text[at - 86 : at + len("liquidated   damages") + 260].split()) if "liquidated damages" in text else None
    assert row is None and want is None  # three blanks do not match the rule
    text = text.replace("   ", " ")
    at = text.index("liquidated")
    row = scan_rules(spark.createDataFrame([(1, 0, text, None)], "doc_id int, chunk_index int, text string, heading string")).first()
    assert row["excerpt"] == "…" + " ".join(text[at - 86 : at + len("liquidated damages") + 260].split()) + "…"


def test_labels_and_counts(spark):
    found = scan_rules(clauses(spark))
    a = {(r["doc_id"], r["chunk_index"]): r["label"] for r in clause_labels(clauses(spark), found).collect()}
    b = {(r["doc_id"], r["chunk_index"]): r["label"] for r in label_clauses(clauses(spark)).collect()}
    assert a == b == {(1, 0): "high", (1, 1): "high", (1, 2): "none", (1, 3): "high", (2, 0): "low"}
    assert {r["doc_id"]: (r["high"], r["medium"], r["low"]) for r in severity_counts(found).collect()} == {1: (3, 1, 0), 2: (0, 0, 1)}


def test_coverage_and_review(spark):
    c = coverage(clauses(spark))
    got = {(r["doc_id"], r["category_id"]): (r["status"], r["evidence_chunk_index"]) for r in c.collect()}
    assert got[(1, "termination")] == ("found", 0) and got[(1, "notice_period")] == ("found", 3) and got[(1, "payment")] == ("found", 3)
    assert got[(2, "governing_law")] == ("found", 0) and got[(2, "termination")] == ("not_found", None) and len(got) == 18
    obligations = spark.createDataFrame([(1, "notice", "x", "30 days", True), (1, "notice", "x", "two months", True)], "doc_id int, category string, obligation string, deadline string, grounded boolean")
    items = review_items(scan_rules(clauses(spark)), contradictions(obligations), c).where("doc_id = 1").collect()
    top = [r for r in items if r["section"] == "top_issue"]
    assert {(r["source"], r["severity"]) for r in top} == {("risk", "high"), ("contradiction", "high"), ("coverage", "medium")}
    assert any("30 days, 60 days" in r["detail"] for r in top)
    assert len([r for r in items if r["section"] == "question"]) == 4  # four rules with a question, each once


def test_comparison(spark):
    pairs = spark.createDataFrame([(1, 2)], "doc_a int, doc_b int")
    got = {r["rule_id"]: (r["in_a"], r["in_b"], r["impact"][:29]) for r in compare_documents(pairs, scan_rules(clauses(spark))).collect()}
    assert got["assignment_restriction"] == (False, True, "Present in Document B only, a") and got["non_compete"][:2] == (True, False) and len(got) == 5


def test_durations(spark):
    rows = [("within 30 days", 30), ("One month after", 30), ("a two-week period", 14), ("ten years", 3650), ("0 days", 0), ("soon", None), ("", None), ("99999999999 days", None)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(duration_days(F.col("t"))).collect()]
    assert got == [d for _, d in rows]


def test_contradictions(spark):
    rows = [
        (1, "notice", "o", "30 days", True), (1, "notice", "o", "60 days", True),
        (2, "notice", "o", "30 days", True), (2, "notice", "o", "one month", True),
        (3, "renewal", "o", "30 days", True), (3, "renewal", "o", "60 days", False),
        (4, "payment", "o", "30 days", True), (4, "payment", "o", "60 days", True),
        (5, "notice", "within 10 days", "0 days", True), (5, "notice", "o", "20 days", True),
    ]
    df = spark.createDataFrame(rows, "doc_id int, category string, obligation string, deadline string, grounded boolean")
    assert {r["doc_id"]: r["values_days"] for r in contradictions(df).collect()} == {1: [30, 60], 5: [10, 20]}


def test_grounding(spark):
    text = "The owner shall pay all taxes levied on the premises by the local or government authorities. Second clause about parking spaces."
    chunks = spark.createDataFrame([(1, 0, "The owner shall pay all taxes levied on the premises by the local or"), (1, 1, "government authorities. Second clause about parking spaces.")], "doc_id int, chunk_index int, text string")
    quotes = [
        ("exact", "pay all  TAXES levied", True, 0),
        ("overlap", "owner shall pay the taxes levied premises local", True, 0),
        ("spanning", "local or government authorities. second clause", True, None),
        ("made up", "tenant shall repair the roof every winter", False, None),
        ("short", "roof winter", False, None),
        ("empty", "", False, None),
    ]
    q = spark.createDataFrame([(1, k, t) for k, t, _, _ in quotes], "doc_id int, quote_id string, quote string")
    got = {r["quote_id"]: (r["grounded"], r["evidence_chunk_index"]) for r in ground_quotes(q, chunks, spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    spark_text = {"spanning": "local or"}  # both of its halves lie in different clauses
    assert spark_text and got == {k: (g, i) for k, _, g, i in quotes}
    cases = spark.createDataFrame([(1, "c", "owner pays taxes for premises")], "doc_id int, case_id string, expected_answer string")
    assert [(r["chunk_index"], r["overlap"]) for r in best_chunks_by_overlap(cases, chunks).collect()] == [(0, 3)]


def test_small_helpers(spark):
    df = spark.createDataFrame([("The Tenant's 2 x RENT, in a row",)], "t string")
    assert df.select(content_words(F.col("t"))).first()[0] == ["tenant", "rent", "row"]
    html = '<html><head><style>p{}</style><script>var a="<b>";</script></head><body><!-- no --><p>A &amp; B&nbsp;&lt;c&gt;</p>\n<p>D</p></body></html>'
    assert spark.createDataFrame([(html,)], "h string").select(html_text(F.col("h"))).first()[0] == "A & B <c> D"
    asked = [("What is the notice period to vacate?", "notice_period"), ("Can I VACATE early?", "termination"), ("Hello", "general")]
    got = [r[0] for r in spark.createDataFrame([(q,) for q, _ in asked], "q string").select(keyword_category(F.col("q"), QUESTION_CATEGORIES)).collect()]
    assert got == [c for _, c in asked]


def test_pages(spark):
    pages = spark.createDataFrame([("d", 2, "b" * 50, False), ("d", 1, "a" * 50, True), ("d", 3, "", False), ("e", 1, "c" * 60, False)], "doc_id string, page_number int, text string, used_ocr boolean")
    assert {r["doc_id"]: r["text"] for r in document_text(pages).collect()} == {"d": "a" * 50 + "\n\n" + "b" * 50, "e": "c" * 60}
    got = {r["doc_id"]: r["summary"] for r in extraction_quality(pages).collect()}
    assert got["e"] == "Extracted cleanly from native text; no quality concerns detected."
    assert got["d"] == "1 of 3 page(s) required OCR (no native text layer); 1 page extracted unusually little text -- worth a manual check."


def test_needed_word_is_only_what_every_match_holds():
    cases = {
        r"\blicen[sc]e\b": "licen", r"[a-z]+@[a-z]+\.[a-z]{2,}": "@", "a|bcd": "", "(abc)?de": "de", "ab?cd": "cd", "Abc D": "abc d", "x{0}yy": "yy",
        "(?i)abc": "", "(?x)a b c": "", r"\Qa+\E": "", "[a[b]cde]": "", r"\p{L}abc": "", "(abc": "", "(?=abcd)ef": "ef", "(?!abcd)ef": "ef", "äbc": "bc", r"\vabc": "",
    }
    assert {p: needed_word(p) for p in cases} == cases
    assert all(needed_word(p) for r in RISK_RULES for p in r.patterns)


def test_scan_finds_what_the_patterns_alone_find(spark):
    """Also where another character stands for an ASCII letter, and chunks without the needed word skip the pattern."""
    rules = [Rule(f"r{i}", "l", "low", (p,)) for i, p in enumerate(["kiss", r"\bRisk\b.{0,9}?lies", "a|b", r"\d{3}-\d"])]
    texts = ["KISS", "\u212ai\u017fs", "k\u0130ss and k\u0131SS", "rI\u017fK \u00e4 L\u0130ES", "risk", "\u0130\u00df b", "123-4", "", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk_index", F.lit(0))
    found = scan_rules(chunks, rules)
    assert "Contains(" in found._jdf.queryExecution().analyzed().toString() or "contains(" in found._jdf.queryExecution().analyzed().toString()
    want = {(r[0], x.rule_id) for x in rules for r in chunks.where(F.col("text").rlike("(?isU)" + x.patterns[0])).select("doc_id").collect()}
    assert {(r.doc_id, r.rule_id) for r in found.collect()} == want and {(0, "r0"), (1, "r0"), (2, "r0"), (3, "r1")} <= want
