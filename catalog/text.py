"""Chunking, rules, grounding, contradictions and page extraction over whole texts."""

from pyspark.sql import functions as F

from catalog import query, table
from lakesignal.functions.fixed_rules import COVERAGE_CATEGORIES, NEGOTIATION_QUESTIONS, RISK_RULES, Category, Rule
from lakesignal.functions.text import duration_days, first_words, html_text
from lakesignal.operators.chunking import chunk_documents, clause_lines, sentences
from lakesignal.operators.grounding import best_chunks_by_overlap, ground_quotes
from lakesignal.operators.quote_index import QuoteIndex
from lakesignal.operators.rules import clause_labels, compare_documents, coverage, label_clauses, scan_rules, severity_counts
from lakesignal.plans.review import contradictions, document_text, extraction_quality, review_items
from lakesignal.scale import numbered, pinned

#: Rules whose words do occur in the generated prose.
RULES = (
    Rule("license_line", "License text", "high", (r"\blicen[sc]e\b", r"\bcopyright\b"), "the publisher", "A license line is part of the text."),
    Rule("mail_address", "Mail address", "medium", (r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}",), "the person named", "A mail address is part of the text."),
    Rule("phone_number", "Phone number", "low", (r"\d{3}-\d{4}", r"\+\d{2} \d+"), "the person named", "A phone number is part of the text."),
    Rule("long_and", "Long run after and", "medium", (r"\band\b[^.]{60,90}?\bthe\b",), "the reader", "A long sentence part follows."),
    Rule("worthless", "Insult", "high", (r"worthless", r"\bidiot"), "the reader", "An insult is part of the text."),
)
CATEGORIES = (
    Category("license", "License", "high", (r"\blicen[sc]e\b",)),
    Category("contact", "Contact", "high", (r"@[a-z0-9.]+", r"\d{3}-\d{4}")),
    Category("verdict", "Verdict", "medium", (r"worthless", r"\bidiot")),
    Category("joining", "Joining words", "medium", (r" and the ", r" und die ", r" et la ", r" y la ")),
)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# -- SQL of the chunker ------------------------------------------------------

_WS = r"^\s+|\s+$"
_P1 = r"^\s*\d{1,2}(?:\.\d{1,2}){0,2}\.?\s+\S"
_P2 = r"^\s*\([a-zA-Z0-9]{1,4}\)\s+\S"
_P3 = r"(?i)^\s*(ARTICLE|Article|SECTION|Section|Clause|CLAUSE)\s+[IVXLCM\d]+"
_P4 = r"^[A-Z][A-Z \-&]{6,60}$"


def strip_sql(x):
    return f"regexp_replace({x}, '{_WS}', '', 'g')"


def collapse_sql(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# The boundary and duration patterns, as in the library.
def boundary_sql(x):
    t = strip_sql(x)
    return f"({t} <> '' and (regexp_matches({t}, '{_P1}') or regexp_matches({t}, '{_P2}') or regexp_matches({t}, '{_P3}') or regexp_matches({t}, '{_P4}')))"


def packs_sql(x, limit=1500):
    sents = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    fold = f"""list_reduce(list_transform({sents}, lambda s: {{'done': []::varchar[], 'cur': s}}),
      lambda a, b: case when a.cur <> '' and length(a.cur) + length(b.cur) + 1 > {limit} then {{'done': list_append(a.done, {strip_sql('a.cur')}), 'cur': b.cur}}
                        else {{'done': a.done, 'cur': {strip_sql("a.cur || ' ' || b.cur")}}} end, {{'done': []::varchar[], 'cur': ''}})"""
    return fold


CHUNKS = f"""
ln as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
st as (select *, list_filter(range(1, len(ls) + 1), lambda i: i = 1 or {boundary_sql('ls[i]')}) as s from ln),
pc as (select doc_id, text, list_filter(list_transform(range(1, len(s) + 1),
        lambda k: {strip_sql("array_to_string(ls[s[k]:coalesce(s[k + 1] - 1, len(ls))], chr(10))")}), lambda p: p <> '') as ps from st),
one as (select doc_id, unnest(case when len(ps) <= 1 then [text] else ps end) as p, generate_subscripts(case when len(ps) <= 1 then [text] else ps end, 1) as k, len(ps) <= 1 as force from pc),
fold as (select doc_id, k, p, case when force or length(p) > 1500 then {packs_sql('p')} else {{'done': []::varchar[], 'cur': p}} end as f from one),
sized as (select doc_id, k, case when length({strip_sql('f.cur')}) > 0 then list_append(f.done, {strip_sql('f.cur')}) when len(f.done) > 0 then f.done else [p] end as xs from fold),
pieces as (select doc_id, flatten(list(xs order by k)) as ps from sized group by 1),
mg as (select doc_id, list_reduce(list_transform(ps, lambda x: {{'done': []::varchar[], 'buf': x}}), lambda a, b: (
    case when length(case when a.buf <> '' then {strip_sql("a.buf || chr(10) || chr(10) || b.buf")} else b.buf end) <= 1500
         then case when length(case when a.buf <> '' then {strip_sql("a.buf || chr(10) || chr(10) || b.buf")} else b.buf end) >= 200
                   then {{'done': list_append(a.done, case when a.buf <> '' then {strip_sql("a.buf || chr(10) || chr(10) || b.buf")} else b.buf end), 'buf': ''}}
                   else {{'done': a.done, 'buf': case when a.buf <> '' then {strip_sql("a.buf || chr(10) || chr(10) || b.buf")} else b.buf end}} end
         else case when length(b.buf) >= 200 then {{'done': list_append(case when a.buf <> '' then list_append(a.done, a.buf) else a.done end, b.buf), 'buf': ''}}
                   else {{'done': case when a.buf <> '' then list_append(a.done, a.buf) else a.done end, 'buf': b.buf}} end end),
    {{'done': []::varchar[], 'buf': ''}}) as m from pieces),
fin as (select doc_id, case when m.buf = '' then m.done
    when len(m.done) > 0 and length(m.buf) < 200 then list_append(m.done[1:len(m.done) - 1], {strip_sql("m.done[len(m.done)] || chr(10) || chr(10) || m.buf")})
    else list_append(m.done, m.buf) end as cs from mg),
chunks as (select doc_id, generate_subscripts(cs, 1) - 1 as chunk_index, unnest(cs) as text from fin)"""


def chunk_table(spark, sf_dir):
    return chunk_documents(docs(spark, sf_dir))


@query("clause_lines", f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*)::bigint as lines, count(*) filter (where {boundary_sql('line')})::bigint as boundaries from l group by 1")
def clause_lines_query(spark, sf_dir):
    lines = clause_lines(docs(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_boundary").alias("boundaries"))


@query("document_chunks", f"with {CHUNKS} select doc_id, chunk_index::int as chunk_index, length(text)::int as n_chars, md5(text) as digest, case when {boundary_sql('string_split(text, chr(10))[1]')} then {strip_sql('string_split(text, chr(10))[1]')} end as heading from chunks")
def document_chunks(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "heading")


@query(
    "document_sentences",
    rf"""select doc_id, len(list_filter(list_transform(string_split(regexp_replace({strip_sql('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}),
  lambda s: length(s) >= 12))::int as n_sentences from documents""",
)
def document_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(sentences(F.col("text"))).alias("n_sentences"))


# -- rules -----------------------------------------------------------------------


def _match_sql(rules, text="text"):
    """(rule_no, pattern_no, pattern, ...) rows per chunk, first matching pattern per rule."""
    rows = ", ".join(
        f"({i}, '{r.rule_id}', '{r.label}', '{r.severity}', '{r.affects}', {j}, '(?is){p}')" for i, r in enumerate(rules) for j, p in enumerate(r.patterns)
    )
    return f"""
rules(rule_no, rule_id, label, severity, affects, pattern_no, pattern) as (values {rows}),
hits as (select c.doc_id, c.chunk_index, c.text, r.* from chunks c join rules r on regexp_matches(c.text, r.pattern)
         qualify row_number() over (partition by c.doc_id, c.chunk_index, r.rule_no order by r.pattern_no) = 1)"""


_HITS = f"with {CHUNKS}, {_match_sql(RULES)}"


@query(
    "rule_findings",
    _HITS
    + rf""", m as (select *, regexp_extract(text, pattern) as hit, length(regexp_extract(text, '(?is)^(.*?)(?:' || pattern || ')', 1)) as pos from hits),
e as (select *, greatest(0, pos - 86) as f, least(length(text), pos + length(hit) + 260) as t from m)
select doc_id, chunk_index::int as chunk_index, rule_id, severity, pattern_no::int as pattern_no,
  case when f > 0 then '…' else '' end || {collapse_sql('substring(text, f + 1, t - f)')} || case when t < length(text) then '…' else '' end as excerpt from e""",
)
def rule_findings(spark, sf_dir):
    return scan_rules(chunk_table(spark, sf_dir), RULES).select("doc_id", "chunk_index", "rule_id", "severity", "pattern_no", "excerpt")


@query(
    "risk_rules_scan",
    f"with {CHUNKS}, {_match_sql(RISK_RULES)} select r.rule_id, r.severity, count(h.doc_id)::bigint as findings from (select distinct rule_id, severity from rules) r left join hits h using (rule_id) group by 1, 2",
)
def risk_rules_scan(spark, sf_dir):
    """The built-in rules over every document; rules that never fire count 0."""
    found = scan_rules(chunk_table(spark, sf_dir), RISK_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    rules = spark.createDataFrame([(r.rule_id, r.severity) for r in RISK_RULES], "rule_id string, severity string")
    return rules.join(found, "rule_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


@query(
    "severity_counts",
    _HITS + " select doc_id, count(*) filter (where severity = 'high')::bigint as high, count(*) filter (where severity = 'medium')::bigint as medium, count(*) filter (where severity = 'low')::bigint as low from hits group by 1",
)
def severity_counts_query(spark, sf_dir):
    return severity_counts(scan_rules(chunk_table(spark, sf_dir), RULES))


@query(
    "severity_counts_every_document",
    _HITS + " select d.doc_id, count(*) filter (where severity = 'high')::bigint as high, count(*) filter (where severity = 'medium')::bigint as medium, count(*) filter (where severity = 'low')::bigint as low from documents d left join hits h using (doc_id) group by 1",
)
def severity_counts_every_document(spark, sf_dir):
    """Documents without a finding have a row of zeros."""
    return severity_counts(scan_rules(chunk_table(spark, sf_dir), RULES), every=docs(spark, sf_dir))


_LABELS = _HITS + ", lab as (select c.doc_id, c.chunk_index, c.text, coalesce(min(case severity when 'high' then '0high' when 'medium' then '1medium' when 'low' then '2low' end), '3none')[2:] as label from chunks c left join hits h using (doc_id, chunk_index) group by 1, 2, 3)"


@query("clause_labels", _LABELS + " select doc_id, chunk_index::int as chunk_index, label from lab")
def clause_labels_query(spark, sf_dir):
    chunks = pinned(chunk_table(spark, sf_dir))
    return clause_labels(chunks, scan_rules(chunks, RULES)).select("doc_id", "chunk_index", "label")


@query(
    "labelled_clause_set",
    _LABELS + f" select {strip_sql('text')} as text, label, 'documents/' || doc_id as source_document, chunk_index::int as chunk_index from lab where {strip_sql('text')} <> ''",
)
def labelled_clause_set(spark, sf_dir):
    """The training rows for the clause classifier, in one map-only pass."""
    from lakesignal.sources.datasets import labelled_clauses

    chunks = chunk_table(spark, sf_dir).withColumn("source_document", F.concat(F.lit("documents/"), "doc_id"))
    return labelled_clauses(label_clauses(chunks, RULES))


@query(
    "finding_factors",
    _HITS
    + r""" select doc_id, chunk_index::int as chunk_index, 'digits' as key, regexp_matches(text, '(?is)\d{2,}') as present,
  nullif(regexp_extract(text, '(?is)\d{2,}'), '') as quote from hits where rule_id = 'license_line' """,
)
def finding_factors(spark, sf_dir):
    from dataclasses import replace

    from lakesignal.functions.fixed_rules import Factor

    rules = (replace(RULES[0], factors=(Factor("digits", "Has a number", r"\d{2,}"),)),)
    found = scan_rules(chunk_table(spark, sf_dir), rules)
    return found.select("doc_id", "chunk_index", F.inline("factors")).drop("label")


_COVER = f"""{{chunks}},
cats(category_no, category_id, label, importance, pattern) as (values {{cats}}),
found as (select doc_id, category_id, min(chunk_index) as evidence_chunk_index, arg_min(text, chunk_index) as t from chunks join cats on regexp_matches(text, pattern) group by 1, 2),
cover as (select d.doc_id, c.category_id, c.label, c.importance, case when f.t is null then 'not_found' else 'found' end as status, evidence_chunk_index::int as evidence_chunk_index,
  left({collapse_sql('t')}, 200) as evidence_preview
  from (select distinct doc_id from chunks) d cross join (select distinct category_id, label, importance from cats) c left join found f using (doc_id, category_id))"""


def cover_sql(cats):
    rows = ", ".join(f"({i}, '{c.category_id}', '{c.label}', '{c.importance}', '(?is){p}')" for i, c in enumerate(cats) for p in c.patterns)
    return _COVER.replace("{chunks}", CHUNKS).replace("{cats}", rows)


@query("coverage_scan", f"with {cover_sql(CATEGORIES)} select * from cover")
def coverage_scan(spark, sf_dir):
    return coverage(chunk_table(spark, sf_dir), CATEGORIES)


@query(
    "coverage_gaps",
    f"with {cover_sql(COVERAGE_CATEGORIES)} select category_id, importance, count(*) filter (where status = 'not_found')::bigint as documents_without from cover group by 1, 2",
)
def coverage_gaps(spark, sf_dir):
    """The built-in categories: how many documents show no clause of each."""
    c = coverage(chunk_table(spark, sf_dir))
    return c.groupBy("category_id", "importance").agg(F.count_if(F.col("status") == "not_found").alias("documents_without"))


@query(
    "compare_documents",
    _HITS
    + """, r as (select distinct doc_id, rule_id, label, severity, affects from hits),
p as (select a.doc_id as doc_a, b.doc_id as doc_b from documents a join documents b on b.doc_id = a.doc_id + 1),
u as (select doc_a, doc_b, rule_id, severity, affects, true as a from p join r on r.doc_id = doc_a union all select doc_a, doc_b, rule_id, severity, affects, false from p join r on r.doc_id = doc_b),
g as (select doc_a, doc_b, rule_id, severity, affects, bool_or(a) as in_a, bool_or(not a) as in_b from u group by 1, 2, 3, 4, 5)
select doc_a, doc_b, rule_id, severity, in_a, in_b, case when in_a and in_b then 'Appears in both documents. Whether this is actually the same risk depends on the clause wording -- amounts, durations, and triggers can still differ; open both clauses to compare them directly.'
  when in_a then 'Present in Document A only, absent from Document B -- this specific risk to ' || affects || ' does not apply under Document B''s stated terms.'
  else 'Present in Document B only, absent from Document A -- this specific risk to ' || affects || ' does not apply under Document A''s stated terms.' end as impact from g""",
)
def compare_documents_query(spark, sf_dir):
    """Every document next to the one that follows it."""
    findings = pinned(scan_rules(chunk_table(spark, sf_dir), RULES).select("doc_id", "rule_id", "label", "severity", "affects").distinct())
    ids = docs(spark, sf_dir).select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b")).join(ids.withColumnRenamed("doc_id", "doc_b"), "doc_b", "left_semi")
    return compare_documents(pairs, findings).select("doc_a", "doc_b", "rule_id", "severity", "in_a", "in_b", "impact")


# -- grounding --------------------------------------------------------------------

# Fixed values, as in lakesignal.functions.text.
_STOP = "['the','a','an','is','are','of','to','and','or','in','on','for','by','with','this','that','be','will','shall','at','as','it','not','no','any','may','can','does','do','who','what','which','under','from','such','if','would','than','then']"


def words_sql(x, stop=_STOP, longer=1):
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > {longer} and not list_contains({stop}, w))"


QUOTES = f"""
w as (select doc_id, string_split({collapse_sql('text')}, ' ') as ws from documents),
quotes as (
  select doc_id, 'exact' as quote_id, array_to_string(ws[6:17], ' ') as quote from w union all
  select doc_id, 'changed', array_to_string(list_concat(ws[3:9], ['zzz'], ws[11:26]), ' ') from w union all
  select doc_id - 1, 'foreign', array_to_string(ws[2:14], ' ') from w where doc_id > 0),
far as (
  select doc_id, 'middle' as quote_id, array_to_string(ws[len(ws) // 2 + 1:len(ws) // 2 + 12], ' ') as quote from w union all
  select doc_id, 'end', array_to_string(ws[greatest(len(ws) - 10, 1):], ' ') from w union all
  select doc_id, 'across', array_to_string(ws[len(ws) // 2 - 149:len(ws) // 2 + 150], ' ') from w where len(ws) >= 400 union all
  select doc_id, 'cut', substr(array_to_string(ws, ' '), 30, 80) from w union all
  select doc_id, 'short', array_to_string(ws[len(ws) // 2:len(ws) // 2 + 3], ' ') from w where len(ws) >= 2 union all
  select doc_id, 'thinned', array_to_string(list_filter(ws[len(ws) // 2 + 1:len(ws) // 2 + 40], lambda x, i: i % 9 <> 0), ' ') from w)"""


def quotes(spark, sf_dir):
    """Three quotes per document: copied, copied with one word changed, taken from the next document."""
    w = docs(spark, sf_dir).select("doc_id", first_words(F.col("text"), 26).alias("ws"))
    part = lambda a, b: F.slice("ws", a, b - a + 1)
    own = F.array(
        F.struct(F.lit("exact").alias("quote_id"), F.array_join(part(6, 17), " ").alias("quote"), F.col("doc_id").alias("doc")),
        F.struct(F.lit("changed").alias("quote_id"), F.array_join(F.concat(part(3, 9), F.array(F.lit("zzz")), part(11, 26)), " ").alias("quote"), F.col("doc_id").alias("doc")),
        F.struct(F.lit("foreign").alias("quote_id"), F.array_join(part(2, 14), " ").alias("quote"), (F.col("doc_id") - 1).alias("doc")),
    )
    return w.select(F.inline(own)).where("doc >= 0").withColumnRenamed("doc", "doc_id")


def far_quotes(spark, sf_dir):
    """Quotes from the middle and the end, across clauses, cut inside words, of four words, and with words left out."""
    w = docs(spark, sf_dir).select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("ws"))
    n = F.size("ws")
    half = F.floor(n / 2).cast("int")
    words = lambda c: F.array_join(c, " ")
    parts = {
        "middle": words(F.slice("ws", half + 1, 12)),
        "end": words(F.slice("ws", F.greatest(n - 10, F.lit(1)), 11)),
        "across": F.when(n >= 400, words(F.slice("ws", F.greatest(half - 149, F.lit(1)), 300))),
        "cut": F.substring(words("ws"), 30, 80),
        "short": F.when(n >= 2, words(F.slice("ws", F.greatest(half, F.lit(1)), 4))),
        "thinned": words(F.filter(F.slice("ws", half + 1, 40), lambda x, i: (i + 1) % 9 != 0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("quote_id"), v.alias("quote")) for k, v in parts.items()])
    return w.select("doc_id", F.inline(rows)).where("quote is not null")


@query(
    "ground_quotes",
    f"""with {CHUNKS}, {QUOTES}, every as (select * from quotes union all select * from far),
q as (select doc_id, quote_id, {collapse_sql('lower(quote)')} as q, {words_sql('quote')} as qw from every),
c as (select doc_id, chunk_index, {collapse_sql('lower(text)')} as t, {words_sql('text')} as cw from chunks),
d as (select doc_id, {collapse_sql('lower(text)')} as t, {words_sql('text')} as cw from documents),
qc as (select q.doc_id, quote_id, chunk_index, contains(t, q) as ex, case when len(qw) > 0 then len(list_filter(qw, lambda w: list_contains(cw, w))) / len(qw) else 0 end as ratio
       from q join c using (doc_id) where q <> ''),
bc as (select doc_id, quote_id, min(chunk_index) filter (where ex) as ex, max(ratio) as ratio, arg_max(chunk_index, (ratio, -chunk_index)) as best from qc group by 1, 2),
bd as (select q.doc_id, quote_id, len(qw) as n, contains(t, q) as ind, case when len(qw) > 0 then len(list_filter(qw, lambda w: list_contains(cw, w))) / len(qw) else 0 end as dr
       from q join d using (doc_id) where q <> '')
select q.doc_id, quote_id, ex is not null or coalesce(n >= 3 and ratio >= 0.85, false) or coalesce(ind or (n >= 3 and dr >= 0.85), false) as grounded,
  case when ex is not null then ex when n >= 3 and ratio >= 0.85 then best end::int as evidence_chunk_index
from q left join bc using (doc_id, quote_id) left join bd using (doc_id, quote_id)""",
)
def ground_quotes_query(spark, sf_dir):
    asked = quotes(spark, sf_dir).select("doc_id", "quote_id", "quote").unionByName(far_quotes(spark, sf_dir))
    return ground_quotes(asked, chunk_table(spark, sf_dir), docs(spark, sf_dir)).select("doc_id", "quote_id", "grounded", "evidence_chunk_index")


@query(
    "quote_index_rows",
    rf"""with t as (select doc_id, -1 as unit, {collapse_sql('lower(text)')} as t, text from documents where text is not null),
g as (select doc_id, unit, greatest(len(string_split(t, ' ')) - 4, 0) as n from t),
w as (select doc_id, len(list_distinct({words_sql('text')})) as n from t)
select g.doc_id, g.n::bigint as grams, w.n::bigint as words from g join w using (doc_id)""",
)
def quote_index_rows(spark, sf_dir):
    """Rows of the stored index per whole document."""
    index = QuoteIndex.of(chunk_table(spark, sf_dir), docs(spark, sf_dir)).stored()
    count = lambda df, name: df.where("unit = -1").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = index.texts.where("unit = -1 and t is not null").select("doc_id").join(count(index.grams, "grams"), "doc_id", "left").join(count(index.words, "words"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("grams", F.lit(0)).cast("long").alias("grams"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))


# Fixed values, as in lakesignal.functions.text.
_CASE_STOP = "['the','a','an','is','are','of','to','and','or','in','on','for','by','with','this','that','be','will','shall','at','as','it','not','no','any','may','can','does','do','who','what','which']"


@query(
    "relevant_chunks",
    f"""with {CHUNKS}, {QUOTES},
a as (select doc_id, list_distinct({words_sql('quote', _CASE_STOP, 2)}) as aw from quotes where quote_id = 'changed'),
c as (select doc_id, chunk_index, list_distinct({words_sql('text', _CASE_STOP, 2)}) as cw from chunks),
o as (select doc_id, chunk_index, len(list_intersect(aw, cw)) as overlap from a join c using (doc_id))
select doc_id, chunk_index::int as chunk_index, overlap::int as overlap, row_number() over (partition by doc_id order by overlap desc, chunk_index)::int as rank from o
where overlap >= 2 qualify rank <= 2""",
)
def relevant_chunks(spark, sf_dir):
    cases = quotes(spark, sf_dir).where("quote_id = 'changed'")
    best = best_chunks_by_overlap(cases, chunk_table(spark, sf_dir), ["quote_id"], "quote")
    return best.drop("quote_id")


# -- durations, contradictions, review ------------------------------------------------

_DEADLINE = "case o_orderkey % 7 when 0 then 'within ' || (o_orderkey % 50) || ' days' when 1 then 'One month after receipt' when 2 then null when 3 then '2-week period' when 4 then 'ten years' when 5 then '0 days' else 'promptly' end"
_OBLIGATION = "'must give ' || (o_orderkey % 3 + 1) || ' weeks of notice'"
_CATEGORY = "case o_orderpriority when '1-URGENT' then 'notice' when '2-HIGH' then 'renewal' when '3-MEDIUM' then 'payment' when '4-NOT SPECIFIED' then 'notice' else 'termination' end"
_OBL = f"obl as (select o_orderkey, o_custkey as doc_id, {_CATEGORY} as category, {_OBLIGATION} as obligation, {_DEADLINE} as deadline, o_orderstatus <> 'P' as grounded from orders)"


def days_sql(x):
    p = r"(?i)\b(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s*[-\s]?\s*(day|days|week|weeks|month|months|year|years)\b"
    num, unit = f"lower(regexp_extract({x}, '{p}', 1))", f"lower(regexp_extract({x}, '{p}', 2))"
    return f"""(coalesce(try_cast({num} as int), list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], {num}))
  * case {unit} when 'day' then 1 when 'days' then 1 when 'week' then 7 when 'weeks' then 7 when 'month' then 30 when 'months' then 30 when 'year' then 365 when 'years' then 365 end)"""


def obligations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("doc_id"),
        F.expr(_CATEGORY).alias("category"),
        F.expr(_OBLIGATION).alias("obligation"),
        F.expr(_DEADLINE).alias("deadline"),
        (F.col("o_orderstatus") != "P").alias("grounded"),
    )


@query("durations", f"with {_OBL} select o_orderkey, {days_sql('deadline')}::int as days from obl")
def durations(spark, sf_dir):
    return obligations(spark, sf_dir).select("o_orderkey", duration_days(F.col("deadline")).alias("days"))


_CONFLICTS = f"""{_OBL},
dd as (select doc_id, category, coalesce(nullif({days_sql("coalesce(deadline, '')")}, 0), {days_sql('obligation')}) as days from obl where grounded and category in ('notice', 'renewal')),
conf as (select doc_id, category, array_to_string(list_sort(list_distinct(list(days))), ', ') as days_list, count(*) as n from dd where days is not null group by 1, 2 having count(distinct days) > 1)"""


@query("contradictions", f"with {_CONFLICTS} select doc_id, category, days_list, n::bigint as n_obligations from conf")
def contradictions_query(spark, sf_dir):
    c = contradictions(obligations(spark, sf_dir))
    return c.select("doc_id", "category", F.array_join(F.transform("values_days", lambda v: v.cast("string")), ", ").alias("days_list"), "n_obligations")


@query("grounded_obligations", f"with {_OBL} select doc_id, count(*) filter (where grounded)::bigint as grounded_count, count(*)::bigint as total_count from obl group by 1")
def grounded_obligations(spark, sf_dir):
    from lakesignal.operators.answers import obligation_counts

    return obligation_counts(obligations(spark, sf_dir))


_REVIEW_RULES = tuple(Rule(rid, r.label, r.severity, r.patterns, r.affects, r.explanation) for rid, r in zip(("ip_assignment", "auto_renewal", "lock_in_period", "broad_indemnity", "non_compete"), RULES))
_CONF_DOCS = _CONFLICTS.replace("from conf", "from conf")


@query(
    "review_rollup",
    f"""with {cover_sql(CATEGORIES)}, {_match_sql(_REVIEW_RULES)}, {_CONFLICTS},
items as (
  select doc_id, 'top_issue' as section, severity, 'risk' as source, label as title from hits where severity = 'high' union all
  select doc_id, 'negotiable', severity, 'risk', label from hits where severity in ('high', 'medium') union all
  select doc_id, 'top_issue', 'high', 'contradiction', 'Potential conflict requiring review: ' || category || ' durations differ' from conf where doc_id in (select doc_id from documents) union all
  select doc_id, 'top_issue', 'medium', 'coverage', 'No ' || label || ' clause found' from cover where status = 'not_found' and importance = 'high' union all
  select doc_id, 'clarification', 'low', 'coverage', category_id from cover where status = 'not_found' union all
  select distinct doc_id, 'question', severity, 'risk', rule_id from hits where rule_id in ('ip_assignment', 'auto_renewal', 'lock_in_period', 'broad_indemnity', 'non_compete'))
select doc_id, section, severity, source, title, count(*)::bigint as n from items group by 1, 2, 3, 4, 5""",
)
def review_rollup(spark, sf_dir):
    chunks = pinned(chunk_table(spark, sf_dir))
    conflicts = contradictions(obligations(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    items = review_items(scan_rules(chunks, _REVIEW_RULES), conflicts, coverage(chunks, CATEGORIES))
    by_question = F.create_map(*[F.lit(x) for rid, q in NEGOTIATION_QUESTIONS.items() for x in (q, rid)])
    title = F.when(F.col("section") == "question", F.try_element_at(by_question, F.col("detail"))).otherwise(F.col("title"))
    return items.groupBy("doc_id", "section", "severity", "source", title.alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_evidence",
    f"""with {cover_sql(CATEGORIES)}, {_match_sql(_REVIEW_RULES)}, {_CONFLICTS},
cno(category_id, no) as (values {", ".join(f"('{c.category_id}', {i})" for i, c in enumerate(CATEGORIES))}),
items as (
  select doc_id, 0 as s, chunk_index::bigint as p1, rule_no::bigint as p2, 'risk' as source, rule_id, chunk_index::int as chunk_index, null as category, null as days from hits where severity = 'high' union all
  select doc_id, 0, 1099511627776, case category when 'notice' then 1 else 2 end, 'contradiction', null, null, category, days_list from conf where doc_id in (select doc_id from documents) union all
  select doc_id, 1, 2199023255552, no, 'coverage', null, null, category_id, null from cover join cno using (category_id) where status = 'not_found' and importance = 'high')
select doc_id, row_number() over (partition by doc_id order by s, p1, p2)::int as position, source, rule_id, chunk_index, category, days from items""",
)
def review_evidence(spark, sf_dir):
    """Top issues of every document in report order, each with its evidence."""
    chunks = pinned(chunk_table(spark, sf_dir))
    conflicts = contradictions(obligations(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    items = review_items(scan_rules(chunks, _REVIEW_RULES), conflicts, coverage(chunks, CATEGORIES, numbered=True)).where("section = 'top_issue'")
    placed = numbered(items, ["doc_id"], ["severity_rank", "p1", "p2"], "position")
    days = F.when(F.col("values_days").isNotNull(), F.array_join(F.transform("values_days", lambda v: v.cast("string")), ", "))
    return placed.select("doc_id", F.col("position").cast("int").alias("position"), "source", "rule_id", "chunk_index", "category", days.alias("days"))


# -- pages ----------------------------------------------------------------------------

_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""
_PAGES = f"pg as (select page_id, regexp_extract(url, '://([^/]+)', 1) as doc_id, {_TEXT} as text, page_id % 7 = 0 as used_ocr from pages)"


def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("page_number"), F.regexp_extract("url", "://([^/]+)", 1).alias("doc_id"), html_text(F.col("html")).alias("text"), (F.col("page_id") % 7 == 0).alias("used_ocr")
    )


@query("page_text", f"with {_PAGES} select page_id, text from pg")
def page_text(spark, sf_dir):
    return page_texts(spark, sf_dir).select(F.col("page_number").alias("page_id"), "text")


@query("page_flags", f"with {_PAGES} select page_id, length(text)::int as char_count, length(text) < 40 as flagged_low_text from pg")
def page_flags_query(spark, sf_dir):
    from lakesignal.plans.review import page_flags

    return page_flags(page_texts(spark, sf_dir)).select(F.col("page_number").alias("page_id"), "char_count", "flagged_low_text")


@query("document_text", f"with {_PAGES} select page_id // 12 as doc_id, md5(array_to_string(list(text order by page_id), chr(10) || chr(10))) as digest from pg where text <> '' group by 1")
def document_text_query(spark, sf_dir):
    """Twelve pages make a document."""
    pages = page_texts(spark, sf_dir).withColumn("doc_id", F.floor(F.col("page_number") / 12))
    return document_text(pages).select("doc_id", F.md5("text").alias("digest"))


@query(
    "extraction_quality",
    f"""with {_PAGES}, q as (select doc_id, count(*) as n, count(*) filter (where used_ocr) as o, count(*) filter (where length(text) < 40) as l from pg group by 1)
select doc_id, n::bigint as total_pages, o::bigint as ocr_page_count, l::bigint as low_text_page_count,
  case when o = 0 and l = 0 then 'Extracted cleanly from native text; no quality concerns detected.' else concat_ws('; ',
    case when o > 0 then o || ' of ' || n || ' page(s) required OCR (no native text layer)' end,
    case when l > 0 then l || ' page' || case when l <> 1 then 's' else '' end || ' extracted unusually little text -- worth a manual check' end) || '.' end as summary from q""",
)
def extraction_quality_query(spark, sf_dir):
    return extraction_quality(page_texts(spark, sf_dir))
