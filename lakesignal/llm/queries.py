"""Driver queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesignal.llm import decontaminate, html, lsh_forest, ngram_join, pii, quality, ranked_search, secrets, sentencepiece_bpe, token_counts, toxicity, warc, whitening
from lakesignal.llm.common import load, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.loaded_totals(load(spark, sf_dir, "documents"), f"{shared_folder(spark)}/token_counts/{uuid.uuid4().hex}")


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(load(spark, sf_dir, "documents")))


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(load(spark, sf_dir, "documents"))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@_query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(load(spark, sf_dir, "documents")).drop("_key")


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(load(spark, sf_dir, "documents")))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(load(spark, sf_dir, "documents"))


@_query
def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(load(spark, sf_dir, "documents"))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


# Exact quantiles in place of sketches: the two agree while a group has no more rows than the sketch keeps (k = 4096).
ORACLE["op10_quality_rules"] = r"""with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, {'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]} as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rw as (select doc_id, count(distinct p) as c from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by 1),
m as (select w.doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c, 0)::bigint as n_repeat_words,
  len(ls) as n_lines, len(regexp_extract_all(t, '\p{Lu}')) as n_upper from w left join rw using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
v as (select doc_id, lang, source, base_failed, unnest([
  {'rule': 1, 'least': 0.2::double, 'x': case when n_words > 0 then word_chars / n_words else 0.0 end},
  {'rule': 2, 'least': 0.005::double, 'x': case when word_chars > 0 then n_symbols / word_chars else 0.0 end},
  {'rule': 3, 'least': 0.06::double, 'x': case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end},
  {'rule': 4, 'least': 0.05::double, 'x': case when n_words > 0 then n_repeat_words / n_words else 0.0 end},
  {'rule': 5, 'least': 0.02::double, 'x': case when word_chars > 0 then n_upper / word_chars else 0.0 end}]) as s from b),
f as (select lang, source, s.rule as rule, s.x as x from v where not base_failed),
s1 as (select lang, source, rule, list_sort(list(x)) as l from f group by all), s2 as (select lang, rule, list_sort(list(x)) as l from f group by all), s3 as (select rule, list_sort(list(x)) as l from f group by all),
c as (select k.lang, k.source, s3.rule, case when len(s1.l) >= 200 then s1.l when len(s2.l) >= 200 then s2.l else s3.l end as l
  from (select distinct lang, source from d) k cross join s3 left join s1 on s1.lang is not distinct from k.lang and s1.source is not distinct from k.source and s1.rule = s3.rule
  left join s2 on s2.lang is not distinct from k.lang and s2.rule = s3.rule),
q as (select *, l[ceil(0.25 * len(l))::bigint] as q1, l[ceil(0.5 * len(l))::bigint] as q2, l[ceil(0.75 * len(l))::bigint] as q3 from c),
j as (select v.doc_id, bool_and(s.x <= q3 + 6 * greatest(q3 - q2, s.least) and s.x >= case when s.rule = 1 then q1 - 6 * greatest(q2 - q1, s.least) else 0 end) as ok
  from v join q on q.lang is not distinct from v.lang and q.source is not distinct from v.source and q.rule = v.s.rule group by 1)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from b join j using (doc_id)"""

ORACLE["op9_warc"] = """with p as (select page_id, coalesce(html, '') as h from pages), m as (select *, max(page_id) over (partition by h) as keeper from p)
select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest, case when strlen(h) >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
  case when strlen(h) >= 1000 and page_id <> keeper then keeper end as refers_to from m"""

ORACLE["op5_ngram_join"] = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n, md5(array_to_string(list_sort(list(s)), chr(10))) as k from s group by 1),
l as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
k as (select a, b, x.k as ka, y.k as kb from l join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) as (select doc_id, doc_id from w union select r.a, k.b from r join k on k.a = r.b),
c as (select a, min(b) as component_id from r group by 1), d as (select a, count(distinct kb) filter (where ka <> kb) as n_links from k group by 1)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links from w join c on c.a = w.doc_id left join n using (doc_id) left join d on d.a = w.doc_id"""


ORACLE["op11_lsh_forest"] = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
l as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
k as (select a, b from l join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) as (select doc_id, doc_id from w union select r.a, k.b from r join k on k.a = r.b),
c as (select a, min(b) as component_id from r group by 1)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept from w join c on c.a = w.doc_id left join n using (doc_id)"""

ORACLE["op13_ranked_search"] = r"""with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents where text is not null),
d as (select doc_id, ws, len(ws) as n from t where len(ws) > 0), st as (select count(*) as nn, sum(n)::bigint as ll from d),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select distinct item_id, text from benchmark)) group by 1, 2),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(ws) as term from d) where term in (select term from q) group by 1, 2, 3),
w as (select term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)))::bigint as w from tf, st group by 1),
i as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) as s from tf join w using (term), st),
s as (select item_id, doc_id, sum(times * s)::bigint as score from q join i using (term) group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify rank <= 20"""
