"""Scans, appends, backfill, versions, micro-batches and registry actions."""

import uuid

from pyspark.sql import functions as F

from catalog import query, table
from catalog.checks import _RAG_SQL, TEL, _events_with_vectors, _feature_mmd_sql, telemetry
from catalog.drift import _KS_P
from catalog.monitoring import _fold, hourly_runs
from catalog.text import CHUNKS, RULES, _HITS, chunk_table, docs
from lakesignal.functions.fixed_rules import NEGOTIATION_QUESTIONS
from lakesignal.operators.chunking import chunk_documents
from lakesignal.operators.rules import impact_text, rules_from_table, scan_rules, severity_rank
from lakesignal.plans.run_check import run_telemetry_checks, telemetry_baselines
from lakesignal.plans.stored_checks import baseline_data, run_stored_checks, store_state
from lakesignal.scale import pinned, shared_folder, top_per_key
from lakesignal.sources import datasets, documents, files, registry
from lakesignal.sources.registry import Registry
from lakesignal.sources.telemetry import newest, traced, with_defaults
from lakesignal.streaming.retention import STATE_STORE, buffer_of, stream_newest
from lakesignal.streaming.telemetry import micro_batches, windowed_metrics


@query("telemetry_snapshot", f"with {TEL} select event_id, segment, grounded, citations::int as citations, round(latency_ms, 6) as latency_ms from tel")
def telemetry_snapshot(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", "segment", "grounded", "citations", F.round("latency_ms", 6).alias("latency_ms"))


@query("bounded_buffer", "select event_id from events order by ts desc, event_id desc limit 500")
def bounded_buffer(spark, sf_dir):
    """The newest 500 events; the limit is the operator."""
    return newest(table(spark, sf_dir, "events"), 500, "ts", "event_id").select("event_id")


@query(
    "retention_replay",
    "select event_type, event_id::varchar as event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id::varchar desc) <= 500",
)
def retention_replay(spark, sf_dir):
    """The newest 500 events per type after the table went through the stream with expiring state."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_type", F.col("ts").alias("at"), "event_id")
    folder = f"{shared_folder(spark)}/retention/{uuid.uuid4().hex}"
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(setting, STATE_STORE)
    try:
        changes = stream_newest(events, "event_type", 500, idle_seconds=10**9, watermark="36500 days")
        writer = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return buffer_of(spark.read.schema(changes.schema).parquet(f"{folder}/out"), "event_type").select("event_type", "event_id")


@query("null_defaults", "select event_id, case when value > 50 then value else 0 end as latency_ms, case when event_type = 'click' then 3 else 0 end as citations from events")
def null_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") > 50, F.col("value")).alias("latency_ms"), F.when(F.col("event_type") == "click", 3).alias("citations")
    )
    return with_defaults(e)


@query("answer_events", f"with {CHUNKS} select doc_id, count(*)::int as retrieved, least(2, count(*))::int as citations, round(sum(round(1.0 / (length(text) + 1), 4)), 4) as score_total from chunks group by 1")
def answer_events(spark, sf_dir):
    """One answer per document: all of its chunks retrieved, at most two cited."""
    hit = F.struct("chunk_index", (1.0 / (F.length("text") + 1)).alias("distance"))
    a = chunk_table(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(hit)).alias("retrieved_chunks"))
    e = documents.answer_event(a.withColumn("cited_chunks", F.slice("retrieved_chunks", 1, 2)))
    total = F.aggregate("retrieval_scores", F.lit(0.0), lambda x, y: x + y)
    return e.select("doc_id", "retrieved", "citations", F.round(total, 4).alias("score_total"))


@query("forwarded_traces", f"with {TEL} select event_id::varchar as trace_id, 'app' as model_id from tel where not grounded")
def forwarded_traces(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(F.col("event_id").cast("string").alias("trace_id"), F.col("ts").alias("at"), F.when(~F.col("grounded"), F.lit("{}")).alias("full_trace"))
    return traced(t, "app").select("trace_id", "model_id")


@query(
    "micro_batches",
    """with r as (select event_id, (row_number() over (order by ts, event_id) - 1) // 7 as batch_no from events)
select event_id, batch_no::bigint as batch_no, (batch_no + 1) * 7 <= (select count(*) from events) as complete from r""",
)
def micro_batches_query(spark, sf_dir):
    return micro_batches(table(spark, sf_dir, "events"), ["ts", "event_id"], 7).select("event_id", "batch_no", "complete")


def _window_sql(origin):
    return f"""select strftime({origin}, '%Y-%m-%d %H:%M') as window_start, segment, round(avg((not grounded)::int), 6) as refusal_rate, round(avg((citations > 0)::int), 6) as citation_rate,
  round(list_sort(list(latency_ms))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))], 6) as latency_p95_ms, count(*)::bigint as n_events"""


def _windows(df):
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "segment", *[F.round(c, 6).alias(c) for c in ("refusal_rate", "citation_rate", "latency_p95_ms")], "n_events"
    )


@query("windowed_metrics", f"with {TEL}, s as (select *, date_trunc('day', ts) as w from tel) {_window_sql('w')} from s group by w, segment")
def windowed_metrics_query(spark, sf_dir):
    return _windows(windowed_metrics(telemetry(spark, sf_dir), ["segment"], "ts", "1 day"))


@query(
    "sliding_metrics",
    f"with {TEL}, s as (select *, date_trunc('day', ts) - to_days(d) as w from tel, (values (0), (1)) v(d)) {_window_sql('w')} from s group by w, segment",
)
def sliding_metrics(spark, sf_dir):
    return _windows(windowed_metrics(telemetry(spark, sf_dir), ["segment"], "ts", "2 days", "1 day"))


# -- documents -------------------------------------------------------------------


@query(
    "document_registry",
    """with o as (select o_custkey as doc_id, o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then o_custkey % 50 end as g, case when o_orderstatus = 'F' then 2 end as v from orders)
select doc_id, max(o_orderkey) as uploaded_at, coalesce(arg_max(coalesce(g, -1), o_orderkey), -1) as raw_group from o group by 1""".replace(
        "coalesce(arg_max(coalesce(g, -1), o_orderkey), -1) as raw_group", "case when arg_max(coalesce(g, -1), o_orderkey) = -1 then doc_id else arg_max(coalesce(g, -1), o_orderkey) end as version_group_id, case when arg_max(coalesce(v, -1), o_orderkey) = -1 then 1 else 2 end as version_number"
    ),
)
def document_registry(spark, sf_dir):
    """Orders as appended registry rows of a customer's document: the latest one counts."""
    done = F.col("o_orderstatus") == "F"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("uploaded_at"), F.when(done, F.col("o_custkey") % 50).alias("version_group_id"), F.when(done, 2).alias("version_number")
    )
    return documents.current_documents(rows).select("doc_id", "uploaded_at", "version_group_id", "version_number")


@query(
    "version_chain",
    """with d as (select doc_id, case when lang = 'en' then doc_id else doc_id % 20 end as version_group_id, case when lang = 'en' then 1 else (n_chars % 5 + 1) end as version_number from documents)
select doc_id, version_group_id, row_number() over (partition by version_group_id order by version_number, doc_id)::int as position from d""",
)
def version_chain(spark, sf_dir):
    legacy = F.col("lang") == "en"
    rows = docs(spark, sf_dir).select(
        "doc_id", F.when(~legacy, F.col("doc_id") % 20).alias("version_group_id"), F.when(~legacy, F.col("n_chars") % 5 + 1).alias("version_number"), F.col("doc_id").alias("uploaded_at")
    )
    return documents.version_chain(rows).select("doc_id", "version_group_id", "position")


@query(
    "next_versions",
    """with e as (select doc_id, doc_id % 20 as g, n_chars % 5 + 1 as v from documents),
u as (select doc_id + 1000000 as doc_id, case when doc_id % 3 = 0 then doc_id end as of_doc from documents)
select u.doc_id, coalesce(e.g, u.doc_id) as version_group_id, coalesce((select max(v) from e x where x.g = e.g), 0) + 1 as version_number from u left join e on e.doc_id = u.of_doc""",
)
def next_versions(spark, sf_dir):
    existing = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 20).alias("version_group_id"), (F.col("n_chars") % 5 + 1).alias("version_number"))
    uploads = docs(spark, sf_dir).select((F.col("doc_id") + 1000000).alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("new_version_of"))
    return documents.next_version(existing, uploads).select("doc_id", "version_group_id", "version_number")


@query("row_access", "select doc_id from documents where nullif(source, 'src3') is null or source = 'src7'")
def row_access(spark, sf_dir):
    """Documents of src3 have no owner; the user is src7."""
    d = docs(spark, sf_dir).withColumn("owner", F.when(F.col("source") != "src3", F.col("source")))
    return d.where(documents.can_access("src7")).select("doc_id")


@query("chunk_index_rows", f"with {CHUNKS} select doc_id || '::' || chunk_index as id, '' as heading, md5(text) as digest from chunks")
def chunk_index_rows(spark, sf_dir):
    return documents.index_rows(chunk_table(spark, sf_dir)).select("id", "heading", F.md5("text").alias("digest"))


@query(
    "index_upsert",
    """with e as (select doc_id::varchar as id, n_chars as v from documents where lang <> 'de'), i as (select doc_id::varchar as id, -n_chars as v from documents where lang <> 'en')
select * from e where id not in (select id from i) union all select * from i""",
)
def index_upsert(spark, sf_dir):
    d = docs(spark, sf_dir)
    old = d.where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("v"))
    new = d.where("lang <> 'en'").select(F.col("doc_id").cast("string").alias("id"), (-F.col("n_chars")).alias("v"))
    return documents.upsert_index(old, new)


@query("index_delete", "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 0)")
def index_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("quality = 0")
    return documents.drop_documents(docs(spark, sf_dir).select("doc_id", "source"), gone)


@query("cascade_delete", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return registry.cascade_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query(
    "backfill_counts",
    """with s as (select o_custkey as doc_id, o_comment_broken from (select o_custkey, o_orderkey % 17 = 0 as o_comment_broken from orders)), t as (select c_custkey as doc_id from customer where c_mktsegment = 'BUILDING')
select count(*) filter (where not o_comment_broken and doc_id not in (select doc_id from t))::bigint as migrated, count(*) filter (where not o_comment_broken and doc_id in (select doc_id from t))::bigint as skipped,
  count(*) filter (where o_comment_broken)::bigint as failed from s""",
)
def backfill_counts(spark, sf_dir):
    """Orders as source rows (every 17th one broken), building customers as rows that exist already."""
    source = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 17 == 0, "broken").alias("_corrupt_record"))
    target = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    return datasets.backfill_counts(datasets.backfill_plan(source, target, "doc_id"))


@query(
    "case_defaults",
    """select item_id::varchar as id, len(case when item_id % 2 = 0 then [item_id::int] else [] end)::int as n_chunks, 0 as n_citations from benchmark""",
)
def case_defaults(spark, sf_dir):
    """Evaluation cases written as JSON lines and read back with list defaults."""
    path = f"{shared_folder(spark)}/lakesignal/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, F.array(F.col("item_id").cast("int"))).alias("relevant_chunks")
    )
    datasets.write_json(rows, path)
    back = datasets.read_cases(spark, path)
    return back.select("id", F.size("relevant_chunks").alias("n_chunks"), F.size("expected_citations").alias("n_citations"))


@query("source_documents", "select source, count(*)::bigint as n from (select distinct source, doc_id from documents) group by 1")
def source_documents(spark, sf_dir):
    """Distinct documents of a case set, each indexed once."""
    cases = docs(spark, sf_dir).select("source", "doc_id").distinct()
    return cases.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("file_validation")
def file_validation(spark, sf_dir):
    """The table files themselves as uploads: size and signature checks."""
    return files.validate_files(spark, sf_dir, glob="*.parquet").select("length", "accepted", "reason")


# -- rules as tables and set operations ---------------------------------------------


@query("rule_table_scan", _HITS.replace("with ", "with ", 1) + " select doc_id, rule_id, count(*)::bigint as n from hits group by 1, 2")
def rule_table_scan(spark, sf_dir):
    """The same rules supplied by the caller as a table."""
    rows = [(f"{i}_{r.rule_id}", r.label, r.severity, j, p) for i, r in enumerate(RULES) for j, p in enumerate(r.patterns)]
    rules = rules_from_table(spark.createDataFrame(rows, "rule_id string, label string, severity string, pattern_no int, pattern string"))
    found = scan_rules(chunk_table(spark, sf_dir), rules)
    return found.groupBy("doc_id", F.substring_index("rule_id", "_", -2).alias("rid"), "label").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", F.expr("CASE label " + " ".join(f"WHEN '{r.label}' THEN '{r.rule_id}'" for r in RULES) + " END").alias("rule_id"), "n"
    )


@query(
    "finding_order",
    _HITS
    + """ select doc_id, rule_id, chunk_index::int as chunk_index, row_number() over (partition by doc_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, chunk_index, rule_no)::int as position
from hits qualify position <= 5""",
)
def finding_order(spark, sf_dir):
    """The five most severe findings of each document, in report order."""
    f = scan_rules(chunk_table(spark, sf_dir), RULES).select("doc_id", "rule_id", "rule_no", "severity", "chunk_index")
    top = top_per_key(f, ["doc_id"], [severity_rank(F.col("severity")), F.col("chunk_index"), F.col("rule_no")], 5, "position")
    return top.select("doc_id", "rule_id", "chunk_index", "position")


@query(
    "rule_set_difference",
    _HITS
    + """, r as (select distinct d.source, h.rule_id from hits h join documents d using (doc_id))
select rule_id, bool_or(source = 'src0') as in_a, bool_or(source = 'src1') as in_b from r where source in ('src0', 'src1') group by 1""",
)
def rule_set_difference(spark, sf_dir):
    """Rules of two sources by set operations: only in A, only in B, in both."""
    asked = docs(spark, sf_dir).where(F.col("source").isin("src0", "src1"))  # before any text is cut up
    f = scan_rules(chunk_documents(asked), RULES).select("doc_id", "rule_id").join(asked.select("doc_id", "source"), "doc_id")
    a, b = (f.where(F.col("source") == s).select("rule_id") for s in ("src0", "src1"))
    mark = lambda df, x, y: df.withColumns({"in_a": F.lit(x), "in_b": F.lit(y)})
    return mark(a.intersect(b), True, True).unionByName(mark(a.subtract(b), True, False)).unionByName(mark(b.subtract(a), False, True))


@query(
    "impact_text",
    """select distinct 'Present in Document A only, absent from Document B -- this specific risk to ' || lang || ' does not apply under Document B''s stated terms.' as impact from documents""",
)
def impact_text_query(spark, sf_dir):
    return docs(spark, sf_dir).select(impact_text(F.lit(True), F.lit(False), F.col("lang")).alias("impact")).distinct()


@query(
    "negotiation_questions",
    "select case l_returnflag when 'A' then 'auto_renewal' when 'N' then 'non_compete' else 'other' end as rule_id, count(*)::bigint as n, l_returnflag in ('A', 'N') as has_question from lineitem group by 1, 3",
)
def negotiation_questions(spark, sf_dir):
    """Question lookup by rule id: rules without a question stay, without one."""
    rid = F.when(F.col("l_returnflag") == "A", "auto_renewal").when(F.col("l_returnflag") == "N", "non_compete").otherwise("other")
    questions = spark.createDataFrame(list(NEGOTIATION_QUESTIONS.items()), "rule_id string, question string")
    joined = table(spark, sf_dir, "lineitem").groupBy(rid.alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).join(questions, "rule_id", "left")
    return joined.select("rule_id", "n", F.col("question").isNotNull().alias("has_question"))


@query(
    "experiment_records",
    "select o_orderkey::varchar as experiment_id, 'order ' || o_orderkey as name, o_orderpriority as kind, o_orderstatus as status, o_totalprice > 100000 as large from orders where o_orderpriority in ('1-URGENT', '5-LOW')",
)
def experiment_records(spark, sf_dir):
    """Experiments appended in two batches, their results as JSON, and read back by kind."""
    reg = Registry(spark, f"{shared_folder(spark)}/registry/{uuid.uuid4().hex}")
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("experiment_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"),
        F.to_timestamp("o_orderdate").alias("created_at"), F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("config"), F.to_json(F.struct(F.col("o_totalprice").alias("price"))).alias("results"), F.col("o_orderstatus").alias("status"),
    )
    for odd in (0, 1):
        reg.append("experiments", rows.where(F.col("experiment_id").cast("long") % 2 == odd))
    stored = reg.read("experiments")
    found = registry.experiments_of(stored, "1-URGENT").unionByName(registry.experiments_of(stored, "5-LOW"))
    large = F.from_json("results", "price double")["price"] > 100000
    return found.select("experiment_id", "name", "kind", "status", large.alias("large"))


@query(
    "result_export",
    "select l_returnflag as name, round(sum(l_quantity), 2) as quantity, count(*)::bigint as n from lineitem group by 1",
)
def result_export(spark, sf_dir):
    """A metric table written as JSON and read back."""
    path = f"{shared_folder(spark)}/export/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"), F.count(F.lit(1)).alias("n"))
    datasets.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# -- registry actions ----------------------------------------------------------------


def _registry_after_two_batches(spark, sf_dir):
    reg = registry.Registry(spark, f"{shared_folder(spark)}/lakesignal/{uuid.uuid4().hex}")
    at = F.timestamp_seconds(F.col("run_id") * 3600)
    runs = hourly_runs(spark, sf_dir).withColumn("ts", at)
    models = runs.select("model_id").distinct().select("model_id", F.col("model_id").alias("name"), F.lit("rag").alias("check_name"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    reg.register(models, models.select("model_id", F.lit("{}").alias("data"), "created_at"))
    reg.record_runs(runs.where("run_id < 300"), 1, 2, 2)
    reg.record_runs(runs.where("run_id >= 300"), 1, 2, 2)
    return reg


_LAST = f"with {_fold(1, 2, 2)}, la as (select * from tl qualify row_number() over (partition by model_id order by rn desc) = 1)"


@query("registry_health", _LAST + " select model_id, state, cd as consecutive_drifted, cc as consecutive_clean from la")
def registry_health(spark, sf_dir):
    """Models registered and checked in two batches; health is stored between them."""
    reg = _registry_after_two_batches(spark, sf_dir)
    return reg.health().select("model_id", "state", "consecutive_drifted", "consecutive_clean")


@query(
    "registry_alerts",
    f"""with {_fold(1, 2, 2)} select a.model_id, a.run_id, count(r.run_id) > 0 as resolved, (count(r.run_id) > 0 and min(r.run_id) is not null)::int as with_time
from tl a left join tl r on r.model_id = a.model_id and r.resolves and r.rn > a.rn where a.opens group by 1, 2""",
)
def registry_alerts(spark, sf_dir):
    reg = _registry_after_two_batches(spark, sf_dir)
    return reg.read("alerts").select("model_id", "run_id", "resolved", F.col("resolved_at").isNotNull().cast("int").alias("with_time"))


@query(
    "registry_rebaseline",
    f"""with {_fold(1, 2, 2)} select model_id, case when model_id in ('error', 'view') then 2 else 1 end as version,
  case when model_id in ('error', 'view') then 0 else count(*) filter (where opens and not exists (select 1 from tl r where r.model_id = tl.model_id and r.resolves and r.rn > tl.rn)) end::bigint as open_alerts from tl group by 1""",
)
def registry_rebaseline(spark, sf_dir):
    """Two models get a new baseline: version 2, their alerts resolved; the others stay as they were."""
    reg = _registry_after_two_batches(spark, sf_dir)
    new = reg.read("models").where(F.col("model_id").isin("error", "view")).select("model_id", F.lit('{"v": 2}').alias("data"), F.timestamp_seconds(F.lit(10**10)).alias("created_at"))
    reg.rebaseline(new)
    open_alerts = reg.read("alerts").where(~F.col("resolved")).groupBy("model_id").agg(F.count(F.lit(1)).alias("open_alerts"))
    return reg.baselines().select("model_id", "version").join(open_alerts, "model_id", "left").withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))


_DAILY_LIMITS = {"refusal_tolerance": 0.02, "citation_tolerance": 0.03, "latency_multiplier": 1.02}

_DAILY_RUNS = f"""{TEL},
b as (select segment, avg((not grounded)::int) as r, avg((citations > 0)::int) as c,
      list_sort(list(latency_ms))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))] as l from tel where sample = 'baseline' group by 1),
m as (select segment, day(ts)::bigint as run_id, avg((not grounded)::int) as r, avg((citations > 0)::int) as c,
      list_sort(list(latency_ms))[greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0)::bigint))] as l, count(*) as n
      from tel where sample = 'current' group by 1, 2),
d as (select m.segment, run_id, m.r,
        (n >= 5 and m.r - b.r > 0.02)::int + (n >= 5 and b.c - m.c > 0.03)::int + (n >= 5 and case when b.l > 0 then m.l / b.l else 1.0 end > 1.02)::int as k
      from m join b using (segment)),
p as (select *, k > 0 as bad, row_number() over w as rn, max(case when k > 0 then run_id end) over (partition by segment order by run_id rows between unbounded preceding and 1 preceding) as bad_before
      from d window w as (partition by segment order by run_id)),
t as (select *, case when bad then 'degraded' when bad_before is null then 'healthy' when run_id - bad_before = 1 then 'recovering' else 'healthy' end as state from p),
u as (select *, coalesce(lag(state) over (partition by segment order by run_id), 'healthy') as was from t)"""


def _checked_days(spark, sf_dir, times):
    """Segments are models; each day of the second half is a run against the first half, recorded ``times`` times."""
    events = telemetry(spark, sf_dir).withColumn("model_id", F.col("segment").cast("string")).withColumn("run_id", F.dayofmonth("ts").cast("bigint"))
    reg = Registry(spark, f"{shared_folder(spark)}/registry/{uuid.uuid4().hex}")
    start = F.timestamp_seconds(F.lit(0))
    base = telemetry_baselines(events.where("sample = 'baseline'")).withColumn("created_at", start)
    models = base.select("model_id", F.col("model_id").alias("name"), F.lit("live_telemetry").alias("check_name"), "created_at", F.lit("{}").alias("config"))
    reg.register(models, base)
    for _ in range(times):
        out = run_telemetry_checks(reg, events.where("sample = 'current'"), _DAILY_LIMITS)
    return reg, out


@query(
    "run_check_end_to_end",
    f"""with {_DAILY_RUNS} select segment::varchar as model_id, run_id, round(k / 3.0, 6) as drift_score, round(1 - r, 6) as quality_score, bad as is_drifted, state,
  bad and was not in ('degraded', 'recovering') as opens_alert, not bad and was = 'recovering' as resolves_alerts from u""",
)
def run_check_end_to_end(spark, sf_dir):
    """From stored baseline to runs with their health."""
    _, out = _checked_days(spark, sf_dir, 1)
    return out.timeline.select("model_id", "run_id", F.round("drift_score", 6).alias("drift_score"), F.round("quality_score", 6).alias("quality_score"), "is_drifted", "state", "opens_alert", "resolves_alerts")


@query(
    "run_check_replayed",
    f"""with {_DAILY_RUNS} select segment::varchar as model_id, count(*)::bigint as n_runs, sum(bad::int)::bigint as n_drifted,
  sum((bad and was not in ('degraded', 'recovering'))::int)::bigint as n_alerts, max_by(state, run_id) as state from u group by 1""",
)
def run_check_replayed(spark, sf_dir):
    """The same events again: stored runs, alerts and health are those of one call."""
    reg, _ = _checked_days(spark, sf_dir, 2)
    runs = reg.raw("runs").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("is_drifted").alias("n_drifted"))
    alerts = reg.read("alerts").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_alerts"))
    joined = runs.join(alerts, "model_id", "left").join(reg.health().select("model_id", "state"), "model_id")
    return joined.withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))


_FOUR = f"""with {_RAG_SQL}, {_feature_mmd_sql(100)},
rsig as (select segment, p < 0.05 or (name = 'retrieval' and w / iqr > 0.2) as drifted from ksp join iqr using (segment, name) union all
  select segment, abs((xc / nc - xb / nb) / sqrt((xb + xc) / (nb + nc) * (1 - (xb + xc) / (nb + nc)) * (1 / nb + 1 / nc))) > 1.959963984540054 from prop union all
  select segment, coalesce(m >= 8 and n >= 8 and p_value < 0.05, false) from (select distinct segment from tel) left join fmmd on g = segment),
daily as (with {_DAILY_RUNS.replace(TEL + ",", "", 1)} select segment, run_id, k, r from d),
fv as (select l_linenumber as run_id, feature, value from (select l_linenumber, unnest([{{'feature': 'l_quantity', 'value': l_quantity::double}}, {{'feature': 'l_discount', 'value': l_discount::double}}], recursive := true) from lineitem)),
fc as (select r.run_id, feature, value, count(*) filter (where fv.run_id = 1) as nb, count(*) filter (where fv.run_id <> 1) as nc from (select unnest(range(2, 8)) as run_id) r join fv on fv.run_id = 1 or fv.run_id = r.run_id group by 1, 2, 3),
fr as (select *, sum(nb) over w as cb, sum(nc) over w as cc, sum(nb) over g as n_b, sum(nc) over g as n_c from fc window w as (partition by run_id, feature order by value rows unbounded preceding), g as (partition by run_id, feature)),
fd as (select run_id, feature, max(abs(cb / n_b - cc / n_c)) as d, max(n_b) as n_b, max(n_c) as n_c from fr group by 1, 2), fp as ({_KS_P.format(src="fd")}),
ga as (select run, item_id, text as e, case run when 1 then text when 2 then left(text, length(text) // 2) else other end as a from (select item_id, text, lead(text, 1, 'nothing') over (order by item_id) as other from benchmark), (select unnest([1, 2, 3]) as run)),
gt as (select run, item_id, term, count(*) filter (where s) as tl, count(*) filter (where not s) as tr from (select run, item_id, true as s, unnest(regexp_extract_all(lower(e), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from ga union all
  select run, item_id, false, unnest(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]{{2,}}')) from ga) group by 1, 2, 3),
gi as (select run, term, ln((1 + 2 * (select count(*) from benchmark)) / (1 + sum((tl > 0)::int + (tr > 0)::int))) + 1 as idf from gt group by 1, 2),
gs as (select run, item_id, coalesce(sum(tl * tr * idf * idf) / nullif(sqrt(sum(tl * tl * idf * idf)) * sqrt(sum(tr * tr * idf * idf)), 0), 0) as sim from gt join gi using (run, term) group by 1, 2),
runs4 as (select 'lineitem' as model_id, run_id::bigint as run_id, avg((p < 0.05 / 2)::int) as drift_score, null::double as quality_score, avg((p < 0.05 / 2)::int) >= 0.3 as is_drifted from fp group by 1, 2 union all
  select 'passages', run, greatest(0, 1 - avg(sim)), avg(sim), avg(sim) < 0.35 from gs group by 1, 2 union all
  select 's' || segment, run_id, k / 3.0, 1 - r, k > 0 from daily union all
  select 'r' || segment, 1, count(*) filter (where drifted) / 5, (select avg(grounded::int) from tel t where t.segment = rsig.segment and t.sample = 'current'), bool_or(drifted) from rsig group by segment),
seen4 as (select *, lag(is_drifted) over w as was_bad, bool_or(is_drifted) over (partition by model_id order by run_id rows between unbounded preceding and 1 preceding) as any_bad from runs4 window w as (partition by model_id order by run_id))"""


@query(
    "run_check_all_kinds",
    _FOUR + """ select model_id, run_id, round(drift_score, 6) as drift_score, round(quality_score, 6) as quality_score, is_drifted,
  case when is_drifted then 'degraded' when was_bad then 'recovering' else 'healthy' end as state from seen4""",
)
def run_check_all_kinds(spark, sf_dir):
    """Models of all four kinds, registered with stored baselines, checked in one call and, repeated, not again."""
    reg, inputs, options = _four_kinds(spark, sf_dir)
    first = run_stored_checks(reg, inputs, options)
    again = run_stored_checks(reg, inputs, options)
    runs = first.timeline.unionByName(again.timeline)
    return runs.select("model_id", "run_id", F.round("drift_score", 6).alias("drift_score"), F.round("quality_score", 6).alias("quality_score"), "is_drifted", "state")


def _four_kinds(spark, sf_dir):
    """A registry with baselines in two batches, and the rows to check by kind."""
    at = F.timestamp_seconds(F.col("run_id") * 86400)
    events = pinned(_events_with_vectors(spark, sf_dir))  # read for two baselines and two kinds of runs
    telemetry_rows = events.withColumn("model_id", F.concat(F.lit("s"), F.col("segment").cast("string"))).withColumn("run_id", F.dayofmonth("ts").cast("bigint"))
    rag_rows = events.withColumn("model_id", F.concat(F.lit("r"), F.col("segment").cast("string"))).withColumn("run_id", F.lit(1).cast("bigint"))
    features = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("l_quantity", "l_discount")]))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("model_id"), F.col("l_linenumber").cast("bigint").alias("run_id"), "l_orderkey", features)
    b = table(spark, sf_dir, "benchmark")
    following = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    golden = b.select(F.lit("passages").alias("model_id"), F.col("item_id").cast("string").alias("prompt"), F.col("text").alias("expected_answer"), F.col("item_id").cast("bigint").alias("position"))
    half = F.expr("left(text, cast(length(text) div 2 as int))")
    answers = b.join(following, "item_id", "left").select(
        F.lit("passages").alias("model_id"), F.col("item_id").cast("string").alias("prompt"),
        F.inline(F.array(*[F.struct(F.lit(r).cast("bigint").alias("run_id"), c.alias("actual_answer")) for r, c in ((1, F.col("text")), (2, half), (3, F.coalesce("other", F.lit("nothing"))))])),
    )
    based = {
        "classifier": lines.where("run_id = 1").select("model_id", "feature", "value", "l_orderkey"),
        "llm": golden,
        "live_telemetry": telemetry_rows.where("sample = 'baseline'"),
        "rag": rag_rows.where("sample = 'baseline'"),
    }
    reg = Registry(spark, f"{shared_folder(spark)}/registry/{uuid.uuid4().hex}")
    start = F.timestamp_seconds(F.lit(0))
    for kind, rows in based.items():
        data = baseline_data(kind, rows).withColumn("created_at", start)
        reg.register(data.select("model_id", F.col("model_id").alias("name"), F.lit(kind).alias("check_name"), "created_at", F.lit("{}").alias("config")), data)
        parts = [rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1")] if kind == "classifier" else [rows]
        for part in parts:  # a baseline may grow by batches
            store_state(reg, kind, part)
    inputs = {
        "classifier": lines.where("run_id > 1").withColumn("ts", at),
        "llm": answers.withColumn("ts", at),
        "live_telemetry": telemetry_rows.where("sample = 'current'"),
        "rag": rag_rows.where("sample = 'current'"),
    }
    return reg, inputs, {"live_telemetry": {"limits": _DAILY_LIMITS}, "rag": {"permutations": 100}}
