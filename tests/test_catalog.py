import __spark_entry__ as entry_module
from catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 120
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 4 and {r["feature"] for r in rows} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(QUERIES["history_limit"](spark, sf))
    assert "PushedFilters" in p and "EqualTo(event_type,error)" in p
    p = plan(QUERIES["psi_by_feature"](spark, sf))
    assert "l_orderkey" in p or "ReadSchema" in p
    p = plan(QUERIES["rule_findings"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_python_on_the_hot_path(spark, sf):
    for name in ("rule_findings", "document_chunks", "coverage_scan", "diagnose_traces", "parse_answers", "telemetry_metrics_daily", "health_timeline", "bm25_topk"):
        p = plan(QUERIES[name](spark, sf))
        assert "EvalPython" not in p and "InPandas" not in p, name


def test_no_cartesian_products(spark, sf):
    for name in ("rule_findings", "ground_quotes", "compare_documents", "hybrid_topk", "tfidf_nearest", "knn_predictions", "threshold_sweep", "baseline_as_of"):
        p = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


def test_chunking_is_map_only_once_the_text_is_spread(spark, sf):
    from lakesignal.operators.chunking import chunk_documents
    from catalog import table

    assert "Exchange" not in plan(chunk_documents(table(spark, sf, "documents")))
