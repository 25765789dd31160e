import random

import pytest
from pyspark.sql import functions as F

from lakesignal import scale


def skewed_rows(n=600, seed=1):
    r = random.Random(seed)
    return [(("hot" if r.random() < 0.6 else f"k{r.randrange(5)}"), r.randrange(200), i, r.random()) for i in range(n)]


def test_numbered_and_running_match_a_sequential_pass(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, t int, id int, v double")
    placed = scale.numbered(df, ["k"], ["t", "id"], "rn", buckets=7)
    assert placed.select("_bucket").distinct().count() > 1
    total = scale.running(placed, ["k"], ["rn"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.when(F.col("v") > 0.5, F.col("v")))})
    lagged = scale.previous(total, ["k"], ["rn"], "id", "prev")
    got = {r["id"]: r for r in lagged.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        s, hi, lo, prev = 0.0, None, None, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            s, hi = s + v, v if hi is None else max(hi, v)
            lo = lo if v <= 0.5 else (v if lo is None else min(lo, v))
            g = got[i]
            assert g["rn"] == n and abs(g["s"] - s) < 1e-9 and g["hi"] == hi and g["lo"] == lo and g["prev"] == prev
            prev = i


def test_numbering_a_whole_table(spark):
    df = spark.createDataFrame([(7, i) for i in range(300)], "t int, id int")
    got = scale.numbered(df, [], ["t", "id"], buckets=5)
    assert got.where("rn <> id + 1").count() == 0 and got.select("_bucket").distinct().count() > 1


def test_buckets_keep_the_value_order(spark):
    rows = [("a", float(v)) for v in range(500)] + [("b", 1.0)] * 400
    df = spark.createDataFrame(rows, "k string, v double")
    out = scale.with_bucket(df, scale.value_cuts(df, ["k"], "v", 6), ["k"], "v", 6)
    spans = out.where("k = 'a'").groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert len(spans) == 6 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))
    assert out.where("k = 'b'").select("_bucket").distinct().count() == 1


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1)], "k string, i int")
    table = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, w double")
    got = scale.salted_lookup(rows, table, ["k"], 5)
    assert got.count() == 201 and got.select("w").distinct().count() == 2


def test_top_per_key_and_latest(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, t int, id int, v double")
    got = scale.top_per_key(df, ["k"], [F.desc("v"), F.col("id")], 3).collect()
    for key in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[3], r[2]))[:3]
        assert [r["id"] for r in sorted((g for g in got if g["k"] == key), key=lambda g: g["rank"])] == [w[2] for w in want]
    newest = {r["k"]: r["id"] for r in scale.latest(df, ["k"], ["t", "id"]).collect()}
    assert newest == {k: max((r[1], r[2]) for r in rows if r[0] == k)[1] for k in newest}


def test_configuration_tables_are_never_cut(spark):
    assert len(scale.small_rows(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        scale.small_rows(spark.range(6), 5)


class _Conf(dict):
    def __call__(self, *_):
        return self


def test_the_work_folder_is_never_a_machine_local_fallback():
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = _Conf(conf)

    assert scale.shared_folder(Session("spark://x", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert scale.shared_folder(Session("yarn", **{"spark.lakesignal.work_dir": "s3://w"})) == "s3://w"
    assert scale.shared_folder(Session("local[2]", **{"spark.sql.warehouse.dir": "file:/w"})) == "file:/w/_work"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scale.shared_folder(Session(master))
