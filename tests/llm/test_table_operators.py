"""Operators over whole tables against brute force: joins, rollups, archives, the pipeline."""

import base64
import hashlib
import random
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesignal.llm import decontaminate, ngram_join, queries, token_counts, warc
from lakesignal.scale import shared_folder

WORDS = [f"w{i}" for i in range(400)]


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


# --- op5 -------------------------------------------------------------------------------------------------------------


def plain_sets(rows, size):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    return out


def plain_components(sets, percent):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, links = sorted(sets), defaultdict(set)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(frozenset(sets[b]))
                links[b].add(frozenset(sets[a]))
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}, {i: len(links[i] - {frozenset(sets[i])}) for i in ids}


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two three four", "Éa b c", "éa b c"]
    for n in (5, 8, 14, 30, 80, 200):
        base = [rng.choice(WORDS) for _ in range(n)]
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.01, 0.02, 0.03, 0.05)]
        texts += [" ".join(base + base[:k]) for k in (1, n // 8)] + ["  ".join(base[:-1]).upper()]
    hot = [rng.choice(WORDS) for _ in range(60)]
    texts += [" ".join(edited(rng, hot, 0.02)) for _ in range(120)]
    return list(enumerate(texts))


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, size, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.classes(docs, size=size, percent=percent).collect()}
    sets = plain_sets(rows, size)
    roots, links = plain_components(sets, percent)
    assert {i: got[i].component_id for i in sets} == roots
    assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i].n_links for i in sets} == links


def test_clusters_in_many_blocks_equal_brute_force(spark, monkeypatch):
    """Every shared signature forms a cluster, cut into tiny blocks over several size classes."""
    monkeypatch.setattr(ngram_join, "SMALL", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 25)
    rows = corpus(11)
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()}
    sets = plain_sets(rows, 5)
    roots, links = plain_components(sets, 80)
    assert {i: got[i].component_id for i in sets} == roots and {i: got[i].n_links for i in sets} == links


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 85, 95):
        for n in [*range(1, 40), 97, 150, 300, 1000, 4001]:
            for _ in range(4):
                one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
                other = np.unique(np.concatenate([one[: len(one) - drop // 2], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
                both = len(np.intersect1d(one, other))
                if 100 * both >= percent * (len(one) + len(other) - both) and not np.array_equal(one, other):
                    a, b = (set(ngram_join.signatures(x, percent).tolist()) for x in (one, other))
                    assert a & b, (percent, n, drop)


def test_join_odd_tables(spark):
    schema = "doc_id long, text string, node long, _key string, n long"
    rows = [(7, "a b c d e f", 1, "x", 2), (7, "a b c d e f", 1, "x", 2), (None, "A b c d e f", 1, "x", 2), (9, None, 1, "x", 2), (8, "", 1, "x", 2), (3, "z", 1, "x", 2)]
    docs = spark.createDataFrame(rows, schema)
    out = [(r.doc_id, r.component_id) for r in ngram_join.classes(docs).collect()]
    assert sorted(out, key=str) == sorted([(7, 7), (7, 7), (None, 7), (9, 9), (8, 8), (3, 3)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]
    assert ngram_join.classes(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_keep_one_keeps_unlinked_rows(spark):
    """A lone null id, unrelated null ids, null copies, and one id with unrelated texts."""
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (5, "S t u v w x"), (6, "s t u v w x"), (None, "m n o p q r"), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.lower()) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a b c d e f"), (None, "g h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (None, " ")], key=str)
    assert ngram_join.keep_one(docs.where("doc_id is null")).count() == 4


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(path).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- op7 -------------------------------------------------------------------------------------------------------------


def test_substitution_tolerant_overlaps(spark):
    rng = random.Random(1)
    item = [rng.choice(WORDS) for _ in range(40)]
    other = [rng.choice(WORDS) for _ in range(30)]
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    every = lambda k: [("zz" if i % k == k - 1 else w) for i, w in enumerate(item)]
    texts = {
        1: noise(50) + item + noise(50), 2: noise(9) + every(7) + noise(9), 3: every(3), 4: noise(400), 5: item[:20], 6: item[:9] + noise(30),
        7: [w.upper() + "," for w in item], 8: other + item, 9: ["sh", "ort", "it", "em"], 10: noise(5) + ["sh", "ort", "x", "em"],
    }
    docs = [(i, " ".join(w), "k") for i, w in texts.items()] + [(None, " ".join(item), "k"), (11, None, "k"), (12, "", "k"), (1, " ".join(texts[1]), "k")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, _key string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "Sh-ort: it em"), (4, None), (5, "a b"), (6, " ".join(item))], "item_id long, text string")
    for rows in (10**6, 0):
        found = decontaminate.contaminated(docs, items, broadcast_rows=rows)
        got = sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str)
        assert got == sorted([(d, i) for d in (None, 1, 2, 5, 7, 8) for i in (1, 6)] + [(8, 2), (9, 3)], key=str)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 10, 11, 12]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def stretch(bits, cost=2):
    """(points, the slice) of the best stretch."""
    best = (0, "")
    for i in range(len(bits)):
        run = 0
        for j in range(i, len(bits)):
            run += 1 if bits[j] == "1" else -cost
            best = max(best, (run, bits[i : j + 1]), key=lambda b: b[0])
    return best


def hit(masks, bits):
    return any(all(b == "0" or bits[i + k] == "1" for k, b in enumerate(m)) for m in masks for i in range(len(bits) - len(m) + 1))


def test_masks_hit_every_accepted_pattern():
    """Every pattern of short items by enumeration; longer ones by the search, which is itself compared with enumeration."""
    for n in range(4, 17):
        points = min(13, -(-8 * n // 10))
        masks = decontaminate.masks_for(points, 2, n)
        for x in range(2**n):
            bits = f"{x:0{n}b}"
            if bits.count("1") >= points and stretch(bits)[0] >= points:
                assert hit(masks, bits), bits
    assert decontaminate.masks_for(13, 2) == decontaminate.MASKS and decontaminate.missed(decontaminate.MASKS, 13, 2) is None
    for masks in (("11101011011", "10111101011"), ("11111",)):
        gap = decontaminate.missed(masks, 13, 2)
        assert stretch(gap)[0] >= 13 and not hit(masks, gap)
    rng = random.Random(2)
    for _ in range(3000):
        bits = "".join("0" if rng.random() < rng.choice((0.2, 0.25, 0.3)) else "1" for _ in range(rng.randint(16, 90)))
        assert stretch(bits)[0] < 13 or hit(decontaminate.MASKS, bits), bits
    for cost in (0, 1, 3):
        assert decontaminate.missed(decontaminate.masks_for(13, cost), 13, cost) is None


def test_hard_overlaps_are_found(spark):
    """Replaced words that no pair of wide masks gets past."""
    cases = [(43, range(3, 43, 4)), (120, range(3, 120, 4)), (20, (8, 9)), (30, (6, 7, 18, 19)), (11, (0,)), (11, (10,)), (12, (0, 1)), (7, (6,)), (5, (0,)), (9, (0,)), (15, (7,)), (15, (0, 1, 2))]
    items = [(i, " ".join(f"i{i}x{k}" for k in range(n))) for i, (n, _) in enumerate(cases)]
    docs = [(i, " ".join(w if k not in set(cases[i][1]) else "zz" for k, w in enumerate(t.split()))) for i, t in items]
    docs += [(100, "q " * 30 + docs[0][1] + " q" * 30), (101, " ".join(items[8][1].split()[:2])), (102, " ".join(items[2][1].split()[:12]))]
    found = decontaminate.contaminated(*[spark.createDataFrame(t, f"{k} long, text string") for t, k in ((docs, "doc_id"), (items, "item_id"))]).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(len(cases))} | {(100, 0)}
    assert next(r for r in found if r.doc_id == 100).doc_begin == 30


def test_contained_passages_are_found(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    texts, tests = docs.select("doc_id", "text").collect(), items.collect()
    assert {(d.doc_id, t.item_id) for d in texts for t in tests if t.text in d.text} <= got


# --- op1 -------------------------------------------------------------------------------------------------------------


def test_signed_batches(spark):
    totals = token_counts.TokenTotals(spark, folder(spark, "rollup"))
    count = lambda t: len(token_counts._encoding(totals.path).encode_ordinary(t or ""))
    schema = "op string, doc_id long, source string, lang string, text string, n_tokens long"
    frame = lambda rows: spark.createDataFrame([(*r, 5) for r in rows], schema)

    def held():
        return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in totals.totals().collect()}

    first = [("insert", 1, "a", "en", "hello there world"), ("insert", 2, "a", "en", None), ("insert", 3, None, None, "x y"), ("insert", None, "a", "en", "no id"), ("insert", None, "a", "en", "no id")]
    assert totals.totals().count() == 0
    assert totals.apply("b1", frame(first))
    assert held() == {("a", "en"): (4, count("hello there world") + 2 * count("no id")), (None, None): (1, count("x y"))}
    assert not totals.apply("b1", frame(first)) and held()[(None, None)][0] == 1
    second = [("revise", 1, "b", "en", "hello"), ("delete", 3, "zz", None, None), ("delete", 77, "a", "en", None), ("delete", None, "a", "en", None), ("insert", 2, "a", "en", "p q"), ("insert", 2, "a", "en", "p q")]
    assert totals.apply("b2", frame(second))
    assert held() == {("a", "en"): (3, count("p q") + 2 * count("no id")), ("b", "en"): (1, count("hello")), (None, None): (0, 0)}
    assert totals.apply("b3", frame([]).limit(0)) and [b for _, b in totals.committed()] == ["b1", "b2", "b3"]


def test_two_tokenizers_in_one_folder(spark, tmp_path):
    """What A has counted is taken from A's totals when B revises or deletes it."""
    a = token_counts.TokenTotals(spark, folder(spark, "rollup"))
    small = tmp_path / "bytes.tiktoken"  # one token per byte
    small.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    b = token_counts.TokenTotals(spark, a.folder, str(small))
    frame = lambda rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, text string")
    a.apply("a1", frame([("insert", i, "s", "en", "hello there world") for i in (1, 2, 3)]))
    b.apply("b1", frame([("revise", 1, "s", "en", "hello"), ("delete", 2, None, None, None)]))
    one = len(token_counts._encoding(a.path).encode_ordinary("hello there world"))
    held = lambda: {r.tokenizer: (r.n_docs, r.n_tokens) for r in a.totals().collect()}
    assert held() == {a.version: (1, one), b.version: (1, 5)}
    a.apply("a2", frame([("delete", 1, None, None, None)]))
    assert held() == {a.version: (1, one), b.version: (0, 0)}


def test_the_query_goes_through_revisions(spark):
    rows = [(i, f"s{i % 3}", ("en", "de", None)[i % 3 - 1], f"text number {i} of all") for i in range(20)] + [(None, "s1", "en", "no id"), (20, "s9", "en", None)]
    where = folder(spark, "rollup")
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.loaded_totals(docs, where).collect()}
    want = defaultdict(lambda: (0, 0))
    for _, source, lang, text in rows:
        n = len(token_counts._encoding(token_counts.VOCABULARY).encode_ordinary(text or ""))
        want[source, lang] = (want[source, lang][0] + 1, want[source, lang][1] + n)
    assert got == dict(want)
    deltas = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/deltas")
    assert deltas.where("d_docs < 0").count() > 0 and deltas.where("d_tokens < 0").count() > 0


def test_a_broken_batch_is_written_again(spark):
    totals = token_counts.TokenTotals(spark, folder(spark, "rollup"))
    rows = spark.createDataFrame([("insert", 1, "a", "en", "hello")], "op string, doc_id long, source string, lang string, text string")
    # What a batch leaves that was stopped before its commit row: readers must not see it.
    spark.createDataFrame([("a", "en", totals.version, 9, 9)], token_counts.DELTA).write.parquet(f"{totals.folder}/deltas/b1")
    assert totals.totals().count() == 0
    assert totals.apply("b1", rows) and totals.totals().first().n_docs == 1


# --- op9 -------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    big, odd = "<p>" + "é" * 600 + "</p>", "\r\n\r\nWARC/1.0\r\n😀" * 90
    rows = [(1, "http://a/ x\r\ny", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", odd), (7, "u", odd), (None, "u", odd), (7, "u2", odd)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    where = folder(spark, "warc")
    index = warc.write_archive(pages, where)
    records = warc.read_records(index)
    payloads = defaultdict(list)
    for r in records.collect():
        payloads[r.page_id].append(bytes(r.payload))
    assert payloads[5] == [b""] and payloads[2] == [big.encode()] and payloads[1] == [b""] and payloads[6] == [b""]
    out = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.digest(records).collect())
    sha, n = (lambda t: hashlib.sha1((t or "").encode()).hexdigest()), (lambda t: len((t or "").encode()))
    expected = [("1", "revisit", 2, n(big), sha(big)), ("6", "revisit", 7, n(odd), sha(odd))]
    expected += [(str(i), "response", None, n(t), sha(t)) for i, t in [(2, big), (3, "small"), (4, "small"), (5, None), (7, odd), (7, odd), (None, odd)]]
    assert out == sorted(expected, key=lambda x: x)
    some = warc.read_records(index.where("page_id in (2, 4)"), gap=0, block=64).collect()
    assert sorted(r.page_id for r in some) == [2, 4]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges_coalesce_neighbours(spark):
    index = spark.createDataFrame([("f", i * 10, 10, i) for i in range(10) if i not in (4, 5, 6)], "path string, offset long, length long, page_id long")
    parts = sorted((r.begin, r.end, len(r.parts)) for r in warc.ranges(index, gap=5, block=1000).collect())
    assert parts == [(0, 40, 4), (70, 100, 3)]
    assert [(r.begin, r.end) for r in warc.ranges(index, gap=30, block=1000).collect()] == [(0, 100)]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_key", F.lit("clash"))
    ids, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pinned(stage(spark, docs, sf))
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(left) <= ids and len(left) == len(set(left)), name
        ids = set(left)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: s for i, s in plain_sets(texts, 5).items()}
    roots, _ = plain_components(sets, 80)
    assert all(i == r for i, r in roots.items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.where("round_trip").select("doc_id").collect()} == ids


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
