"""Request traces: retrieval entries, claims checked against evidence, scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.text import let
from lakesignal.functions.vectors import cosine_from_parts, dot, norm
from lakesignal.operators.chunking import sentences
from lakesignal.operators.tfidf import document_frequencies, tokens
from lakesignal.scale import pinned, salted_lookup

SUPPORTED, PARTIAL = 0.55, 0.35
#: Requests or claims of a scope in one array, about; and the frequent terms whose idf every task knows.
TOGETHER, KNOWN_TERMS = 64, 1 << 17


def retrieval_entries(hits: Column, cited: Column) -> Column:
    """Trace entries from hits array<struct<chunk_index, heading, text, distance>> and the cited chunk indexes."""
    return F.transform(
        hits,
        lambda h, i: F.struct(
            (i + 1).alias("rank"),
            h["chunk_index"].alias("chunk_index"),
            F.nullif(h["heading"], F.lit("")).alias("heading"),
            F.concat(F.left(h["text"], F.lit(200)), F.when(F.length(h["text"]) > 200, "…").otherwise("")).alias("text_preview"),
            F.round(h["distance"], 4).alias("distance"),
            F.round(F.greatest(F.lit(0.0), 1.0 - h["distance"]), 4).alias("similarity"),
            F.array_contains(cited, h["chunk_index"]).alias("cited"),
        ),
    )


def answer_claims(answers: DataFrame, keys: Sequence[str] = ("trace_id",), answer: str = "answer") -> DataFrame:
    """Sentences of grounded answers, one row per claim."""
    return answers.where("grounded").select(*keys, F.posexplode(sentences(F.col(answer))).alias("claim_no", "claim"))


def evidence_sentences(evidence: DataFrame, keys: Sequence[str] = ("trace_id",), text: str = "text", scope: Sequence[str] | None = None) -> DataFrame:
    """Sentences of evidence chunks; a chunk without any counts as one whole sentence.

    With ``scope`` a chunk stays one row, its sentences an array.
    """
    parts = sentences(F.col(text))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text)))
    if scope is not None:
        return evidence.select(*scope, "_part", "_parts", "chunk_index", "requests", parts.alias("sentences"))
    return evidence.select(*keys, "chunk_index", F.posexplode(parts).alias("sentence_no", "sentence"))


def _dealt(rows: DataFrame, scope: Sequence[str], hashed: Column, kept: Column, name: str) -> DataFrame:
    """(scope, _part, _parts, name): ``kept`` of a scope's rows in arrays of about ``TOGETHER``, dealt by ``hashed``.

    The number of parts is a power of two and every part has a row, so that two tables dealt alike meet part by part.
    """
    n = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / TOGETHER))).cast("int")
    sizes = rows.groupBy(*scope).agg(F.pow(F.lit(2), n).cast("int").alias("_parts"))
    held = rows.select(*scope, hashed.alias("_h"), kept.alias("_kept")).join(sizes, list(scope))
    held = held.select(*scope, F.pmod("_h", "_parts").cast("int").alias("_part"), "_parts", "_kept")
    empty = sizes.select(*scope, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_parts", F.lit(None).cast(held.schema["_kept"].dataType).alias("_kept"))
    return held.unionByName(empty).groupBy(*scope, "_part", "_parts").agg(F.collect_list("_kept").alias(name)).hint("shuffle_hash")


def evidence_of(answers: DataFrame, hits: DataFrame, keys: Sequence[str] = ("trace_id",), scope: Sequence[str] | None = None) -> DataFrame:
    """Cited chunks of each answer, or all retrieved ones where none is cited.

    ``hits``: keys, rank, chunk_index, text; ``answers`` carries ``cited`` ranks.  With ``scope`` (some of the keys) every
    answer got all hits (scope, rank, chunk_index, text) of its scope: a chunk is one row with an array of the ``requests``
    that it is evidence for, so its text is not repeated for each of them.
    """
    if scope is not None:
        rest = [k for k in keys if k not in scope]
        asked = answers.select(*keys).join(answers.select(*keys, "cited"), list(keys))
        asked = _dealt(asked, scope, F.xxhash64(*rest), F.struct(*rest, "cited"), "_asked")
        uses = F.filter("_asked", lambda a: (F.size(a["cited"]) == 0) | F.array_contains(a["cited"], F.col("rank").cast("bigint")))
        requests = F.transform(uses, lambda a: F.struct(*[a[k].alias(k) for k in rest]))
        found = hits.join(asked, list(scope)).select(*scope, "_part", "_parts", "chunk_index", "text", requests.alias("requests"))
        return found.where(F.size("requests") > 0)
    joined = hits.join(answers.select(*keys, "cited"), list(keys))
    return joined.where((F.size("cited") == 0) | F.array_contains("cited", F.col("rank").cast("bigint"))).drop("cited")


def support_status(similarity: Column) -> Column:
    return F.when(similarity >= SUPPORTED, "supported").when(similarity >= PARTIAL, "partial").otherwise("unsupported")


def _best(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest similarity, first sentence in evidence order on ties."""
    order = F.struct(F.round("similarity", 12).alias("s"), (-F.col("chunk_index")).alias("c"), (-F.col("sentence_no")).alias("n"))
    return pairs.groupBy(*keys, "claim_no").agg(F.max(F.struct(order.alias("o"), F.col("similarity"), F.col("sentence"), F.col("chunk_index"))).alias("b"))


def _finish(claims: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    sim = F.coalesce(F.col("b.similarity"), F.lit(0.0))
    return claims.join(best, [*keys, "claim_no"], "left").select(
        *keys,
        "claim_no",
        "claim",
        support_status(sim).alias("status"),
        F.greatest(sim, F.lit(0.0)).alias("best_similarity"),
        F.col("b.chunk_index").alias("best_evidence_chunk_index"),
        F.col("b.sentence").alias("best_evidence_preview"),
    )


def verify_claims(claims: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Each claim against the evidence sentences of its own request, by cosine of the given ``vector`` columns."""
    c = claims.select(*keys, "claim_no", F.col("vector").alias("_cv"), norm(F.col("vector")).alias("_cn"))
    e = evidence.select(*keys, "chunk_index", "sentence_no", "sentence", F.col("vector").alias("_ev"), norm(F.col("vector")).alias("_en"))
    pairs = salted_lookup(c, e, keys, 4)
    pairs = pairs.withColumn("similarity", cosine_from_parts(dot(F.col("_cv"), F.col("_ev")), F.col("_cn"), F.col("_en")))
    return _finish(claims, _best(pairs, keys), keys)


def _counted(words: str) -> Column:
    """Each distinct word of an array with its number, as structs (term, tf), without leaving the row."""

    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)))
        stop = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (stop(at, k) - i).alias("tf"))))

    return let(F.sort_array(words), runs)


def _line(text: Column) -> Column:
    """The tokens of a text, and shorter runs, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many sentences of a batch a term occurs, times the requests that they serve."""
    for batch in batches:
        rows, uses = batch.column("lines"), batch.column("uses").to_pylist()
        lines, at = rows.values.to_pylist(), rows.offsets.to_pylist()
        found: dict[int, Counter] = {}
        for i, n in enumerate(uses):
            counter = found.setdefault(n, Counter())
            for line in lines[at[i] : at[i + 1]]:
                if line:
                    counter.update(set(line.split(" ")))
        counts = [(t, n * times) for n, counter in found.items() for t, times in counter.items() if len(t) > 1]
        yield pa.record_batch([pa.array([t for t, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int64())], ["term", "n"])


def _closest(squares: dict[str, float], low: float, high: float, names: Sequence[str]):
    """For each row's claims the sentences that may be the most similar one.

    ``squares`` has idf * idf of the frequent terms; of the others it lies between ``low`` and ``high``.  A sentence stays
    if it can reach what another one has at least; its terms outside ``squares`` go with it, so that it is scored exactly.
    """
    loose_type = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("asked", pa.int32())]))
    margin = 1 - 1e-8  # similarities are compared by twelve digits

    def of_row(lines: list, claims: list[dict[str, int]]) -> Iterator[tuple]:
        known: dict[str, list] = {}
        rare: dict[str, list] = {}
        for c, words in enumerate(claims):
            for term, tf in words.items():
                square = squares.get(term)
                if square is None:
                    rare.setdefault(term, []).append((c, tf))
                else:
                    known.setdefault(term, []).append((c, tf * square))
        asked = known.keys() | rare.keys()
        least, kept, seen = [0.0] * len(claims), [[] for _ in claims], set()
        for s, line in enumerate(lines):
            if not line or line in seen:  # of equal sentences the first counts
                continue
            seen.add(line)
            terms = line.split(" ")
            shared = asked.intersection(terms)
            if not shared:
                continue
            ones = list(map(squares.get, terms))
            times, loose, spread = None, [], 0
            if len(set(terms)) == len(terms) and None not in ones:
                square = sum(ones)
            else:
                times, square = Counter(terms), 0.0
                for term, tf in times.items():
                    one = squares.get(term)
                    if one is not None:
                        square += tf * tf * one
                    elif len(term) > 1:
                        loose.append((term, tf))
                        spread += tf * tf
            dots: dict[int, float] = {}
            doubt: dict[int, int] = {}
            for term in shared:
                tf = times[term] if times else 1
                if term in known:
                    for c, weight in known[term]:
                        dots[c] = dots.get(c, 0.0) + tf * weight
                else:
                    for c, n in rare[term]:
                        doubt[c] = doubt.get(c, 0) + tf * n
            longest, shortest = math.sqrt(square + high * spread), math.sqrt(square + low * spread)
            for c in dots.keys() | doubt.keys() if doubt else dots:
                dot, more = dots.get(c, 0.0), doubt.get(c, 0)
                most = (dot + high * more) / shortest
                if most >= least[c] * margin:
                    kept[c].append((most, s, dot, square, loose))
                    least[c] = max(least[c], (dot + low * more) / longest)
        for c, words in enumerate(claims):
            own = [(t, n) for t, n in words.items() if t not in squares]
            length = sum(n * n * squares[t] for t, n in words.items() if t in squares)
            if not kept[c]:
                yield c, None, 0.0, 1.0, length, []
            for most, s, dot, square, loose in kept[c]:
                if most >= least[c] * margin:
                    held = {t for t, _ in loose}
                    both = [{"term": t, "tf": n, "asked": words.get(t, 0)} for t, n in loose]
                    yield c, s, dot, square, length, both + [{"term": t, "tf": 0, "asked": n} for t, n in own if t not in held]

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column
            lines, at = col("lines").values.to_pylist(), col("lines").offsets.to_pylist()
            claims, of = col("claims").values, col("claims").offsets.to_pylist()
            words, place = claims.field("words"), claims.field("words").offsets.to_pylist()
            terms, tfs = words.values.field("term").to_pylist(), words.values.field("tf").to_pylist()
            found = []
            for i in range(batch.num_rows):
                own = [dict(zip(terms[place[j] : place[j + 1]], tfs[place[j] : place[j + 1]], strict=True)) for j in range(of[i], of[i + 1])]
                found.extend((i, of[i] + c, *rest) for c, *rest in of_row(lines[at[i] : at[i + 1]], own))
            row, claim, nth, dot, square, length, loose = map(list, zip(*found, strict=True)) if found else [[] for _ in range(7)]
            row, claim = pa.array(row, pa.int64()), pa.array(claim, pa.int64())
            sentence = pa.array([None if s is None else at[i] + s for (i, _, s, *_) in found], pa.int64())
            key = claims.field("key")
            number = pa.compute.coalesce(col("numbers").values.take(sentence), col("first_no").take(row))
            text = pa.compute.if_else(sentence.is_null(), col("first").take(row), col("sentences").values.take(sentence))
            numbers = [pa.array(x, pa.float64()) for x in (dot, square, length)]
            yield pa.record_batch(
                [*[key.field(n).take(claim) for n in names], col("chunk_index").take(row), number, text, *numbers, pa.array(loose, loose_type)],
                [*names, "chunk_index", "sentence_no", "sentence", "dot", "square", "length", "loose"],
            )

    return closest


def verify_claims_lexical(claims: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("trace_id",), salts: int = 1, scope: Sequence[str] | None = None) -> DataFrame:
    """The same with TF-IDF vectors fitted on all claims and sentences; only pairs that share a term are formed.

    A claim that shares no term with its evidence gets similarity 0 and the first evidence sentence.  With ``scope`` the
    evidence is what ``evidence_of`` and ``evidence_sentences`` give for it: chunks with the requests that they serve.

    Claims meet their evidence once, in rows of a chunk.  All else reads these rows where they lie: the document
    frequencies are counted per batch, and of the sentences only those leave that may be a claim's best.
    """
    keys = list(keys)
    names = [*keys, "claim_no"]
    of_claim = F.flatten(F.collect_list(tokens(F.col("claim"))))  # copies of a claim's place count as one text
    asked = pinned(claims.groupBy(*names).agg(_counted(of_claim).alias("words")))
    kept = F.struct(F.struct(*names).alias("key"), "words")
    claims_of = lambda scope: _dealt(asked, scope, F.xxhash64(*([k for k in keys if k not in scope] or ["claim_no"])), kept, "claims")
    if scope is None:
        held = pinned(_plain(evidence, keys, claims_of(keys)))
        n_docs = evidence.agg(F.count(F.lit(1)).alias("n"))
    else:
        held = pinned(_shared(evidence, keys, claims_of(scope), list(scope)))
        n_docs = held.agg(F.sum("copies").alias("n"))
        place = [*scope, "_part", "_c", "chunk_index"]
        torn = pinned(held.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
        held, whole = held.join(torn, place, "left_anti").select(*_ROW), held
        if torn.limit(1).count():  # such chunks are taken apart, as their sentences are one text with those of their copies
            apart = whole.join(torn, place, "left_semi").select(*scope, "chunk_index", F.explode("requests").alias("_r"), "sentences")
            apart = apart.select(*[F.col(k) if k in scope else F.col(f"_r.{k}").alias(k) for k in keys], "chunk_index", F.posexplode("sentences").alias("sentence_no", "sentence"))
            held = pinned(held.unionByName(_plain(apart, keys, claims_of(keys))))
    n_docs = n_docs.unionAll(claims.agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("n_docs"))
    parts = held.where("uses > 0").select("lines", "uses").mapInArrow(_term_counts, "term string, n long")
    parts = parts.unionByName(asked.select(F.explode("words.term").alias("term"), F.lit(1).cast("long").alias("n")))
    idf = pinned(document_frequencies(parts, n_docs, F.col("n")))
    frequent = idf.orderBy("idf", "term").limit(KNOWN_TERMS).collect()
    low = frequent[-1]["idf"] if frequent else 1.0
    high = idf.agg(F.max("idf")).head()[0] or 1.0
    closest = _closest({r["term"]: r["idf"] ** 2 for r in frequent}, low**2, high**2, names)
    types = dict(asked.dtypes) | dict(held.dtypes)
    schema = "".join(f"`{n}` {types[n]}, " for n in [*names, "chunk_index"])
    rows = held.where(F.size("claims") > 0).select(*_ROW, F.col("numbers")[0].alias("first_no"))
    found = pinned(rows.mapInArrow(closest, schema + "sentence_no int, sentence string, dot double, square double, length double, loose array<struct<term:string,tf:int,asked:int>>"))
    # the terms that not every task knew
    at = [*names, "chunk_index", "sentence_no"]
    sums = [*at, "dot", "square", "length"]
    rare = salted_lookup(found.select(*sums, F.explode("loose").alias("l")).select(*sums, "l.*"), idf, ["term"], salts)
    two = F.col("idf") * F.col("idf")
    more = {"dot": F.col("tf") * F.col("asked") * two, "square": F.col("tf") * F.col("tf") * two, "length": F.col("asked") * F.col("asked") * two}
    exact = rare.groupBy(*at).agg(*[(F.max(c) + F.sum(x)).alias(c) for c, x in more.items()])
    scored = found.where(F.size("loose") == 0).select(*sums).unionByName(exact)
    scored = scored.withColumn("similarity", F.when(F.col("dot") > 0, F.col("dot") / (F.sqrt("length") * F.sqrt("square"))).otherwise(0.0))
    # the best place of a claim is found without texts, then its sentence is fetched
    places = _best(scored.withColumn("sentence", F.lit(None).cast("string")), keys)
    places = pinned(places.select(*names, "b.similarity", "b.chunk_index", (-F.col("b.o.n")).alias("sentence_no")))
    return _finish(claims, _best(places.join(found.select(*at, "sentence"), at), keys), keys)


#: A chunk with its sentences' numbers, texts and lines of tokens, the claims that it is evidence for, and for how many
#: requests its terms count.
_ROW = ["chunk_index", "numbers", "sentences", "lines", "first", "claims", "uses"]


def _claims_or_none(claims: DataFrame) -> Column:
    return F.coalesce("claims", F.array().cast(claims.schema["claims"].dataType))


def _plain(evidence: DataFrame, keys: list[str], claims: DataFrame) -> DataFrame:
    """Rows (keys, chunk_index, sentence_no, sentence) with their claims; copies of a sentence's place count as one text."""
    at = [*keys, "chunk_index", "sentence_no"]
    places = evidence.groupBy(*at).agg(F.max("sentence").alias("sentence"), F.min("sentence").alias("first"), F.array_join(F.collect_list("sentence"), " ").alias("every"))
    chunks = places.groupBy(*keys, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence", "first", "every"))).alias("s"))
    each = lambda name, f=lambda x: x: F.transform("s", lambda x: f(x[name]))
    return chunks.join(claims, keys, "left").select(
        "chunk_index",
        each("sentence_no").alias("numbers"),
        each("sentence").alias("sentences"),
        each("every", _line).alias("lines"),
        F.col("s")[0]["first"].alias("first"),
        _claims_or_none(claims).alias("claims"),
        F.when(F.coalesce("_part", F.lit(0)) == 0, 1).otherwise(0).alias("uses"),  # a chunk's terms count with the first part of its claims
    )


def _shared(evidence: DataFrame, keys: list[str], claims: DataFrame, scope: list[str]) -> DataFrame:
    """Chunks that serve several requests of their scope, in parts that have some requests and all their claims."""
    rest = [k for k in keys if k not in scope]
    dealt = claims.withColumnsRenamed({"_part": "_c", "_parts": "_cs"})
    # both sides are dealt by one hash to powers of two; told apart after the join by scope, which texts are dealt for once
    meet = F.col("_cs").isNull() | (F.pmod(F.col("_part") - F.col("_c"), F.least("_parts", "_cs")) == 0)
    own = F.filter("requests", lambda r: F.pmod(F.xxhash64(*[r[k] for k in rest]), F.col("_cs")) == F.col("_c"))
    held = evidence.join(dealt, scope, "left").where(meet).withColumn("requests", F.when(F.col("_cs") > 1, own).otherwise(F.col("requests")))
    asked = F.filter("claims", lambda c: F.exists("requests", lambda r: F.forall(F.array(*[r[k] == c["key"][k] for k in rest]), lambda x: x)))
    return held.where(F.size("requests") > 0).select(
        *scope,
        "_part",
        F.coalesce("_c", F.lit(0)).alias("_c"),
        "chunk_index",
        "requests",
        F.sequence(F.lit(0), F.size("sentences") - 1).alias("numbers"),
        "sentences",
        F.transform("sentences", _line).alias("lines"),
        F.col("sentences")[0].alias("first"),
        F.coalesce(asked, _claims_or_none(claims)).alias("claims"),
        F.size(F.array_distinct("requests")).alias("uses"),
        (F.size("requests") * F.size("sentences")).cast("long").alias("copies"),
    )


def grounding_scores(verified: DataFrame, keys: Sequence[str] = ("trace_id",), every: DataFrame | None = None) -> DataFrame:
    """Mean support of an answer's claims: 1 supported, 0.5 partial, 0 unsupported.

    With ``every`` (a table of the keys) an answer without claims has a row with a null score and no claims.
    """
    weight = F.when(F.col("status") == "supported", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    scores = verified.groupBy(*keys).agg(F.avg(weight).alias("grounding_score"), F.count(F.lit(1)).alias("n_claims"))
    if every is None:
        return scores
    return every.select(*keys).distinct().join(scores, list(keys), "left").fillna(0, ["n_claims"])
