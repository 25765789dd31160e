"""Personal data by bootstrapped contextual extraction, with column functions and joins only.

1. Four base patterns (email, ip, card, phone) give seed entities with exact checks.
2. Every other token with a digit or an at sign is a candidate, and so is a run of neighbouring tokens of digits and
   number punctuation.  Seeds and candidates are *instances*; the two words on the left, the two on the right, or one on
   each side, together with the shape of the value, are its *patterns*, and so are two words on each side without it.
3. Confidence flows over the pattern-instance graph for a fixed number of rounds: a pattern is trusted by the share of
   its distinct instances that are trusted, an instance by the noisy-or of its patterns.
4. A pattern needs ``support`` trusted instances and ``precision``; instances at or above ``trust`` are found wherever
   a trusted pattern holds them.  Found spans are added, base spans stay.

The graph has one edge per distinct (instance, pattern), so a frequent value or a group of copies is one node; both
joins are preceded by a map-side combined aggregation, and the only wide table, the texts, is never shuffled.

Defined cases: a null text counts as empty (no span); spans depend on the text alone, so repeated rows and null or
repeated doc_ids each get their text's spans; ties between kinds go to the kind listed first; an empty table gives an
empty result; ``mask`` keeps every further column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesignal.functions.text import let
from lakesignal.llm import spans as sp
from lakesignal.llm.common import SPACE_CLASS, fresh_names, text_or_empty
from lakesignal.scale import pinned

# The base kinds in their order.  The patterns match what the plain forms in the comments match, but
# never give back characters and start at the beginning of a run, so that they stay linear in a long run.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # [0-9]([\x20-]?[0-9])+ with 14 digits or more
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = rf"(?<![^{SPACE_CLASS}])[^{SPACE_CLASS}0-9@]*+[0-9@][^{SPACE_CLASS}]*+"
# Of the tokens of a run each has a digit; no base kind has more than 19.
RUN = rf"(?<![^{SPACE_CLASS}])[+(]{{0,2}}[0-9][0-9().,:/+-]*+(?:[\x20\t]{{1,2}}[+(]{{0,2}}[0-9][0-9().,:/+-]*+){{1,18}}(?![^{SPACE_CLASS}])"

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_ok(value: Column) -> Column:
    def part_ok(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\.", -1), part_ok)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when((n - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card_ok(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def base_matches(text: Column) -> dict[str, Column]:
    """Checked matches per kind.  ``text`` must be a column, not an expression."""
    digit = text.rlike("[0-9]")
    return {
        "email": sp.find_all(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(sp.find_all(text, IP, digit), lambda m: _ip_ok(m["value"])),
        "card": F.filter(sp.find_all(text, CARD, digit), lambda m: _card_ok(m["value"])),
        "phone": F.filter(sp.find_all(text, PHONE, F.contains(text, F.lit("+"))), lambda m: F.length(_digits(m["value"])).between(10, 15)),
    }


def _trimmed(text: Column, pattern: str, gate: Column) -> Column:
    """Candidates without the punctuation around them; what is cut goes to the context."""
    core = lambda m: F.regexp_extract(m["value"], r"[\p{L}\p{N}+](?:.*[\p{L}\p{N}])?", 0)
    found = sp.find_all(text, pattern, gate)

    def cut(m: Column) -> Column:
        value = core(m)
        lead = F.instr(m["value"], value) - 1
        begin = m["start"] + lead
        return F.struct(
            begin.alias("start"),
            (begin + F.length(value)).alias("end"),
            value.alias("value"),
            F.concat(m["before"], F.left(m["value"], lead)).alias("before"),
            F.concat(F.substring(m["value"], lead + F.length(value) + 1, F.lit(sp.CONTEXT)), m["after"]).alias("after"),
        )

    return F.filter(F.transform(found, cut), lambda m: F.length(m["value"]) >= 5)


def scan(docs: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, _key, _base, _seen): one row per document, without the text.

    ``_key`` names the text, ``_base`` are its base spans, ``_seen`` the occurrences of seeds (with kind) and candidates.
    """
    step = docs.select(*[F.col(c) for c in keep], text_or_empty(text).alias("_text"))
    step = step.withColumns({f"_{kind}": found for kind, found in base_matches(F.col("_text")).items()})
    step = step.withColumn("_tokens", _trimmed(F.col("_text"), TOKEN, F.col("_text").rlike("[0-9@]")))
    step = step.withColumn("_runs", _trimmed(F.col("_text"), RUN, F.col("_text").rlike("[0-9]")))
    with_kind = lambda name, kind: F.transform(name, lambda m: m.withField("kind", F.lit(kind).cast("string")))
    return step.select(
        *keep,
        F.md5("_text").alias("_key"),
        F.array_sort(F.concat(*[sp.labelled(F.col(f"_{kind}"), i, kind) for i, kind in enumerate(KINDS)])).cast(SPAN).alias("_base"),
        F.concat(*[with_kind(f"_{kind}", kind) for kind in KINDS], with_kind("_tokens", None), with_kind("_runs", None)).alias("_seen"),
    )


def _shape(value: Column) -> Column:
    out = F.regexp_replace(value, r"\p{L}+", "a")
    out = F.regexp_replace(out, r"[0-9]+", "9")
    return F.left(F.regexp_replace(out, r"([^a9])\1+", "$1"), F.lit(24))


def occurrences(scanned: DataFrame) -> DataFrame:
    """(_key, start, end, value, kind, pattern): each occurrence with each of its patterns.

    Copies of a text have the same occurrences; they are combined before the shuffle.
    """
    seen = scanned.where(F.size("_seen") > 0).select("_key", F.explode("_seen").alias("m")).select("_key", "m.*")
    seen = seen.groupBy("_key", "start", "end", "value").agg(F.max("kind").alias("kind"), F.first("before").alias("before"), F.first("after").alias("after"))

    def words(side: Column) -> Column:
        masked = F.regexp_replace(F.lower(side), "[0-9]", "0")
        return F.filter(F.split(masked, f"[{SPACE_CLASS}]+", -1), lambda w: w != "")

    seen = seen.withColumn("_l", words(F.col("before"))).withColumn("_r", words(F.col("after"))).withColumn("_s", _shape(F.col("value")))
    at = lambda side, i: F.coalesce(F.try_element_at(side, F.lit(i)), F.lit("^"))
    forms = F.array(
        F.concat_ws(" ", F.lit("LL"), at("_l", -2), at("_l", -1), "_s"),
        F.concat_ws(" ", F.lit("LR"), at("_l", -1), at("_r", 1), "_s"),
        F.concat_ws(" ", F.lit("RR"), at("_r", 1), at("_r", 2), "_s"),
    )
    around = F.concat_ws(" ", F.lit("LLRR"), at("_l", -2), at("_l", -1), at("_r", 1), at("_r", 2))
    forms = F.concat(forms, F.when((F.size("_l") > 0) & (F.size("_r") > 0), F.array(around)).otherwise(F.array().cast("array<string>")))
    return seen.select("_key", "start", "end", "value", "kind", F.explode(forms).alias("pattern"))


def bootstrap(seen: DataFrame, rounds: int = 3, support: int = 3, precision: float = 0.6, trust: float = 0.8) -> DataFrame:
    """(value, pattern, kind): trusted instances with the trusted patterns that vouch for them.

    ``seen`` comes from ``occurrences`` and should be a written table: each round reads it.
    """
    edges = pinned(seen.groupBy("value", "pattern").agg(F.max("kind").alias("seed")))
    seeds = edges.where(F.col("seed").isNotNull()).groupBy("value").agg(F.max("seed").alias("seed"))
    # Only patterns that some seed induces can ever be trusted in the first round; later rounds widen them.
    conf = seeds.select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("conf"))
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    links = edges.select("value", "pattern")
    trusted = None
    for _ in range(rounds):
        mass = links.join(conf, "value").groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"))
        trusted = (
            mass.where(F.col("mass") >= support)
            .join(degree, "pattern")
            .withColumn("score", F.col("mass") / F.col("n"))
            .where(F.col("score") >= precision)
            .select("pattern", "kind", "score")
        )
        trusted = pinned(trusted)
        grown = (
            links.join(trusted, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))).alias("conf"))
            .join(seeds.select("value"), "value", "left_anti")
            .where(F.col("conf") >= trust)
        )
        best = grown.groupBy("value").agg(F.max(F.struct("conf", *[(F.col("kind") == k).alias(k) for k in KINDS], "kind")).alias("b"))
        conf = pinned(best.select("value", "b.kind", "b.conf").unionByName(seeds.select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("conf"))))
    new = conf.join(seeds.select("value"), "value", "left_anti").select("value", "kind")
    return links.join(trusted, "pattern").join(new, ["value", "kind"]).select("value", "pattern", "kind")


def added_spans(seen: DataFrame, **how) -> DataFrame:
    """(_key, _added): the spans that the method adds to each text that gets any."""
    found = bootstrap(seen, **how)
    hits = seen.where(F.col("kind").isNull()).select("_key", "start", "end", "value", "pattern").join(found, ["value", "pattern"])
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    spans = F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).cast(SPAN)  # a set of one text's candidates
    # A token of a run that is found itself is part of it.
    inside = lambda s, o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    whole = lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: inside(s, o)))
    return hits.groupBy("_key").agg(spans.alias("_found")).select("_key", F.array_sort(whole(F.col("_found"))).cast(SPAN).alias("_added"))


def _with_added(scanned: DataFrame, **how) -> DataFrame:
    added = added_spans(pinned(occurrences(scanned)), **how)
    out = scanned.join(added, "_key", "left").withColumn("_added", F.coalesce("_added", F.array().cast(SPAN)))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumn("_all", F.array_sort(F.concat("_base", F.filter("_added", free))))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of every document, as arrays of (start, rank, end, kind)."""
    scanned = pinned(scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]))
    return _with_added(scanned, **how).select("doc_id", F.col("_base").alias("base"), F.col("_all").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[n(kind) for kind in KINDS],
        F.sha2(sp.joined(F.col("base")), 256).alias("base_sha256"),
        sp.joined(F.col("spans")).alias("spans"),
    )


def mask(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; all columns are kept.

    Texts are joined to their spans by a digest of the text.  A table of spans is sent to the tasks only if Spark's own
    size check allows it.
    """
    key, spans, plain = fresh_names(docs.columns, "_key", "_spans", "_plain")
    scanned = pinned(scan(docs, text).where(F.size("_seen") > 0))
    per_text = _with_added(scanned, **how).where(F.size("_all") > 0).groupBy("_key").agg(F.first("_all").alias(spans)).withColumnRenamed("_key", key)
    out = docs.withColumn(plain, text_or_empty(text)).withColumn(key, F.md5(plain)).join(per_text, key, "left")
    disjoint = sp.merged(F.col(spans))
    label = lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    new = F.when(F.col(spans).isNull(), F.col(text)).otherwise(let(disjoint, lambda s: sp.masked(F.col(plain), s, label)))
    return out.withColumn(text, new).select(*docs.columns)
