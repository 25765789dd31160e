"""Spans of regular expressions in a text, with column functions only.

``split`` and ``regexp_extract_all`` cut a text into the pieces around the leftmost non-overlapping matches and into
the matches themselves; running lengths give the positions in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesignal.functions.text import let

MATCH = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Code points by which a context word is told: of a longer one those next to the match.
CONTEXT = 64
_GAP = r"[\x20\x09-\x0D]+"


def _left_words(text: Column) -> Column:
    """The end of ``text`` from its third last word on; a blank stands for white space."""
    near = lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), 3)
    return F.array_join(F.transform(let(F.split(text, _GAP, -1), near), lambda w: F.right(w, F.lit(CONTEXT))), " ")


def _right_words(text: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.split(text, _GAP, -1), 1, 3), lambda w: F.left(w, F.lit(CONTEXT))), " ")


def find_all(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All matches of ``pattern`` as ``MATCH``; an empty array where there are none.

    ``gate``: a cheap condition without which no match is possible.  ``before`` and ``after`` hold the words of the text
    around the match, other matches among them: two whole ones and what adjoins the match.
    """

    def positions(parts: Column) -> Column:
        pieces, found = parts["pieces"], parts["found"]
        zipped = F.arrays_zip(
            found.alias("value"),
            pieces.alias("before"),
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("after"),
        )
        none = F.from_json(F.lit("[]"), MATCH)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["before"])
            end = begin + F.length(x["value"])

            def row(left: Column) -> Column:
                match = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), left.alias("before"), x["after"].alias("after"))
                return F.struct(end.alias("at"), F.concat(left, x["value"]).alias("left"), F.concat(acc["out"], F.array(match)).alias("out"))

            return let(_left_words(F.concat(acc["left"], x["before"])), row)

        def back(acc: Column, m: Column) -> Column:
            """From the last match to the first, as what follows a match reaches into later ones."""
            row = lambda right: F.struct(F.concat(m["value"], right).alias("right"), F.concat(acc["out"], F.array(m.withField("after", right))).alias("out"))
            return let(_right_words(F.concat(m["after"], acc["right"])), row)

        matched = F.slice(zipped, 1, F.greatest(F.size(found), F.lit(0)))
        forward = F.aggregate(matched, start, step, lambda acc: acc["out"])
        both = F.aggregate(F.reverse(forward), F.struct(F.lit("").alias("right"), none.alias("out")), back, lambda acc: F.reverse(acc["out"]))
        return F.when(F.size(found) > 0, both).otherwise(none)

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    out = let(parts, positions)
    return out if gate is None else F.when(gate, out).otherwise(F.from_json(F.lit("[]"), MATCH))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def labelled(found: Column, order: int, kind: str) -> Column:
    """Spans with the fields start, rank, end and kind: their natural order is by start, then kind as listed."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def merged(spans: Column) -> Column:
    """Sorted, possibly overlapping spans as disjoint ones; a union keeps the kind of its first span."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        row = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(row)))

    return F.aggregate(spans, F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string>>"), step)


def masked(text: Column, spans: Column, label) -> Column:
    """``text`` with each of the disjoint sorted spans replaced by ``label(kind)``."""

    def build(parts: Column) -> Column:
        t, s = parts["t"], parts["s"]
        step = lambda acc, x: F.struct(
            F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), label(x["kind"])).alias("out"), x["end"].alias("at")
        )
        done = F.aggregate(s, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
        return let(done, lambda d: F.concat(d["out"], F.substring(t, d["at"] + 1, F.length(t))))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), spans.alias("s")), build)).otherwise(text)
