"""Secrets by assignment-aware lexing.

A small lexer reads ``name = literal``, ``name: literal``, ``name => literal``, ``name := literal``, ``name: type =
literal`` and ``table["name"] = literal`` from source and configuration text.  The right side may join string literals and earlier names with ``+``, and ``${name}`` or a bare
name refers to a constant, the last one above or else the first one below, so a value reaches its sensitive name through any number of assignments.  A literal
is reported when the name that it finally reaches is sensitive enough and the literal looks like a credential.  Three
base patterns (assign, access, hex) are always reported; the lexer's findings are added where they overlap none.

Every text is lexed alone in one pass, so the job has no shuffle and a lost task repeats itself exactly.

Defined cases: a null text counts as empty (no span); repeated rows and null doc_ids each get a row; an assignment to a
name replaces its earlier constant; constants that refer to each other in a circle stay names; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base kinds in their order and their patterns, with the least length built into the repeat counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "secret": 3.0, "apikey": 3.0, "token": 2.5, "credential": 2.5,
    "credentials": 2.5, "bearer": 2.5, "private": 1.5, "key": 1.5, "auth": 1.5, "signature": 1.5, "access": 1.0, "api": 1.0,
}
PLACEHOLDER = re.compile(r"(?i)x{3,}|\*{3,}|change.?me|example|placeholder|your[_-]|dummy|<.*>|true|false|null|none")

_TYPE = r"""[A-Za-z_][\w.]*+(?:\[[\w.,|\[\]\x20]{0,60}+|<[\w.,|<>\[\]\x20]{0,60}+)?[?!]?(?:\x20?\|\x20?[A-Za-z_][\w.]*+){0,4}"""
_TARGET = re.compile(r"""(?<![\w.$-])["']?([A-Za-z_][\w.$-]*+)(?:["'](?:[\x20\t]*+\])?)?[\x20\t]*+(?::=|=>|=(?![=~>])|:[\x20\t]*+(%s)[\x20\t]*+=(?![=~>])|:(?![:/]))[\x20\t]*+""" % _TYPE, re.ASCII)
_TERM = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|\$\{([A-Za-z_][\w.]*+)\}|([A-Za-z_][\w.]*+)(?![\w@/+=-])|([^\s"'#;,{}()\[\]+]++)""", re.ASCII)
_JOIN = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
#: The characters of a random string: 20 or more of these, of all kinds, are enough for a name that says little.
_RANDOM_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0) + (0.5 if len({p for p in parts if p in SENSITIVE}) > 1 else 0.0)


#: The longest text that a placeholder pattern is tried on; longer values can only be runs or bracketed.
SHORT = 64
#: Lengths from which on the numbers of characters are halved together: entropy stays, numbers stay small.
LONG = 1 << 60


class Value:
    """What is known of a string without holding it: length, characters, ends, and the text while it is SHORT."""

    __slots__ = ("n", "chars", "text", "first", "last")

    def __init__(self, n: int, chars: Counter, text: str | None, first: str, last: str):
        self.n, self.chars, self.text, self.first, self.last = n, chars, text, first, last

    @classmethod
    def of(cls, text: str) -> Value:
        return cls(len(text), Counter(text), text if len(text) <= SHORT else None, text[:1], text[-1:])

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        n, chars = sum(p.n for p in parts), Counter()
        for p in parts:
            chars.update(p.chars)
        text = "".join(p.text for p in parts) if n <= SHORT and all(p.text is not None for p in parts) else None
        if n > LONG:
            shift = n.bit_length() - LONG.bit_length()
            chars = Counter({c: max(1, k >> shift) for c, k in chars.items()})
            n = chars.total()
        return cls(n, chars, text, next((p.first for p in parts if p.n), ""), next((p.last for p in reversed(parts) if p.n), ""))

    def placeholder(self) -> bool:
        if self.text is not None:
            return bool(PLACEHOLDER.fullmatch(self.text))
        letters = set(self.chars)
        return letters <= {"x", "X"} or letters == {"*"} or self.first == "<" and self.last == ">" and "\n" not in letters


def literal_weight(value: Value) -> float:
    letters = value.chars
    if value.n < 8 or value.placeholder() or any(c.isspace() for c in letters):
        return -3.0
    n = value.n
    entropy = -sum(c / n * math.log2(c / n) for c in letters.values())
    mixed = any(c.isdigit() for c in letters) + any(c.isalpha() for c in letters) + any(not c.isalnum() for c in letters)
    usual = n >= 20 and all(c in _RANDOM_CHARS for c in letters) and any("a" <= c <= "z" for c in letters) and any("A" <= c <= "Z" for c in letters) and any("0" <= c <= "9" for c in letters)
    return (1.0 if entropy >= 3 else 0.0) + (0.5 if mixed >= 2 else 0.0) + (0.5 if n >= 16 else 0.0) + (1.0 if entropy >= 4 and usual else 0.0)


def _parsed(text: str) -> list[tuple[str, list[tuple[str | None, str, tuple[int, int] | None]]]]:
    """(name, terms) of each assignment in order; a term is (name referred to, its own text, its span)."""
    out = []
    for target in _TARGET.finditer(text):
        at, terms = target.end(), []
        while term := _TERM.match(text, at):
            at = term.end()
            group = next(g for g in (1, 2, 3, 4, 5) if term[g] is not None)
            if group == 3:
                terms.append((term[3], "", None))
            else:
                terms.append((term[4], term[group], term.span(group)))
            join = _JOIN.match(text, at)
            if not join:
                break
            at = join.end()
        if terms:
            out.append((target[1], terms))
            if target[2]:  # what stands where a type would may be a name itself
                out.append((target[2], terms))
    return out


def reported(text: str, least: float) -> set[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name with a score of ``least`` or more.

    Constants are put in as ``Value`` summaries, never as texts, and a summary is forgotten after its last use; the
    literals behind a reported name are looked up once each.  So time and memory grow with the text, not with what its
    constants would expand to.
    """
    parsed = _parsed(text)
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(parsed):
        places.setdefault(name, []).append(i)

    def source(name: str | None, i: int) -> int | None:
        """The assignment that a reference in the i-th one means: the last one above, or else the first one below."""
        those = places.get(name, ())
        above = bisect_left(those, i)
        if above:
            return those[above - 1]
        below = bisect_right(those, i)
        return those[below] if below < len(those) else None

    sources = [[source(ref, i) for ref, _, _ in terms] for i, (_, terms) in enumerate(parsed)]
    uses = Counter(j for those in sources for j in those if j is not None)
    values: dict[int, Value] = {}
    links: list[list[int] | None] = [None] * len(parsed)  # the assignments that each one really takes in
    literals: list[list[tuple[int, int]]] = [[] for _ in parsed]
    begun = [False] * len(parsed)
    found: set[tuple[int, int]] = set()
    seen: set[int] = set()

    def finish(i: int) -> None:
        name, terms = parsed[i]
        parts, into = [], []
        for (_, own, span), j in zip(terms, sources[i]):
            if j is not None and links[j] is not None:
                parts.append(values[j])
                into.append(j)
            elif span:  # a literal, or a name that refers to nothing or back to itself
                parts.append(Value.of(own))
                literals[i].append(span)
        links[i] = into
        known = bool(literals[i] or into)
        value = Value.joined(parts) if parts else Value.of("")
        for j in sources[i]:
            if j is not None:
                uses[j] -= 1
                if not uses[j]:
                    values.pop(j, None)
        if uses[i]:
            values[i] = value
        weight = name_weight(name)
        if known and weight and weight + literal_weight(value) >= least:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    found.update(literals[k])
                    todo += links[k] or ()

    for first in range(len(parsed)):
        todo = [first]
        while todo:
            i = todo[-1]
            if links[i] is not None:
                todo.pop()
            elif begun[i]:
                finish(i)
                todo.pop()
            else:
                begun[i] = True
                todo += [j for j in sources[i] if j is not None and not begun[j]]
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def lexed_spans(text: str, least: float = 4.0) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name with a score of ``least`` or more."""
    if "=" not in text and ":" not in text:
        return []
    found = {(a, b, "assign") for a, b in reported(text, least) if b > a}
    return sorted(found)


def all_spans(text: str, least: float = 4.0) -> tuple[list, list]:
    """(base spans, base spans and the added ones), sorted."""
    base = base_spans(text)
    added, i, reach = [], 0, -1
    for s in lexed_spans(text, least):
        while i < len(base) and base[i][0] < s[1]:
            reach, i = max(reach, base[i][1]), i + 1
        if reach <= s[0]:
            added.append(s)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 4.0) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind, value) for every document."""
    span = "array<struct<start:int,end:int,kind:string,value:string>>"
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(all_spans(t, least), t) for t in batch["text"]]
            fill = lambda spans, t: [{"start": a, "end": b, "kind": k, "value": t[a:b]} for a, b, k in spans]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": [fill(r[0], t) for r, t in rows], "spans": [fill(r[1], t) for r, t in rows]})

    return narrow.mapInPandas(run, f"doc_id {kind}, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
