"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, removes invisible characters and reads
digits and signs inside words as the letters they stand for.  The lexicon is a small list of known insults plus words
and word beginnings learnt from labelled rows: entries whose presence in toxic texts, at a cautious bound, is many
times that in clean ones; their weight is the log ratio.  Hits inside an exception phrase do not count.  The sum of
weights, plain and per hundred words, goes through a logistic curve fitted on the same labelled rows.

Learning uses at most ``train_rows`` labelled rows, those with the smallest hash of their id, so the choice is the same
in every run; the lexicon has at most ``max_terms`` entries.  Both bounds are parameters of the classifier.  Scoring is
one pass over all texts without a shuffle.

Defined cases: a null or empty text has no hit and gets the curve's lowest score; of several labels of one doc_id the
majority counts, a tie is toxic; null labels and null ids are not learnt from; without usable labels the known insults
and a fixed curve are used; repeated rows get equal scores; further columns are kept by ``drop_toxic`` and not read
otherwise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesignal.llm.common import bounded_broadcast, fresh_names, pinned

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"
KNOWN = ("idiot", "moron", "stupid", "scum", "loser", "clown", "trash", "worthless", "pathetic", "disgusting", "dumb", "imbecile", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pathetic fallacy", "no idiot", "not stupid")

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {ord(c): None for c in INVISIBLE}
_FOREIGN = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～]")
_WITH_DIGIT = re.compile(r"(?<![^\W_])[^\W\d_]*+[0-9][^\W_]*+")
_INNER_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")
_LETTERS = str.maketrans(SIGNS)
PREFIXES = (4, 5, 6)


def folded(text: str) -> str:
    """Folded words, each between single blanks; a blank for a text without words."""
    out = text.lower()
    if not out.isascii() and _FOREIGN.search(out):
        out = out.translate(_FOLD)
    if any(s in out for s in "@$!|"):
        out = _INNER_SIGN.sub(lambda m: m[0].translate(_LETTERS), out)
    out = _WITH_DIGIT.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_LETTERS), out)
    return f" {_GAP.sub(' ', out).strip()} " if out else " "


@dataclass
class Lexicon:
    """``terms``: " word " or " beginning" with weights; ``curve``: intercept and slopes of the logistic curve."""

    terms: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.5)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._machine.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                if words := folded(phrase).strip():
                    self._machine.add_word(f" {words} ", (len(words) + 2, None))
            self._machine.make_automaton()
        return self._machine

    def measure(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of all hits, at most one per word, and the number of words."""
        clean = folded(text or "")
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine().iter(clean) if self.terms else ():
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if spared and hits:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        return sum(hits.values()), max(clean.count(" ") - 1, 0)

    def score(self, total: float, words: int) -> float:
        a, b, c = self.curve
        x, y = features(total, words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


#: Terms that a task counts at once; then it hands its counts on and begins anew.
TERMS_HELD = 100_000


def _per_task_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with each word or beginning in one task's share of the bounded sample, in parts that are to be summed."""
    n, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            words = set(folded(text or "").split())
            found = {f" {w} " for w in words if len(w) <= 40} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}
            n.update(found)
            if label:
                toxic.update(found)
            if len(n) >= TERMS_HELD:
                yield _counted(n, toxic)
                n, toxic = Counter(), Counter()
    if n:
        yield _counted(n, toxic)


def _counted(n: Counter, toxic: Counter) -> pd.DataFrame:
    return pd.DataFrame({"term": list(n), "n": list(n.values()), "t": [toxic[k] for k in n]})


def labelled_sample(docs: DataFrame, labels: DataFrame, keep, train_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``train_rows`` labelled rows for which ``keep`` holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep)
    one = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", "text").join(bounded_broadcast(chosen, train_rows), "doc_id")  # whole texts stay where they are read
    # Copies of a text say the same thing once.
    return texts.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")).drop("key")


def _weight(t: float, f: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((f + 0.5) / (clean + 1))


def choose_terms(counts: pd.DataFrame, toxic: int, clean: int, least: float, max_terms: int) -> dict[str, float]:
    """Terms whose cautious log ratio is ``least`` or more, shorter beginnings in place of the longer ones they cover."""
    scored = []
    for term, n, t in counts.itertuples(index=False):
        f = n - t
        low = _weight(max(t - 1.64 * math.sqrt(t), 0.0), f + 1.64 * math.sqrt(f + 1), toxic, clean)
        if t >= max(3, 0.003 * toxic) and low >= least:
            scored.append((term, low, t))
    scored.sort(key=lambda x: (-x[2], x[0]))
    kept: dict[str, tuple[float, int]] = {}
    for term, low, t in sorted(scored[: 4 * max_terms], key=lambda x: (len(x[0].rstrip()), x[0])):
        word = term.rstrip()
        if any((b := kept.get(word[:k])) and b[0] >= 0.9 * low for k in range(4, len(word) + (term != word))):
            continue
        kept[term] = (low, t)
    # A beginning that stands for one word only is replaced by that word.
    words = {term: t for term, _, t in scored if term.endswith(" ")}
    out: dict[str, float] = {}
    for term, (low, t) in kept.items():
        same = [w for w, n in words.items() if not term.endswith(" ") and w.startswith(term) and n >= 0.95 * t]
        for entry in same[:1] or [term]:
            out[entry] = max(out.get(entry, 0.0), low)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:max_terms])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression with slopes kept at zero or more; ``x`` has the two features."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array([-3.0, 1.0, 0.1])
    penalty = np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return float(min(w[0], -0.5)), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, keep=None, train_rows: int = 20_000, max_terms: int = 2_000, least: float = 3.0) -> Lexicon:
    """Lexicon and curve from the labelled rows for which ``keep`` (a condition on doc_id) holds."""
    known = {f" {w} ": 4.0 for w in KNOWN}
    sample = labelled_sample(docs, labels, F.lit(True) if keep is None else keep, train_rows)
    sample = pinned(sample)
    sizes = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic, rows = int(sizes[0] or 0), int(sizes[1])
    if not 0 < toxic < rows:
        return Lexicon(known)
    counts = sample.mapInPandas(_per_task_counts, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    frequent = counts.where(F.col("t") >= max(3.0, 0.003 * toxic)).where(F.col("t") >= 0.3 * F.col("n"))
    counted = frequent.orderBy(F.desc("t"), "term").limit(20 * max_terms).toPandas()
    terms = known | choose_terms(counted, toxic, rows - toxic, least, max_terms)
    lexicon = Lexicon(terms)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(*lexicon.measure(t)) for t in batch["text"]]
            yield pd.DataFrame({"x": [f[0] for f in found], "y": [f[1] for f in found], "label": batch["label"]})

    points = sample.mapInPandas(measured, "x double, y double, label int").toPandas()  # train_rows rows at most
    lexicon.curve = fit_curve(points[["x", "y"]].to_numpy(), points["label"].to_numpy(float))
    return lexicon


def with_score(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score column added; all columns are kept."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[score] = [lexicon.score(*lexicon.measure(t)) for t in batch[text]]
            yield batch

    return docs.mapInPandas(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; held-out labels are not learnt from."""
    lexicon = learn(docs, labels, ~held_out())
    out = with_score(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``least`` or more; learns from all labels of these documents."""
    (score,) = fresh_names(docs.columns, "_score")
    lexicon = learn(docs, labels, ~held_out())
    return with_score(docs, lexicon, score=score).where(F.col(score) < least).select(*docs.columns)
