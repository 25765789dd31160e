"""Token counts kept as additive totals by source, language and tokenizer version.

A batch of changes (insert, revise, delete) is turned into signed rows against the ledger of documents counted so far:
minus the old count, under the tokenizer that it was made with, plus the new one.  Their sums per (source, lang, tokenizer) are the batch's deltas; totals are the
sum of all committed deltas and are never recomputed from texts.

A batch is three tables named by its id, ``ledger``, ``deltas`` and, written last, ``commits``.  Readers take the
committed ids only.  Applying a committed batch again changes nothing; a batch that broke off is written anew.

Texts are tokenized inside the tasks and only (doc_id, source, lang, count) is shuffled.  A hot source or language is
summed map-side first.

Defined cases: a null text has no tokens; null source or lang is a group of its own; of repeated rows of one doc_id in a
batch, a delete yields to an insert, and of inserts the one with the greatest count, then source, then lang stays; rows
without doc_id cannot be revised, so each is added as it comes and deletes of them are ignored; deletes of unknown
documents change nothing; groups whose documents are all gone keep a row with zero totals; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Where the public vocabulary files are; a parameter everywhere.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEDGER = "doc_id {kind}, source string, lang string, n_tokens long, live boolean, tokenizer string"
DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
COMMIT = "batch_id string, seq long"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_version(path: str = VOCABULARY) -> str:
    """Name and digest of the vocabulary: another file is another version."""
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def counted(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens``."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for batch in batches:
            out = batch[others].copy()
            out["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield out

    return docs.select(*others, text).mapInPandas(run, schema)


class TokenTotals:
    """The rollup below one shared folder; what is counted here is of one tokenizer version, the folder may hold several."""

    def __init__(self, spark: SparkSession, folder: str, path: str = VOCABULARY, id_type: str = "bigint"):
        self.spark, self.folder, self.path = spark, folder.rstrip("/"), path
        self.version, self.id_type = tokenizer_version(path), id_type

    def _read(self, table: str, schema: str, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/{i}" for i in ids])

    def committed(self) -> list[tuple[int, str]]:
        """(seq, batch_id) in order: one small row per batch."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not base.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(base):
            return []
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits").collect()
        return sorted((r["seq"], r["batch_id"]) for r in rows)

    def ledger(self) -> DataFrame:
        """The last committed state of each document, deleted ones with ``live`` false."""
        done = self.committed()
        parts = None
        for seq, batch_id in done:
            part = self._read("ledger", LEDGER.format(kind=self.id_type), [batch_id]).withColumn("seq", F.lit(seq))
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return self._read("ledger", LEDGER.format(kind=self.id_type), [])
        row = F.struct("source", "lang", "n_tokens", "live", "tokenizer")
        last = parts.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(row, "seq").alias("r"))
        return last.select("doc_id", "r.source", "r.lang", "r.n_tokens", "r.live", "r.tokenizer")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch of (op, doc_id, source, lang, text); False if that id is committed already.

        ``op`` is insert, revise or delete; insert and revise both set a document's state.
        """
        done = self.committed()
        if batch_id in {b for _, b in done}:
            return False
        rows = counted(changes.select("op", "doc_id", "source", "lang", F.when(F.col("op") != "delete", F.col("text")).alias("text")), self.path)
        rows = rows.withColumn("live", F.col("op") != "delete")
        state = F.struct("live", "n_tokens", "source", "lang")
        known = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(state).alias("r")).select("doc_id", "r.source", "r.lang", "r.n_tokens", "r.live")
        nameless = rows.where("doc_id is null and live").select("doc_id", "source", "lang", "n_tokens", "live")
        written = f"{self.folder}/ledger/{batch_id}"
        known.unionByName(nameless).withColumn("tokenizer", F.lit(self.version)).write.mode("overwrite").parquet(written)
        new = self._read("ledger", LEDGER.format(kind=self.id_type), [batch_id])
        signed = new.where("live").select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "n_tokens")
        if done:
            old = self.ledger().where("live").join(new.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
            signed = signed.unionByName(old.select("source", "lang", "tokenizer", F.lit(-1).alias("sign"), "n_tokens"))
        deltas = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"))
        deltas.select("source", "lang", "tokenizer", "d_docs", "d_tokens").write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch_id}")
        seq = max((s for s, _ in done), default=0) + 1
        self.spark.createDataFrame([(batch_id, seq)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) from the committed deltas."""
        deltas = self._read("deltas", DELTA, [b for _, b in self.committed()])
        return deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))


def loaded_totals(docs: DataFrame, folder: str, path: str = VOCABULARY) -> DataFrame:
    """Totals after batches that bring every document from an old state to that of ``docs``, and after they arrive again.

    First all documents are inserted with half of their text and with source and lang swapped.  Then one half of them is
    revised and the other deleted, which the last batch inserts anew.  Rows without doc_id cannot be revised; the first
    batch has them as they are.  Groups that only the old states had are left out when their totals are zero.
    """
    rollup = TokenTotals(docs.sparkSession, folder, path, docs.schema["doc_id"].dataType.simpleString())
    rows = docs.select("doc_id", "source", "lang", "text")
    named, first = rows.where("doc_id is not null"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    old = named.select("doc_id", F.col("lang").alias("source"), F.col("source").alias("lang"), half.alias("text"))
    op = lambda df, name: df.withColumn("op", F.lit(name))
    batches = {
        "load": op(old.unionByName(rows.where("doc_id is null")), "insert"),
        "change": op(named.where(first), "revise").unionByName(op(named.where(~first).withColumn("text", F.lit(None).cast("string")), "delete")),
        "return": op(named.where(~first), "insert"),
    }
    for batch_id in [*batches, *batches]:  # a replay changes nothing
        rollup.apply(batch_id, batches[batch_id])
    return rollup.totals().where("n_docs <> 0 or n_tokens <> 0")
