"""WARC archives with an index written first, read back by coalesced byte ranges.

``write_archive`` streams each partition into gzip-per-record WARC files and stores an index row per record (file,
offset, length, url, digest) as Parquet before anything is read.  ``read_records`` takes any selection of index rows,
sorts the offsets of a file, joins neighbours while the gap is small into ranges never much longer than ``block``
bytes, reads each range once and cuts the records out of it.

Equal payloads: digests are counted with map-side combining, and only the table of repeated digests is joined back, so
no group of copies is gathered anywhere.  Payloads are never shuffled unless that table is too long to be sent to the
tasks by Spark's own size check.

Lost executors: a task writes to a file of its own attempt and the stored index names only files of attempts that
succeeded, so a repeated task leaves at most an unreferenced file.

Defined cases: a null html is an empty payload, a null url an empty one; rows tied for the largest page_id of a payload
are all responses; a null page_id never revisits others and is never revisited; an empty table gives an empty archive
and an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakesignal.llm.common import pinned, shared_folder

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
#: Bytes of archive that a task reads back, about.
TASK_BYTES = 16 << 20
_FIELD = re.compile(rb"(?i)^([A-Za-z-]+):[ \t]*(.*)$")
_INDEX = "url string, digest string, kind string, path string, offset long, length long"


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member.  A revisit names the response's record and carries no payload."""
    body = b"" if refers_to is not None else payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "%20", url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))] if refers_to is not None else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and content of one gzip member."""
    head, _, rest = zlib.decompress(packed, 31).partition(b"\r\n\r\n")
    fields = {m[1].decode().lower(): m[2].decode() for line in head.split(b"\r\n")[1:] if (m := _FIELD.match(line))}
    return fields, rest[: int(fields["content-length"])]


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(digest, first_id): payloads of ``LEAST_SHARED`` bytes and more that several pages share, with the page that keeps them."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    return keys.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write_archive(pages: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes WARC files and their index below ``folder``; returns the stored index.

    Needs the columns page_id, url and html.  A file is closed when it has ``file_bytes`` bytes.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    html = F.coalesce("html", F.lit(""))
    repeated = pinned(repeated_payloads(pages))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).join(repeated, "digest", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))).drop("first_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/data", recursive=True)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                index = []
                ids = [None if pd.isna(x) else x for x in batch["page_id"].astype(object)]
                kept = [None if pd.isna(x) else x for x in batch["refers_to"].astype(object)]
                for page_id, refers, url, payload, digest in zip(ids, kept, batch["url"], batch["payload"], batch["digest"]):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, at = f"{folder}/data/{name}", 0
                        out = system.open_output_stream(f"{root}/data/{name}", compression=None)
                    packed = record_bytes(int(page_id) if kind in ("bigint", "int") and page_id is not None else page_id, url, payload, digest, int(refers) if kind in ("bigint", "int") and refers is not None else refers)
                    out.write(packed)
                    index.append((page_id, url, digest, "response" if refers is None else "revisit", path, at, len(packed)))
                    at += len(packed)
                yield pd.DataFrame(index, columns=["page_id", "url", "digest", "kind", "path", "offset", "length"]).astype({"page_id": "Int64"} if kind == "bigint" else {})
        finally:
            if out is not None:
                out.close()

    rows.mapInPandas(write, f"page_id {kind}, {_INDEX}").write.mode("errorifexists").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(f"page_id {kind}, {_INDEX}").parquet(f"{folder}/index")


def ranges(index: DataFrame, gap: int, block: int) -> DataFrame:
    """(path, begin, end, parts): byte ranges that cover the selected records, each read once.

    A range holds records that start in one block of ``block`` bytes, at most ``gap`` bytes apart, so it is bounded by
    the block and one record.
    """
    in_block = W.partitionBy("path", "_block").orderBy("offset")
    rows = index.withColumn("_block", F.floor(F.col("offset") / block))
    before = F.lag(F.col("offset") + F.col("length")).over(in_block)
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("offset") - before > gap), 1).otherwise(0))
    rows = rows.withColumn("_range", F.sum("_new").over(in_block))
    return rows.groupBy("path", "_block", "_range").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length", "page_id"))).alias("parts")
    )


def read_records(index: DataFrame, gap: int = 64 << 10, block: int = 4 << 20) -> DataFrame:
    """The selected records as stored: page_id, url, kind, record_urn, refers_urn, header_digest, payload."""
    kind = index.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples(index=False):
                system, path = fs.FileSystem.from_uri(row.path)
                with system.open_input_file(path) as source:
                    source.seek(row.begin)
                    data = memoryview(source.read(row.end - row.begin))
                out = []
                for part in row.parts:
                    at = part["offset"] - row.begin
                    f, payload = parse_record(bytes(data[at : at + part["length"]]))
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {row.path}:{part['offset']}")
                    out.append((part["page_id"], f["warc-target-uri"], f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), digest, payload))
                yield pd.DataFrame(out, columns=["page_id", "url", "kind", "record_urn", "refers_urn", "header_digest", "payload"]).astype({"page_id": "Int64"} if kind == "bigint" else {})

    schema = f"page_id {kind}, url string, kind string, record_urn string, refers_urn string, header_digest string, payload binary"
    # Ranges are tiny rows for much data: their number of tasks follows from the bytes behind them.
    size = index.agg(F.sum("length")).first()[0] or 0
    spread = ranges(index, gap, block).repartition(-(-size // TASK_BYTES) or 1, "path", "begin")
    return spread.mapInPandas(read, schema)


def digest(records: DataFrame) -> DataFrame:
    """The contract's columns from records read back; a revisit takes the payload's length from the response it names."""
    seen = pinned(records.select("page_id", "kind", "record_urn", "refers_urn", "header_digest", F.octet_length("payload").cast("long").alias("payload_bytes")))
    named = seen.where("refers_urn is not null").select(F.col("refers_urn").alias("record_urn")).distinct()
    whole = seen.where("kind = 'response'").join(named, "record_urn", "left_semi").groupBy("record_urn")
    whole = whole.agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes")).withColumnRenamed("record_urn", "refers_urn")
    out = seen.join(whole, "refers_urn", "left")
    size = F.when(F.col("kind") == "revisit", F.col("_bytes")).otherwise(F.col("payload_bytes"))
    return out.select("page_id", size.alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def new_folder(pages: DataFrame) -> str:
    return f"{shared_folder(pages.sparkSession)}/warc/{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` below the shared folder and reads all of them back by ranges."""
    return digest(read_records(write_archive(pages, folder or new_folder(pages))))
