"""Upload validation over a directory of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MB = 25

# Leading bytes per file extension (hex).
MAGIC_BYTES = (
    ("pdf", "255044462D"),
    ("png", "89504E470D0A1A0A"),
    ("jpg", "FFD8FF"),
    ("jpeg", "FFD8FF"),
    ("tiff", "49492A00"),
    ("tiff", "4D4D002A"),
    ("tif", "49492A00"),
    ("tif", "4D4D002A"),
    ("bmp", "424D"),
)


def validate_files(spark: SparkSession, path: str, max_mb: int = MAX_MB, glob: str | None = None) -> DataFrame:
    """(path, length, accepted, reason).  Sizes are checked first, from metadata; only files within the limit are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    limit = max_mb * 1024 * 1024
    size_mb = F.format_string("file is %.1fMB, exceeding the %dMB limit", F.col("length") / (1024 * 1024), F.lit(max_mb))
    large = files.where(F.col("length") > limit).select("path", "length", size_mb.alias("reason"))
    empty = files.where(F.col("length") == 0).select("path", "length", F.lit("uploaded file is empty").alias("reason"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    known, ok = F.lit(False), F.lit(False)
    for e, magic in MAGIC_BYTES:
        known = known | (ext == e)
        ok = ok | ((ext == e) & head.startswith(magic))
    rest = files.where((F.col("length") > 0) & (F.col("length") <= limit)).select(
        "path", "length", F.when(known & ~ok, F.concat(F.lit("file content doesn't match a valid ."), ext, F.lit(" file (failed signature check)"))).alias("reason")
    )
    return large.unionByName(empty).unionByName(rest).select("path", "length", F.col("reason").isNull().alias("accepted"), "reason")
