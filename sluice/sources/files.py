"""File sources: source-code uploads (A2) and the image folder listing.

Both use Spark's ``binaryFile`` source. Directory listing is distributed
(``spark.sql.sources.parallelPartitionDiscovery``), and when only metadata
columns are selected the file contents are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_text
from ..operators.code import upload_language

REPLACEMENT_CHAR = "\ufffd"
# A character that no text should have, and what stands for it and for a real U+FFFD meanwhile.
_ESCAPE = "\ufdd0"


def decode_utf8_dropping_bad_bytes(content) -> F.Column:
    """Bytes → text, invalid UTF-8 sequences removed.

    ``make_valid_utf8`` replaces each bad sequence with U+FFFD, which is then
    removed; one that is really in the file is escaped before and put back.
    """
    text = content.cast("string")
    for old, new in ((_ESCAPE, _ESCAPE + "0"), (REPLACEMENT_CHAR, _ESCAPE + "1")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.replace(F.make_valid_utf8(text), F.lit(REPLACEMENT_CHAR), F.lit(""))
    for old, new in ((_ESCAPE + "1", REPLACEMENT_CHAR), (_ESCAPE + "0", _ESCAPE)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def scan_code_corpus(spark: SparkSession, path: str, glob: str | None = None,
                     recursive: bool = True) -> DataFrame:
    """A2: one row per file: file_id, filename, path, code, language.

    ``file_id`` is a 64-bit hash of the path (stable across runs); the
    language follows the chat page's rule on the file name.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    return files.select(
        F.xxhash64("path").alias("file_id"), name.alias("filename"), "path",
        decode_utf8_dropping_bad_bytes(F.col("content")).alias("code"),
        upload_language(name).alias("language"))


def recent_images(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    """The newest ``limit`` ``*.png`` files of a folder (not recursive):
    filename, url, created_at (ISO text), newest first.

    Only ``path`` and ``modificationTime`` are selected, so the image bytes
    are never read; ``orderBy().limit()`` plans as a top-k
    (``TakeOrderedAndProject``).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
             .load(folder).select("path", "modificationTime"))
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    top = files.orderBy(F.col("modificationTime").desc(), F.col("path")).limit(limit)
    return top.select(name.alias("filename"), F.concat(F.lit("/outputs/"), name).alias("url"),
                      iso_text(F.col("modificationTime").cast("timestamp_ntz")).alias("created_at"))
