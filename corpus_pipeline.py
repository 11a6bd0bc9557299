"""A training corpus from ``documents`` in five stages, each one operator of ``sluice.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; the last returns each document's
tokens as counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import exact_dedup, langid, mixing, simhash
from sluice.llm.common import keep_rows, materialize, read, words
from sluice.llm.queries import encode_documents, quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are no text of the language they look like most.

    That is ``und`` (no letter; null and empty texts too), and a score below
    what texts of that language and length have (``langid.least_scores``).
    Profiles and bounds are learned from all documents with a language label;
    with none at all nothing can be told, and documents without a letter go.
    Texts are read whole; repeated rows stand or fall together; an empty table
    gives an empty result; other columns pass through, whatever their names.
    """
    profiles = langid.train(docs, per_language=None)
    if not profiles.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # written once, so that the bounds and the rows read the same scores and no text is identified twice
    found = materialize(docs.select(F.struct("*").alias("doc"), langid.identify(F.col("text"), profiles).alias("found")), "identified")
    told = F.col("found.lang") != langid.UNKNOWN
    least = langid.least_scores(found.select("doc.text", "doc.lang", "found"), profiles, found=F.col("found"))
    if least:
        bounds = F.create_map(*[F.lit(x) for (lang, size), cut in least.items() for x in (f"{size} {lang}", cut)])
        key = F.concat_ws(" ", langid.length_class(F.col("doc.text")).cast("string"), F.col("found.lang"))
        told = told & (F.col("found.score") >= F.coalesce(F.try_element_at(bounds, key), F.lit(0.0)))
    return found.filter(told).select("doc.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the row with the smallest doc_id stays.

    A null text counts as empty; a null id stays only where no row of the group
    has one; of rows that repeat with id and text one stays. Long texts move as
    chunks. An empty table gives an empty result; other columns pass through.
    """
    kept = exact_dedup.deduplicate(docs).filter("kept").select(
        "doc_id", F.col("text_sha256").alias("mark"))
    return keep_rows(docs, F.sha2(exact_dedup.normalized(F.col("text")), 256), kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (3-word shingles, 3 bits), the one with the smallest doc_id stays.

    Texts without a word are linked with each other; a null id stays only where
    no linked row has one; of rows that repeat with id and text one stays. An
    empty table gives an empty result; other columns pass through.
    """
    mark = F.xxhash64("text").cast("string")
    kept = simhash.near_duplicates(docs, mark=mark).filter("row_id = keep_row").select("doc_id", "mark")
    return keep_rows(docs, mark, kept)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or more.

    Null sources are one source; empty and null texts have no words and follow
    their draw; repeated rows are drawn each by itself. An empty table gives an
    empty result; other columns pass through.
    """
    names = docs.columns
    # size and hash of the text are taken before the join, so that the draws don't move texts
    inner = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("ident"), F.struct("*").alias("doc"))
    weighed = quality(inner, read(spark, sf_dir, "labels"), "quality_weight")
    taken = mixing.mix(weighed, F.col("n_words"), F.col("quality_weight"), text="ident")
    return (taken.filter("mix.copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy"))
            .select(*[F.col(f"doc.`{c}`") for c in names]))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix; a null text counts as empty."""
    return encode_documents(docs)


STAGES = [
    ("language ID", language_id), ("exact dedup", exact_duplicates), ("SimHash near-dedup", near_duplicates),
    ("mixing", mixed), ("BPE encoding", encoded),
]

#: Language profiles, 64-bit hashes, draws and merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; an empty table, or one whose rows all go, gives an empty result."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
