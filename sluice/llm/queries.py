"""Registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, digest, exact_dedup, langid, lexical, mixing, negatives, sharding, simhash, toxicity, urls, warc
from .common import held_out, read, words

VOCABULARY = "byte_bpe_50k.tiktoken"

# The listed rules (verdict, host, path) in their order.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    test = held_out(F.col("doc_id"), 3, 1)
    fold = docs.filter(~test)
    sample = toxicity.sample_labels(fold, labels)
    # about 2 * SAMPLE_PER_LABEL different texts
    lexicon = toxicity.train(fold.withColumn("mark", F.xxhash64("text")).join(F.broadcast(sample), "mark"))
    return docs.select("doc_id", test.alias("held_out"), toxicity.score(F.col("text"), lexicon).alias("score")).withColumn(
        "predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = held_out(F.col("doc_id"), 4, 2)
    profiles = langid.train(docs.filter(~test))
    found = docs.select("doc_id", test.alias("held_out"), langid.identify(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(read(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; a null text counts as empty.

    Texts are encoded whole, however long; null ids and repeated rows pass
    through as rows of their own; an empty table gives an empty result; other
    columns are ignored.
    """
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = docs.select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("both")).select("doc_id", "both.ids", "both.decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def quality(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` with the weight ``name``: 2 for quality 1, 0.5 for quality 0, 1 without a label.

    Of labels that repeat an id the best counts; a null id or quality is no
    label. Repeated rows of ``docs`` stay; empty tables give weight 1, or no
    rows. A column ``name`` of ``docs`` must not exist.
    """
    best = labels.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("quality").alias("q")).filter("labelled_id is not null")
    joined = docs.join(best, docs["doc_id"] == best["labelled_id"], "left")
    return joined.select(*[docs[c] for c in docs.columns], F.when(best["q"] == 1, 2.0).when(best["q"] == 0, 0.5).otherwise(1.0).alias(name))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the draw needs a text's size and hash only
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("ident"))
    weighed = quality(slim, read(spark, sf_dir, "labels"), "weight")
    mixed = mixing.mix(weighed, F.col("n_words"), F.col("weight"), text="ident")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest_neighbours, op2_simhash_dedup, op3_url_filter, op4_toxicity, op5_warc, op6_language_id,
                            op7_sharding, op8_bpe, op9_mixing, op10_exact_dedup, op11_lexical_search, op12_fingerprints, op13_hard_negatives)
}

ORACLES: dict[str, str] = {}

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p),
c AS (SELECT *, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[k * 10 + 1:k * 10 + 10] AS BIGINT)) AS fives FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((fives[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM c"""

ORACLES["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""


ORACLES["op11_lexical_search"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) u GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) u GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) x WHERE rank <= 10"""


ORACLES["op13_hard_negatives"] = """
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) x WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
