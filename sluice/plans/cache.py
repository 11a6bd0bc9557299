"""Registered cache queries (H1-H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as H
from ..views import AS_OF, AS_OF_SQL
from .registry import query

_UPSERT_CTE = """WITH cur AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY cache_key ORDER BY created_at DESC, id DESC) AS rn
    FROM cache_entries) q WHERE rn = 1)
"""
_LOOKUP_CTE = _UPSERT_CTE.rstrip() + f""",
req AS (SELECT event_id AS request_id, md5(event_type || '|' || props) AS cache_key FROM events),
look AS (
  SELECT r.request_id, r.cache_key, c.id IS NOT NULL AS hit, c.id AS entry_id, c.value
  FROM req r LEFT JOIN (SELECT * FROM cur WHERE expires_at > {AS_OF_SQL}) c ON c.cache_key = r.cache_key)
"""


def _requests(t):
    """Every event reads the cache key it would write."""
    return t.events.select(F.col("event_id").alias("request_id"),
                           F.md5(F.concat_ws("|", "event_type", "props")).alias("cache_key"))


@query("cache_upsert", ("cache_entries",), _UPSERT_CTE + "SELECT * FROM cur")
def cache_upsert(t):
    return H.cache_upsert(t.cache_entries)


@query("cache_lookup", ("cache_entries",), _LOOKUP_CTE + "SELECT * FROM look")
def cache_lookup(t):
    return H.cache_lookup(_requests(t), H.cache_upsert(t.cache_entries), AS_OF)


@query("cache_lookup_at", ("cache_entries",), """
WITH req AS (SELECT event_id AS request_id, md5(event_type || '|' || props) AS cache_key, ts + INTERVAL 6 HOUR AS requested_at FROM events),
found AS (
  SELECT r.*, c.id, c.value, c.expires_at,
    ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY c.created_at DESC, c.id DESC) AS place
  FROM req r LEFT JOIN cache_entries c ON c.cache_key = r.cache_key AND c.created_at <= r.requested_at)
SELECT request_id, cache_key, requested_at, COALESCE(expires_at > requested_at, false) AS hit,
  CASE WHEN expires_at > requested_at THEN id END AS entry_id, CASE WHEN expires_at > requested_at THEN value END AS value
FROM found WHERE place = 1""")
def cache_lookup_at(t):
    """Every event's key is asked for six hours after the event, against every other write that has an entry by then."""
    asked = t.events.select(F.col("event_id").alias("request_id"), F.md5(F.concat_ws("|", "event_type", "props")).alias("cache_key"),
                            (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("requested_at"))
    return H.cache_lookup_at(asked, t.cache_entries)


@query("cache_hits", ("cache_entries",), _LOOKUP_CTE + """
SELECT c.cache_key, c.id AS entry_id, CAST(COALESCE(h.hits, 0) AS BIGINT) AS hit_count
FROM cur c LEFT JOIN (SELECT cache_key, COUNT(*) AS hits FROM look WHERE hit GROUP BY cache_key) h USING (cache_key)""")
def cache_hits(t):
    entries = H.cache_upsert(t.cache_entries)
    return H.cache_hits(H.cache_lookup(_requests(t), entries, AS_OF), entries)


@query("cache_evict", ("cache_entries",), _UPSERT_CTE + f"""
SELECT cache_type, CAST(COALESCE(count_if(expires_at > {AS_OF_SQL}), 0) AS BIGINT) AS live,
  CAST(COALESCE(count_if(NOT (expires_at > {AS_OF_SQL})), 0) AS BIGINT) AS expired
FROM cur GROUP BY cache_type""")
def cache_evict(t):
    _kept, counts = H.cache_evict(H.cache_upsert(t.cache_entries), AS_OF)
    return counts


@query("cache_evict_kept", ("cache_entries",), _UPSERT_CTE + f"""
SELECT * FROM cur WHERE expires_at > {AS_OF_SQL}""")
def cache_evict_kept(t):
    """The entries that eviction leaves."""
    kept, _counts = H.cache_evict(H.cache_upsert(t.cache_entries), AS_OF)
    return kept


@query("similar_entries", ("cache_entries",), _UPSERT_CTE.rstrip() + """,
ent AS (SELECT c.id AS entry_id, CAST(e.embedding AS DOUBLE[]) AS v FROM cur c JOIN embeddings e ON e.vec_id = c.vec_id),
qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT q.query_id, n.entry_id, ROUND(list_cosine_similarity(q.v, n.v), 9) AS score FROM qs q, ent n)
SELECT query_id, entry_id, ROUND(score, 6) AS score, rank FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INT) AS rank FROM sc) r
WHERE rank <= 5""")
def similar_entries(t):
    """Five nearest live-table entries for every embedding used as a query."""
    entries = (H.cache_upsert(t.cache_entries).join(t.embeddings, "vec_id")
               .select(F.col("id").alias("entry_id"), "embedding"))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    out = H.similar_entries(queries, entries, k=5)
    return out.withColumn("score", F.round("score", 6))


@query("ttl_replay", (), """
WITH RECURSIVE r AS (
  SELECT event_id AS id, md5(event_type || '|' || props) AS cache_key, ts AS created_at,
    ROW_NUMBER() OVER (PARTITION BY md5(event_type || '|' || props) ORDER BY ts, event_id) AS rn
  FROM events),
walk AS (
  SELECT cache_key, rn, id, created_at AS fill_at, false AS hit FROM r WHERE rn = 1
  UNION ALL
  SELECT n.cache_key, n.rn, n.id,
    CASE WHEN n.created_at >= w.fill_at + INTERVAL 24 HOUR THEN n.created_at ELSE w.fill_at END,
    n.created_at < w.fill_at + INTERVAL 24 HOUR
  FROM walk w JOIN r n ON n.cache_key = w.cache_key AND n.rn = w.rn + 1)
SELECT id, cache_key, hit FROM walk""")
def ttl_replay(t):
    """Every event reads its key through a 24-hour TTL cache: hit or refill."""
    reqs = t.events.select(F.col("event_id").alias("id"),
                           F.md5(F.concat_ws("|", "event_type", "props")).alias("cache_key"),
                           F.col("ts").alias("created_at"))
    return H.ttl_replay(reqs, ttl_hours=24).select("id", "cache_key", "hit")


@query("similar_entries_lsh")
def similar_entries_lsh(t):
    """The same question through hash tables; approximate, so without an oracle (recall is tested)."""
    entries = (H.cache_upsert(t.cache_entries).join(t.embeddings, "vec_id")
               .select(F.col("id").alias("entry_id"), "embedding"))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return H.similar_entries_lsh(queries, entries, k=5)
