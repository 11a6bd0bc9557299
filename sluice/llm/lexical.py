"""Ranked lexical search by a hybrid of TAAT and DAAT (operator 11).

Term at a time: the postings of rare terms (short lists) are joined with the
queries and summed per query and document, a plain grouped sum. Document at a
time: the documents are dealt into blocks, and in each block a query walks
windows of documents in order. The summed accumulators are one more iterator
with a known maximum beside the long lists. A window whose bounds cannot reach
the score to beat is skipped; in the others the lists of the smallest bounds
are looked up only for documents that the larger ones leave in the running
(MaxScore with a bound for each window). The k-th best accumulator over all
documents is the score to beat from the start. Results are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the contract: bytes that end a term, and the letters that are lower-cased.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")

#: Postings of a list up to which it is summed term at a time.
SHORT = 1024
#: A block has about so many documents and long postings at most; a window is what is skipped at once.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW = 16_384, 500_000, 1024
#: Queries that meet a block in one task.
QUERIES_AT_ONCE = 512
_PIECE = 1 << 20


def count_text(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their occurrences; long texts go in pieces that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        piece = text[at:at + _PIECE].translate(_FOLD)
        at += len(piece)
        if at < len(text):  # on to the end of the term that is cut
            end = at
            while end < len(text) and text[end:end + 1].translate(_FOLD) != b" ":
                end += 1
            piece, at = piece + text[at:end].translate(_FOLD), end
        found.update(piece.split())
    return found


def count_terms(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, n, terms, tfs`` of every row: terms with repeats, and each term's occurrences."""
    slim = rows.select(key.cast("long").alias("key"), text.cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, ends, terms, tfs = [], [0], [], []
                for value in batch.column(1):
                    found = count_text(value.as_py() or b"")
                    n.append(sum(found.values()))
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["key", "n", "terms", "tfs"])

    return slim.mapInArrow(count, "key long, n long, terms array<string>, tfs array<long>")


def _unfold(counted: DataFrame, *keep: str) -> DataFrame:
    return counted.select(*keep, F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        *keep, F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


class _Best:
    """The ``k`` best documents so far, by score and then id, and the score to beat."""

    def __init__(self, k: int, floor: int, ids: np.ndarray, unknown: np.ndarray):
        self.k, self.floor, self.ids, self.unknown = k, max(floor, 1), ids, unknown
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, scores])
        order = np.lexsort((self.ids[docs], self.unknown[docs], -scores))[:self.k]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def walk(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, best: _Best, window: int = WINDOW) -> int:
    """Walk the iterators ``(sorted docs, values, weight)`` window by window into ``best``.

    Returns the number of postings that were read.
    """
    read = 0
    edges = np.arange(0, n_docs + window, window)
    cuts = [np.searchsorted(docs, edges) for docs, _, _ in lists]
    for w in range(len(edges) - 1):
        # the bound of each list in this window
        here = [(int(values[c[w]:c[w + 1]].max()) * weight, i) for i, ((docs, values, weight), c) in enumerate(zip(lists, cuts)) if c[w] < c[w + 1]]
        here.sort()
        upto = np.cumsum([b for b, _ in here])
        if not here or upto[-1] < best.floor:
            continue
        # lists below ``must`` cannot lift a document over the score to beat by themselves
        must = int(np.searchsorted(upto, best.floor))
        score = np.zeros(window, np.int64)
        for _, i in here[must:]:
            docs, values, weight = lists[i]
            part = slice(cuts[i][w], cuts[i][w + 1])
            score[docs[part] - edges[w]] += values[part] * weight
            read += part.stop - part.start
        run = np.flatnonzero(score)
        for j in range(must - 1, -1, -1):
            run = run[score[run] + upto[j] >= best.floor]
            if not len(run):
                break
            docs, values, weight = lists[here[j][1]]
            part = slice(cuts[here[j][1]][w], cuts[here[j][1]][w + 1])
            at = np.searchsorted(docs[part], run + edges[w])
            hit = at < part.stop - part.start
            hit[hit] = docs[part][at[hit]] == run[hit] + edges[w]
            score[run[hit]] += values[part][at[hit]] * weight
            read += int(hit.sum())
        run = run[score[run] >= best.floor]
        if len(run):
            best.add(run + edges[w], score[run])
    return read


_FOUND = "item_id long, doc_id long, score long"


def _rank_block(k: int):
    """One block of documents against one portion of the queries."""

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, row, value = (left[c].to_numpy() for c in ("kind", "row", "value"))
        key = left["key"].fill_null(0).to_numpy()
        is_doc = kind == 2
        order = np.argsort(row[is_doc])
        rows, ids = row[is_doc][order], key[is_doc][order]
        unknown = np.asarray(left["key"].is_null())[is_doc][order]

        def lists_of(which: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            mine = kind == which
            docs, names, values = np.searchsorted(rows, row[mine]), key[mine], value[mine]
            order = np.lexsort((docs, names))
            docs, names, values = docs[order], names[order], values[order]
            names, starts = np.unique(names, return_index=True)
            stops = np.append(starts[1:], len(docs))
            return {int(n): (docs[a:b], values[a:b]) for n, a, b in zip(names, starts, stops)}

        postings, sums = lists_of(0), lists_of(1)
        out = {"item_id": [], "doc_id": [], "score": []}
        for q in right.to_pylist():
            best = _Best(k, q["floor"], ids, unknown)
            lists = [(*postings[t], w) for t, w in zip(q["terms"], q["weights"]) if t in postings]
            if q["item_id"] in sums:
                lists.append((*sums[q["item_id"]], 1))
            if lists:
                walk(lists, len(rows), best)
            out["item_id"] += [q["item_id"]] * len(best.docs)
            out["doc_id"] += [None if unknown[d] else int(ids[d]) for d in best.docs]
            out["score"] += best.scores.tolist()
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    return rank


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", short: int = SHORT) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of the highest score above 0.

    Ranks count from 1; equal scores go by ascending doc_id, a null id last.
    A null or empty text has no term: such a document is not counted and not
    found, such an item finds nothing. Documents that repeat an id are ranked
    each by itself. Rows that repeat an item's id are one query of all their
    terms; an item without an id takes no part. Texts are read whole, in
    pieces. Empty tables give an empty result; other columns are ignored.
    """
    counted = materialize(count_terms(docs, F.col(doc_id), F.col(text)).filter("n > 0")
                          .withColumn("row", F.monotonically_increasing_id()), "terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    asked = count_terms(items.filter(F.col(item_id).isNotNull()), F.col(item_id), F.col(item_text))
    asked = materialize(_unfold(asked, "key").groupBy(F.col("key").alias("item_id"), "term").agg(F.sum("tf").alias("times")), "queries")
    names = materialize(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "query-terms")

    N, L = F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long")
    m = F.lit(25).cast("long") + F.call_function("div", F.lit(75).cast("long") * F.col("n") * N, L)
    impact = F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), F.lit(1000).cast("long") * F.col("tf") + F.lit(8).cast("long") * m)
    postings = materialize(_unfold(counted, "row", "n").join(names, "term").select("row", "term_id", impact.alias("value")), "postings")
    df = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    worth = F.floor(F.lit(1000.0) * F.log((2.0 * N + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = materialize(asked.join(names, "term").join(df, "term_id").withColumn("weight", F.col("times") * worth)
                          .filter("weight > 0").select("item_id", "term_id", "weight", "df"), "weights")

    # term at a time: short lists, at most ``short`` rows for each term of an item
    rare = weighed.filter(F.col("df") <= short)
    sums = materialize(postings.join(rare, "term_id").groupBy("item_id", "row").agg(F.sum(F.col("weight") * F.col("value")).alias("value")), "accumulators")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("value")))
    floor = sums.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).select("item_id", F.col("value").alias("floor"))

    # document at a time: blocks of documents by portions of queries
    common = weighed.filter(F.col("df") > short)
    long_postings, n_items = common.select("term_id", "df").distinct().agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], weighed.select("item_id").distinct().count()
    blocks, portions = max(1, -(-n_docs // BLOCK_DOCS), -(-long_postings // BLOCK_POSTINGS)), max(1, -(-n_items // QUERIES_AT_ONCE))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    block, portion = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("item_id"), F.lit(portions)).alias("portion")
    listed = postings.join(common.select("term_id").distinct(), "term_id", "left_semi")
    left = (listed.select(block, F.lit(0).alias("kind"), "row", F.col("term_id").alias("key"), "value", every(portions).alias("portion"))
            .unionByName(sums.select(block, F.lit(1).alias("kind"), "row", F.col("item_id").alias("key"), "value", portion))
            .unionByName(counted.select(block, F.lit(2).alias("kind"), "row", "key", F.lit(0).cast("long").alias("value"), every(portions).alias("portion"))))
    long_term = F.col("df") > short
    right = (weighed.groupBy("item_id").agg(F.collect_list(F.when(long_term, F.struct("term_id", "weight"))).alias("long"))
             .join(floor, "item_id", "left")
             .select("item_id", F.col("long.term_id").alias("terms"), F.col("long.weight").alias("weights"),
                     F.coalesce("floor", F.lit(0).cast("long")).alias("floor"), portion, every(blocks).alias("block")))
    found = left.groupBy("block", "portion").cogroup(right.groupBy("block", "portion")).applyInArrow(_rank_block(k), _FOUND)
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
