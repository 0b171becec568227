"""Filtered top-k search: dense, lexical, fused; batches of queries against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import cut, join_small

#: Queries that are scored at once by one matrix product.
BLOCK = 1024
#: Bytes of query vectors that go to every task in one scan of the corpus: a bound on what is sent, not on the queries.
SCAN_BYTES = 64 << 20
PLACES = 6


def top(scored: DataFrame, k: int, query: str = "qid", item: str = "id", score: str = "score") -> DataFrame:
    """The k best items of each query, equal scores by item: rank counts from 1."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(qid, id, score, rank): the k rows of `corpus(id, vector)` nearest to each of `queries(qid, vector)`.

    Cosine similarity to six places; rows without a vector, or with a zero one,
    are never found. Exact: every query against all rows. One scan of the corpus
    serves `scan_bytes` of query vectors (some 100,000 queries); a task scores
    them block by block, one matrix product a block and batch, and keeps the k
    best of a query, so that the shuffle carries k rows a task and query, not
    pairs. Filters belong on `corpus`, before the call.
    """
    asked = cut(queries.select("qid", "vector").where("vector IS NOT NULL"))
    count, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    scans = -(-count * (width or 0) * 8 // scan_bytes)  # a scan's queries are a hash class
    numbered = asked.withColumn("scan", F.pmod(F.xxhash64("qid"), F.lit(max(1, scans))))
    kinds = dict(queries.dtypes)["qid"], dict(corpus.dtypes)["id"]
    schema = f"qid {kinds[0]}, id {kinds[1]}, score double"
    found = None
    for scan in range(scans):
        rows = numbered.where(F.col("scan") == scan).select("qid", "vector").toArrow()  # about scan_bytes
        if not rows.num_rows:
            continue
        qids = rows.column("qid").combine_chunks()
        shared = corpus.sparkSession.sparkContext.broadcast(_unit(_matrix(rows.column("vector").combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch], qids=qids, shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * -(-len(q) // block)
            kind = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind = batch.column(0).type
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = _unit(_matrix(batch.column(1))).T
                for n in range(len(best)):
                    best[n] = _best(np.round(q[n * block : (n + 1) * block] @ vectors, PLACES), ids, k, best[n])
            for n, kept in enumerate(best):
                if kept is not None:
                    at, ids, scores = kept
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + n * block)), pa.array(ids, kind), pa.array(scores, pa.float64())], names=["qid", "id", "score"])

        one = corpus.where("vector IS NOT NULL").select("id", "vector").mapInArrow(score, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    return top(found, k)


def _matrix(vectors) -> np.ndarray:
    """The rows of a list column as a matrix, from its flat values; a vector of another length, or with a null in it, is a zero one."""
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        m = values.reshape(len(sizes), width)
    else:
        m = np.zeros((len(sizes), width))
        starts = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        for row in np.nonzero(sizes == width)[0]:
            m[row] = values[starts[row] : starts[row] + width]
    return np.where(np.isnan(m).any(axis=1, keepdims=True), 0.0, m)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, m / norm, np.nan)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, before: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query among `before` and the new scores, equal scores by id."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero((s >= kth[:, None]) & np.isfinite(s))  # with all ties at the cut
    else:
        row, column = np.nonzero(np.isfinite(s))
    found_ids, found = ids[column], s[row, column]
    if before is not None:
        row, found_ids, found = np.concatenate([before[0], row]), np.concatenate([before[1], found_ids]), np.concatenate([before[2], found])
    order = np.lexsort((found_ids, -found, row))
    row, found_ids, found = row[order], found_ids[order], found[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], found_ids[keep], found[keep]


def postings(docs: DataFrame, item: str, text: str, most: float | None = None, among: DataFrame | None = None) -> DataFrame:
    """(id, token, weight): a lexical stand-in, 1 + ln(occurrences) of words of letters, marks and figures in any script.

    With `most`, tokens that over this share of the items hold are left out, before
    they are counted: they tell nothing and would pair every query with every item.
    With `among`, only its tokens are counted, as those of the queries to come.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    asked = None if among is None else cut(among.select("token").distinct())

    def tokens(words: Column) -> DataFrame:
        rows = docs.select(F.col(item).alias("id"), F.explode(words).alias("token"))
        return rows if asked is None else join_small(rows, asked, ["token"], how="left_semi", spread="id")

    rows = tokens(words)
    if most is not None:
        held = tokens(F.array_distinct(words)).groupBy("token").agg(F.count("*").alias("n"))
        common = held.where(F.col("n") > most * docs.count()).select("token")  # at most the tokens of a mean item / most
        rows = rows.join(F.broadcast(common), "token", "left_anti")
    return rows.groupBy("id", "token").agg(F.round(1 + F.log(F.count("*").cast("double")), PLACES).alias("weight"))


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by the dot product over shared tokens of two posting tables.

    An equi-join on the token, with hot tokens salted where the queries are too
    many to be broadcast; only items that share a token with a query appear.
    """
    q = cut(queries.select(F.col("id").alias("qid"), "token", F.col("weight").alias("qw")))
    scored = join_small(corpus, q, ["token"], spread="id").groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 4).alias("score"))
    return top(scored, k)


def reciprocal_rank(legs: list[DataFrame], k: int, limit: int, first: int = 0) -> DataFrame:
    """(qid, id, score, rank): legs of (qid, id, rank) fused by the sum of 1 / (k + rank - 1 + first)."""
    rows = legs[0].select("qid", "id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("qid", "id", "rank"))
    fused = rows.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1 + first)), 9).alias("score"))
    return top(fused, limit)


def boosted(found: DataFrame, flagged: Column, boost: float, limit: int) -> DataFrame:
    """Re-ranked by score + boost where flagged, stable on the old rank; the score itself stays."""
    lifted = F.coalesce("score", F.lit(0.0)) + F.when(flagged, boost).otherwise(0.0)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(lifted, 9)), "rank")
    return found.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= limit).drop("rank").withColumnRenamed("new_rank", "rank")


def fuse_lists(lists: DataFrame, limit: int, keep_top: int = 0, k: int = 60) -> DataFrame:
    """(qid, id, score, rank) from rows (qid, list_no, pos, id, weight), pos from 1.

    Score: the sum of weight / (k + pos). The first keep_top of every list are
    reserved, in the order of lists and positions, up to the limit; the rest of
    the limit goes to the others by score. All come out by score, equal scores
    in the order in which they were first seen.
    """
    seen = F.min(F.struct("list_no", "pos")).alias("seen")
    scored = lists.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("pos"))), 12).alias("score"), seen, F.min(F.when(F.col("pos") <= keep_top, F.struct("list_no", "pos"))).alias("kept"))
    by_kept = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("kept").asc_nulls_last()))
    scored = scored.withColumn("reserved", F.col("kept").isNotNull() & (by_kept <= limit))
    others = Window.partitionBy("qid").orderBy(F.desc("reserved"), F.desc("score"), "seen")
    chosen = scored.withColumn("n", F.row_number().over(others)).where(F.col("n") <= limit)
    final = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return chosen.select("qid", "id", "score", F.row_number().over(final).alias("rank"))


def rerank(found: DataFrame, score: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """A shortlist rescored by a seam: `score` adds a column `new_score`; the old rank and score stay as prerank_*."""
    rescored = score(found.withColumnRenamed("score", "prerank_score").withColumnRenamed("rank", "prerank_rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("new_score"), "prerank_rank")
    return rescored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumnRenamed("new_score", "score")


@dataclass(frozen=True)
class SearchPolicy:
    """How a search is run (R01): its limit, what each leg fetches, and what follows the fusion."""

    limit: int = 8
    prefetch: int = 50
    store_k: int = 2
    boost: float = 0.0
    rerank: Callable[[DataFrame], DataFrame] | None = None

    @property
    def depth(self) -> int:
        """Items to fuse: 30 and more before a reranker, four more before a boost."""
        return max(self.limit, 30) if self.rerank else self.limit + 4 if self.boost > 0 else self.limit


def search(legs: Callable[[int], list[DataFrame]], policy: SearchPolicy, flagged: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank, ...): the legs fetched, fused, then reranked or boosted as the policy says.

    `legs(k)` gives the ranked legs, filtered before their top k; `flagged(id,
    flag)` marks the items that a boost lifts. A reranker takes precedence.
    """
    found = reciprocal_rank(legs(policy.prefetch), policy.store_k, policy.depth)
    if policy.rerank:
        return rerank(found, policy.rerank, policy.limit)
    if policy.boost > 0 and flagged is not None:
        lifted = boosted(found.join(flagged, "id", "left"), F.coalesce("flag", F.lit(False)), policy.boost, policy.limit)
        return lifted.select("qid", "id", "score", "rank")
    return found.where(F.col("rank") <= policy.limit)


def dual_search(first: DataFrame, second: DataFrame, wordings: DataFrame, limit: int, weights: tuple[float, float] = (1.0, 1.0), keep_top: int = 2) -> DataFrame:
    """Two wordings of a question searched and fused.

    first and second are ranked lists (qid, id, rank) of depth 2 * limit;
    wordings has qid, question, rewrite. Without a rewrite, or with one that is
    equal but for case and white space, the second list is left out.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), r"(?U)\s+", " "))
    differs = wordings.where(F.col("rewrite").isNotNull() & (F.trim("rewrite") != "") & (plain("rewrite") != plain("question"))).select("qid")
    lists = [(first, weights[0]), (second.join(differs, "qid", "left_semi"), weights[1])]
    rows = [x.where(F.col("rank") <= 2 * limit).select("qid", F.lit(n + 1).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit(w).alias("weight")) for n, (x, w) in enumerate(lists)]
    return fuse_lists(rows[0].unionByName(rows[1]), limit, keep_top)
