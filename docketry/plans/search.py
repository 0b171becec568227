"""Search queries: every vector, or document, whose id is divisible by 50 asks for its nearest others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.retrieval import SearchPolicy, dense_top_k, fuse_lists, postings, reciprocal_rank, rerank, search, sparse_top_k
from docketry.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LIMIT, PREFETCH, BOOST, STORE_K = 8, 50, 0.05, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents that may be shown: those with a source (the mandatory filter of every leg)."""
    shown = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("id"), "lang")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(shown, "id")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def shown_postings(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """Postings of the documents that may be shown, of the tokens that are asked for."""
    return postings(table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL"), "doc_id", "text", most=0.1, among=asked)


def title_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings(table(spark, d, "documents").where("doc_id % 50 = 0 AND title IS NOT NULL"), "doc_id", "title")


def sparse_leg(spark: SparkSession, d: str, k: int = PREFETCH) -> DataFrame:
    asked = title_postings(spark, d)
    return sparse_top_k(asked, shown_postings(spark, d, asked), k)


def dense_leg(spark: SparkSession, d: str, k: int = PREFETCH) -> DataFrame:
    return dense_top_k(asked(spark, d), vectors(spark, d), k)


_DENSE = """shown AS (SELECT doc_id AS id, lang FROM documents WHERE source IS NOT NULL),
 q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
 v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings JOIN shown ON id = vec_id),
 ds AS (SELECT qid, id, round(list_cosine_similarity(v, qv), 6) AS score FROM q, v),
 dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ds)"""
_POST = r"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS token FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
 every AS (SELECT id, token, round(1 + ln(count(*)::DOUBLE), 6) AS w FROM tok GROUP BY ALL),
 common AS (SELECT token FROM every GROUP BY 1 HAVING count(*) > 0.1 * (SELECT count(*) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)),
 p AS (SELECT * FROM every WHERE token NOT IN (SELECT token FROM common)),
 qtok AS (SELECT doc_id AS qid, unnest(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}]+')) AS token FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
 qp AS (SELECT qid, token, round(1 + ln(count(*)::DOUBLE), 6) AS qw FROM qtok GROUP BY ALL),
 ss AS (SELECT qid, id, round(sum(w * qw), 4) AS score FROM p JOIN qp USING (token) GROUP BY ALL),
 sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ss)"""
_HYBRID = f"""{_DENSE}, {_POST}, both_legs AS (SELECT qid, id, rank FROM dense WHERE rank <= {PREFETCH} UNION ALL SELECT qid, id, rank FROM sparse WHERE rank <= {PREFETCH}),
 f AS (SELECT qid, id, round(sum(1.0 / ({STORE_K} + rank - 1)), 9) AS score FROM both_legs GROUP BY ALL),
 hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"""


@query(f"WITH {_DENSE} SELECT qid, id, score, rank FROM dense WHERE rank <= 10")
def k01_dense_top_k(spark, d):
    return dense_leg(spark, d, 10)


@query(f"WITH {_POST} SELECT qid, id, score, rank FROM sparse WHERE rank <= 10")
def k02_sparse_top_k(spark, d):
    return sparse_leg(spark, d, 10)


@query(f"WITH {_HYBRID} SELECT qid, id, score, rank FROM hybrid WHERE rank <= {LIMIT}")
def k03_hybrid(spark, d):
    return reciprocal_rank([dense_leg(spark, d), sparse_leg(spark, d, PREFETCH)], STORE_K, LIMIT)


@query(f"WITH {_DENSE} SELECT q.qid, coalesce(max(score), 0.0) AS relevance FROM q LEFT JOIN dense USING (qid) GROUP BY 1")
def k04_relevance(spark, d):
    best = dense_leg(spark, d, 1).groupBy("qid").agg(F.max("score").alias("best"))
    return asked(spark, d).select("qid").join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("relevance"))


@query(f"""WITH {_HYBRID}, h AS (SELECT hybrid.*, lang FROM hybrid JOIN shown USING (id) WHERE rank <= {LIMIT + 4})
 SELECT qid, id, score, new_rank AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score + CASE WHEN lang = 'en' THEN {BOOST} ELSE 0 END, 9) DESC, rank) AS new_rank FROM h) WHERE new_rank <= {LIMIT}""")
def r02_boosted_search(spark, d):
    flagged = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("flag"))
    legs = lambda k: [dense_leg(spark, d, k), sparse_leg(spark, d, k)]
    return search(legs, SearchPolicy(limit=LIMIT, prefetch=PREFETCH, store_k=STORE_K, boost=BOOST), flagged)


@query(f"""WITH {_HYBRID}, h AS (SELECT qid, id, rank AS prerank_rank, score AS prerank_score FROM hybrid WHERE rank <= 30),
 n AS (SELECT h.*, coalesce(ds.score, 0.0) AS s FROM h LEFT JOIN ds USING (qid, id))
 SELECT qid, id, prerank_rank, prerank_score, s AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, prerank_rank) AS rank FROM n) WHERE rank <= {LIMIT}""")
def r03_rerank(spark, d):
    """Reranking through the seam; the stand-in score is the cosine of the pair, not a cross-encoder's."""
    short = reciprocal_rank([dense_leg(spark, d), sparse_leg(spark, d, PREFETCH)], STORE_K, 30)
    q, v = asked(spark, d).withColumnRenamed("vector", "qv"), vectors(spark, d).select("id", "vector")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def stand_in(found: DataFrame) -> DataFrame:
        pairs = found.join(q, "qid", "left").join(v, "id", "left")
        cosine = dot("vector", "qv") / F.sqrt(dot("vector", "vector") * dot("qv", "qv"))
        return pairs.withColumn("new_score", F.coalesce(F.round(cosine, 6), F.lit(0.0))).drop("qv", "vector")

    return rerank(short, stand_in, LIMIT).select("qid", "id", "prerank_rank", "prerank_score", "score", "rank")


@query(f"""WITH {_DENSE}, {_POST}, l AS (SELECT qid, 1 AS list_no, rank AS pos, id, 1.0 AS weight FROM dense WHERE rank <= 16 UNION ALL SELECT qid, 2, rank, id, 1.5 FROM sparse WHERE rank <= 16),
 s AS (SELECT qid, id, round(sum(weight / (60 + pos)), 12) AS score, min(list_no * 1000 + pos) AS seen, min(CASE WHEN pos <= 2 THEN list_no * 1000 + pos END) AS kept FROM l GROUP BY ALL),
 r AS (SELECT *, kept IS NOT NULL AND row_number() OVER (PARTITION BY qid ORDER BY kept NULLS LAST) <= {LIMIT} AS reserved FROM s),
 c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY reserved DESC, score DESC, seen) AS n FROM r)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM c WHERE n <= {LIMIT}""")
def r04_fused_lists(spark, d):
    one = dense_leg(spark, d, 16).select("qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit(1.0).alias("weight"))
    two = sparse_leg(spark, d, 16).select("qid", F.lit(2).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit(1.5).alias("weight"))
    return fuse_lists(one.unionByName(two), LIMIT, keep_top=2)


@query(f"WITH {_HYBRID}, pinned AS (SELECT doc_id AS id FROM documents WHERE source IS NOT NULL AND title IS NOT NULL ORDER BY doc_id LIMIT 3) SELECT q.qid, p.id, 0 AS rank FROM q, pinned p WHERE NOT EXISTS (SELECT 1 FROM hybrid h WHERE h.qid = q.qid AND h.id = p.id AND h.rank <= {LIMIT})")
def j12_pinned_not_found(spark, d):
    found = k03_hybrid(spark, d).select("qid", "id")
    pinned = table(spark, d, "documents").where("source IS NOT NULL AND title IS NOT NULL").select(F.col("doc_id").alias("id")).orderBy("id").limit(3)
    every = asked(spark, d).select("qid").join(F.broadcast(pinned))  # three rows
    return every.join(found, ["qid", "id"], "left_anti").withColumn("rank", F.lit(0))
