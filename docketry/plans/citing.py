"""Queries on citations, attribution and printed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.citing import COMMON_WORDS, attribute, body_size, drop_repeated_sections, line_kind, number_by_source, render_sources
from docketry.operators.maintenance import once
from docketry.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each source in a fixed order, numbered from 1."""
    c = once(table(spark, d, "chunks"), "id").where("chunk_text IS NOT NULL").select(F.col("source_id").alias("qid"), "id", "version", "chunk_index", F.col("source_url").alias("url"), F.col("chunk_text").alias("text"))
    return c.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("version", "chunk_index", "id")))


_C = "WITH c AS (SELECT DISTINCT ON (id) * FROM chunks), n AS (SELECT source_id AS qid, id, source_url AS url, chunk_text AS text, row_number() OVER (PARTITION BY source_id ORDER BY version, chunk_index, id) AS pos FROM c WHERE chunk_text IS NOT NULL)"
_STOP = "(" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + ")"


@query(_C + f""", lw AS (SELECT DISTINCT id AS qid, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{4,}}')) AS word FROM sources),
 a AS (SELECT qid, word, count(*) OVER (PARTITION BY qid) AS n FROM lw WHERE word NOT IN {_STOP}),
 b AS (SELECT DISTINCT qid, pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS word FROM n),
 s AS (SELECT a.qid, pos, count(*) / max(a.n) AS overlap FROM a JOIN b USING (qid, word) WHERE a.n >= 4 GROUP BY ALL)
 SELECT qid, 0 AS line_no, pos, round(overlap, 6) AS overlap FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, pos) = 1 AND overlap >= 0.6""")
def t22_attributed_titles(spark, d):
    """Each source's title attributed to the chunk of the source that holds most of its words."""
    lines = table(spark, d, "sources").where("title IS NOT NULL").select(F.col("id").alias("qid"), F.lit(0).alias("line_no"), F.col("title").alias("text"))
    return attribute(lines, numbered_chunks(spark, d))


@query(_C + "SELECT qid, sha256(string_agg('[' || pos || '] Source: ' || url || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS block_hash FROM n GROUP BY qid")
def t28_rendered_sources(spark, d):
    blocks = render_sources(numbered_chunks(spark, d).withColumn("trail", F.lit("")))
    return blocks.select("qid", F.sha2("block", 256).alias("block_hash"))


@query("""WITH l AS (SELECT DISTINCT ON (id) * FROM chat_logs), a AS (SELECT id AS qid, answer, source_urls[1] AS u1, source_urls[2] AS u2, source_urls[9] AS u9, len(source_urls) AS n FROM l WHERE len(source_urls) > 0 AND answer IS NOT NULL),
 k AS (SELECT *, n >= 2 AS two, n >= 9 AS nine FROM a), i AS (SELECT *, CASE WHEN two AND u1 <> u2 THEN 2 ELSE 1 END AS i1 FROM k),
 j AS (SELECT *, CASE WHEN NOT nine THEN NULL WHEN two AND u9 = u2 THEN 1 WHEN u9 = u1 THEN i1 ELSE i1 + 1 END AS i9 FROM i)
 SELECT qid, answer || ' ' || CASE WHEN two THEN '[1]' ELSE '' END || CASE WHEN two AND i1 = 1 THEN '' ELSE '[' || i1 || ']' END || ' and [' || i1 || '] ' || coalesce('[' || i9 || ']', '') AS text,
  (i1 + CASE WHEN i9 > i1 THEN 1 ELSE 0 END)::INT AS citations FROM j""")
def t19_numbered_by_source(spark, d):
    """Answers that cite their sources in turn, renumbered by source."""
    logs = once(table(spark, d, "chat_logs"), "id").where("size(source_urls) > 0 AND answer IS NOT NULL")
    answers = logs.select(F.col("id").alias("qid"), F.concat("answer", F.lit(" [2][1] and [1] [9]")).alias("text"))
    chunks = logs.select(F.col("id").alias("qid"), F.posexplode("source_urls").alias("p", "url")).select("qid", (F.col("p") + 1).alias("pos"), "url", F.concat_ws(":", "qid", "p").alias("chunk_id"))
    return number_by_source(answers, chunks).select("qid", "text", F.size("citations").alias("citations"))


@query("""WITH c AS (SELECT DISTINCT ON (extract_id) extract_id AS doc, text FROM extracted_chunks WHERE text IS NOT NULL),
 i AS (SELECT doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM c),
 k AS (SELECT *, CASE WHEN length(text) < 60 THEN 'h2' ELSE 'p' END AS kind FROM i),
 m AS (SELECT *, count(CASE WHEN kind = 'h2' THEN 1 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM k),
 h AS (SELECT doc, section, row_number() OVER (PARTITION BY doc, lower(text) ORDER BY pos) > 1 AS again FROM m WHERE kind = 'h2')
 SELECT m.doc, m.pos::INT AS pos, kind, text FROM m LEFT JOIN h USING (doc, section) WHERE NOT coalesce(again, FALSE)""")
def n11_sections_once(spark, d):
    c = once(table(spark, d, "extracted_chunks"), "extract_id").where("text IS NOT NULL").select(F.col("extract_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return drop_repeated_sections(c.withColumn("kind", F.when(F.length("text") < 60, "h2").otherwise("p")))


@query("""WITH w AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_quantity / 2 AS size FROM lineitem),
 r AS (SELECT doc, round_even(size, 0) AS size, count(*) AS n, min(pos) AS f FROM w GROUP BY ALL)
 SELECT doc, size::DOUBLE AS size FROM r QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f, size) = 1""")
def a15_body_size(spark, d):
    """The most frequent size of an order's lines, as of the words of a page."""
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") / 2).alias("size"))
    return body_size(w).withColumn("size", F.col("size").cast("double"))


@query(r"""WITH c AS (SELECT DISTINCT ON (extract_id) extract_id, text FROM extracted_chunks WHERE text IS NOT NULL),
 x AS (SELECT extract_id, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM c),
 s AS (SELECT *, CASE (extract_id + line_no) % 4 WHEN 0 THEN 14.0 WHEN 1 THEN 12.0 WHEN 2 THEN 10.8 ELSE 10.0 END / 10.0 AS r FROM x)
 SELECT extract_id, line_no, CASE WHEN r >= 1.08 THEN 'heading' WHEN regexp_matches(t, '^([•●■\-*]|\d+[.)]|\([a-zA-Z0-9]+\)|[a-zA-Z][.)])\s+(.+)$') THEN 'list_item' ELSE 'paragraph' END AS type,
 CASE WHEN r >= 1.4 THEN 1 WHEN r >= 1.2 THEN 2 WHEN r >= 1.08 THEN 3 ELSE 0 END AS level FROM s""")
def d03_line_kinds(spark, d):
    """Every line of the extracted chunks, classified as if printed in one of four sizes."""
    c = once(table(spark, d, "extracted_chunks"), "extract_id").where("text IS NOT NULL").select("extract_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    k = (F.col("extract_id") + F.col("line_no")) % 4
    size = F.when(k == 0, 14.0).when(k == 1, 12.0).when(k == 2, 10.8).otherwise(10.0)
    kind = line_kind(size, F.lit(10.0), F.col("t"))
    return c.select("extract_id", "line_no", kind["type"].alias("type"), kind["level"].alias("level"))


@query("WITH c AS (SELECT DISTINCT ON (id) * FROM chunks) SELECT source_id, count(*) AS chunks, round(avg(greatest(1, length(chunk_text) // 4)), 1) AS mean_tokens, max(length(chunk_text)) AS longest FROM c GROUP BY 1")
def a12_extraction_summary(spark, d):
    c = once(table(spark, d, "chunks"), "id")
    return c.groupBy("source_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 4))), 1).alias("mean_tokens"), F.max(F.length("chunk_text")).alias("longest"))


@query("SELECT id, regexp_matches(url, '(?i)^https?://') AS safe FROM sources")
def pr10_safe_urls(spark, d):
    return table(spark, d, "sources").select("id", F.col("url").rlike("(?i)^https?://").alias("safe"))


@query("SELECT DISTINCT id, least(greatest(coalesce(retrieved_count, 0), 1), 50) AS clamped FROM chat_logs")
def pr14_clamped(spark, d):
    return table(spark, d, "chat_logs").select("id", F.least(F.greatest(F.coalesce("retrieved_count", F.lit(0)), F.lit(1)), F.lit(50)).alias("clamped")).distinct()


@query("""WITH l AS (SELECT DISTINCT ON (id) * FROM chat_logs WHERE session_id IS NOT NULL AND question IS NOT NULL), a AS (SELECT *, regexp_matches(trim(question), '(?i)^(?:yes|yeah|ok|okay|sure|please|thanks?|thank you|more)[\\s!.,?]*$') AS accepts FROM l)
 SELECT session_id, coalesce(arg_max(question, (created_at, id)) FILTER (NOT accepts), arg_max(question, (created_at, id))) AS last_real FROM a GROUP BY 1""")
def t32_last_real_question(spark, d):
    """The newest question of a session that is more than an acceptance, else its newest."""
    l = once(table(spark, d, "chat_logs"), "id").where("session_id IS NOT NULL AND question IS NOT NULL")
    accepts = F.trim("question").rlike(r"(?i)^(?:yes|yeah|ok|okay|sure|please|thanks?|thank you|more)[\s!.,?]*$")
    at = F.struct("created_at", "id")
    return l.withColumn("accepts", accepts).groupBy("session_id").agg(F.coalesce(F.max_by("question", F.when(~F.col("accepts"), at)), F.max_by("question", at)).alias("last_real"))
