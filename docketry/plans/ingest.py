"""Queries on indexing, payloads, audit rows and the small operators around a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators import textops as T
from docketry.operators.indexing import change_action, fingerprint, index_run, log_events, payload, result_of, union_in_order, with_ocr_fallback
from docketry.operators.maintenance import index_diff, once, patch, text_diff
from docketry.operators.retrieval import SearchPolicy, dual_search, postings, search, sparse_top_k
from docketry.operators.usage import turn_format
from docketry.plans.search import _HYBRID, LIMIT, STORE_K, dense_leg, shown_postings, sparse_leg, vectors
from docketry.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
C = "WITH c AS (SELECT DISTINCT ON (id) * FROM chunks)"
L = "WITH l AS (SELECT DISTINCT ON (id) * FROM chat_logs)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks"), "id")


def logs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chat_logs"), "id")


# ---- the index run: the chunks of each source's latest version extracted again, every third one changed, and one new chunk a source ----
def indexed(spark: SparkSession, d: str):
    c = chunks(spark, d).where("source_id IS NOT NULL AND version IS NOT NULL").select("id", "source_id", "source_version_id", "version", "chunk_index", "content_hash", "review_status")
    latest = c.groupBy("source_id").agg(F.max(F.struct("version", "source_version_id")).alias("x")).select("source_id", F.col("x.source_version_id").alias("source_version_id"), F.col("x.version").alias("version"))
    again = c.join(latest, ["source_id", "source_version_id", "version"], "left_semi").select("id", "source_id", "source_version_id", "version", "chunk_index", F.when(F.col("chunk_index") % 3 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    new = latest.select(F.concat(F.lit("new-"), "source_id").alias("id"), "source_id", "source_version_id", "version", F.lit(-1).alias("chunk_index"), F.lit("h").alias("content_hash"))
    records = again.unionByName(new)
    points = c.select("id", F.array(F.lit(0.0)).alias("vector"), "review_status")
    audit = spark.createDataFrame([], "entity_type string, entity_id string, action string, details string, actor string")
    return index_run(c, points, audit, records, records.select("id", F.array(F.lit(1.0)).alias("vector")))


_RUN = C + """, a AS (SELECT id, source_id, source_version_id, version, chunk_index, content_hash, review_status FROM c WHERE source_id IS NOT NULL AND version IS NOT NULL),
 latest AS (SELECT source_id, source_version_id, version FROM a QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC, source_version_id DESC NULLS LAST) = 1),
 again AS (SELECT a.*, chunk_index % 3 = 0 AS changed FROM a JOIN latest l ON a.source_id = l.source_id AND a.source_version_id = l.source_version_id AND a.version = l.version),
 st AS (SELECT id, source_id, source_version_id, version, 'rec' AS part, review_status AS before, CASE WHEN review_status IS NULL THEN 'pending_review' WHEN review_status = 'superseded' THEN 'superseded' WHEN changed AND content_hash IS NOT NULL THEN 'pending_review' ELSE review_status END AS review_status FROM again
  UNION ALL SELECT 'new-' || source_id, source_id, source_version_id, version, 'rec', NULL, 'pending_review' FROM latest
  UNION ALL SELECT a.id, a.source_id, a.source_version_id, a.version, CASE WHEN a.review_status <> 'superseded' THEN 'stale' ELSE 'rest' END, a.review_status, CASE WHEN a.review_status <> 'superseded' THEN 'superseded' ELSE a.review_status END FROM a WHERE a.id NOT IN (SELECT id FROM again))"""


@query(_RUN + " SELECT id, review_status FROM st")
def d15_index_run(spark, d):
    """The chunk table after an index run of every source."""
    return indexed(spark, d).chunks.select("id", "review_status")


@query(_RUN + " SELECT id, CASE WHEN part = 'rec' THEN 1.0 ELSE 0.0 END::DOUBLE AS vector, review_status FROM st")
def d15_index_points(spark, d):
    return indexed(spark, d).points.select("id", F.col("vector")[0].cast("double").alias("vector"), "review_status")


@query(_RUN + """ SELECT 'source_version' AS entity_type, source_version_id AS entity_id, 'review_reset_content_changed' AS action, to_json({'chunk_ids': list_sort(list(id))})::VARCHAR AS details, 'system' AS actor FROM st WHERE part = 'rec' AND before IN ('approved', 'rejected') AND review_status = 'pending_review' GROUP BY source_version_id
 UNION ALL SELECT 'source_version', source_version_id, 'chunks_embedded', to_json({'version': version, 'chunk_count': count(*)})::VARCHAR, 'system' FROM st WHERE part = 'rec' GROUP BY source_id, source_version_id, version
 UNION ALL SELECT 'source', source_id, 'chunks_superseded', to_json({'superseded_chunk_ids': list_sort(list(id))})::VARCHAR, 'system' FROM st WHERE part = 'stale' GROUP BY source_id""")
def d15_index_audit(spark, d):
    return indexed(spark, d).audit


@query(_RUN + " SELECT source_id, max(version) FILTER (part = 'rec') AS version, count(*) FILTER (part = 'rec') AS chunks_created, count(*) FILTER (part = 'stale') AS chunks_superseded FROM st GROUP BY 1")
def d15_index_summary(spark, d):
    return indexed(spark, d).summary


@query("""WITH p AS (SELECT DISTINCT ON (raw_content_path) raw_content_path, page_text FROM raw_pages WHERE page_text IS NOT NULL)
 SELECT raw_content_path, sha256(regexp_replace(array_to_string(list_filter(string_split(page_text, chr(10)), lambda x: trim(x) <> ''), chr(10)), 'z', 'y', 'g')) AS text_hash FROM p""")
def d12_fingerprints(spark, d):
    """Fingerprints of pages by the texts of their blocks (one block a line that is not blank)."""
    p = once(table(spark, d, "raw_pages").where("page_text IS NOT NULL"), "raw_content_path")
    blocks = F.transform(F.filter(F.split("page_text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.replace(x, F.lit("z"), F.lit("y")).alias("text")))
    return p.select("raw_content_path", fingerprint(blocks).alias("text_hash"))


@query("""WITH p AS (SELECT raw_content_path, md5(min(page_text)) AS t FROM raw_pages GROUP BY 1), v AS (SELECT v.id, s.source_type, v.content_hash AS h, p.t, row_number() OVER w AS n, lag(v.content_hash) OVER w AS ph, lag(p.t) OVER w AS pt
  FROM source_versions v JOIN sources s ON s.id = v.source_id LEFT JOIN p USING (raw_content_path) WHERE fetch_status = 'success' AND content_hash IS NOT NULL WINDOW w AS (PARTITION BY v.source_id ORDER BY version, v.id))
 SELECT id, CASE WHEN ph IS NULL THEN 'first' WHEN ph = h THEN 'identical_bytes' WHEN source_type = 'html' AND pt = t THEN 'identical_extracted_text' ELSE 'new_version' END AS action FROM v""")
def d13_change_actions(spark, d):
    """What each successful fetch meant, by bytes and, for pages, by text; a page whose text is not stored counts as changed."""
    pages = table(spark, d, "raw_pages").groupBy("raw_content_path").agg(F.md5(F.min("page_text")).alias("t"))
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "source_type")
    v = table(spark, d, "source_versions").where("fetch_status = 'success' AND content_hash IS NOT NULL").join(s, "source_id").join(pages, "raw_content_path", "left")
    w = Window.partitionBy("source_id").orderBy("version", "id")
    v = v.withColumn("ph", F.lag("content_hash").over(w)).withColumn("pt", F.lag("t").over(w))
    return v.select("id", change_action(F.col("source_type"), F.col("ph"), F.col("content_hash"), F.col("pt"), F.col("t")).alias("action"))


@query(r"""WITH e AS (SELECT DISTINCT ON (extract_id) extract_id AS page, raw_content_path AS doc, text FROM extracted_chunks WHERE text IS NOT NULL AND raw_content_path IS NOT NULL),
 n AS (SELECT *, page % 3 = 0 AS poor FROM e),
 l AS (SELECT doc, page, 1 AS late, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) - 1 AS pos FROM n WHERE poor),
 t AS (SELECT doc, page, late, pos, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM l),
 m AS (SELECT doc, late, page, pos, line, regexp_extract(line, '^([•●■\-*]|\d+[.)]|\([a-zA-Z0-9]+\)|[a-zA-Z][.)])\s+(.+)$', 1) AS marker, regexp_extract(line, '^([•●■\-*]|\d+[.)]|\([a-zA-Z0-9]+\)|[a-zA-Z][.)])\s+(.+)$', 2) AS rest FROM t WHERE line <> ''),
 u AS (SELECT doc, 0 AS late, page, 0 AS pos, 'paragraph' AS type, text, NULL AS ordinal, 'native' AS source FROM n WHERE NOT poor
  UNION ALL SELECT doc, late, page, pos, CASE WHEN marker <> '' THEN 'list_item' ELSE 'paragraph' END, CASE WHEN marker <> '' THEN rest ELSE line END, nullif(marker, ''), 'ocr' FROM m)
 SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY late, page, pos) - 1)::INT AS place, type, md5(text) AS text_hash, ordinal, page, source FROM u""")
def d04_ocr_fallback(spark, d):
    """Extracted texts as pages of their documents, every third one without words of its own and read by the recogniser instead."""
    e = once(table(spark, d, "extracted_chunks"), "extract_id").where("text IS NOT NULL AND raw_content_path IS NOT NULL").select(F.col("raw_content_path").alias("doc"), F.col("extract_id").alias("page"), "text")
    words = e.select("doc", "page", F.when(F.col("page") % 3 == 0, 4).otherwise(5).alias("n"))
    native = e.select("doc", "page", F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("string").alias("ordinal"))
    return with_ocr_fallback(native, words, e).select("doc", "place", "type", F.md5("text").alias("text_hash"), "ordinal", "page", "source")


_TWO = C + """, n AS (SELECT source_id, version, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS rn FROM (SELECT DISTINCT source_id, version FROM c)),
 p AS (SELECT source_id, max(version) AS nv, min(version) AS ov FROM n WHERE rn <= 2 GROUP BY 1 HAVING max(version) > min(version)),
 t AS (SELECT c.*, nv, ov, version = nv AS fresh FROM c JOIN p USING (source_id) WHERE version IN (nv, ov))"""


@query(_TWO + """, h AS (SELECT source_id, nv, ov, content_hash, bool_or(fresh) AS a, bool_or(NOT fresh) AS b, list_filter(list(chunk_index), lambda x: x IS NOT NULL) AS idx FROM t GROUP BY ALL)
 SELECT source_id, ov AS previous_version, nv AS latest_version, coalesce(array_to_string(list_sort(flatten(list(idx) FILTER (a AND NOT b))), ','), '') AS added, coalesce(array_to_string(list_sort(flatten(list(idx) FILTER (b AND NOT a))), ','), '') AS removed FROM h GROUP BY ALL""")
def v05_index_diffs(spark, d):
    """Added and removed chunk indices between the two latest versions of each source."""
    x = index_diff(chunks(spark, d).select("source_id", "version", "content_hash", "chunk_index"))
    return x.select("source_id", "previous_version", "latest_version", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query()
def v05_text_diffs(spark, d):
    return text_diff(chunks(spark, d).select("source_id", "version", "chunk_index", "chunk_text"))


# ---- payloads and results ----
@query(C + """ SELECT id, strftime(retrieval_date, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(retrieval_date) % 1000000 <> 0 THEN '.' || lpad((epoch_us(retrieval_date) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS retrieved, review_status, chunk_index, array_to_string(jurisdiction, ',') AS jurisdiction FROM c""")
def pr17_payloads(spark, d):
    p = chunks(spark, d).select("id", payload(chunks(spark, d)).alias("payload"))
    return p.select("id", F.col("payload.retrieval_date").alias("retrieved"), "payload.review_status", "payload.chunk_index", F.array_join("payload.jurisdiction", ",").alias("jurisdiction"))


@query(C + " SELECT source_id AS qid, row_number() OVER (PARTITION BY source_id ORDER BY id)::INT AS rank, id AS chunk_id, source_url, version, chunk_text FROM c WHERE review_status = 'approved' QUALIFY rank <= 5")
def pr11_results(spark, d):
    """The first five approved chunks of each source as search results."""
    c = chunks(spark, d).where("review_status = 'approved'")
    ranked = c.select(F.col("source_id").alias("qid"), "id", payload(c).alias("payload"), F.row_number().over(Window.partitionBy("source_id").orderBy("id")).alias("rank"), F.lit(0.0).alias("score")).where("rank <= 5")
    return result_of(ranked).select("qid", "rank", "chunk_id", "source_url", "version", "chunk_text")


@query(C + " SELECT id, source_id FROM c WHERE review_status = 'approved' AND canonical AND service_category IN ('oci', 'visa')")
def pr02_approved_only(spark, d):
    """The mandatory status stands beside whatever the caller asks for."""
    return chunks(spark, d).where(F.col("review_status") == "approved").where(F.col("canonical") & F.col("service_category").isin("oci", "visa")).select("id", "source_id")


@query(C + " SELECT id, chunk_index, review_status FROM c WHERE id = (SELECT min(id) FROM chunks)")
def pr06_chunk_by_id(spark, d):
    c = chunks(spark, d).select("id", "chunk_index", "review_status")
    return c.join(F.broadcast(c.agg(F.min("id").alias("id"))), "id", "left_semi")


@query(C + " SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS place FROM c WHERE review_status = 'pending_review'")
def pr08_pending_ids(spark, d):
    w = Window.partitionBy("source_id").orderBy("chunk_index", "id")
    return chunks(spark, d).where("review_status = 'pending_review'").select("source_id", "id", F.row_number().over(w).cast("long").alias("place"))


@query(C + " SELECT id, source_url FROM (SELECT * FROM c WHERE review_status = 'approved' AND service_category = 'oci' ORDER BY source_id, chunk_index, id LIMIT 20)")
def s13_scroll_filtered(spark, d):
    return chunks(spark, d).where("review_status = 'approved' AND service_category = 'oci'").orderBy("source_id", "chunk_index", "id").limit(20).select("id", "source_url")


@query(C + " SELECT id, 'superseded' AS review_status, source_url FROM c WHERE version = 1 UNION ALL SELECT id, review_status, source_url FROM c WHERE version IS DISTINCT FROM 1")
def w10_patched_payloads(spark, d):
    c = chunks(spark, d).select("id", "review_status", "source_url", "version")
    return patch(c, c.where("version = 1"), "id", {"review_status": F.lit("superseded")}).drop("version")


@query("SELECT id, active AND NOT canonical AS active FROM sources")
def w12_source_flags(spark, d):
    s = table(spark, d, "sources").select("id", "active", "canonical")
    return patch(s, s.where("canonical"), "id", {"active": F.lit(False)}).drop("canonical")


@query("SELECT 'source_version' AS entity_type, id AS entity_id, 'fetch_failed' AS action, to_json({'version': version, 'source_id': source_id})::VARCHAR AS details, 'system' AS actor FROM source_versions WHERE fetch_status = 'failure' UNION ALL SELECT 'source', id, 'listed', NULL, 'registry' FROM sources")
def w05_audit_events(spark, d):
    audit = spark.createDataFrame([], "entity_type string, entity_id string, action string, details string, actor string")
    failed = table(spark, d, "source_versions").where("fetch_status = 'failure'").withColumn("entity_id", F.col("id"))
    audit = log_events(audit, "source_version", failed, "fetch_failed", F.struct("version", "source_id"))
    return log_events(audit, "source", table(spark, d, "sources").withColumn("entity_id", F.col("id")), "listed", actor="registry")


@query(L + " SELECT mode, count(*) AS n, max(id) AS newest FROM (SELECT id, mode FROM l UNION ALL SELECT id + (SELECT max(id) FROM l), 'replayed' FROM l WHERE is_followup) GROUP BY 1")
def w06_appended_logs(spark, d):
    l = logs(spark, d).select("id", "mode", "is_followup")
    new = l.where("is_followup").join(F.broadcast(l.agg(F.max("id").alias("last")))).select((F.col("id") + F.col("last")).alias("id"), F.lit("replayed").alias("mode"))
    return l.select("id", "mode").unionByName(new).groupBy("mode").agg(F.count("*").alias("n"), F.max("id").alias("newest"))


@query(L + ", u AS (SELECT id AS qid, url, min(p) AS p FROM (SELECT id, unnest(source_urls) AS url, generate_subscripts(source_urls, 1) AS p FROM l UNION ALL SELECT id, source_urls[1], 0 FROM l WHERE len(source_urls) > 1 UNION ALL SELECT id, source_urls[2], -1 FROM l WHERE len(source_urls) > 1) GROUP BY ALL) SELECT qid, url AS id, row_number() OVER (PARTITION BY qid ORDER BY p)::INT AS place FROM u")
def u02_union_in_order(spark, d):
    """Two lists of a conversation's addresses, the second and first one before all of them."""
    l = logs(spark, d).where("size(source_urls) > 0")
    one = l.where("size(source_urls) > 1").select(F.col("id").alias("qid"), F.lit(1).alias("list_no"), F.posexplode(F.array(F.col("source_urls")[1], F.col("source_urls")[0])).alias("pos", "id"))
    two = l.select(F.col("id").alias("qid"), F.lit(2).alias("list_no"), F.posexplode("source_urls").alias("pos", "id"))
    return union_in_order(one.unionByName(two))


# ---- searches run by a policy ----
def legs(spark, d):
    return lambda k: [dense_leg(spark, d, k), sparse_leg(spark, d, k)]


@query(f"WITH {_HYBRID} SELECT qid, id, score, rank FROM hybrid WHERE rank <= 5")
def r01_plain_search(spark, d):
    return search(legs(spark, d), SearchPolicy(limit=5, store_k=STORE_K))


@query(f"""WITH {_HYBRID}, h AS (SELECT hybrid.*, lang FROM hybrid JOIN shown USING (id) WHERE rank <= {LIMIT + 4})
 SELECT qid, id, score, new_rank AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score + CASE WHEN lang = 'de' THEN 0.1 ELSE 0 END, 9) DESC, rank) AS new_rank FROM h) WHERE new_rank <= {LIMIT}""")
def r01_boosted_search(spark, d):
    flagged = vectors(spark, d).select("id", F.coalesce(F.col("lang") == "de", F.lit(False)).alias("flag"))
    return search(legs(spark, d), SearchPolicy(limit=LIMIT, store_k=STORE_K, boost=0.1), flagged)


_WORDINGS = r"""wq AS (SELECT doc_id AS qid, title AS question, CASE WHEN doc_id % 100 = 0 THEN upper(title) ELSE regexp_replace(title, '^\S+\s+', '') END AS rewrite FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
 rtok AS (SELECT qid, unnest(regexp_extract_all(lower(rewrite), '[\p{L}\p{M}\p{N}]+')) AS token FROM wq WHERE lower(rewrite) <> lower(question)),
 rp AS (SELECT qid, token, round(1 + ln(count(*)::DOUBLE), 6) AS qw FROM rtok GROUP BY ALL),
 rs AS (SELECT qid, id, round(sum(w * qw), 4) AS score FROM p JOIN rp USING (token) GROUP BY ALL),
 second AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM rs),"""


@query(f"""WITH {_HYBRID}, {_WORDINGS} l AS (SELECT qid, 1 AS list_no, rank AS pos, id FROM sparse WHERE rank <= 16 UNION ALL SELECT qid, 2, rank, id FROM second WHERE rank <= 16),
 s AS (SELECT qid, id, round(sum(1.0 / (60 + pos)), 12) AS score, min(list_no * 1000 + pos) AS seen, min(CASE WHEN pos <= 2 THEN list_no * 1000 + pos END) AS kept FROM l GROUP BY ALL),
 r AS (SELECT *, kept IS NOT NULL AND row_number() OVER (PARTITION BY qid ORDER BY kept NULLS LAST) <= {LIMIT} AS reserved FROM s),
 c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY reserved DESC, score DESC, seen) AS n FROM r)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM c WHERE n <= {LIMIT}""")
def r05_dual_wordings(spark, d):
    """Titles and their rewrites searched and fused; a rewrite that is the title in capitals is no second wording."""
    docs = table(spark, d, "documents").where("doc_id % 50 = 0 AND title IS NOT NULL")
    rewrite = F.when(F.col("doc_id") % 100 == 0, F.upper("title")).otherwise(F.regexp_replace("title", r"^\S+\s+", ""))
    wordings = docs.select(F.col("doc_id").alias("qid"), F.col("title").alias("question"), rewrite.alias("rewrite"))
    one, two = postings(wordings, "qid", "question"), postings(wordings, "qid", "rewrite")
    posted = shown_postings(spark, d, one.unionByName(two))
    first, second = sparse_top_k(one, posted, 2 * LIMIT), sparse_top_k(two, posted, 2 * LIMIT)
    return dual_search(first, second, wordings, LIMIT)


# ---- conversation and answers ----
_TURNS = L + ", q AS (SELECT id, session_id, question, list(question) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS e FROM l WHERE session_id IS NOT NULL AND question IS NOT NULL), w AS (SELECT id, question, coalesce(e, []) AS e FROM q)"


def _with_earlier(spark, d):
    w = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(-3, -1)
    return logs(spark, d).where("session_id IS NOT NULL AND question IS NOT NULL").select("id", "question", F.collect_list("question").over(w).alias("earlier"))


@query(_TURNS + " SELECT id, array_to_string(list_concat(e[greatest(len(e) - 1, 1):len(e)], [question]), ' ') AS search_text FROM w")
def t08_retrieval_queries(spark, d):
    return _with_earlier(spark, d).select("id", T.retrieval_query(F.col("question"), F.col("earlier")).alias("search_text"))


@query(L + """, r AS (SELECT id, CASE id % 4 WHEN 0 THEN chr(10) || '  Query: "' || question || '"' || chr(10) || 'more' WHEN 1 THEN question WHEN 2 THEN '   ' ELSE NULL END AS raw FROM l WHERE question IS NULL OR NOT regexp_matches(question, '[\\n\\r"''`]|^\\s|\\s$|(?i)query')),
 n AS (SELECT id, raw, CASE id % 4 WHEN 0 THEN trim(regexp_extract(raw, '"(.*)"', 1)) WHEN 1 THEN trim(raw) END AS line FROM r) SELECT id, CASE WHEN line <> '' AND length(line) <= 200 THEN line END AS rewritten FROM n""")
def t09_clean_rewrites(spark, d):
    """Replies of a rewriting model made of the questions: labelled and quoted, plain, blank and missing."""
    k = F.col("id") % 4
    l = logs(spark, d).where(F.col("question").isNull() | ~F.col("question").rlike(r"[\n\r\"'`]|^\s|\s$|(?i)query"))
    raw = F.when(k == 0, F.concat(F.lit('\n  Query: "'), "question", F.lit('"\nmore'))).when(k == 1, F.col("question")).when(k == 2, "   ")
    return l.select("id", T.clean_rewrite(raw).alias("rewritten"))


@query(_TURNS + " SELECT id, CASE WHEN len(e) > 0 THEN 'Earlier questions in this conversation:' || chr(10) || array_to_string(list_transform(e, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || 'New message: ' || question ELSE question END AS prompt FROM w")
def t10_rewrite_prompts(spark, d):
    return _with_earlier(spark, d).select("id", T.rewrite_prompt(F.col("question"), F.col("earlier")).alias("prompt"))


@query(L + """, t AS (SELECT session_id AS conv, created_at, id, 0 AS part, 'user' AS role, question AS content FROM l UNION ALL SELECT session_id, created_at, id, 1, 'assistant', answer FROM l),
 k AS (SELECT conv, created_at, id, part, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, content FROM t WHERE conv IS NOT NULL AND content IS NOT NULL),
 g AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY conv ORDER BY created_at NULLS FIRST, id, part)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv ORDER BY created_at NULLS FIRST, id, part) AS run FROM g)
 SELECT conv, run::BIGINT AS run, min(role) AS role, string_agg(content, '|' ORDER BY created_at NULLS FIRST, id, part) AS parts FROM r GROUP BY conv, run
 UNION ALL SELECT DISTINCT conv, 0, 'system', 'Answer from the sources.' || chr(10) || chr(10) || 'Be brief.' FROM k""")
def t33_turn_formats(spark, d):
    """The turns of each session with two system texts before them."""
    l = logs(spark, d).where("session_id IS NOT NULL")
    said = l.select(F.col("session_id").alias("conv"), "created_at", "id", F.posexplode(F.array("question", "answer")).alias("part", "content")).where("content IS NOT NULL")
    turns = said.select("conv", F.struct(F.lit(1).alias("late"), "created_at", "id", "part").alias("turn"), F.when(F.col("part") == 0, "user").otherwise("assistant").alias("role"), "content")
    first = said.select("conv").distinct().select("conv", F.posexplode(F.array(F.lit("Answer from the sources."), F.lit("Be brief."))).alias("part", "content"))
    first = first.select("conv", F.struct(F.lit(0).alias("late"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("long").alias("id"), "part").alias("turn"), F.lit("system").alias("role"), "content")
    return turn_format(turns.unionByName(first)).select("conv", "run", "role", F.array_join("parts", "|").alias("parts"))


@query(L + " SELECT id, 'The visitor asked: ' || question || chr(10) || chr(10) || 'Here is the correct written answer:' || chr(10) || chr(10) || answer || chr(10) || chr(10) || 'Rewrite it as a short spoken reply, following the rules exactly.' AS prompt FROM l WHERE answer IS NOT NULL")
def t40_voice_prompts(spark, d):
    return logs(spark, d).where("answer IS NOT NULL").select("id", T.voice_prompt(F.col("question"), F.col("answer")).alias("prompt"))


@query(L + r""", x AS (SELECT id, answer || (SELECT string_agg(', then the part number ' || n || ' of it', '' ORDER BY n) FROM range(12) t(n)) || '. Done.' AS t FROM l WHERE answer IS NOT NULL),
 p AS (SELECT id, string_split(regexp_replace(t, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM x),
 e AS (SELECT id, regexp_replace(unnest(s), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s, generate_subscripts(s, 1) AS i FROM p),
 n AS (SELECT *, len(list_filter(regexp_split_to_array(s, '[\s\p{Z}]+'), lambda w: w <> '')) AS n FROM e WHERE s <> ''),
 c AS (SELECT id, i, string_split(regexp_replace(s, ',[\s\p{Z}]+', ',' || chr(1), 'g'), chr(1)) AS c FROM n WHERE n > 30),
 d AS (SELECT id, i, unnest(c) AS piece, generate_subscripts(c, 1) AS j FROM c),
 w AS (SELECT *, len(list_filter(regexp_split_to_array(piece, '[\s\p{Z}]+'), lambda x: x <> '')) AS n FROM d),
 r AS (SELECT id, i, list(n ORDER BY j) AS ns, list(piece ORDER BY j) AS ps FROM w GROUP BY id, i),
 f AS (SELECT id, i, ps, list_reduce(list_prepend({'g': 0, 'upto': 0, 'all': []::INT[]}, list_transform(ns, lambda n: {'g': 0, 'upto': n::INT, 'all': []::INT[]})), lambda a, b: CASE WHEN a.upto > 0 AND a.upto + b.upto > 30 THEN {'g': a.g + 1, 'upto': b.upto, 'all': list_append(a.all, a.g + 1)} ELSE {'g': a.g, 'upto': a.upto + b.upto, 'all': list_append(a.all, a.g)} END) AS z FROM r),
 o AS (SELECT id, i, unnest(ps) AS piece, unnest(z.all) AS g, generate_subscripts(ps, 1) AS j FROM f),
 u AS (SELECT id, i, 0 AS g, s AS sentence FROM n WHERE n <= 30 UNION ALL SELECT id, i, g, string_agg(piece, ' ' ORDER BY j) FROM o GROUP BY id, i, g)
 SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i, g) - 1)::INT AS place, sentence FROM u""")
def t31_spoken_sentences(spark, d):
    """Answers cut for speaking, with a long list of commas added."""
    long = F.concat_ws(", ", F.col("answer"), *[F.lit(f"then the part number {n} of it") for n in range(12)])
    return logs(spark, d).where("answer IS NOT NULL").select("id", F.posexplode(T.spoken_sentences(F.concat(long, F.lit(". Done.")))).alias("place", "sentence"))


@query("SELECT id, '[' || (length(id) % 9) || '] ' || upper(coalesce(service_category, 'source')) || ' ' || coalesce(title, 'source') AS title FROM sources")
def t42_citation_titles(spark, d):
    return table(spark, d, "sources").select("id", T.citation_title(F.length("id") % 9, F.col("service_category"), F.col("title")).alias("title"))


@query("SELECT id, trim(title) AS label FROM sources WHERE title IS NOT NULL")
def t42_citation_labels(spark, d):
    """Composed titles parsed again."""
    s = table(spark, d, "sources").where("title IS NOT NULL")
    return s.select("id", T.citation_label(T.citation_title(F.lit(1), F.col("service_category"), F.col("title")), F.col("url")).alias("label"))


_MONEY, _SPANS = r"(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)? (?:crowns|dollars))", r"(?i)\d+(?:\s*(?:-|to)\s*\d+)? (?:working |business )?(?:day|week|month|year|hour|minute)s?"


@query(L + rf""", a AS (SELECT id, answer, outcome, left(answer, 120) AS spoken FROM l WHERE answer IS NOT NULL),
 v AS (SELECT outcome, len(list_filter(list_concat(regexp_extract_all(answer, '{_MONEY}'), regexp_extract_all(answer, '{_SPANS}')), lambda x: NOT list_contains(list_concat(regexp_extract_all(spoken, '{_MONEY}'), regexp_extract_all(spoken, '{_SPANS}')), x))) = 0 AS kept FROM a)
 SELECT outcome, count(*) AS n, count(*) FILTER (kept) AS kept, round(avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM v GROUP BY 1""")
def a20_values_kept(spark, d):
    """Whether the first 120 characters of an answer, as if spoken, keep all its amounts and spans of time."""
    values = lambda c: F.concat(T.money_values(c), T.duration_values(c))
    a = logs(spark, d).where("answer IS NOT NULL").select("outcome", (F.size(F.array_except(values(F.col("answer")), values(F.substring("answer", 1, 120)))) == 0).alias("kept"))
    return a.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.round(F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)), 6).alias("ratio"))


@query("SELECT count(*) FILTER (fetch_status = 'success') AS successes, count(*) FILTER (fetch_status <> 'success') AS failures, bool_and(fetch_status <> 'success') FILTER (raw_content_path IS NULL) AS broken_failed FROM source_versions")
def a23_fetch_smoke(spark, d):
    v = table(spark, d, "source_versions")
    return v.agg(F.count_if(F.col("fetch_status") == "success").alias("successes"), F.count_if(F.col("fetch_status") != "success").alias("failures"), F.bool_and(F.when(F.col("raw_content_path").isNull(), F.col("fetch_status") != "success")).alias("broken_failed"))


@query(L + " SELECT id, CASE WHEN s IN (429, 500, 503) AND e + d < 45 THEN d END AS delay FROM (SELECT id, [200, 429, 404, 500, 503][(id % 5 + 1)::INT] AS s, coalesce(latency_ms, 0) / 1000.0 AS e, [2, 5, 10, NULL][(id % 4 + 1)::INT] AS d FROM l)")
def x04_retry_delays(spark, d):
    """The waits before the next attempt, if every conversation were a failed one."""
    status = F.get(F.array(*[F.lit(x) for x in (200, 429, 404, 500, 503)]), (F.col("id") % 5).cast("int"))
    return logs(spark, d).select("id", T.retry_delay((F.col("id") % 4 + 1).cast("int"), F.coalesce("latency_ms", F.lit(0)) / 1000.0, status).alias("delay"))
