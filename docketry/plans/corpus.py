"""Queries on the registry of sources, their versions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.columns import all_of, chunk_id, estimate_tokens, micros
from docketry.operators.maintenance import latest_per, move_keys, next_versions, once, patch, retain, upsert, version_diff
from docketry.runtime import table

AS_OF = "2031-06-01 00:00:00"
STATUSES = ("approved", "pending_review", "rejected", "superseded")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ONCE = "WITH c AS (SELECT DISTINCT ON (id) * FROM chunks), l AS (SELECT DISTINCT ON (id) * FROM chat_logs) "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks"), "id")


def tie(*names: str):
    return [F.asc_nulls_last(n) for n in names]


@query("SELECT id, title, source_group, row_number() OVER (ORDER BY source_group NULLS LAST, title NULLS LAST, id) AS place FROM sources WHERE active")
def s02_active_sources(spark, d):
    active = table(spark, d, "sources").where("active").select("id", "title", "source_group")
    # the registry is small by nature; its report is one ordered list
    return active.withColumn("place", F.row_number().over(Window.orderBy(*tie("source_group", "title", "id"))).cast("long"))


@query("SELECT id, url, service_category FROM sources WHERE url = (SELECT min(url) FROM sources)")
def s03_source_by_url(spark, d):
    s = table(spark, d, "sources")
    return s.join(F.broadcast(s.agg(F.min("url").alias("url"))), "url", "left_semi").select("id", "url", "service_category")


@query("SELECT id, url FROM sources WHERE regexp_matches(regexp_replace(url, '^[A-Za-z]+://[^/]+', ''), '^/passport') AND source_type = 'html'")
def s09_sources_by_path(spark, d):
    return table(spark, d, "sources").where((F.col("source_type") == "html") & F.parse_url("url", F.lit("PATH")).startswith("/passport")).select("id", "url")


@query(ONCE + "SELECT c.id, c.source_id, c.service_category FROM c WHERE review_status = 'approved' AND canonical AND list_contains(jurisdiction, 'all') AND service_category = 'oci'")
def pr01_metadata_filter(spark, d):
    return chunks(spark, d).where(all_of(F.col("review_status") == "approved", F.col("canonical"), F.array_contains("jurisdiction", "all"), F.col("service_category") == "oci", None)).select("id", "source_id", "service_category")


@query(ONCE + "SELECT id, source_id, chunk_index, count(*) OVER () AS total FROM c WHERE review_status = 'pending_review' ORDER BY source_id, chunk_index, id LIMIT 50 OFFSET 20")
def pr03_pending_page(spark, d):
    pending = chunks(spark, d).where("review_status = 'pending_review'").select("id", "source_id", "chunk_index")
    total = pending.agg(F.count("*").alias("total"))
    page = pending.orderBy("source_id", "chunk_index", "id").offset(20).limit(50)
    return page.join(F.broadcast(total))  # one row


@query(ONCE + "SELECT source_version_id, chunk_index, id FROM c WHERE source_version_id IN (SELECT min(id) FROM source_versions) ")
def pr04_chunks_of_version(spark, d):
    version = table(spark, d, "source_versions").agg(F.min("id").alias("source_version_id"))
    return chunks(spark, d).join(F.broadcast(version), "source_version_id", "left_semi").select("source_version_id", "chunk_index", "id")


@query(ONCE + ", v AS (SELECT source_id, max(version) AS latest FROM source_versions GROUP BY 1) SELECT c.id, c.source_id, c.version FROM c JOIN v USING (source_id) WHERE c.version <> latest")
def pr05_chunks_of_other_versions(spark, d):
    latest = table(spark, d, "source_versions").groupBy("source_id").agg(F.max("version").alias("latest"))
    return chunks(spark, d).join(latest, "source_id").where("version <> latest").select("id", "source_id", "version")


@query(ONCE + "SELECT id, review_status, version FROM c WHERE id IN (SELECT DISTINCT lower(id) FROM chunk_snapshots WHERE snapshot_no = 1)")
def pr07_state_of_ids(spark, d):
    ids = table(spark, d, "chunk_snapshots").where("snapshot_no = 1").select(F.lower("id").alias("id"))
    return chunks(spark, d).join(ids, "id", "left_semi").select("id", "review_status", "version")


@query("SELECT s.id, s.source_group, count(c.id) AS n FROM sources s LEFT JOIN (SELECT DISTINCT ON (id) * FROM chunks) c ON c.source_id = s.id GROUP BY ALL")
def j01_sources_left_chunks(spark, d):
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("source_id").alias("id"))
    return table(spark, d, "sources").select("id", "source_group").join(c, "id", "left").groupBy("id", "source_group").agg(F.count("chunk_id").alias("n"))


@query("SELECT v.id, s.url, v.version, epoch_us(v.retrieval_date) AS retrieved FROM source_versions v JOIN sources s ON s.id = v.source_id WHERE v.fetch_status = 'success'")
def j02_versions_with_urls(spark, d):
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "url")
    return table(spark, d, "source_versions").where("fetch_status = 'success'").join(s, "source_id").select("id", "url", "version", micros(F.col("retrieval_date")).alias("retrieved"))


@query("WITH u AS (SELECT DISTINCT id, unnest(source_urls) AS url FROM chat_logs) SELECT u.id, u.url, s.title FROM u LEFT JOIN sources s ON s.url = u.url")
def j03_titles_of_cited_urls(spark, d):
    cited = table(spark, d, "chat_logs").select("id", F.explode("source_urls").alias("url")).distinct()
    return cited.join(table(spark, d, "sources").select("url", "title"), "url", "left").select("id", "url", "title")


@query("SELECT s.id, max(v.version) AS version, count(*) AS versions FROM sources s JOIN source_versions v ON v.source_id = s.id GROUP BY s.id")
def j04_latest_version_of_sources(spark, d):
    v = table(spark, d, "source_versions").groupBy(F.col("source_id").alias("id")).agg(F.max("version").alias("version"), F.count("*").alias("versions"))
    return table(spark, d, "sources").select("id").join(v, "id")


@query(ONCE + """, n AS (SELECT source_id, version, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS rn FROM (SELECT DISTINCT source_id, version FROM c)),
  p AS (SELECT source_id, max(version) AS nv, min(version) AS ov FROM n WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2),
  h AS (SELECT c.source_id, nv, ov, content_hash, count(*) FILTER (version = nv) AS a, count(*) FILTER (version = ov) AS b FROM c JOIN p USING (source_id) WHERE version IN (nv, ov) GROUP BY ALL)
  SELECT source_id, nv AS new_version, ov AS old_version, sum(CASE WHEN b = 0 THEN a ELSE 0 END)::BIGINT AS added, sum(CASE WHEN a = 0 THEN b ELSE 0 END)::BIGINT AS removed, count(*) FILTER (a > 0 AND b > 0) AS unchanged FROM h GROUP BY ALL""")
def j06_version_diff(spark, d):
    return version_diff(chunks(spark, d).select("source_id", "version", "content_hash"))


@query("SELECT count(DISTINCT id) AS n FROM chunks")
def a01_count_chunks(spark, d):
    return table(spark, d, "chunks").agg(F.countDistinct("id").alias("n"))


@query(ONCE + "SELECT service_category, count(*) AS n FROM c GROUP BY 1")
def a02_count_by_category(spark, d):
    return chunks(spark, d).groupBy("service_category").agg(F.count("*").alias("n"))


@query(ONCE + "SELECT s.id, s.source_group, s.title, max(c.version) AS version, " + ", ".join(f"count(c.id) FILTER (review_status = '{x}') AS {x}" for x in STATUSES) + ", count(c.id) AS total FROM sources s LEFT JOIN c ON c.source_id = s.id GROUP BY ALL")
def a03_source_rollup(spark, d):
    c = chunks(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.max("version").alias("version"), *[F.count_if(F.col("review_status") == x).alias(x) for x in STATUSES], F.count("*").alias("total"))
    zero = {x: 0 for x in (*STATUSES, "total")}
    return table(spark, d, "sources").select("id", "source_group", "title").join(c, "id", "left").fillna(zero)


@query("SELECT count(*) AS sources, count(*) FILTER (canonical) AS canonical, count(DISTINCT service_category) AS categories, (SELECT count(*) FROM source_versions) AS versions, (SELECT count(*) FROM source_versions WHERE fetch_status = 'failure') AS failures FROM sources")
def a04_registry_totals(spark, d):
    v = table(spark, d, "source_versions").agg(F.count("*").alias("versions"), F.count_if(F.col("fetch_status") == "failure").alias("failures"))
    s = table(spark, d, "sources").agg(F.count("*").alias("sources"), F.count_if("canonical").alias("canonical"), F.countDistinct("service_category").alias("categories"))
    return s.join(F.broadcast(v))


@query("SELECT v.id, v.raw_content_path FROM source_versions v WHERE fetch_status = 'success' AND raw_content_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_pages r WHERE r.raw_content_path = v.raw_content_path)")
def a05_versions_without_page(spark, d):
    pages = table(spark, d, "raw_pages").select("raw_content_path")
    return table(spark, d, "source_versions").where("fetch_status = 'success' AND raw_content_path IS NOT NULL").join(pages, "raw_content_path", "left_anti").select("id", "raw_content_path")


@query("SELECT id, url FROM sources s WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_id = s.id)")
def a13_sources_without_chunks(spark, d):
    return table(spark, d, "sources").select("id", "url").join(table(spark, d, "chunks").select(F.col("source_id").alias("id")), "id", "left_anti")


@query("SELECT source_id, count(*) AS attempts, count(*) FILTER (fetch_status = 'success') AS succeeded, count(*) FILTER (fetch_status = 'failure') AS failed, count(DISTINCT content_hash) AS contents FROM source_versions GROUP BY 1")
def a14_fetch_summary(spark, d):
    return table(spark, d, "source_versions").groupBy("source_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("fetch_status") == "success").alias("succeeded"), F.count_if(F.col("fetch_status") == "failure").alias("failed"), F.countDistinct("content_hash").alias("contents"))


@query("SELECT bool_or(review_status = 'approved') AS has_approved FROM chunks")
def a18_has_approved(spark, d):
    return table(spark, d, "chunks").agg(F.bool_or(F.col("review_status") == "approved").alias("has_approved"))


@query("SELECT raw_content_path, bool_or(used_ocr) AS any_ocr, to_json(list_sort(list_distinct(flatten(list(page_numbers))))) AS pages, count(DISTINCT extract_id) AS chunks FROM extracted_chunks GROUP BY 1")
def a17_collects_per_document(spark, d):
    e = table(spark, d, "extracted_chunks").groupBy("raw_content_path").agg(F.bool_or("used_ocr").alias("any_ocr"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("p"), F.countDistinct("extract_id").alias("chunks"))
    return e.select("raw_content_path", "any_ocr", F.concat(F.lit("["), F.array_join(F.col("p").cast("array<string>"), ","), F.lit("]")).alias("pages"), "chunks")


@query(ONCE + "SELECT id, source_url, chunk_index FROM (SELECT * FROM c WHERE review_status = 'approved' AND source_url IN (SELECT url FROM sources WHERE canonical) ORDER BY id LIMIT 20)")
def k05_pinned_chunks(spark, d):
    urls = table(spark, d, "sources").where("canonical").select(F.col("url").alias("source_url"))
    return chunks(spark, d).where("review_status = 'approved'").join(urls, "source_url", "left_semi").select("id", "source_url", "chunk_index").orderBy("id").limit(20)


@query("SELECT source_id, id, version FROM source_versions QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC, id) = 1")
def k06_latest_version(spark, d):
    return latest_per(table(spark, d, "source_versions").select("source_id", "id", "version"), "source_id", [F.desc("version"), F.col("id")])


@query("SELECT source_id, version, row_number() OVER (PARTITION BY source_id ORDER BY version, id) AS place FROM source_versions")
def k07_versions_ascending(spark, d):
    w = Window.partitionBy("source_id").orderBy("version", "id")
    return table(spark, d, "source_versions").select("source_id", "version", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT id, source_id, epoch_us(created_at) AS at FROM source_versions ORDER BY created_at DESC, id LIMIT 25")
def k08_newest_versions(spark, d):
    return table(spark, d, "source_versions").orderBy(F.desc("created_at"), "id").limit(25).select("id", "source_id", micros(F.col("created_at")).alias("at"))


@query("SELECT source_id, version, lag(version) OVER (PARTITION BY source_id ORDER BY version, id) AS previous FROM source_versions QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC, id DESC) <= 2")
def k09_two_latest_versions(spark, d):
    up, down = Window.partitionBy("source_id").orderBy("version", "id"), Window.partitionBy("source_id").orderBy(F.desc("version"), F.desc("id"))
    v = table(spark, d, "source_versions").select("source_id", "version", F.lag("version").over(up).alias("previous"), F.row_number().over(down).alias("rn"))
    return v.where("rn <= 2").drop("rn")


@query(ONCE + "SELECT count(*) AS shared FROM (SELECT content_hash FROM c WHERE version = 1 INTERSECT SELECT content_hash FROM c WHERE version > 1)")
def u01_shared_hashes(spark, d):
    c = chunks(spark, d)
    return c.where("version = 1").select("content_hash").intersect(c.where("version > 1").select("content_hash")).agg(F.count("*").alias("shared"))


@query("SELECT id, url, coalesce(n.title, s.title) AS title, coalesce(n.title, s.title) IS DISTINCT FROM s.title AS touched FROM sources s LEFT JOIN (SELECT url, upper(title) AS title FROM sources WHERE canonical AND title IS NOT NULL) n USING (url)")
def w01_upsert_sources(spark, d):
    old = table(spark, d, "sources").select("url", "id", "title")
    new = old.where("title IS NOT NULL").join(table(spark, d, "sources").where("canonical").select("url"), "url", "left_semi").select("url", F.upper("title").alias("title"))
    merged = upsert(old, new, "url")
    before = old.select("url", F.col("title").alias("before"))
    return merged.join(before, "url").select("id", "url", "title", (~F.col("title").eqNullSafe(F.col("before"))).alias("touched"))


@query(ONCE + ", s AS (SELECT DISTINCT lower(id) AS id FROM chunk_snapshots WHERE snapshot_no = 2) SELECT c.id, c.version, CASE WHEN s.id IS NULL THEN review_status ELSE 'pending_review' END AS review_status FROM c LEFT JOIN s USING (id)")
def w02_upsert_chunks(spark, d):
    old = chunks(spark, d).select("id", "version", "review_status")
    new = table(spark, d, "chunk_snapshots").where("snapshot_no = 2").select(F.lower("id").alias("id")).distinct().join(old.select("id"), "id", "left_semi").select("id", F.lit(0).alias("version"), F.lit("pending_review").alias("review_status"))
    return upsert(old, new, "id", overwrite=["review_status"])


@query("SELECT s.id AS source_id, coalesce(max(v.version), 0) + 1 AS version FROM sources s LEFT JOIN source_versions v ON v.source_id = s.id GROUP BY 1")
def w03_next_versions(spark, d):
    return next_versions(table(spark, d, "source_versions"), table(spark, d, "sources").select(F.col("id").alias("source_id")))


@query("SELECT s.id, 'data/raw/' || s.id || '/v1/' || coalesce(nullif(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '^[A-Za-z]+://[^/]+/(?:.*/)?([^/]*)/?$', 1), ''), 'index') AS path FROM sources s")
def w04_version_paths(spark, d):
    plain = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    name = F.regexp_extract(plain, r"^[A-Za-z]+://[^/]+/(?:.*/)?([^/]*)/?$", 1)
    return table(spark, d, "sources").select("id", F.concat(F.lit("data/raw/"), "id", F.lit("/v1/"), F.when(name != "", name).otherwise("index")).alias("path"))


@query("SELECT count(*) AS kept, (SELECT count(*) FROM chat_logs) - count(*) AS purged FROM chat_logs WHERE created_at >= TIMESTAMPTZ '2031-06-01 00:00:00+00' - INTERVAL 60 DAYS")
def w07_retention(spark, d):
    logs = table(spark, d, "chat_logs").select("created_at")
    kept = retain(logs, "created_at", F.lit(AS_OF).cast("timestamp"), 60)
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(logs.agg(F.count("*").alias("n")))).select("kept", (F.col("n") - F.col("kept")).alias("purged"))


@query(ONCE + ", s AS (SELECT DISTINCT lower(id) AS id FROM chunk_snapshots WHERE snapshot_no = 3) SELECT c.review_status AS before, CASE WHEN s.id IS NULL THEN review_status ELSE 'superseded' END AS after, count(*) AS n FROM c LEFT JOIN s USING (id) GROUP BY ALL")
def w09_mark_ids(spark, d):
    c = chunks(spark, d).select("id", F.col("review_status").alias("before"), F.col("review_status").alias("after"))
    ids = table(spark, d, "chunk_snapshots").where("snapshot_no = 3").select(F.lower("id").alias("id"))
    return patch(c, ids, "id", {"after": F.lit("superseded")}).groupBy("before", "after").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN canonical THEN 'https://moved.example/' || id ELSE url END AS url FROM sources")
def w14_move_urls(spark, d):
    s = table(spark, d, "sources")
    moves = s.where("canonical").select(F.col("url").alias("old_value"), F.concat(F.lit("https://moved.example/"), "id").alias("new_value"))
    return move_keys(s.select("id", "url"), moves, "url")


@query(ONCE + "SELECT c.id, CASE WHEN s.title IS NULL THEN chunk_text ELSE s.title || chr(10) || chr(10) || chunk_text END AS record_text, sha256(CASE WHEN s.title IS NULL THEN chunk_text ELSE s.title || chr(10) || chr(10) || chunk_text END) AS record_hash FROM c LEFT JOIN sources s ON s.id = c.source_id")
def pr12_chunk_records(spark, d):
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "title")
    text = F.when(F.col("title").isNull(), F.col("chunk_text")).otherwise(F.concat("title", F.lit("\n\n"), "chunk_text"))
    return chunks(spark, d).select("id", "source_id", "chunk_text").join(s, "source_id", "left").select("id", text.alias("record_text"), F.sha2(text, 256).alias("record_hash"))


@query("""WITH c AS (SELECT DISTINCT ON (id) * FROM chunks), h AS (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('source_version:' || source_version_id || ':chunk:' || chunk_index)::BLOB) AS h FROM c)
 SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4 + 1)::INT, 1) || h[18:20] || '-' || h[21:32] AS derived_id FROM h""")
def d10_chunk_ids(spark, d):
    return chunks(spark, d).select("id", chunk_id(F.col("source_version_id"), F.col("chunk_index")).alias("derived_id"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, sha256(text) AS text_hash FROM documents")
def d05_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.sha2("text", 256).alias("text_hash"))


@query("""SELECT id, CASE WHEN previous IS NULL THEN 'first' WHEN content_hash = previous THEN 'identical_bytes' ELSE 'new_version' END AS action
FROM (SELECT id, content_hash, lag(content_hash) OVER (PARTITION BY source_id ORDER BY version, id) AS previous FROM source_versions WHERE fetch_status = 'success')""")
def d13_change_detection(spark, d):
    w = Window.partitionBy("source_id").orderBy("version", "id")
    v = table(spark, d, "source_versions").where("fetch_status = 'success'").select("id", "content_hash", F.lag("content_hash").over(w).alias("previous"))
    return v.select("id", F.when(F.col("previous").isNull(), "first").when(F.col("content_hash") == F.col("previous"), "identical_bytes").otherwise("new_version").alias("action"))
