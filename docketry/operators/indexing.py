"""Indexing of extracted chunks: change detection, fallback for pages without text, the index run, payloads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.textops import list_marker

# ---- fixed values: fields of a vector's payload and of a search result, and the words below which a page has no text layer ----
LEAST_WORDS = 5
PAYLOAD = (
    "source_id source_version_id chunk_index source_url retrieval_date source_last_modified service_category canonical jurisdiction applicant_variant"
    " review_status version content_hash chunk_text heading_trail used_ocr"
).split()
RESULT = "rank score chunk_id source_id source_url service_category canonical jurisdiction applicant_variant version retrieval_date heading_trail used_ocr chunk_text".split()


def fingerprint(blocks: Column) -> Column:
    """sha256 of the texts of a page's blocks, one a line (D12); null for null blocks."""
    return F.sha2(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), 256)


def change_action(source_type: Column, old_hash: Column, new_hash: Column, old_text: Column, new_text: Column) -> Column:
    """What a fetch means (D13): `first`, `identical_bytes`, `identical_extracted_text` or `new_version`.

    Only pages are compared by their text; a previous text that is null could
    not be read, and the page counts as changed.
    """
    same_text = (source_type == "html") & (old_text == new_text)
    return F.when(old_hash.isNull(), "first").when(old_hash == new_hash, "identical_bytes").when(same_text, "identical_extracted_text").otherwise("new_version")


def with_ocr_fallback(native: DataFrame, words: DataFrame, recognised: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, place, type, text, ordinal, page, source): native blocks of pages with enough words, then the recognised lines of the others.

    native has doc, page, pos, type, text, ordinal; words doc, page, n; recognised
    doc, page, text, one row a page, the seam to a recogniser: a page that it
    lacks, or whose text is null, is passed over. Lines are stripped, blank ones
    dropped, list marks split off. Recognised pages follow all native ones.
    """
    poor = words.where(F.col("n") < least).select("doc", "page")
    kept = native.join(poor, ["doc", "page"], "left_anti").select("doc", F.lit(0).alias("late"), "page", "pos", "type", "text", "ordinal", F.lit("native").alias("source"))
    lines = recognised.join(poor, ["doc", "page"], "left_semi").select("doc", "page", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    marker, rest = list_marker(F.col("line"))
    read = lines.select("doc", F.lit(1).alias("late"), "page", "pos", F.when(marker.isNotNull(), "list_item").otherwise("paragraph").alias("type"), F.coalesce(rest, "line").alias("text"), marker.alias("ordinal"), F.lit("ocr").alias("source"))
    order = Window.partitionBy("doc").orderBy("late", "page", "pos")
    return kept.unionByName(read).select("doc", (F.row_number().over(order) - 1).alias("place"), "type", "text", "ordinal", "page", "source")


def iso_time(ts: Column) -> Column:
    """A time as ISO 8601 with its offset, fractions only where there are some."""
    whole, part = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(part != ".000000", part).otherwise(""), F.date_format(ts, "xxx"))


def payload(chunks: DataFrame) -> Column:
    """The payload of a chunk's vector (P17): ids as text, times as ISO 8601 or null; columns that chunks lacks are null."""
    kinds = dict(chunks.dtypes)

    def value(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        c = F.col(name)
        return (c.cast("string") if name in ("source_id", "source_version_id") else iso_time(c) if kinds[name] == "timestamp" else c).alias(name)

    return F.struct(*[value(name) for name in PAYLOAD])


def result_of(found: DataFrame) -> DataFrame:
    """Search results (P11) from (qid, id, rank, score, payload)."""
    return found.select("qid", *[F.col("id").cast("string").alias("chunk_id") if n == "chunk_id" else F.col(n) if n in ("rank", "score") else F.col(f"payload.{n}").alias(n) for n in RESULT])


def log_events(audit: DataFrame, entity_type: str, rows: DataFrame, action: str, details: Column | None = None, actor: str = "system") -> DataFrame:
    """`audit` with an event for each of rows(entity_id) appended (W05); details as JSON, null if not given."""
    new = rows.select(F.lit(entity_type).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), F.lit(action).alias("action"), (F.to_json(details) if details is not None else F.lit(None).cast("string")).alias("details"), F.lit(actor).alias("actor"))
    return audit.unionByName(new)


class Indexed(NamedTuple):
    chunks: DataFrame
    points: DataFrame
    audit: DataFrame
    summary: DataFrame


def index_run(chunks: DataFrame, points: DataFrame, audit: DataFrame, records: DataFrame, vectors: DataFrame) -> Indexed:
    """New versions of any number of sources indexed at once (D15), as new tables.

    chunks has id, source_id, source_version_id, version, content_hash,
    review_status (others stay as they are), points id, vector, review_status,
    records what chunks has but the status, vectors id and vector of the records.
    The status of a record follows from what is stored: a new one is pending, a
    superseded one stays so, one whose content changed is pending again, any
    other keeps its status. Chunks of other versions of a record's source are
    superseded. A record without a vector, or a vector without a record, is
    refused: no partial set is indexed. The points come last and follow the chunks.
    """
    ids = records.select("id").join(vectors.select("id", F.lit(True).alias("met")), "id", "full")
    unmet = ids.where("met IS NULL").count() + vectors.join(records.select("id"), "id", "left_anti").count()
    if unmet:
        raise ValueError(f"{unmet} records without a vector or vectors without a record")
    prior = chunks.select("id", F.col("content_hash").alias("old_hash"), F.col("review_status").alias("old_status"))
    status = F.when(F.col("old_status").isNull(), "pending_review").when(F.col("old_status") == "superseded", "superseded").when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "pending_review").otherwise(F.col("old_status"))
    new = records.join(prior, "id", "left").withColumn("review_status", status)
    reset = new.where("old_status IN ('approved', 'rejected') AND review_status = 'pending_review'")
    runs = records.select("source_id", "source_version_id", "version").distinct()
    # everything of the runs' sources that belongs to none of their new versions
    rest = chunks.join(records.select("id"), "id", "left_anti").join(runs.select("source_id").distinct(), "source_id", "left_semi")
    stale = rest.join(runs.select("source_id", "source_version_id"), ["source_id", "source_version_id"], "left_anti").where("review_status <> 'superseded'")
    kept = chunks.join(records.select("id"), "id", "left_anti").join(stale.select("id", F.lit(True).alias("stale")), "id", "left")
    kept = kept.withColumn("review_status", F.when(F.col("stale"), "superseded").otherwise(F.col("review_status"))).select(*chunks.columns)
    merged = kept.unionByName(new.select(*[c for c in chunks.columns if c in new.columns]), allowMissingColumns=True)
    counted = records.groupBy("source_id", "source_version_id", "version").agg(F.count("*").alias("chunks_created"))
    gone = stale.groupBy("source_id").agg(F.count("*").alias("chunks_superseded"), F.sort_array(F.collect_list("id")).alias("ids"))
    resets = reset.groupBy("source_version_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    audit = log_events(audit, "source_version", resets.withColumn("entity_id", F.col("source_version_id")), "review_reset_content_changed", F.struct(F.col("ids").alias("chunk_ids")))
    audit = log_events(audit, "source_version", counted.withColumn("entity_id", F.col("source_version_id")), "chunks_embedded", F.struct("version", F.col("chunks_created").alias("chunk_count")))
    audit = log_events(audit, "source", gone.withColumn("entity_id", F.col("source_id")), "chunks_superseded", F.struct(F.col("ids").alias("superseded_chunk_ids")))
    summary = counted.join(gone.select("source_id", "chunks_superseded"), "source_id", "left").select("source_id", "version", "chunks_created", F.coalesce("chunks_superseded", F.lit(0)).alias("chunks_superseded"))
    fresh = new.select("id", "review_status").join(vectors, "id").select("id", "vector", "review_status")
    old = points.join(records.select("id"), "id", "left_anti").join(stale.select("id", F.lit(True).alias("stale")), "id", "left")
    old = old.select("id", "vector", F.when(F.col("stale"), "superseded").otherwise(F.col("review_status")).alias("review_status"))
    return Indexed(merged, old.unionByName(fresh), audit, summary)


def union_in_order(lists: DataFrame) -> DataFrame:
    """(qid, id, place) of rows (qid, list_no, pos, id): each id once, where it came first."""
    first = lists.groupBy("qid", "id").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("place"))
