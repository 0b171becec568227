"""Citations of drafted answers: attribution, one number a source, rendered source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ----
COMMON_WORDS = (
    "that this with from have will must your they their been were which when where what should would could"
    " also only into about after before other than then them these those such more most each does done"
    " applicant applicants application applications please"
).split()


def content_words(text: Column) -> Column:
    """Distinct words of four letters or digits and more, without common ones."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{4,}"), F.lit(0)), F.array(*[F.lit(w) for w in COMMON_WORDS]))


def attribute(lines: DataFrame, chunks: DataFrame, least: float = 0.6, words: int = 4) -> DataFrame:
    """(qid, line_no, pos, overlap): the chunk of the same qid that holds most of a line's words.

    lines has qid, line_no, text, chunks qid, pos, text. Lines of fewer than
    `words` content words are passed over; of equal overlaps the first pos wins;
    overlaps under `least` do not count. An equi-join on (qid, word), so pairs
    arise only where a word is shared.
    """
    a = lines.select("qid", "line_no", content_words(F.col("text")).alias("w")).where(F.size("w") >= words)
    a = a.select("qid", "line_no", F.size("w").alias("n"), F.explode("w").alias("word"))
    b = chunks.select("qid", "pos", F.explode(content_words(F.col("text"))).alias("word"))
    shared = a.join(b, ["qid", "word"]).groupBy("qid", "line_no", "pos").agg((F.count("*") / F.first("n")).alias("overlap"))
    best = shared.groupBy("qid", "line_no").agg(F.max(F.struct("overlap", (-F.col("pos")).alias("first"))).alias("x"))
    return best.where(F.col("x.overlap") >= least).select("qid", "line_no", (-F.col("x.first")).alias("pos"), F.round("x.overlap", 6).alias("overlap"))


def number_by_source(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, text, citations): markers [n] renumbered so that each source has one number, by first citation.

    answers has qid, text, chunks qid, pos (the number in the text), url,
    chunk_id. Markers of no chunk are dropped, neighbouring equal ones become
    one. citations: array<struct<index, chunk_id, url>> with the first cited chunk.
    """
    cited = answers.select("qid", F.posexplode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))).alias("place", "pos"))
    met = cited.join(chunks.select("qid", "pos", "url", "chunk_id"), ["qid", "pos"])
    first = met.withColumn("first", F.min("place").over(Window.partitionBy("qid", "url")))
    numbered = first.withColumn("index", F.dense_rank().over(Window.partitionBy("qid").orderBy("first")))
    maps = numbered.groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("string"), F.col("index").cast("string")))).alias("to"),
        F.array_sort(F.collect_list(F.when(F.col("place") == F.col("first"), F.struct("index", "chunk_id", "url")))).alias("citations"),
    )
    parts = F.split("text", r"(?=\[\d+\])")
    one = lambda p: F.when(
        p.rlike(r"^\[\d+\]"),
        F.concat(F.coalesce(F.concat(F.lit("["), F.try_element_at(F.col("to"), F.regexp_extract(p, r"^\[(\d+)\]", 1)), F.lit("]")), F.lit("")), F.regexp_replace(p, r"^\[\d+\]", "")),
    ).otherwise(p)
    rewritten = F.regexp_replace(F.array_join(F.transform(parts, one), ""), r"(\[\d+\])(?:\1)+", "$1")
    return answers.join(maps, "qid", "left").select("qid", rewritten.alias("text"), F.coalesce("citations", F.array().cast("array<struct<index:int,chunk_id:string,url:string>>")).alias("citations"))


def render_sources(chunks: DataFrame) -> DataFrame:
    """(qid, block) from (qid, pos, url, trail, text): `[n] Source: url`, its section and text, blocks apart by a blank line."""
    head = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] Source: "), "url", F.when(F.col("trail") != "", F.concat(F.lit("\nSection: "), "trail")).otherwise(""), F.lit("\n"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", head.alias("b")))), lambda x: x["b"])
    return chunks.groupBy("qid").agg(F.array_join(ordered, "\n\n").alias("block"))


def drop_repeated_sections(items: DataFrame) -> DataFrame:
    """(doc, pos, kind, text) without sections whose h2 or h3 heading came before in the document."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("kind").isin("h2", "h3")
    marked = items.withColumn("head", F.when(is_head, F.lower("text"))).withColumn("section", F.count("head").over(w))
    heads = marked.where(is_head).withColumn("again", F.row_number().over(Window.partitionBy("doc", "head").orderBy("pos")) > 1).select("doc", "section", "again")
    return marked.join(heads, ["doc", "section"], "left").where(~F.coalesce("again", F.lit(False))).select("doc", "pos", "kind", "text")


def body_size(words: DataFrame) -> DataFrame:
    """(doc, size): the most frequent size, rounded half to even, first seen among equals, then the smaller."""
    counted = words.where("size IS NOT NULL").groupBy("doc", F.bround("size").alias("rounded")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("doc").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), (-F.col("rounded")).alias("small"))).alias("x")).select("doc", (-F.col("x.small")).alias("size"))


def line_kind(size: Column, body: Column, text: Column) -> Column:
    """struct<type, level> of a printed line by its size against the body's, else by a list marker."""
    from docketry.operators.textops import LIST_MARKER

    ratio = size / body
    level = F.when(ratio >= 1.4, 1).when(ratio >= 1.2, 2).when(ratio >= 1.08, 3).otherwise(0)
    kind = F.when(level > 0, "heading").when(text.rlike(LIST_MARKER), "list_item").otherwise("paragraph")
    return F.struct(kind.alias("type"), level.alias("level"))
