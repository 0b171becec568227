"""Readers and writers of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY = "sources array<struct<id:string,url:string,file_type:string,service_category:string,canonical:boolean,applicant_variant:string,group:string,title:string,notes:string>>"
POINT = "id string, dense array<float>, sparse_indices array<int>, sparse_values array<float>, payload map<string,string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON registry: the variant as an array, every jurisdiction, file_type and group renamed."""
    rows = spark.read.schema(REGISTRY).json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")
    variant = F.when(F.col("applicant_variant").isNull(), F.array().cast("array<string>")).otherwise(F.array("applicant_variant"))
    return rows.select("id", "url", F.col("file_type").alias("source_type"), "service_category", F.coalesce("canonical", F.lit(False)).alias("canonical"), F.array(F.lit("all")).alias("jurisdiction"), variant.alias("applicant_variant"), F.col("group").alias("source_group"), "title", "notes")


def read_raw(spark: SparkSession, root: str, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): versions with the bytes at their raw_content_path below `root`, and those without a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.regexp_replace("path", r"^.*?(?=data/raw/)", "").alias("raw_content_path"), "content", "length")
    return versions.join(files, "raw_content_path"), versions.join(files.select("raw_content_path"), "raw_content_path", "left_anti")


def _paragraphs(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    styles = {"heading1": "h1", "title": "h1", "heading2": "h2", "heading3": "h3", "heading4": "h3"}
    for p in body.iter(f"{_W}p"):
        text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")).split())
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        kind = styles.get((style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else "", "")
        if not kind and p.find(f"{_W}pPr/{_W}numPr") is not None:
            kind = "li"
        if not kind and (m := re.match(r"Q\s*[.:]\s*", text)):
            kind, text = "h2", text[m.end() :]
        if not kind:
            kind, text = "p", re.sub(r"^A\s*[.:]\s*", "", text)
        yield kind, text


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, kind, text) of the paragraphs of word-processor files; a broken file gives no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    out += [(name, i, k, t) for i, (k, t) in enumerate(_paragraphs(data.as_py()))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["path", "pos", "kind", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, pos int, kind string, text string")


def write_points(points: DataFrame, path: str) -> None:
    """Vectors and payloads as gzipped JSON lines."""
    points.write.mode("overwrite").option("compression", "gzip").json(path)


def read_points(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """The rows of `write_points`; with `expected` their number must agree."""
    points = spark.read.schema(POINT).json(path)
    if expected is not None and (n := points.count()) != expected:
        raise ValueError(f"{n} points read, {expected} expected")
    return points


def write_log_csv(logs: DataFrame, path: str) -> None:
    """A conversation log as CSV with a header, arrays joined by blanks, each file beginning with the UTF-8 byte order mark.

    The mark stands before the first name of the header, where spreadsheets look for it.
    """
    arrays = [c for c, t in logs.dtypes if t.startswith("array")]
    logs.withColumns({c: F.concat_ws(" ", c) for c in arrays}).withColumnRenamed(logs.columns[0], "\ufeff" + logs.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def render_html(paragraphs: DataFrame, title: str = "Untitled") -> DataFrame:
    """(path, html) from (path, pos, kind, text): runs of items in one list, bare addresses as links, the first h1 as title.

    Runs are islands by lag and a running sum over each document.
    """
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    linked = F.regexp_replace(escaped, r"(https?://[^\s<]*[^\s<.,;:!?)])", '<a href="$1">$1</a>')
    w = Window.partitionBy("path").orderBy("pos")
    opens = F.when((F.col("kind") == "li") & ~F.coalesce(F.lag("kind").over(w) == "li", F.lit(False)), "<ul>\n").otherwise("")
    shuts = F.when((F.col("kind") == "li") & ~F.coalesce(F.lead("kind").over(w) == "li", F.lit(False)), "\n</ul>").otherwise("")
    rows = paragraphs.withColumn("line", F.concat(opens, F.lit("<"), "kind", F.lit(">"), linked, F.lit("</"), "kind", F.lit(">"), shuts))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    head = F.coalesce(F.min_by("text", F.when(F.col("kind") == "h1", F.col("pos"))), F.lit(title))
    return rows.groupBy("path").agg(F.concat(F.lit("<!doctype html>\n<title>"), head, F.lit("</title>\n"), body).alias("html"))


def pending_migrations(available: DataFrame, applied: DataFrame) -> DataFrame:
    """File names not yet applied, in order."""
    return available.select("filename").join(applied.select("filename"), "filename", "left_anti").orderBy("filename")


def apply_migrations(spark: SparkSession, folder: str, applied: DataFrame, run: Callable[[str], None]) -> DataFrame:
    """`applied` with the files of `folder` (*.sql) that it lacks, each run once and in order.

    `run` gets the text of a file. If one fails, the migrations before it stay
    applied and are given; the failing one and those after it are not.
    """
    files = spark.read.text(f"{folder}/*.sql", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), "value")
    done: list[str] = []
    for row in files.join(applied.select("filename"), "filename", "left_anti").orderBy("filename").collect():  # a list of scripts
        try:
            run(row.value)
        except Exception:  # noqa: BLE001
            break
        done.append(row.filename)
    return applied.select("filename").unionByName(spark.createDataFrame([(x,) for x in done], "filename string"))


def write_chunk_dump(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one folder a source, ids and times as text."""
    text = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for f in chunks.schema.fields if f.dataType.typeName() == "timestamp"}
    chunks.withColumns(text).write.mode("overwrite").partitionBy("source_id").json(path)


def scroll(points: DataFrame, after: str | None = None, page: int = 256) -> DataFrame:
    """The next `page` points by id after the id `after` (S12): pages of a list, never skipped or repeated."""
    rest = points if after is None else points.where(F.col("id") > after)
    return rest.orderBy("id").limit(page)
