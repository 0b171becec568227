from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from docketry.sources import fetch, files
from docketry.streaming import logs


def test_registry(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"sources": [{"id": "1", "url": "u", "file_type": "pdf", "applicant_variant": "minor", "group": "g"}, {"id": "2", "url": "v", "file_type": "html"}]}))
    got = files.read_registry(spark, str(p)).orderBy("id").collect()
    assert [(r.source_type, r.applicant_variant, r.jurisdiction, r.canonical, r.source_group) for r in got] == [("pdf", ["minor"], ["all"], False, "g"), ("html", [], ["all"], False, None)]


def test_docx_and_html(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, style="", num="": f'<w:p><w:pPr>{f"<w:pStyle w:val=%r/>" % style if style else ""}{num}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'.replace("'", '"')
    body = para("Title here", "Heading1") + para("Q. What is it?") + para("A. It is this: https://x.y/z.") + para("one", num="<w:numPr/>") + para("two", num="<w:numPr/>") + para(" ")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = files.read_docx(spark, str(tmp_path / "*.docx"))
    assert [(r.kind, r.text) for r in rows.orderBy("pos").collect()] == [("h1", "Title here"), ("h2", "What is it?"), ("p", "It is this: https://x.y/z."), ("li", "one"), ("li", "two")]
    html = files.render_html(rows).first().html
    assert html == '<!doctype html>\n<title>Title here</title>\n<h1>Title here</h1>\n<h2>What is it?</h2>\n<p>It is this: <a href="https://x.y/z">https://x.y/z</a>.</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>'


def test_points_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("a", [1.0, 2.0], [3], [0.5], {"k": "v"})], files.POINT)
    files.write_points(points, str(tmp_path / "p"))
    assert files.read_points(spark, str(tmp_path / "p"), expected=1).first() == points.first()


def test_recorded_pages_and_attempts(spark, tmp_path):
    import hashlib

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / hashlib.sha256(b"http://a").hexdigest()).write_bytes(b"page")
    (tmp_path / "urls").write_text("http://a\nhttp://b\n")
    got = fetch.read_recorded(spark, str(tmp_path / "urls"), str(tmp_path / "r")).orderBy("url", "attempt").collect()
    assert [(r.url, r.attempt, r.success, r.wait_s) for r in got] == [("http://a", 1, True, 0.0), ("http://b", 1, False, 0.0), ("http://b", 2, False, 2.0), ("http://b", 3, False, 4.0)]


def test_robots(spark):
    df = spark.createDataFrame([("http://a/x", "User-agent: *\nDisallow: /x"), ("http://a/y", "User-agent: *\nDisallow: /x"), ("http://b/x", None)], "url string, robots string")
    assert [r.allowed for r in fetch.allowed_by_robots(df, "bot").orderBy("url").collect()] == [False, True, True]


def test_raw_files_and_csv(spark, tmp_path):
    (tmp_path / "data/raw/s/v1").mkdir(parents=True)
    (tmp_path / "data/raw/s/v1/p.html").write_text("hi")
    v = spark.createDataFrame([("1", "data/raw/s/v1/p.html"), ("2", "data/raw/s/v2/p.html")], "id string, raw_content_path string")
    found, missing = files.read_raw(spark, str(tmp_path), v)
    assert [bytes(r.content) for r in found.collect()] == [b"hi"] and [r.id for r in missing.collect()] == ["2"]
    files.write_log_csv(spark.createDataFrame([(1, ["u", "v"])], "id long, source_urls array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().source_urls == "u v"


def test_streams(spark, tmp_path):
    for n, s in enumerate(([0, 100], [190, 300], [371])):
        spark.createDataFrame([("a", t) for t in s], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    like = spark.read.parquet(str(tmp_path / "in" / "0"))
    stream = logs.read_stream(spark, str(tmp_path / "in" / "*"), like)
    step = logs.repeat_suppressor(spark, "key", "ts", 180, str(tmp_path / "kept"))
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "kept" / "out"))
    assert sorted((r.s, r.kept) for r in out.selectExpr("unix_seconds(ts) AS s", "kept").collect()) == [(0, True), (100, False), (190, True), (300, False), (371, True)]
    q = logs.window_counts(logs.read_stream(spark, str(tmp_path / "in" / "*"), like), "ts", "key", "3 minutes", "1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.s, r.n) for r in spark.sql("SELECT unix_seconds(start) AS s, n FROM counts").collect()) == [(0, 2), (180, 2), (360, 1)]
