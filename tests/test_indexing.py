from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import textops as T
from docketry.operators.documents import word_lines
from docketry.operators.indexing import change_action, fingerprint, index_run, with_ocr_fallback
from docketry.operators.retrieval import SearchPolicy, dense_top_k, dual_search, postings, search, sparse_top_k
from docketry.operators.usage import suppress_repeats
from docketry.sources.files import apply_migrations, scroll, write_chunk_dump, write_log_csv

CHUNK = "id string, source_id string, source_version_id string, version int, content_hash string, review_status string"
AUDIT = "entity_type string, entity_id string, action string, details string, actor string"


def test_index_run(spark):
    chunks = spark.createDataFrame(
        [("a", "s", "v1", 1, "h", "approved"), ("b", "s", "v2", 2, "h", "approved"), ("c", "s", "v2", 2, "h", "rejected"), ("d", "s", "v2", 2, "h", "superseded"), ("e", "s", "v1", 1, "h", "superseded"), ("z", "t", "w1", 1, "h", "approved")], CHUNK
    )
    records = spark.createDataFrame([("b", "s", "v2", 2, "new"), ("c", "s", "v2", 2, "h"), ("d", "s", "v2", 2, "new"), ("f", "s", "v2", 2, "h")], CHUNK.rpartition(",")[0])
    points = chunks.select("id", F.array(F.lit(0.0)).alias("vector"), "review_status")
    vectors = records.select("id", F.array(F.lit(1.0)).alias("vector"))
    out = index_run(chunks, points, spark.createDataFrame([], AUDIT), records, vectors)
    want = {"a": "superseded", "b": "pending_review", "c": "rejected", "d": "superseded", "e": "superseded", "f": "pending_review", "z": "approved"}
    assert {r.id: r.review_status for r in out.chunks.collect()} == want
    assert {r.id: (r.vector[0], r.review_status) for r in out.points.collect()} == {k: (1.0 if k in "bcdf" else 0.0, v) for k, v in want.items()}
    assert {(r.action, r.entity_id, r.details) for r in out.audit.collect()} == {
        ("review_reset_content_changed", "v2", '{"chunk_ids":["b"]}'), ("chunks_embedded", "v2", '{"version":2,"chunk_count":4}'), ("chunks_superseded", "s", '{"superseded_chunk_ids":["a"]}'),
    }
    assert [tuple(r) for r in out.summary.collect()] == [("s", 2, 4, 1)]
    # nothing is indexed in part
    for v in (vectors.where("id <> 'f'"), vectors.unionByName(vectors.limit(1).withColumn("id", F.lit("q")))):
        with pytest.raises(ValueError):
            index_run(chunks, points, spark.createDataFrame([], AUDIT), records, v)
    empty = index_run(chunks, points, spark.createDataFrame([], AUDIT), records.limit(0), vectors.limit(0))
    assert {r.id: r.review_status for r in empty.chunks.collect()} == {r.id: r.review_status for r in chunks.collect()} and empty.summary.count() == 0


def test_change_action_and_fingerprint(spark):
    rows = [("html", None, "b", "t", "t"), ("html", "b", "b", None, None), ("html", "a", "b", "t", "t"), ("pdf", "a", "b", "t", "t"), ("html", "a", "b", None, "t"), ("html", "a", "b", "t", "u")]
    df = spark.createDataFrame(rows, "k string, oh string, nh string, ot string, nt string")
    got = [r[0] for r in df.select(change_action(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["first", "identical_bytes", "identical_extracted_text", "new_version", "new_version", "new_version"]
    b = spark.createDataFrame([([("x",), ("y",)],), ([],), (None,)], "b array<struct<text:string>>")
    assert [r[0] for r in b.select(fingerprint(F.col("b")) == F.sha2(F.lit("x\ny"), 256)).collect()] == [True, False, None]


def test_ocr_fallback(spark):
    native = spark.createDataFrame([("d", 1, 0, "heading", "T", None), ("d", 2, 0, "paragraph", "x", None), ("d", 3, 0, "paragraph", "y", None)], "doc string, page int, pos int, type string, text string, ordinal string")
    words = spark.createDataFrame([("d", 1, 9), ("d", 2, 4), ("d", 3, 5), ("d", 4, 0)], "doc string, page int, n int")
    read = spark.createDataFrame([("d", 2, " a line \n\n1) first\r\n"), ("d", 3, "not read"), ("d", 4, None)], "doc string, page int, text string")
    got = [tuple(r) for r in with_ocr_fallback(native, words, read).orderBy("place").collect()]
    assert got == [("d", 0, "heading", "T", None, 1, "native"), ("d", 1, "paragraph", "y", None, 3, "native"), ("d", 2, "paragraph", "a line", None, 2, "ocr"), ("d", 3, "list_item", "first", "1)", 2, "ocr")]


def test_dense_search_against_brute_force(spark):
    random.seed(4)
    rows = [(f"i{k}", [float(random.randint(-2, 2)) for _ in range(4)]) for k in range(300)] + [("null", None), ("zero", [0.0] * 4), ("short", [1.0]), ("hole", [1.0, None, 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = [(k, rows[k][1]) for k in range(0, 300, 25)] + [(-1, None)]
    queries = spark.createDataFrame(asked, "qid int, vector array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    truth = {}
    for q, v in asked:
        if v and norm(v):
            scored = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 6), i) for i, w in rows[:300] if norm(w))
            truth[q] = [(i, -s) for s, i in scored[:7]]
    for size in ({}, {"block": 3}, {"block": 2, "scan_bytes": 100}):
        got = dense_top_k(queries, corpus.repartition(5), 7, **size).orderBy("qid", "rank").collect()
        assert {q: [(r.id, r.score) for r in got if r.qid == q] for q in {r.qid for r in got}} == truth
    assert dense_top_k(queries, corpus.limit(0), 7).count() == 0 and dense_top_k(queries.limit(0), corpus, 7).count() == 0


def test_lexical_search_of_any_script(spark):
    docs = spark.createDataFrame([(1, "वीज़ा शुल्क the"), (2, "die Gebühr the"), (3, "the fee"), (4, None), (5, "")], "id int, t string")
    posted = postings(docs.where("t IS NOT NULL"), "id", "t", most=0.7)
    asked = postings(spark.createDataFrame([(9, "the GEBÜHR"), (8, "वीज़ा")], "id int, t string"), "id", "t")
    assert [(r.qid, r.id) for r in sparse_top_k(asked, posted, 5).orderBy("qid").collect()] == [(8, 1), (9, 2)]


def test_search_policy_and_dual_wordings(spark):
    assert [SearchPolicy(limit=n, boost=b, rerank=r).depth for n, b, r in ((8, 0, None), (8, 0.1, None), (8, 0.1, len), (40, 0, len))] == [8, 12, 30, 40]
    leg = spark.createDataFrame([(1, f"x{k}", k) for k in range(1, 9)], "qid int, id string, rank int")
    plain = search(lambda k: [leg.where(F.col("rank") <= k)], SearchPolicy(limit=3, prefetch=5))
    assert [r.id for r in plain.orderBy("rank").collect()] == ["x1", "x2", "x3"]
    flagged = spark.createDataFrame([("x5", True)], "id string, flag boolean")
    assert [r.id for r in search(lambda k: [leg], SearchPolicy(limit=2, boost=1.0), flagged).orderBy("rank").collect()] == ["x5", "x1"]
    second = spark.createDataFrame([(1, "y", 1)], "qid int, id string, rank int")
    for rewrite, found in (("Other", True), (" THE  one", False), (None, False), (" ", False)):
        wordings = spark.createDataFrame([(1, "the one", rewrite)], "qid int, question string, rewrite string")
        assert ("y" in {r.id for r in dual_search(leg, second, wordings, 3).collect()}) is found


def test_suppression_of_a_busy_key_against_brute_force(spark):
    random.seed(6)
    rows = [(random.choice(["busy"] * 8 + ["a", None]), random.randrange(4000), k) for k in range(3000)]
    last, truth = {}, set()
    for key, t, k in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        if key not in last or t - last[key] > 30:
            last[key] = t
            truth.add(k)
    df = spark.createDataFrame(rows, "key string, t long, n int").select("key", F.timestamp_seconds("t").alias("ts"), "n")
    assert {r.n for r in suppress_repeats(df, "key", "ts", 30).where("kept").collect()} == truth
    assert suppress_repeats(df.limit(0), "key", "ts", 30).count() == 0


def test_word_lines_against_brute_force(spark):
    random.seed(7)
    words = [(p, f"w{k}", random.choice([None, *(random.uniform(0, 40) for _ in range(30))]), random.choice([0.0, 1.0, 2.0]), random.choice([9.0, 10.0, None])) for p in range(3) for k in range(60)]
    truth = set()
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for p in range(3):
        lines = []
        for _, text, top, x0, size in sorted((w for w in words if w[0] == p), key=lambda w: (none_first(w[2]), none_first(w[3]), w[1], none_first(w[4]))):
            at = next((line for line in lines if top is not None and line[0][0] is not None and abs(line[0][0] - top) <= 3), None)
            if at is None:
                lines.append(at := [])
            at.append((top, x0, text, size))
        truth |= {(p, n, " ".join(t for _, t in sorted((x, t) for _, x, t, _ in line))) for n, line in enumerate(lines)}
    df = spark.createDataFrame(words, "page int, text string, top double, x0 double, size double")
    assert {(r.page, r.line, r.text) for r in word_lines(df).collect()} == truth


def test_small_text_operators(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    long = " ".join(["word"] * 20) + ", " + " ".join(["more"] * 15) + "."
    assert value(T.spoken_sentences(F.lit("It costs $41.00. Come!  Now? " + long))) == ["It costs $41.00.", "Come!", "Now?", " ".join(["word"] * 20) + ",", " ".join(["more"] * 15) + "."]
    assert value(T.spoken_sentences(F.lit(" "))) == [" "] and value(T.spoken_sentences(F.lit(None).cast("string"))) == [None]
    assert value(T.clean_rewrite(F.lit("\n Search query:  'fees for a visa' \nmore"))) == "fees for a visa"
    assert value(T.clean_rewrite(F.lit("x" * 201))) is None and value(T.clean_rewrite(F.lit(" \n "))) is None
    assert value(T.citation_label(F.lit("[1] OCI source"), F.lit("https://a.example/fee-list.html"))) == "fee list"
    assert [value(T.retry_delay(F.lit(a), F.lit(e), F.lit(s))) for a, e, s in ((1, 0, 429), (3, 34, 503), (3, 35, 503), (4, 0, 500), (1, 0, 404))] == [2, 10, None, None, None]
    assert value(T.retrieval_query(F.lit("q"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "b c q"


def test_files(spark, tmp_path):
    logs = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, urls array<string>")
    write_log_csv(logs.coalesce(1), str(tmp_path / "csv"))
    data = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfid,urls") and b"1,a b" in data
    (tmp_path / "m").mkdir()
    for name in ("001.sql", "002.sql", "003.sql", "004.sql"):
        (tmp_path / "m" / name).write_text(f"run {name}")
    ran = []

    def run(text):
        ran.append(text)
        if "003" in text:
            raise RuntimeError

    applied = apply_migrations(spark, str(tmp_path / "m"), spark.createDataFrame([("001.sql",)], "filename string"), run)
    assert ran == ["run 002.sql", "run 003.sql"] and {r.filename for r in applied.collect()} == {"001.sql", "002.sql"}
    chunks = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "id string, source_id string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    write_chunk_dump(chunks, str(tmp_path / "dump"))
    assert {(r.id, r.source_id, r.at) for r in spark.read.option("inferSchema", False).schema("id string, at string, source_id string").json(str(tmp_path / "dump")).collect()} == {("c1", "s1", "1970-01-01T00:00:00.000000Z"), ("c2", "s2", "1970-01-01T00:00:00.000000Z")}
    points, seen, after = spark.createDataFrame([(f"p{k}",) for k in range(7)], "id string"), [], None
    while rows := scroll(points, after, 3).collect():
        seen += [r.id for r in rows]
        after = seen[-1]
    assert seen == [f"p{k}" for k in range(7)]


def test_diffs_of_versions(spark):
    import difflib

    from docketry.operators.maintenance import index_diff, text_diff

    rows = [("s", 1, 0, "x", "old"), ("s", 2, 0, "a", "one\ntwo"), ("s", 2, 1, "b", "three"), ("s", 3, 1, "b", "three"), ("s", 3, 0, "c", "one\n2"), ("s", 3, 2, "c", None), ("t", 1, 0, "a", "alone")]
    df = spark.createDataFrame(rows, "source_id string, version int, chunk_index int, content_hash string, chunk_text string")
    assert [tuple(r) for r in index_diff(df).collect()] == [("s", 2, 3, [0, 2], [0])]
    want = "\n".join(difflib.unified_diff("one\ntwo\n\nthree".splitlines(), "one\n2\n\nthree".splitlines(), "v2", "v3", lineterm=""))
    assert [tuple(r) for r in text_diff(df).collect()] == [("s", 2, 3, want)]
    assert text_diff(df.limit(0)).count() == 0 and index_diff(df.limit(0)).count() == 0
