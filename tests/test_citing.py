from __future__ import annotations

from docketry.operators.citing import attribute, drop_repeated_sections, number_by_source


def test_numbers_by_source(spark):
    answers = spark.createDataFrame([("a", "Fee [1][2]. Time [3] and [1], [9] out."), ("b", "none"), ("c", "[2] then [1]")], "qid string, text string")
    chunks = spark.createDataFrame([("a", 1, "u", "c1"), ("a", 2, "u", "c2"), ("a", 3, "v", "c3"), ("c", 1, "u", "c1"), ("c", 2, "v", "c2")], "qid string, pos int, url string, chunk_id string")
    got = {r.qid: (r.text, [(c["index"], c["chunk_id"]) for c in r.citations]) for r in number_by_source(answers, chunks).collect()}
    assert got == {"a": ("Fee [1]. Time [2] and [1],  out.", [(1, "c1"), (2, "c3")]), "b": ("none", []), "c": ("[1] then [2]", [(1, "c2"), (2, "c1")])}


def test_attribution(spark):
    lines = spark.createDataFrame([("q", 0, "Bring passport photographs original certificate"), ("q", 1, "Invented words nobody wrote anywhere"), ("q", 2, "short line")], "qid string, line_no int, text string")
    chunks = spark.createDataFrame([("q", 1, "nothing here"), ("q", 2, "bring your passport, photographs and the original certificate"), ("q", 3, "bring passport photographs original certificate"), ("r", 1, "invented words nobody wrote anywhere")], "qid string, pos int, text string")
    assert [tuple(r) for r in attribute(lines, chunks).collect()] == [("q", 0, 2, 1.0)]


def test_sections_once(spark):
    rows = [("d", 0, "h1", "T"), ("d", 1, "h2", "A"), ("d", 2, "p", "x"), ("d", 3, "h2", "a"), ("d", 4, "p", "y"), ("d", 5, "h3", "B"), ("d", 6, "p", "z")]
    got = drop_repeated_sections(spark.createDataFrame(rows, "doc string, pos int, kind string, text string")).orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 1, 2, 5, 6]
