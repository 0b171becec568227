from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.operators import textops as T


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def masked(c):
    return T.mask(c, T.personal_details(c))


@pytest.mark.parametrize(
    "text, want",
    [
        ("my number is +1 (404) 555-1234 ok", "my number is [PHONE] ok"),
        ("ask +91 98765 43210", "ask [PHONE]"),
        ("write a.b@c.org now", "write [EMAIL] now"),
        ("ssn 123-45-6789", "ssn [SSN]"),
        ("A-12345678 and Z1234567", "[A_NUMBER] and [PASSPORT_NO]"),
        ("file CANT0D7B4N24", "file [REFERENCE_NO]"),
        ("tracking 12 34 56 78", "tracking [NUMBER]"),
        ("My name is Asha Rao Please help", "My name is [NAME] Please help"),
        ("Full name: Asha. Asha", "Full name: [NAME]. [NAME]"),
        ("what is the fee of 150 dollars in 2026", "what is the fee of 150 dollars in 2026"),
        ("", ""),
        (None, None),
    ],
)
def test_mask(spark, text, want):
    assert run(spark, masked, text) == [want]
    if want:
        assert run(spark, masked, want) == [want]  # masking again changes nothing


def test_dashes(spark):
    texts = ["10 – 15 days", "5–10", "Monday – Friday", "word — word", "a—b", "$25 – $50", "9 am – 5 pm", "10 – soon", "none", None, "1–2 and x — y – 3"]
    want = ["10 to 15 days", "5-10", "Monday to Friday", "word, word", "a, b", "$25 to $50", "9 am to 5 pm", "10, soon", "none", None, "1-2 and x, y, 3"]
    assert run(spark, T.rewrite_dashes, *texts) == want


def test_markdown(spark):
    texts = ["**bold** and __b__", "## Head\ntext", "* a\n+ b", "`code`", "see [x](https://a.b/c)", "1.  one", "an *it* word", "2*3*4", "[1] stays"]
    want = ["bold and b", "Head\ntext", "- a\n- b", "code", "see x (https://a.b/c)", "1. one", "an it word", "2*3*4", "[1] stays"]
    assert run(spark, T.strip_markdown, *texts) == want


def test_citations(spark):
    assert run(spark, T.expand_citations, "a [1, 2, 3] b [2-4] c [9-1] d [1-40] [5]", "none", None) == ["a [1][2][3] b [2][3][4] c [9][1] d [1][40] [5]", "none", None]
    assert run(spark, T.cited_indices, "x [2][1] y [2]", "") == [[2, 1], []]
    assert run(spark, T.strip_citations, "Fee [1], [2] now [3].", "a [1] .") == ["Fee now.", "a."]


def test_speech_and_sentences(spark):
    assert run(spark, T.strip_for_speech, "Pay **$41.00** [1]\nat https://x.y/z (https://a.b ) now — please") == ["Pay $41.00 at now, please"]
    assert run(spark, lambda c: T.first_sentences(c, 4), "One two three. Four. Five six.", "a b c d e f. g", "") == ["One two three. Four.", "a b c d e f.", ""]
    assert run(spark, T.strip_thinking, " <think>a\nb</think> hi ") == ["hi"]


def test_small_ones(spark):
    assert run(spark, T.normal_question, "  How  do I? ?!. ", None) == ["how do i", None]
    assert run(spark, T.deobfuscate_emails, "oci[dot]atl [AT] mea[dot] in") == ["oci.atl@mea.in"]
    assert run(spark, T.file_name, "https://a.b/x/y.pdf?q=1", "https://a.b/", "https://a.b") == ["y.pdf", "index", "index"]
    assert run(spark, T.source_label, "https://www.a.b/x/my-file_name%20one.pdf", "https://www.a.b/", "nothing") == ["my file name one", "a.b", "nothing"]
    assert [str(x) for x in run(spark, T.http_date, "Tue, 07 Jan 2025 10:00:00 GMT", "soon", None)] == ["2025-01-07 10:00:00", "None", "None"]
    assert run(spark, lambda c: T.list_marker(c)[1], "1) one", "• two", "a. three", "plain") == ["one", "two", "three", None]
    assert run(spark, T.split_oversized, "a b") == [["a b"]]
    pieces = run(spark, lambda c: T.split_oversized(c, 10), "One two. Three four five. " + "x" * 15)[0]
    assert pieces == ["One two.", "Three four", "five.", "x" * 15]
