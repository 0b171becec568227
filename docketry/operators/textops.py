"""Scalar text operators as column expressions and, where order matters, folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and words that results depend on ----
WEEKDAYS_AND_MONTHS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun"
    " january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
LIST_MARKER = r"^([•●■\-*]|\d+[.)]|\([a-zA-Z0-9]+\)|[a-zA-Z][.)])\s+(.+)$"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"(?U)(?<![\w+])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?!\w)|(?<![\w+])\+91[\s.-]?\d{5}[\s.-]?\d{5}(?!\w)"
A_NUMBER = r"\bA[-\s]?\d{8,9}\b"
PASSPORT = r"\b[A-Za-z]\d{7}\b"
TOKEN = r"\b[A-Za-z0-9]{8,20}\b"
LONG_NUMBER = r"(?U)(?<![\w.])\d(?:[\s-]?\d){5,}(?![\w.])"
NAME = r"(?U)\b(?i:my\s+(?:full\s+)?name\s+is|full\s+name\s*(?:is)?\s*[:\-]?)\s*([A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+){0,3})"
#: Markdown marks and what replaces them, in the order in which they go.
MARKDOWN = [
    (r"\[([^\]\d][^\]]*)\]\((https?://[^)\s]+)\)", "$1 ($2)"),
    (r"(?s)(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
    (r"`+([^`\n]+)`+", "$1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^([ \t]*)[*+][ \t]+", "$1- "),
    (r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])", "$1"),
    (r"(?m)^([ \t]*\d+[.)])[ \t]{2,}", "$1 "),
]
THINKING = r"(?s)<think>.*?</think>"
GROUPED_CITATION = r"\[\s*(\d+(?:\s*(?:,|-|–|to)\s*\d+)+)\s*\]"
CITATIONS = r"(?U)\s*\[\d+\](?:\s*,?\s*\[\d+\])*"
#: Wordings of prompts.
EARLIER_QUESTIONS = "Earlier questions in this conversation:\n"
NEW_MESSAGE = "\n\nNew message: "
VISITOR_ASKED = "The visitor asked: "
WRITTEN_ANSWER = "\n\nHere is the correct written answer:\n\n"
SPOKEN_REPLY = "\n\nRewrite it as a short spoken reply, following the rules exactly."
QUERY_LABEL = r"(?i)^(?:search\s+)?query\s*:\s*"
CITATION_TITLE = r"^\[(\d+)\]\s*(\S+)\s*(.*)$"
NAME_STOPS = (
    "could can please i my and the is what how when where why do does will would should thank thanks kindly help need want passport oci visa application file date"
).split()


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _labelled(values: Column, label: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(f"[{label}]").alias("label")))


def personal_details(text: Column) -> Column:
    """array<struct<value, label>> of details by eight patterns in their order of precedence (T01); each value with its first label."""
    is_reference = lambda t: (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2)
    name = lambda captured: F.array_join(
        F.aggregate(
            F.split(captured, r"(?U)\s+"),
            F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over")),
            lambda acc, w: F.struct(
                F.when(acc["over"] | F.lower(w).isin(NAME_STOPS), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(w))).alias("kept"),
                (acc["over"] | F.lower(w).isin(NAME_STOPS)).alias("over"),
            ),
        )["kept"],
        " ",
    )
    found = F.concat(
        _labelled(_all(text, EMAIL), "EMAIL"),
        _labelled(_all(text, SSN), "SSN"),
        _labelled(_all(text, PHONE), "PHONE"),
        _labelled(_all(text, A_NUMBER), "A_NUMBER"),
        _labelled(_all(text, PASSPORT), "PASSPORT_NO"),
        _labelled(F.filter(_all(text, TOKEN), is_reference), "REFERENCE_NO"),
        _labelled(_all(text, LONG_NUMBER), "NUMBER"),
        _labelled(F.filter(F.transform(_all(text, NAME, 1), name), lambda n: n != ""), "NAME"),
    )
    return F.aggregate(
        found,
        F.array().cast("array<struct<value:string,label:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["value"] == x["value"]), acc).otherwise(F.concat(acc, F.array(x))),
    )


def mask(text: Column, details: Column) -> Column:
    """Every literal occurrence of the details replaced by their labels, longest value first."""
    longest = F.array_sort(F.transform(details, lambda x, i: F.struct((-F.length(x["value"])).alias("n"), i.alias("i"), x["value"].alias("value"), x["label"].alias("label"))))
    return F.aggregate(longest, text, lambda acc, x: F.replace(acc, x["value"], x["label"]))


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, THINKING, ""))


def strip_markdown(text: Column) -> Column:
    """Links, bold, code, headings, bullets, italics, numbered items, in this order."""
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return text


def rewrite_dashes(text: Column) -> Column:
    """Em and en dashes as `, `; as ` to ` or `-` in a range (digits, or weekdays and months, on both sides).

    The text is cut at its dashes; what a dash means is read from the original
    words to its left and right.
    """
    pieces = F.split(text, "[—–]")
    words = "|".join(WEEKDAYS_AND_MONTHS)
    last = lambda s, n: F.regexp_extract(s, rf"(?U)((?:\S+\s+){{0,{n - 1}}}\S+)\s*$", 1)
    first = lambda s, n: F.regexp_extract(s, rf"(?U)^\s*(\S+(?:\s+\S+){{0,{n - 1}}})", 1)
    bare = lambda s: F.lower(F.regexp_replace(s, r"(?U)\W+", ""))
    whole_left = lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "—")
    whole_right = lambda i: F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "—")

    def step(acc: Column, i: Column) -> Column:
        left, right = whole_left(i), whole_right(i)
        digits = last(left, 2).rlike(r"\d") & first(right, 2).rlike(r"\d")
        named = bare(last(left, 1)).rlike(f"^(?:{words})$") & bare(first(right, 1)).rlike(f"^(?:{words})$")
        spaced = F.element_at(pieces, i).rlike(r"(?U)\s$") | F.element_at(pieces, i + 1).rlike(r"(?U)^\s")
        by = F.when(digits | named, F.when(spaced, F.lit(" to ")).otherwise(F.lit("-"))).otherwise(F.lit(", "))
        return F.concat(F.regexp_replace(acc, r"(?U)\s+$", ""), by, F.regexp_replace(F.element_at(pieces, i + 1), r"(?U)^\s+", ""))

    folded = F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), F.element_at(pieces, 1), step)
    return F.when(F.size(pieces) < 2, text).otherwise(folded)


def expand_citations(text: Column) -> Column:
    """`[1, 3-5]` as `[1][3][4][5]`; a span over 20 or reversed keeps its two ends."""
    marks, inner = _all(text, GROUPED_CITATION), _all(text, GROUPED_CITATION, 1)

    def numbers(part: Column) -> Column:
        ends = F.transform(_all(part, r"\d+"), lambda x: x.cast("int"))
        lo, hi = ends[0], F.element_at(ends, -1)
        return F.when(F.size(ends) == 1, ends).when((hi - lo > 0) & (hi - lo <= 20), F.sequence(lo, hi)).otherwise(F.array(lo, hi))

    expanded = F.transform(inner, lambda g: F.array_join(F.transform(F.flatten(F.transform(F.split(g, r"\s*,\s*"), numbers)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    return F.aggregate(F.arrays_zip(marks.alias("mark"), expanded.alias("by")), text, lambda acc, x: F.replace(acc, x["mark"], x["by"]))


def cited_indices(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, r"\[(\d+)\]", 1), lambda x: x.cast("int")))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CITATIONS, ""), r"[ \t]+([.,;:!?])", "$1")


def normal_question(text: Column) -> Column:
    """Stripped, lower case, without `?.! ` at the end, white space as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), r"[?.! ]+$", ""), r"(?U)\s+", " ")


def deobfuscate_emails(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?iU)\s*\[dot\]\s*", "."), r"(?iU)\s*\[at\]\s*", "@")


def strip_for_speech(text: Column) -> Column:
    """Readable aloud: no marks, markdown, addresses, empty brackets, dashes or line breaks."""
    text = strip_markdown(F.regexp_replace(text, r"\s*\[\d+\]", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\bhttps?://\S+", ""), r"\(\s*\)", "")
    text = F.regexp_replace(rewrite_dashes(text), r"[ \t]*\n[ \t]*", " ")
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " "))


def first_sentences(text: Column, words: int = 55) -> Column:
    """Whole sentences from the start while at most `words` words; the first always."""
    sentences = F.split(F.trim(text), r"(?U)(?<=[.!?])\s+")
    size = lambda s: F.size(F.filter(F.split(F.trim(s), r"(?U)\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc: Column, s: Column) -> Column:
        over = acc["over"] | ((F.size(acc["out"]) > 0) & (acc["n"] + size(s) > words))
        return F.struct(F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out"), (acc["n"] + size(s)).alias("n"), over.alias("over"))

    return F.trim(F.array_join(F.aggregate(sentences, start, step)["out"], " "))


def list_marker(text: Column) -> tuple[Column, Column]:
    """(marker, rest), both null for a text without a list marker."""
    marker, rest = F.regexp_extract(text, LIST_MARKER, 1), F.regexp_extract(text, LIST_MARKER, 2)
    return F.when(marker != "", marker), F.when(marker != "", rest)


def file_name(url: Column) -> Column:
    """The last part of an address's path, `index` if empty."""
    name = F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"([^/]*)/?$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("index")).otherwise(name)


def source_label(url: Column) -> Column:
    """A readable label of an address: its last path part decoded, or its host."""
    part = F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"([^/]+)/*$", 1)
    label = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(part), part), r"(?i)\.(?:html?|php|aspx?|pdf)$", ""), "[-_]+", " "))
    host = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^www\.", "")
    return F.when(label != "", label).when(host != "", host).otherwise(url)


def http_date(text: Column) -> Column:
    """An HTTP date as a timestamp, null if it is none."""
    rest = F.regexp_extract(text, r"^\s*[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1)
    return F.when(rest != "", F.try_to_timestamp(rest, F.lit("dd MMM yyyy HH:mm:ss")))


def subject(text: Column, n: int = 80) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def money_values(text: Column) -> Column:
    return _all(text, r"(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)? (?:crowns|dollars))")


def duration_values(text: Column) -> Column:
    return _all(text, r"(?i)\d+(?:\s*(?:-|to)\s*\d+)? (?:working |business )?(?:day|week|month|year|hour|minute)s?")


def looks_like_label(text: Column) -> Column:
    """Loose text of under four words without a digit or one of `.:;$`."""
    return (F.size(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")) < 4) & ~text.rlike(r"(?U)[\d.:;$]")


def split_oversized(text: Column, limit: int = 1800) -> Column:
    """Pieces of at most `limit` characters, cut at sentence ends, else at blanks; a longer word stays whole."""
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+")
    parts = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + 1 + F.length(part) > limit)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"),
            F.when(full, part).otherwise(F.trim(F.concat(acc["now"], F.lit(" "), part))).alias("now"),
        )

    folded = F.aggregate(parts, start, step)
    return F.when(folded["now"] == "", folded["out"]).otherwise(F.concat(folded["out"], F.array(folded["now"])))


def spoken_sentences(text: Column, words: int = 30) -> Column:
    """Sentences for speaking; one of over `words` words is cut at commas into parts of at most so many, where commas allow."""
    count = lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        longer = F.concat(acc["now"], F.lit(" "), piece)
        full = (acc["now"] != "") & (count(longer) > words)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"), F.when(full | (acc["now"] == ""), piece).otherwise(longer).alias("now"))

    def cut(s: Column) -> Column:
        folded = F.aggregate(F.split(s, r"(?U)(?<=,)\s+"), start, step)
        return F.when(folded["now"] == "", folded["out"]).otherwise(F.concat(folded["out"], F.array(folded["now"])))

    sentences = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    parts = F.flatten(F.transform(sentences, lambda s: F.when(count(s) <= words, F.array(s)).otherwise(cut(s))))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def citation_title(index: Column, category: Column, title: Column) -> Column:
    """`[n] CATEGORY title`, `source` for what is missing."""
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.upper(F.coalesce(category, F.lit("source"))), F.lit(" "), F.coalesce(title, F.lit("source")))


def citation_label(title: Column, url: Column) -> Column:
    """The source's name in a citation title, or a label of its address where it says only `source`."""
    name = F.trim(F.regexp_extract(title, CITATION_TITLE, 3))
    return F.when((name != "") & (name != "source"), name).otherwise(source_label(url))


def clean_rewrite(text: Column, most: int = 200) -> Column:
    """The first line that is not blank, without a `query:` label and quotes; null if empty or over `most` characters."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.regexp_replace(F.get(lines, F.lit(0)), QUERY_LABEL, "")
    line = F.trim(F.regexp_replace(F.trim(line), "^[\"'`]+|[\"'`]+$", ""))
    return F.when((line != "") & (F.length(line) <= most), line)


def rewrite_prompt(question: Column, earlier: Column) -> Column:
    """A question under the earlier ones as a list, or alone."""
    listed = F.array_join(F.transform(earlier, lambda q: F.concat(F.lit("- "), q)), "\n")
    return F.when(F.size(earlier) > 0, F.concat(F.lit(EARLIER_QUESTIONS), listed, F.lit(NEW_MESSAGE), question)).otherwise(question)


def retrieval_query(question: Column, earlier: Column) -> Column:
    """At most two earlier questions and the question, joined by blanks."""
    return F.array_join(F.concat(_last(earlier, 2), F.array(question)), " ")


def _last(values: Column, n: int) -> Column:
    values = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.size(values) <= n, values).otherwise(F.slice(values, F.size(values) - n + 1, F.lit(n)))


def retry_delay(attempt: Column, elapsed: Column, status: Column, delays: tuple[int, ...] = (2, 5, 10), budget: int = 45) -> Column:
    """Seconds to wait after failed attempt number `attempt` (from 1), null to stop.

    Only 429 and 5xx are tried again, as often as there are delays, and not if
    the wait would end at `budget` seconds or later.
    """
    delay = F.get(F.array(*[F.lit(d) for d in delays]), attempt - 1)
    return F.when(((status == 429) | status.between(500, 599)) & (elapsed + delay < budget), delay)


def voice_prompt(question: Column, answer: Column) -> Column:
    """What a model is asked that turns a grounded answer into a spoken one."""
    return F.concat(F.lit(VISITOR_ASKED), question, F.lit(WRITTEN_ANSWER), answer, F.lit(SPOKEN_REPLY))
