"""Text of scanned pages made continuous and readable.

Lines at page edges that repeat across a document, up to misread letters, are
running headers; lines of nothing but a page number go too. Body lines are then
joined: a word broken at a line end is put together if the corpus vocabulary
(from native text layers) knows it joined, and kept hyphenated if it knows the
compound. A word that the vocabulary lacks is misread if it looks, letter by
letter, like one that it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import cut, join_small

# ---- fixed values: the strokes that a scanner may see in a letter; letters and groups of the same strokes look alike ----
STROKES = {
    "i": "l", "1": "l", "!": "l", "|": "l", "t": "l", "+": "l", "u": "ll", "h": "ll", "n": "rl", "m": "rrl", "e": "c", "é": "c", "d": "cl", "w": "vv", "y": "v",
    "0": "o", "5": "s", "$": "s", "@": "a", "9": "g", "q": "g", "6": "b", "8": "b", "ﬁ": "fl", "ﬂ": "fl",
}
BREAK_MARKS = "-‐‑–\xad¬="
PAGE_NUMBER = r"(?:[-–—\[(]\s*)?(?:(?:page|seite|pág\.?|p\.|no\.?)\s*)?(?:[0-9OolISB]{1,9}|[ivxlcd]{1,9}|[IVXLCD]{1,9})(?:\s*(?:/|of|von|de|sur)\s*[0-9OolISB]{1,9})?(?:\s*[-–—\])])?"

#: Words of the vocabulary that are sent to every task, to pass over without a join.
FREQUENT = 20_000
_STROKES = str.maketrans(STROKES)
_PAGE = re.compile(PAGE_NUMBER, re.I)
_ATTACHED = re.compile(r"^\s*(?:[0-9OolISB]{1,9}|[ivxlcd]{1,9})\s*\|\s*|(?:\s{2,}|\s*\|\s*)(?:[0-9OolISB]{1,9}|[ivxlcd]{1,9})\s*$")
_PLAIN_NUMBER = re.compile(r"[0-9OolISB]+|[ivxlcd]+|[IVXLCD]+")
_NUMBER = re.compile(rf"(?<!\w)(?:{_PLAIN_NUMBER.pattern})(?!\w)")
_FIGURES = str.maketrans("OolISB", "001158")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500}
_WORD = re.compile(r"(?:[^\W_]|[!|+@$](?=[^\W\d_]))(?:[^\W_]|[!|+@$'’\-](?=[^\W_]))*(?:(?<=[^\W\d_])[+@|](?=[\s.,;:)?]|$))?")
_AMOUNT = re.compile(r"(?=[^\s]*\d)(?=[^\s]*[OolISB])[0-9OolISB]+(?:[.:,][0-9OolISB]+)*")
_BROKEN = re.compile(rf"([^\W\d_](?:[^\W_]|[!|+@$'’\-](?=[^\W_]))*)\s*[{re.escape(BREAK_MARKS)}]\s*$")
_HEAD = re.compile(r"\s*([^\s.,;:()\"?/–—]+)")
_TITLE_WORD = re.compile(r"[^\W_](?:[^\W_]|[!|+@$](?=[^\W_]))*")
_ENDS = ".!?:;।"


def look(word: str) -> str:
    """How a word looks to a scanner: words that it may confuse look the same."""
    return word.lower().translate(_STROKES)


def is_scan(text: str, marked: bool = False) -> bool:
    """Lines broken by the width of a page: most are nearly full, and sentences run on over their ends.

    Two lines, or lines narrower than a printed column, tell too little by
    themselves; there it takes the mark of the extraction as well.
    """
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        return False
    width = max(map(len, lines))
    if not marked and (len(lines) < 3 or width < 25):
        return False
    full = sum(len(x) >= 0.65 * width for x in lines)
    if full < 0.4 * len(lines):
        return False
    runs = sum(x[-1] not in _ENDS and y[:1].islower() for x, y in zip(lines, lines[1:]))
    return runs >= 0.2 * len(lines)


def words_of(line: str) -> list[str]:
    return [m.group() for m in _WORD.finditer(line)]


def _page_number(line: str) -> bool:
    text = line.strip()
    return bool(text) and _PAGE.fullmatch(text) is not None and (any(c.isdigit() for c in text) or re.fullmatch(r"[ivxlcd]+", text) is not None)


def number_of(text: str) -> int | None:
    """The first number of a page-number line, letters that a scanner takes for figures read as such; null if there is none."""
    m = _NUMBER.search(text)
    if m is None:
        return None
    found = m.group()
    if any(map(str.isdigit, found)) or found.lower().strip("ivxlcd"):
        found = found.translate(_FIGURES)
        return int(found) if found.isascii() and found.isdigit() else None
    values = [_ROMAN[c] for c in found.lower()]
    return sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))


def _header_like(line: str) -> str:
    """The title in a line that may be a running header, or ''."""
    text = _ATTACHED.sub("", line).strip()
    if not text or text[-1] in ".;,?!:" or not (text[0].isupper() or text[0].isdigit() and text[1:2].isalpha()):
        return ""
    return text


def header_key(title: str) -> str:
    return "".join(look(w) for w in _TITLE_WORD.findall(title) if not w.isdigit())


def read_scan(text: str) -> dict[int, tuple]:
    """line_no -> ('page', number, sure, lines beside it) or ('title', key, edge).

    A page number is sure by itself if it is set as one (`Page 3 of 9`, `— 3 —`),
    stands at an end of the text, beside another one, or within a sentence. edge: 2 for a title with a page number or within a sentence, 1 for
    one at an end of the text, else 0.
    """
    lines = text.split("\n")
    shown = [k for k, x in enumerate(lines) if x.strip()]
    pages = {k for k in shown if _page_number(lines[k])}
    out: dict[int, tuple] = {}
    rest = [k for k in shown if k not in pages]
    at = {k: n for n, k in enumerate(shown)}
    for n, k in enumerate(rest):
        title = _header_like(lines[k])
        key = header_key(title) if title else ""
        if len(key) < 5:
            continue
        before = lines[rest[n - 1]].rstrip() if n else ""
        after = lines[rest[n + 1]].lstrip() if n + 1 < len(rest) else ""
        beside = [shown[j] for j in (at[k] - 1, at[k] + 1) if 0 <= j < len(shown)]
        numbered = _ATTACHED.search(lines[k]) is not None or not pages.isdisjoint(beside)
        cuts = bool(before) and before[-1] not in _ENDS and after[:1].islower()
        out[k] = ("title", key, 2 if numbered or cuts else 1 if n in (0, len(rest) - 1) else 0)
    for k in pages:
        n, own = at[k], lines[k].strip()
        before = lines[shown[n - 1]].rstrip() if n else ""
        beside = [shown[j] for j in (n - 1, n + 1) if 0 <= j < len(shown)]
        sure = n in (0, len(shown) - 1) or _PLAIN_NUMBER.fullmatch(own) is None or before[-1] not in _ENDS or any(j in pages for j in beside)
        out[k] = ("page", number_of(own), sure, beside)
    return out


class _Tokens(dict):
    """A token between white space -> (is an amount with misread figures, its words that the frequent ones do not hold), kept as tokens come up."""

    def __init__(self, frequent: frozenset):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, token: str) -> tuple[str | None, tuple[tuple[str, str], ...]]:
        if len(self) >= 200_000:
            self.clear()
        amount, words = None, ()
        if not (token.isalpha() and token.lower() in self.frequent):
            bare = token.strip(".,;:()\"'’?")
            if not bare.isalpha() and any(map(str.isdigit, bare)) and _AMOUNT.fullmatch(bare):
                amount = bare
            words = tuple((w.lower(), look(w)) for w in words_of(token) if w.lower() not in self.frequent and not w.isdigit() and not _AMOUNT.fullmatch(w))
        found = self[token] = amount, words
        return found


class ScanRepair:
    """Findings in `chunks`, made when the object is made.

    chunks has extract_id, raw_content_path, text, used_ocr; other columns are
    ignored. used_ocr, now and then wrong, only tips the scale for texts too short
    or narrow to tell: what a scan is shows in the text. Rows with null id or text
    hold nothing; a null path is a document of its own; of rows that differ under
    one id the one whose text has the least hash counts.

    in_document: a title is a header if its document holds it so often, once with
    a page number or within a sentence; in_corpus: or all documents so often, half
    of them so. Titles of the same document within one edit in ten letters of a
    header are headers too. A bare number is a page number if it stands like one,
    beside a header, or continues the numbers of its document.
    found: (extract_id, line_no, kind).
    """

    def __init__(self, chunks: DataFrame, valid: int = 2, in_document: int = 2, in_corpus: int = 4):
        rows = chunks.select("extract_id", "raw_content_path", "text", F.coalesce("used_ocr", F.lit(False)).alias("used_ocr") if "used_ocr" in chunks.columns else F.lit(False).alias("used_ocr")).where("extract_id IS NOT NULL AND text IS NOT NULL")
        self.id_kind = dict(chunks.dtypes)["extract_id"]
        read = cut(self._read(rows)).withColumn("row", F.monotonically_increasing_id())
        once = read.where("extract_id IS NOT NULL")
        version = F.min(F.struct("text_hash", "doc", "row"))
        several = cut(once.groupBy("extract_id").agg(F.count("*").alias("n"), version.alias("x")).where("n > 1").select("extract_id", F.col("x.row").alias("kept")))
        once = join_small(once, several, ["extract_id"], how="left", spread="row").where("kept IS NULL OR row = kept")
        self.native = once.where("text IS NULL").select("extract_id")
        self.once = once.where("text IS NOT NULL").select("extract_id", "doc", "text")
        self.chunks = rows
        words = read.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.first("look").alias("look"))
        self.vocabulary = cut(words.where((F.col("n") >= valid) & F.col("word").rlike(r"\p{L}")))
        self.headers = self._headers(in_document, in_corpus)
        self.body = self._body()
        self.found = self._found()

    def _read(self, rows: DataFrame) -> DataFrame:
        """One row a text, with the text itself if it is a scan, and the words of native texts with their counts, each task summing up its own."""
        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(self.id_kind, pa.string())
        names = ["extract_id", "doc", "text", "text_hash", "word", "n", "look"]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens: Counter = Counter()

            def words() -> pa.RecordBatch:
                total: Counter = Counter()
                for token, n in tokens.items():
                    for w in words_of(token):
                        total[w.lower()] += n
                tokens.clear()
                none = pa.nulls(len(total), pa.string())
                return pa.RecordBatch.from_arrays([pa.nulls(len(total), id_type), none, none, pa.nulls(len(total), pa.int64()), pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([look(w) for w in total], pa.string())], names=names)

            for batch in batches:
                texts = []
                for text, marked in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                    if is_scan(text, marked):
                        texts.append(text)
                    else:
                        texts.append(None)
                        tokens.update(text.split())
                n, none = len(texts), pa.nulls(len(texts), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3), none, pa.nulls(n, pa.int64()), none], names=names)
                if len(tokens) > 500_000:
                    yield words()
            yield words()

        doc = F.coalesce("raw_content_path", F.concat(F.lit("?"), F.col("extract_id").cast("string")))
        return rows.select("extract_id", doc.alias("doc"), "text", F.xxhash64("text").alias("text_hash"), "used_ocr").mapInArrow(read, f"extract_id {self.id_kind}, doc string, text string, text_hash long, word string, n long, look string")

    def _headers(self, in_document: int, in_corpus: int) -> DataFrame:
        """(extract_id, line_no, kind): page numbers, and titles that repeat in their document or, at an edge, in the corpus."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, nos, kinds, keys, numbers, edges, besides = [], [], [], [], [], [], []
                for row, text in enumerate(batch.column(2)):
                    for k, x in read_scan(text.as_py()).items():
                        rows.append(row)
                        nos.append(k)
                        kinds.append(x[0])
                        keys.append(x[1] if x[0] == "title" else None)
                        numbers.append(x[1] if x[0] == "page" and x[1] is not None and x[1] < 1 << 31 else None)
                        edges.append(int(x[2]))
                        besides.append(x[3] if x[0] == "page" else None)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(nos, pa.int32()), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(edges, pa.int32()), pa.array(besides, pa.list_(pa.int32()))], names=["extract_id", "doc", "line_no", "kind", "key", "number", "edge", "beside"])

        lines = cut(self.once.mapInArrow(read, f"extract_id {self.id_kind}, doc string, line_no int, kind string, key string, number int, edge int, beside array<int>"))
        titles = lines.where("kind = 'title'")
        here = titles.groupBy("doc", "key").agg(F.count("*").alias("here"), F.max("edge").alias("edge_here"))
        there = here.groupBy("key").agg(F.sum("here").alias("there"), F.sum(F.when(F.col("edge_here") == 2, F.col("here")).otherwise(0)).alias("edges"))
        judged = here.join(there, "key")
        good = cut(judged.where(((F.col("here") >= in_document) & (F.col("edge_here") == 2)) | ((F.col("there") >= in_corpus) & (F.col("edges") >= 0.5 * F.col("there")))).select("doc", "key"))
        exact = join_small(titles, good, ["doc", "key"], how="left_semi", spread="extract_id").select("extract_id", "line_no")
        # letters lost or added: one edit leaves five letters at the beginning or at the end as they are
        ends = lambda key: F.array(F.concat(F.lit("<"), F.substring(key, 1, 5)), F.concat(F.lit(">"), F.expr(f"right({key}, 5)")))
        known = good.select("doc", F.col("key").alias("known"), F.explode(ends("key")).alias("end"))
        near = titles.where("edge > 0 AND length(key) >= 10").select("extract_id", "line_no", "doc", "key", F.explode(ends("key")).alias("end"))
        near = join_small(near, known, ["doc", "end"], spread="extract_id").where(F.levenshtein("key", "known") <= F.floor(F.length("known") / 10)).select("extract_id", "line_no")
        headers = exact.unionByName(near).distinct().withColumn("kind", F.lit("running_header"))
        # bare numbers within the text count beside a header, or if the one before or after is in the document too
        pages = lines.where("kind = 'page'")
        numbers = pages.where("number IS NOT NULL").select("doc", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number")).distinct()
        loose = pages.where("edge = 0")
        headed = loose.select("extract_id", F.col("line_no").alias("own"), F.explode("beside").alias("line_no")).join(headers, ["extract_id", "line_no"], "left_semi").select("extract_id", F.col("own").alias("line_no"))
        loose = loose.join(numbers, ["doc", "number"], "left_semi").select("extract_id", "line_no").unionByName(headed).distinct()
        numbered = pages.where("edge = 1").select("extract_id", "line_no").unionByName(loose)
        return cut(numbered.withColumn("kind", F.lit("page_number")).unionByName(headers))

    def _body(self) -> DataFrame:
        """(extract_id, line_no, item, left, right, word, compound, look): words of body lines that need the vocabulary."""
        gone = self.headers.groupBy("extract_id").agg(F.collect_set("line_no").alias("gone"))
        # the most frequent words are known to every task, at most FREQUENT of them; all others meet the vocabulary in a join
        words = self.vocabulary.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow().column(0).to_pylist()
        shared = self.once.sparkSession.sparkContext.broadcast(frozenset(words))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _Tokens(shared.value)
            names = ["extract_id", "line_no", "next_no", "item", "left", "right", "word", "compound", "look"]
            for batch in batches:
                out: list[list] = [[] for _ in names]

                def add(*values, out=out) -> None:
                    for column, value in zip(out, values):
                        column.append(value)

                for row, text in enumerate(batch.column(1).to_pylist()):
                    skip = set(batch.column(2)[row].as_py() or ())
                    lines = text.split("\n")
                    shown = [k for k, x in enumerate(lines) if x.strip() and k not in skip]
                    carried = 0  # characters at a line's start that belong to the word before
                    for n, k in enumerate(shown):
                        line = lines[k]
                        after = shown[n + 1] if n + 1 < len(shown) else None
                        stop, start, carried = len(line), carried, 0
                        if line.rstrip()[-1] in BREAK_MARKS and after is not None and (m := _BROKEN.search(line)) and (head := _HEAD.match(lines[after])):
                            left, right = m.group(1), head.group(1)
                            add(row, k, after, "break", left, right, (left + right).lower(), f"{left}-{right}".lower(), look(left + right))
                            stop, carried = m.start(1), head.end()
                        seen = set()
                        for token in line[start:stop].split():
                            amount, words = tokens[token]
                            if amount is not None:
                                add(row, k, None, "amount", None, None, amount, None, None)
                            if words:
                                seen.update(words)
                        for word, looks in seen:
                            add(row, k, None, "word", None, None, word, None, looks)
                ids = batch.column(0).take(pa.array(out[0], pa.int32()))
                ints, strings = pa.int32(), pa.string()
                yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], ints), pa.array(out[2], ints), *[pa.array(x, strings) for x in out[3:]]], names=names)

        texts = self.once.select("extract_id", "text").join(gone, "extract_id", "left").select("extract_id", "text", "gone")
        return cut(texts.mapInArrow(read, f"extract_id {self.id_kind}, line_no int, next_no int, item string, left string, right string, word string, compound string, look string"))

    def _found(self) -> DataFrame:
        known = self.vocabulary.select("word", F.col("n").alias("known"))
        compounds = self.vocabulary.select(F.col("word").alias("compound"), F.col("n").alias("compound_n"))
        # of words that look alike the most frequent stands for all
        best = self.vocabulary.groupBy("look").agg(F.max(F.struct("n", "word")).alias("x")).select("look", F.col("x.word").alias("meant"), F.col("x.n").alias("meant_n"))
        # distinct words meet the vocabulary, not their occurrences; those then meet the judged words, salted if these are many
        body = self.body.withColumn("compound", F.coalesce("compound", F.lit("")))
        words = body.where("item <> 'amount'").select("word", "compound", "look").distinct()
        judged = words.join(known, "word", "left").join(compounds, "compound", "left").join(best, "look", "left")
        judged = cut(judged.select("word", "compound", "known", "compound_n", "meant", "meant_n"))
        met = join_small(body.where("item <> 'amount'"), judged, ["word", "compound"], how="left", spread="extract_id")
        joined_n = F.coalesce("known", "meant_n", F.lit(0))
        broken = met.where("item = 'break'").withColumn("is_break", (joined_n >= F.coalesce("compound_n", F.lit(0))) & ((joined_n > 0) | F.col("compound_n").isNull()))
        breaks = broken.where("is_break").select("extract_id", "line_no", F.lit("word_break").alias("kind"))
        # the misread half of a broken word is the one that its word does not begin or end with
        half = broken.where("is_break AND known IS NULL AND meant IS NOT NULL AND word <> meant")
        first = half.where(~F.expr("startswith(meant, lower(left))")).select("extract_id", "line_no")
        second = half.where(~F.expr("endswith(meant, lower(right))")).select("extract_id", F.col("next_no").alias("line_no"))
        whole = met.where("item = 'word' AND known IS NULL AND meant IS NOT NULL").select("extract_id", "line_no")
        amounts = self.body.where("item = 'amount'").select("extract_id", "line_no")
        misread = first.unionByName(second).unionByName(whole).unionByName(amounts).distinct().withColumn("kind", F.lit("misread"))
        self.corrections = judged.where("known IS NULL AND meant IS NOT NULL").select("word", "meant").distinct()
        self.breaks = breaks
        return self.headers.unionByName(breaks).unionByName(misread).distinct()

    def paragraphs(self) -> DataFrame:
        """(extract_id, repaired_text): headers and page numbers out, broken words joined, misread words replaced, lines joined to paragraphs."""
        gone = self.headers.groupBy("extract_id").agg(F.collect_set("line_no").alias("gone"))
        cuts = self.breaks.groupBy("extract_id").agg(F.collect_set("line_no").alias("cuts"))
        fixes = self.body.where("item <> 'amount'").select("extract_id", "word").distinct().join(self.corrections, "word").groupBy("extract_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("fixes"))

        def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, gone, cuts, fixes in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                    out.append(rebuild(text, set(gone or ()), set(cuts or ()), dict(fixes or ())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["extract_id", "repaired_text"])

        rows = self.once.select("extract_id", "text").join(gone, "extract_id", "left").join(cuts, "extract_id", "left").join(fixes, "extract_id", "left").select("extract_id", "text", "gone", "cuts", "fixes")
        repaired = rows.mapInArrow(repair, f"extract_id {self.id_kind}, repaired_text string")
        native = self.chunks.groupBy("extract_id").agg(F.min_by("text", F.xxhash64("text")).alias("repaired_text")).join(self.native, "extract_id", "left_semi")
        return repaired.unionByName(native)


def rebuild(text: str, gone: set[int], cuts: set[int], fixes: dict[str, str]) -> str:
    """One scanned text from its lines; blank lines between paragraphs stay."""
    out, paragraph = [], ""
    glue = ""
    for k, line in enumerate(text.split("\n")):
        if k in gone:
            continue
        if not line.strip():
            if paragraph and paragraph.rstrip()[-1:] in _ENDS:
                out.append(paragraph)
                paragraph, glue = "", ""
            continue
        line = line.strip()
        if k in cuts:
            paragraph, glue = paragraph + glue + re.sub(rf"\s*[{re.escape(BREAK_MARKS)}]\s*$", "", line), ""
        else:
            paragraph, glue = paragraph + glue + line, " "
    if paragraph:
        out.append(paragraph)

    def fix(m: re.Match) -> str:
        word = m.group()
        meant = fixes.get(word.lower())
        return word if meant is None else meant.capitalize() if word[:1].isupper() else meant

    return "\n\n".join(_WORD.sub(fix, x) for x in out)
