"""Template residue, filler text and error-page messages within texts.

Each text is cut into segments (sentences within lines). What the corpus knows
decides first: a short segment is odd if many of its words are held by hardly any
text; odd segments that several hosts give, mostly on pages whose slug and title
share no word with them, are responses of servers and templates rather than
guidance, and so are odd segments in the words of such responses. Segments without
function words are filler if the corpus knows hardly any of their words from
elsewhere. Placeholders are told by their syntax. Lists of messages, notices and
fillers are a prior beside these; short segments in the vocabulary of servers and
browsers are judged by their hosts like odd ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.lines import site_of
from docketry.runtime import cut, join_small

# ---- fixed values: syntax of template languages and form letters ----
PLACEHOLDER = [
    r"\{\{[^{}\n]+\}\}",
    r"\$\{[^{}\n]+\}",
    r"\{[%#][^{}\n]+[%#]\}",
    r"<%[^<>\n]+%>",
    r"\[\[[^\[\]\n]+\]\]",
    r"<<[A-Za-z][^<>\n]*>>",
    r"@@[A-Za-z]\w*@@",
    r"__[A-Za-z](?:(?!__)\w)*__",
    r"%[A-Za-z][A-Za-z_]+%",
    r"#[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*#",
    r"(?<![{$])\{[A-Za-z][A-Za-z_ .]*\}",
    r"&lt;[A-Za-z][\w ]*&gt;",
    r"(?<!<)<[a-z]+(?:[ _][a-z]+)*>(?!>)",
    r"\[[^\[\]\n]*\b(?:TBC|TBD|TODO|tbc|tbd)\]",
    r"\[(?:[Ii]nsert|[Ee]nter|[Aa]dd|INSERT|ENTER)\b[^\[\]\n]+\]",
    r"\((?:TODO|TBD|FIXME)\b[^()\n]*\)",
    r"\bX{3,}(?: [a-z]+){1,4} X{3,}",
    r"\[[A-Z]{2,}(?: [A-Z]+)*\]",
    r"(?<!\[)\[[a-z]+(?: [a-z]+)+\](?![\](])",
    r"\[[Pp]ara(?:graph)? ?\d+\]",
]
#: Labels that stand for a masked detail: no residue.
MASKS = ["EMAIL", "SSN", "PHONE", "A NUMBER", "PASSPORT NO", "REFERENCE NO", "NUMBER", "NAME", "ADDRESS", "ID NUMBER", "REDACTED", "MASKED", "HIDDEN"]
#: Markup of ordinary text: no residue.
TAGS = ["a", "b", "i", "u", "p", "s", "br", "hr", "em", "strong", "small", "sub", "sup", "ul", "ol", "li", "td", "tr", "th", "table", "div", "span", "code", "pre", "q"]
# ---- fixed values: filler ----
FILLER = [
    r"\b(?:lorem|ipsum dolor|dolor sit amet|consectetur adipiscing)\b",
    r"\b(?:demo|dummy|sample|example|filler|test|placeholder|blind) (?:text|content|copy|words?|paragraph|heading|title)\b",
    r"\b(?:asdf|qwer|qwerty|zxcv|uiop|dfgh|hjkl|jkl)\b",
    r"\b(?:content|text|copy|image|title) goes here\b",
    r"\byour (?:introduction|text|title|content|headline) here\b",
    r"\bcoming soon: ",
    r"^coming soon\W*$",
    r"\b(?:title|subtitle|description|text|heading) (?:of|for) (?:this |the )?box\b",
    r"\bnothing to see (?:yet|here)\b",
    r"\breplace me\b",
]
#: A segment that only repeats itself.
REPEATS = [r"^\W*([^\W\d_]{2,})(?:\W+\1){2,}\W*$", r"^\W*([^\W\d_]{2,})\W+([^\W\d_]{2,})(?:\W+\1\W+\2)+\W*$", r"^\W*heading heading\W*$"]
# ---- fixed values: messages of servers, gates and waiting pages ----
_GONE = r"(?:not (?:be )?found|no longer (?:exists?|available)|does not exist|is unavailable)"
MESSAGE = [
    rf"\b(?:page|document|file|site|resource|url|address)(?: you (?:asked for|requested|are looking for))? (?:could |can |was |is )?{_GONE}\W*$",
    r"\b(?:page|document) does not exist\b",
    r"\b(?:page|document|file) (?:has been |was )?(?:moved or deleted|deleted or moved|removed)\b",
    r"\bno record for this address\b",
    r"\b(?:link|session|page) has (?:expired|ended|timed out)\W*$",
    r"\bnot allowed to (?:open|view|access) this\b",
    r"\baccess (?:denied|forbidden)\b",
    r"\b(?:403|401) forbidden\b|^\W*forbidden\W*$|^\W*unauthori[sz]ed\W*$",
    r"\brequest (?:was |is |has been )?(?:blocked|rejected|failed)\b",
    r"\btoo many requests\b",
    r"\b(?:bad gateway|gateway time-?out|gateway sent an empty reply|internal server error)\b",
    r"\bservice (?:is )?(?:temporarily )?(?:unavailable|not available)\b",
    r"\bsomething went wrong\b",
    r"\b(?:server|database|host|gateway) did not (?:answer|respond|reply)\b",
    r"\bconnection to the (?:database|server) (?:was|is) (?:lost|refused|closed)\b",
    r"\bapplication could not be (?:started|loaded)\b",
    r"\bdown for (?:planned|scheduled)? ?(?:work|maintenance)\b",
    r"\b(?:runtime|fatal|syntax|parse) (?:fault|error)\b",
    r"\bat \w+\.\w+ \(\w+:\d+\)",
    r"\bno such file on line \d+|include\([\w./]+\)",
    r"\b(?:null ?pointer|stack ?trace|traceback|uncaught exception)\b",
    r"\b(?:checking|verify(?:ing)?|confirm) that you are (?:not a robot|human)\b",
    r"^\W*(?:please wait|loading|redirecting|one moment(?: please)?)\W*$",
    r"\b(?:please wait|loading) ?(?:\.\.\.|…)",
    r"\bthis may take a few (?:seconds|moments)\b",
    r"\bblocked by (?:the|our) (?:firewall|security)\b",
    r"^\W*(?:http|error|status|code) (?:error |status )?[45]\d\d\W*$|^(?:40[013489]|410|429|50[0234])\W*$",
    r"\b(?:http|error|status) [45]\d\d ?[:–—-]",
    r"\berror code[: ]",
    # the same in other languages
    r"\bpage demandée est introuvable\b|\bpage introuvable\b|\baccès refusé\b|\bservice indisponible\b",
    r"\bseite (?:wurde )?nicht gefunden\b|\bzugriff verweigert\b|\bdienst nicht verfügbar\b",
    r"\bpágina no (?:fue )?encontrada\b|\bacceso denegado\b|\bservicio no disponible\b",
    r"पृष्ठ नहीं मिला|पेज नहीं मिला|सेवा उपलब्ध नहीं",
]
# ---- fixed values: notices that scripts or another feature are required ----
_SCRIPT = r"(?:java ?script|js|scripts?|script support|(?:client-side )?scripting|active content|skripte|frames|flash|cookies)"
SCRIPT = [
    rf"\b(?:enable|activate|allow|turn on|switch on|re-?enable)(?: \w+)? {_SCRIPT}\b",
    rf"\b(?:needs|requires|blocks|without) (?:an? )?(?:javascript|js|scripts?|script support|(?:client-side )?scripting|active content)\b",
    rf"\bcould not (?:detect|find) {_SCRIPT}\b",
    r"\bscripts? (?:are|is) (?:blocked|disabled|switched off|turned off)\b",
    r"\b(?:javascript|js|scripting|active content|script support) (?:is|are) (?:blocked|disabled|off|switched off|turned off|required|not enabled)\b",
    r"\bscript-capable browser\b",
    rf"\bbrowser (?:does not|doesn't|cannot) (?:support|run|show) {_SCRIPT}\b",
    r"\bnoscript\b",
    r"\bupdate your browser\b",
    r"\b(?:activer|autoriser) (?:javascript|les scripts)\b|\b(?:aktivieren|erlauben) sie (?:javascript|skripte)\b|\b(?:active|habilite|activar) (?:javascript|los scripts)\b",
]
#: Guidance that speaks about such things: advice in a sentence of its own.
ADVICE = r"\b(?:works? best|so check|before you choose|keep your|close it and go on|as printed|appears?,|shows? error|at hand|at the gate)\b"
#: Words of servers and browsers; a short segment in them is judged by its hosts.
TECHNICAL = r"\b(?:browser|server|database|gateway|firewall|robot|session|time-?out|reload|retry|loading|frames?|plug-?in|cache|administrator|maintenance|scripts?|javascript|incident|trace|token|proxy|captcha)\b"
# ---- fixed values: function words of the corpus languages ----
FUNCTION_WORDS = frozenset(
    "the a an of to in for and or is are be by on at with from this that it as not may must no if when you your we our has have was were which who before after without i"
    " le la les de des du un une et sont dans pour sur avec au aux en par ce ne pas plus sans avant après"
    " der die das den dem ein eine einer und oder ist sind im am zu mit von für auf nicht nach wird werden bei sich"
    " el los del y o son para con por una al su se sin antes".split()
)
HINDI_FUNCTION_WORDS = frozenset("के लिए का की में से और है हैं साथ को पर ने ही भी या फिर यह तो कि एक बिना जाता होता होती".split())

_TAGS = "|".join(TAGS)
_ANY_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDER))
_ANY_FILLER = re.compile("|".join(f"(?:{p})" for p in FILLER), re.I)
_REPEATS = [re.compile(p, re.I) for p in REPEATS]
_ANY_MESSAGE = re.compile("|".join(f"(?:{p})" for p in MESSAGE), re.I)
_ANY_SCRIPT = re.compile("|".join(f"(?:{p})" for p in SCRIPT), re.I)
_ADVICE, _TECHNICAL, _NO_RESIDUE = re.compile(ADVICE, re.I), re.compile(TECHNICAL, re.I), re.compile(rf"\[(?:{'|'.join(MASKS)})\]|</?(?:{_TAGS})>")
_SENTENCE, _WORD = re.compile(r"(?<=[.!?।…])\s+"), re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: The same with the vowel signs of Devanagari, which are no word characters to `re`.
_SIGNED_WORD = re.compile(r"(?:[^\W\d_]|[\u0900-\u0963])+(?:['’-](?:[^\W\d_]|[\u0900-\u0963])+)*")
_FUNCTION = FUNCTION_WORDS | HINDI_FUNCTION_WORDS
SHORT = 12  # words of a response that says nothing of the page's subject
# A segment without any of these words, signs, starts or parts is none of the messages, notices and fillers above.
_HINTS = frozenset(
    "found exist exists unavailable available deleted moved removed record expired ended timed denied forbidden unauthorized unauthorised blocked rejected failed many"
    " gateway error wrong answer respond reply lost refused closed started loaded maintenance work fault line include pointer traceback exception trace robot human"
    " wait loading redirecting moment seconds moments introuvable refusé indisponible gefunden verweigert verfügbar encontrada denegado disponible मिला उपलब्ध allowed"
    " javascript js script scripts scripting skripte frames flash cookies content noscript browser capable"
    " lorem ipsum dolor consectetur demo dummy sample example filler test placeholder blind asdf qwer qwerty zxcv uiop dfgh hjkl jkl goes here soon box replace heading"
    " http status stacktrace nullpointer down para paragraph"
    " nothing editor server database firewall session timeout time-out reload retry frame plugin plug-in cache administrator incident token proxy captcha not".split()
) - {"not"}
#: Of these a pattern needs a second word as well.
_WEAK = frozenset("closed lost refused exception record work example sample".split())
_STRONG = _HINTS - _WEAK
_BESIDE = frozenset("connection uncaught address planned scheduled down text content copy word words paragraph heading title".split())
_UNKNOWN = re.compile(r"\W*\?{3,}\W*")
_SIGNS = re.compile(r"[\[{<@_%#]|&lt;|XXX|\([TF]")
_STARTS = re.compile(r"\W*(?:(?:http|error|status|code|at)\b|[45]\d\d\b)|\[para", re.I)
#: The words between hyphens and apostrophes, at which patterns may begin and end too; a call in a trace; Hindi messages, whose vowel signs end a word.
_LETTERS, _JOINED, _CALL, _HINDI = re.compile(r"[^\W\d_]+"), re.compile(r"['’-]"), re.compile(r"\(\w+:\d"), ("मिला", "उपलब्ध")


_BREAKS = {i: " " for i in range(128) if not chr(i).isalnum()}


def _hinted(segment: str, words: list[str], letters: list[str]) -> bool:
    if not _HINTS.isdisjoint(words) or letters is not words and not _HINTS.isdisjoint(letters) or _STARTS.match(segment):
        return True
    return "(" in segment and bool(_CALL.search(segment)) or not segment.isascii() and any(x in segment for x in _HINDI)


def hinted(lower: str) -> bool:
    """Cheap: a line (in lower case) that lacks this is none of the residues, but for those of unlisted words."""
    if _SIGNS.search(lower) is not None or "xxx" in lower or "(to" in lower or "(fix" in lower:
        return True
    words = lower.translate(_BREAKS).split()
    if not _HINTS.isdisjoint(words):
        return not _STRONG.isdisjoint(words) or not _BESIDE.isdisjoint(words)
    return not lower.isascii() and any(x in lower for x in _HINDI)


def segments(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        for part in _SENTENCE.split(line):
            if part := part.strip():
                yield part


def words_of(segment: str) -> list[str]:
    lower = segment.lower()
    return _WORD.findall(lower) if lower.isascii() else _SIGNED_WORD.findall(lower)


def judge(segment: str, words: list[str] | None = None, prior: bool = True) -> str | None:
    """placeholder, filler, message, script; or in doubt: `doubt` (technical), `strange` (no function words); else None."""
    if words is None:
        words = words_of(segment)
    if _SIGNS.search(segment):
        for m in _ANY_PLACEHOLDER.finditer(segment):
            if not _NO_RESIDUE.fullmatch(m.group().replace("_", " ")):
                return "placeholder"
    if not words and _UNKNOWN.fullmatch(segment):
        return "filler"
    letters = _LETTERS.findall(segment.lower()) if _JOINED.search(segment) else words
    few = 3 <= len(letters) and len(set(letters)) <= 2 or len(letters) == 2 and letters[0] == letters[1]
    if few and any(p.match(segment) for p in _REPEATS):
        return "filler"
    if prior and _hinted(segment, words, letters):
        if _ANY_FILLER.search(segment):
            return "filler"
        if not _ADVICE.search(segment):
            if _ANY_MESSAGE.search(segment):
                return "message"
            if _ANY_SCRIPT.search(segment):
                return "script"
            if len(words) <= SHORT and _TECHNICAL.search(segment):
                return "doubt"
    if len(words) >= 5 and sum(map(_FUNCTION.__contains__, words)) <= 0.25 * len(words) and sum(map(str.isupper, _INITIAL.findall(segment))) <= 0.3 * len(words):
        return "strange"
    return None


_FOUND = "id string, site string, slug string, title_key string, verdict string, segment string, signature string, odd array<string>, n long"
_NAMES = ["id", "site", "slug", "title_key", "verdict", "segment", "signature", "odd", "n"]
_DIGITS, _INITIAL = re.compile(r"\d+"), re.compile(r"\b[^\W\d_]")
_KEPT, _KEPT_CHARS = 20_000, 200  # segments of which a worker keeps the judgement, and their length


class _Judged(dict):
    """segment -> (verdict, number of words, signature, odd words, words), kept for short ones as they come up."""

    def __init__(self, common: frozenset, odd_share: float, prior: bool):
        super().__init__()
        self.common, self.odd_share, self.prior = common, odd_share, prior

    def __missing__(self, segment: str):
        words = words_of(segment)
        verdict = judge(segment, words, self.prior)
        odd: list[str] = []
        if 0 < len(words) <= SHORT:
            parts = [x for w in words for x in _PARTED.split(w)]
            odd = [x for x in parts if x not in self.common]
            if len(odd) < self.odd_share * len(parts):
                odd = []
        signature = _DIGITS.sub("0", " ".join(words)) if odd or verdict == "doubt" else ""
        found = verdict, len(words), signature, odd, words
        if len(segment) <= _KEPT_CHARS:
            if len(self) >= _KEPT:
                self.clear()
            self[segment] = found
        return found


_PARTED = re.compile(r"['’-]")


class TemplateResidue:
    """Findings in `docs`, made when asked for.

    id_col, text_col, url_col and key_col (joined to `titles(key, title)`) name
    columns of docs, whose other columns are ignored. Rows with null id or null
    text hold nothing; a null address only takes away the host evidence; a row
    delivered twice is found once. Texts are read whole.

    A word is odd if under `rare` of the texts hold it (or only one does), a
    segment of at most SHORT words if at least `odd_share` of its words are.
    `hosts`, `mismatch`: a response counts if it comes from that many hosts, and
    at least on that share of its pages without a word in common with slug and
    title. `prior=False` leaves out the lists of messages, notices and fillers;
    placeholders are found by their syntax, and words that only repeat themselves,
    in either case.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, url_col: str, key_col: str, titles: DataFrame, hosts: int = 2, mismatch: float = 0.8, rare: float = 0.002, odd_share: float = 0.25, known: float = 0.4, known_from: int = 5, odd: float = 0.25, odd_pages: int = 10, prior: bool = True):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), site_of(F.col(url_col)).alias("site"), F.lower(url_col).alias("slug"), F.col(key_col).cast("string").alias("title_key")).where("id IS NOT NULL AND text IS NOT NULL")
        self.odd, self.odd_pages, self.prior, self.rare, self.odd_share = odd, odd_pages, prior, rare, odd_share
        self.titles, self.hosts, self.mismatch, self.known, self.known_from = titles, hosts, mismatch, known, known_from

    def common_words(self) -> frozenset:
        """The words that at least `rare` of the texts hold: at most the different words of a mean text / rare."""
        words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"))
        held = self.docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        found = held.where(F.col("n") >= max(2.0, self.rare * self.docs.count())).select("word")
        return frozenset(found.toArrow().column(0).to_pylist())

    def read(self) -> DataFrame:
        """Suspect segments, the corpus vocabulary as rows of verdict `word` (n: its occurrences in all but strange segments) and hosts as rows of verdict `host`.

        A text's strange segments are given once each, with n the number of its
        distinct segments of five words and more; a host's n sums these up. An
        odd segment that no detector knows has the verdict `odd`.
        """
        shared, odd_share, prior = self.docs.sparkSession.sparkContext.broadcast(self.common_words()), self.odd_share, self.prior

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judged = _Judged(shared.value, odd_share, prior)
            known: Counter = Counter()
            hosts: Counter = Counter()
            strings = pa.list_(pa.string())

            def counts() -> pa.RecordBatch:
                words, sites = pa.nulls(len(known), pa.string()), pa.nulls(len(hosts), pa.string())
                none = pa.concat_arrays([words, sites])
                kinds = pa.array(["word"] * len(known) + ["host"] * len(hosts), pa.string())
                return pa.RecordBatch.from_arrays([none, pa.concat_arrays([words, pa.array(hosts.keys(), pa.string())]), none, none, kinds, pa.concat_arrays([pa.array(known.keys(), pa.string()), sites]), none, pa.nulls(len(none), strings), pa.array([*known.values(), *hosts.values()], pa.int64())], names=_NAMES)

            for batch in batches:
                ids, texts, sites, slugs, keys = batch.columns
                rows, verdicts, found, signatures, odds, sizes = [], [], [], [], [], []

                def add(*values, columns=(rows, verdicts, found, signatures, odds, sizes)) -> None:
                    for column, value in zip(columns, values):
                        column.append(value)

                for row, text in enumerate(texts):
                    long, strange = set(), set()
                    for segment in segments(text.as_py()):
                        verdict, length, signature, odd, words = judged[segment]
                        if verdict == "strange":
                            strange.add(segment)
                        if odd or verdict not in (None, "strange"):
                            add(row, verdict if verdict not in (None, "strange") else "odd", segment, signature, odd, None)
                        if length >= 5:
                            long.add(segment)
                        if verdict in (None, "doubt"):
                            known.update(words)
                    if long:
                        hosts[sites[row].as_py() or ""] += len(long)
                    for segment in strange:
                        add(row, "strange", segment, "", [], len(long))
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(at).cast(pa.string()), sites.take(at), slugs.take(at), keys.take(at), pa.array(verdicts, pa.string()), pa.array(found, pa.string()), pa.array(signatures, pa.string()), pa.array(odds, strings), pa.array(sizes, pa.int64())], names=_NAMES)
                if len(known) + len(hosts) > 500_000:  # bounds memory; the counts are summed up anyway
                    yield counts()
                    known.clear()
                    hosts.clear()
            yield counts()

        return self.docs.mapInArrow(search, _FOUND)

    def responses(self, suspects: DataFrame) -> DataFrame:
        """Odd and doubtful segments that several hosts give on pages they have nothing to do with, and odd ones in the words of these."""
        rows = suspects.where("signature <> ''")
        titles = self.titles.select(F.col("key").cast("string").alias("title_key"), F.lower("title").alias("title")).where("title_key IS NOT NULL").groupBy("title_key").agg(F.min("title").alias("title"))
        rows = rows.join(titles, "title_key", "left")
        words = F.filter(F.split("signature", " "), lambda w: F.length(w) > 3)
        about = F.concat_ws(" ", F.regexp_replace("slug", r"^[a-z]+://[^/]*", ""), "title")
        rows = rows.withColumn("meets", F.exists(words, lambda w: F.contains(about, w)))
        # a response is low in information if it comes again and again, whatever the page
        seen = rows.groupBy("signature").agg(F.countDistinct("site").alias("sites"), F.countDistinct("id").alias("docs"), F.avg(F.when(F.col("meets"), 0.0).otherwise(1.0)).alias("mismatch"), F.first("odd").alias("words"))
        seen = cut(seen.where((F.col("sites") >= self.hosts) & (F.col("docs") >= self.hosts) & (F.col("mismatch") >= self.mismatch)).select("signature", "words"))
        spoken = cut(seen.select(F.explode("words").alias("word")).distinct())
        again = join_small(rows, seen.select("signature"), ["signature"], how="left_semi", spread="id").select("id", "segment", "odd")
        once = rows.where("NOT meets").select("id", "segment", "odd", F.explode("odd").alias("word"))
        once = join_small(once, spoken, ["word"], how="left_semi", spread="id").select("id", "segment", "odd")
        return again.unionByName(once)

    def strange(self, suspects: DataFrame, vocabulary: DataFrame, sizes: DataFrame) -> DataFrame:
        """Segments whose words the corpus hardly knows.

        That tells no filler where whole pages are in a language without listed
        function words. Such a page has more than `odd` of its segments of five
        words and more in words unknown to the corpus, and so has its host, in
        `odd_pages` such pages at least; its segments are not taken. What other
        hosts hold has no part in this. Rows without an address count as one host.
        """
        rows = suspects.withColumn("site", F.coalesce("site", F.lit(""))).groupBy("id", "site", "segment").agg(F.count("*").alias("times"), F.max("n").alias("n"))
        words = rows.select("id", "segment").distinct().select("id", "segment", F.explode(F.regexp_extract_all(F.lower("segment"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word"))
        known = vocabulary.groupBy(F.col("segment").alias("word")).agg(F.sum("n").alias("occurs")).where(F.col("occurs") >= self.known_from)
        counted = words.join(known, "word", "left").groupBy("id", "segment").agg(F.avg(F.when(F.col("occurs").isNotNull(), 1.0).otherwise(0.0)).alias("known"))
        unknown = cut(rows.join(counted.where(F.col("known") < self.known), ["id", "segment"]))
        pages = unknown.groupBy("id", "site").agg(F.count("*").alias("unknown"), F.max("n").alias("n")).where(F.col("unknown") > self.odd * F.col("n"))
        hosts = pages.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= self.odd_pages)
        shares = unknown.groupBy("site").agg(F.sum("times").alias("unknown")).join(sizes.groupBy("site").agg(F.sum("n").alias("every")), "site").where(F.col("unknown") > self.odd * F.col("every"))
        hosts = cut(hosts.join(shares, "site").select("site"))
        spared = join_small(pages.select("id", "site"), hosts, ["site"], how="left_semi", spread="id")
        return unknown.join(spared, ["id", "site"], "left_anti").select("id", "segment", "known").distinct()

    def findings(self) -> DataFrame:
        """(id, verdict, segment, hosted) for every residue; a verdict by the corpus is `response` or `strange`; hosted: the evidence of hosts finds it too."""
        suspects = cut(self.read())
        certain = suspects.where("verdict IN ('placeholder', 'filler', 'message', 'script')").select("id", "verdict", "segment", F.lit(False).alias("hosted"))
        responses = self.responses(suspects.where("verdict NOT IN ('strange', 'word', 'host', 'placeholder')")).select("id", F.lit("response").alias("verdict"), "segment", F.lit(True).alias("hosted"))
        strange = self.strange(suspects.where("verdict = 'strange'"), suspects.where("verdict = 'word'"), suspects.where("verdict = 'host'")).select("id", F.lit("strange").alias("verdict"), "segment", F.lit(False).alias("hosted"))
        found = certain.unionByName(responses).unionByName(strange).groupBy("id", "segment")
        # of several verdicts on a segment that of a detector counts
        return found.agg(F.min(F.struct((F.col("verdict") == "response").alias("late"), "verdict")).alias("x"), F.max("hosted").alias("hosted")).select("id", "x.verdict", "segment", "hosted")
