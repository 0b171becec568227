"""Personal details in free text by bootstrapped contextual extraction.

A first reading proposes typed candidates by their shape, each with the words
around it. Candidates and contexts form a graph: contexts (lexical patterns) on
one side, instances on the other (name parts, street types, number shapes).
Seeds are certain instances (e-mail and phone shapes, street types) and a few
label phrases; in rounds of Spark joins a pattern scores by the share of known
instances it introduces, an instance by the patterns that introduce it. What has
become known is then looked for everywhere, in any letter case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import cut, join_small

# ---- fixed values: seeds ----
STREET_TYPES = "road rd street st lane ln avenue ave close court ct boulevard blvd way drive dr square sq terrace place pl crescent alley mews parade quay".split()
UNIT_WORDS = "flat apt apartment unit suite house no room".split()
NAME_LABELS = ["my name is", "full name :", "name :", "nom :", "nombre :", "je m'appelle", "mein name ist", "me llamo", "मेरा नाम", "mi nombre es", "mon nom est", "ich heiße", "applicant :", "first name :", "last name :", "surname :"]
#: Of each kind the shapes that are taken as known from the start; all others are learned from the contexts that they share with these.
SEEDS = {"email": ["@"], "phone": ["+"], "id_number": ["addddddd", "aadddddd", "aaddddddd"], "address": ["road", "street", "avenue", "lane"]}
TITLES = "mr mrs ms miss dr prof sir madam mme mlle herr frau señor señora shri smt sri".split()
MASK_LABELS = r"\[[A-Z_]+\]"

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]+)+", re.I)
_MAYBE_EMAIL = re.compile(r"@|[\[(]at[\])]| at \S+ (?:dot|\[dot\]|\(dot\)) ", re.I)
_PHONE = re.compile(r"(?<![\w+])(?:\+ ?\d{1,3}|00\d{1,3})(?:[ .\-]?(?:\(\d{1,4}\)|\d{1,5})){2,6}(?![\w])|(?<![\w+])(?:\+?1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+.-])(?:\+?1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}(?![\w])")
_MAYBE_CAPS = re.compile(r"[A-Z][a-zà-ÿ]+ [A-Z]")
_MAYBE_PHONE = re.compile(r"[+(] ?\d|00\d|\d{3}[ .\-]\d{3}[ .\-]")
_MAYBE_ID = re.compile(r"\d(?:\d{4}|[A-Za-z]\d|\d{3}[A-Za-z]|\d\d-\d\d-|\d{3}[ -]\d{4}|(?<=[A-Za-z]\d)[A-Za-z0-9]*\d\d|(?<=-\d)\d{2,}-)")
_MAYBE_BARE = re.compile(r"\d{10}")
_WORDS = re.compile(r"\w+")
_MAYBE_STREET = re.compile(r"\d[A-Za-z]?,? [A-Z]")
_STREETS = frozenset(STREET_TYPES)
_BARE = re.compile(r"(?<![\w+.,/-])\d{10}(?!\w|[.,]\d)")
_ID = re.compile(r"(?<![\w@-])(?:[A-Za-z]{1,4}-\d{3,5}-\d{3,6}|[A-Za-z]{1,3}-\d{6,9}|(?=[A-Za-z0-9]{7,14}(?!\w))[A-Za-z]{1,4}\d[A-Za-z0-9]*\d{2,}[A-Za-z]?|\d{3}-\d{2}-\d{4}|\d{4}[ -]\d{4}[ -]\d{4}(?: ?\d{4})?|[A-Za-z] \d{6,8})(?![\w@])(?!-\d)")
_TYPES = "|".join(sorted(STREET_TYPES, key=len, reverse=True))
_UNIT = rf"(?:(?:{'|'.join(UNIT_WORDS)})\.? ?\d+[A-Za-z]?, ?)?"
_ADDRESS = re.compile(rf"(?<![\w.,/])({_UNIT}\d{{1,4}}[A-Za-z]?,? (?:[^\W\d_][\w'’-]* ){{1,3}}(?:{_TYPES})\b)", re.I)
_NUMBERED = re.compile(rf"(?<![\w.,/])({_UNIT}\d{{1,4}}[A-Za-z]?,? (?:[A-Z][\w'’-]+ ){{1,3}}([A-Z][a-z]+)\b)")
_CAPS = re.compile(r"(?<![\w@.+'’-])[A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]{1,4}\.)?(?: [A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?){1,2}(?![\w@-])")
_ADDRESSED = re.compile(r"[+_.]?\w*@| ?(?:\[at\]|\(at\))|[+.]\w+ ?(?:@|\[at\]|\(at\)| at )| at \S+ dot ", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_AROUND = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[:=,.|/;-]|\d+")
_DIGITS = re.compile(r"\d")


def _left(text: str, at: int, n: int = 3) -> list[str]:
    """The words before, `:` for any label mark, nearest last; a line break ends it."""
    part = text[max(0, at - 40) : at]
    part = part[part.rfind("\n") + 1 :]
    words = _AROUND.findall(part.lower())[-n:]
    return [":" if w == "=" or w == "-" else w for w in words]


def _right(text: str, at: int) -> str:
    word = _AROUND.search(text[at : at + 25].lower())
    if word is None:
        return "$"
    return ":" if word.group() in "=-" else word.group()


def patterns(text: str, start: int, end: int) -> list[str]:
    left = _left(text, start)
    if left and left[-1] in TITLES:
        left = left[-1:]
    found = ["L2 " + " ".join(left[-2:]) if left else "L2 ^", "R " + " ".join([left[-1] if left else "^", _right(text, end)])]
    if len(left) == 3:
        found.append("L3 " + " ".join(left))
    return found


def email_key(text: str) -> str:
    key = re.sub(r" ?(?:\[at\]|\(at\)|\bat\b|@) ?", "@", text.lower(), count=1)
    return re.sub(r" ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?", ".", key)


def phone_key(text: str) -> str:
    digits = "".join(_DIGITS.findall(text))
    return digits[2:] if digits.startswith("00") else digits


_LONG = {"rd": "road", "st": "street", "ln": "lane", "ave": "avenue", "ct": "court", "blvd": "boulevard", "dr": "drive", "sq": "square", "pl": "place"}


def address_key(text: str) -> str:
    """House number and street, without flat and town."""
    m = _ADDRESS.search(text)
    words = re.sub(rf"^{_UNIT}", "", m.group(1) if m else text, flags=re.I).lower().replace(",", " ").split()
    return " ".join(_LONG.get(w.rstrip("."), w.rstrip(".")) for w in words)


def propose(text: str, lower: str, tokens: list[str], offices: dict[str, frozenset]) -> Iterator[tuple]:
    """(kind, start, end, sure, instances): candidates by shape, office contacts left out.

    lower and tokens are the text in lower case and its words, which the caller
    has anyway; the `_MAYBE` patterns say cheaply that a slower one cannot match.
    """
    taken: list[tuple[int, int]] = []

    def free(start: int, end: int) -> bool:
        return all(end <= a or start >= b for a, b in taken)

    if ("@" in text or " dot " in lower or "[at]" in lower or "(at)" in lower) and _MAYBE_EMAIL.search(text):
        for m in _EMAIL.finditer(text):
            start, end = m.span()
            spaced = "@" not in m.group() and "[" not in m.group() and "(" not in m.group()
            if spaced and not re.search(r" at .*\bdot\b", m.group(), re.I) or not spaced and re.match(r"[^\s@]+ at ", m.group(), re.I):
                continue
            taken.append((start, end))
            if email_key(m.group()) not in offices["email"]:
                yield "email", start, end, True, ["@" if "@" in m.group() else "[at]" if "[" in m.group() or "(" in m.group() else "at"]
    digits = len(_DIGITS.findall(text))
    if digits:
        for m in _ADDRESS.finditer(text) if not _STREETS.isdisjoint(tokens) else ():
            start, end = m.span(1)
            if free(start, end):
                taken.append((start, end))
                if address_key(m.group(1)) not in offices["address"]:
                    yield "address", start, end, True, [m.group(1).rsplit(" ", 1)[1].lower()]
        for m in _PHONE.finditer(text) if digits > 7 and _MAYBE_PHONE.search(text) else ():
            start, end = m.span()
            if free(start, end) and len(phone_key(m.group())) >= 8:
                taken.append((start, end))
                if phone_key(m.group()) not in offices["phone"]:
                    yield "phone", start, end, True, [m.group()[0] if m.group()[0] in "+0(" else "ddd ddd dddd"]
        for m in _ID.finditer(text) if digits > 2 and _MAYBE_ID.search(text) else ():
            start, end = m.span()
            if free(start, end):
                taken.append((start, end))
                shape = re.sub(r"\d", "d", re.sub(r"[A-Za-z]", "a", m.group()))
                yield "id_number", start, end, bool(re.search(r"[A-Za-z]-?\d|\d{3}-\d{2}-\d{4}", m.group())), [shape]
        for m in _BARE.finditer(text) if digits > 9 and _MAYBE_BARE.search(text) else ():
            start, end = m.span()
            if free(start, end):
                taken.append((start, end))
                if phone_key(m.group()) not in offices["phone"]:
                    yield "phone", start, end, False, ["d" * (end - start)]
        for m in _NUMBERED.finditer(text) if _MAYBE_STREET.search(text) else ():
            start, end = m.span(1)
            if free(start, end):
                yield "address", start, end, False, [m.group(2).lower()]
    for m in _CAPS.finditer(text) if _MAYBE_CAPS.search(text) else ():
        start, end = m.span()
        if not free(start, end):
            continue
        words = m.group().split()
        while len(words) > 2 and words[0].lower() in TITLES:
            start += len(words[0]) + 1
            words = words[1:]
        if words[0].lower() in TITLES:
            continue
        yield "name", start, end, False, [t.lower() for w in words if not w.endswith(".") for t in w.split("-")]


#: Bits of the filter that goes to every worker: 512 KB at least, 32 MB at most, whatever the data.
_LEAST_BITS, _MOST_BITS = 1 << 22, 1 << 28


def _bits(token: str, size: int) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))
    return h % size, (h >> 32) % size


def known_runs(text: str, known) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of two and more known name parts, in any case; a shortened middle name may stand between. A run of several names without a mark between them is one."""
    run: list[re.Match] = []
    last = None

    def names(run: list[re.Match]) -> tuple[int, int, list[str]] | None:
        while run and run[0].group().lower() in TITLES:
            run = run[1:]
        full = [m for m in run if not _short(text, m)]
        if _ADDRESSED.match(text, run[-1].end()) or text[max(0, run[0].start() - 1) : run[0].start()] in ("@", "_", "."):
            return None  # part of an e-mail address
        if len(full) >= 2 and not _short(text, run[0]) and not _short(text, run[-1]):
            return run[0].start(), run[-1].end(), [m.group().lower() for m in full]
        return None

    for m in _TOKEN.finditer(text):
        gap = text[last.end() : m.start()] if last else ""
        joined = gap == " " or gap == "-" or gap == ". " and _short(text, last)
        ok = known(m.group().lower()) or _short(text, m) and bool(run)
        if run and not (joined and ok):
            while run and _short(text, run[-1]):
                run.pop()
            if run and (found := names(run)):
                yield found
            run = []
        if ok and (run or known(m.group().lower())):
            run.append(m)
        last = m
    while run and _short(text, run[-1]):
        run.pop()
    if run and (found := names(run)):
        yield found


_KEPT_TEXTS = 50_000  # texts of which a worker keeps what was found, as questions and answers come again


def _short(text: str, m: re.Match) -> bool:
    """A shortened name: a few letters and a point, with a word after it."""
    return m.end() - m.start() <= 5 and text[m.end() : m.end() + 2] == ". "


class _Seen(dict):
    """word -> whether the filter knows it, filled as words come up."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits, self.size = bits, 8 * len(bits)

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        a, b = _bits(token, self.size)
        found = self[token] = bool(self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1)
        return found


class Details:
    """Personal details in the text columns of `rows`, found when the object is made.

    `fields` maps field names to columns. Rows with null id and null texts hold
    none; empty texts neither; a row delivered twice is found once, and of texts that
    differ under one id one is read. `offices`
    (email, phone, address) lists public contacts, which are no details however
    they are written: a reference table of a fixed size, at most OFFICES rows.
    found: (id, field_name, kind, start_pos, end_pos).
    """

    OFFICES = 100_000

    def __init__(self, rows: DataFrame, id_col: str, fields: dict, offices: DataFrame, rounds: int = 3, pattern_share: float = 0.5, pattern_least: int = 3, instance_score: float = 0.8, special: float = 0.1):
        self.special = special
        self.rounds, self.share, self.least, self.score = rounds, pattern_share, pattern_least, instance_score
        self.texts = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), c.alias("text")) for k, c in fields.items()])).alias("x")).select("id", "x.*").where("text IS NOT NULL AND text <> ''")
        # of texts that differ under one id the one with the least hash counts, for finding and masking alike
        version = F.xxhash64("text")
        several = cut(self.texts.groupBy("id", "field_name").agg(F.min(version).alias("kept"), F.max(version).alias("most")).where("kept <> most").select("id", "field_name", "kept"))
        self.texts = join_small(self.texts, several, ["id", "field_name"], how="left", spread="text").where(F.col("kept").isNull() | (version == F.col("kept"))).drop("kept")
        listed = offices.select("email", "phone", "address").limit(self.OFFICES + 1).collect()
        assert len(listed) <= self.OFFICES, "the list of offices is a bounded reference table"
        self.offices = {"email": frozenset(email_key(r.email) for r in listed if r.email), "phone": frozenset(phone_key(r.phone) for r in listed if r.phone), "address": frozenset(address_key(r.address) for r in listed if r.address)}
        self.kind = dict(self.texts.dtypes)["id"]
        read = cut(self._propose())
        self.candidates = read.where("kind <> 'word'")
        self.words = read.where("kind = 'word'").select(F.col("instances")[0].alias("instance"), F.col("start_pos").cast("long").alias("n")).groupBy("instance").agg(F.sum("n").alias("all"))
        self.patterns, self.instances = self._learn()
        self.found = self._found()

    def _propose(self) -> DataFrame:
        offices, names = self.offices, ["id", "field_name", "kind", "start_pos", "end_pos", "sure", "instances", "patterns"]
        id_type = pa.int64() if self.kind == "bigint" else pa.int32() if self.kind == "int" else pa.string()

        def words(total: Counter) -> pa.RecordBatch:
            """The corpus vocabulary as rows of kind `word`, the count as start_pos."""
            n, strings = len(total), pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.string()), pa.array(["word"] * n, pa.string()), pa.array([min(x, 2**31 - 1) for x in total.values()], pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array([[w] for w in total], strings), pa.nulls(n, strings)], names=names)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            kept: dict[str, list] = {}  # text -> [times it came again, its candidates]

            def count_again() -> None:
                for text, (n, _) in kept.items():
                    if n:
                        for token in _WORDS.findall(text.lower()):
                            total[token] += n
                kept.clear()

            for batch in batches:
                rows, kinds, starts, ends, sures, instances, contexts = [], [], [], [], [], [], []
                for row, text in enumerate(batch.column(2).to_pylist()):
                    entry = kept.get(text)
                    if entry is None:
                        lower = text.lower()
                        tokens = _WORDS.findall(lower)
                        total.update(tokens)
                        if len(kept) >= _KEPT_TEXTS:
                            count_again()
                        entry = kept[text] = [0, [(*x, patterns(text, x[1], x[2])) for x in propose(text, lower, tokens, offices)]]
                    else:
                        entry[0] += 1
                    for kind, start, end, sure, found, context in entry[1]:
                        rows.append(row)
                        kinds.append(kind)
                        starts.append(start)
                        ends.append(end)
                        sures.append(sure)
                        instances.append(found)
                        contexts.append(context)
                at = pa.array(rows, pa.int32())
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sures, pa.bool_()), pa.array(instances, strings), pa.array(contexts, strings)], names=names)
                if len(total) > 500_000:  # bounds memory; the counts are summed up anyway
                    yield words(total)
                    total.clear()
            count_again()
            yield words(total)

        return self.texts.mapInArrow(read, f"id {self.kind}, field_name string, kind string, start_pos int, end_pos int, sure boolean, instances array<string>, patterns array<string>")

    def _learn(self) -> tuple[DataFrame, DataFrame]:
        """(kind, pattern, score) and (kind, instance): what the rounds have come to trust."""
        # an occurrence is one candidate under one of its patterns; equal ones are counted, so the graph is as large as the vocabulary
        edges = cut(self.candidates.select("kind", "instances", "sure", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instances").agg(F.count("*").alias("n"), F.max("sure").alias("sure")))
        labels = [f"L{len(x.split())} {x}" for x in NAME_LABELS]
        seeded = (F.col("kind") == "name") & F.col("pattern").isin(labels)
        seeds = edges.select("kind", F.explode("instances").alias("instance")).distinct().where(F.array_contains(F.create_map(*[x for k, v in SEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")], F.col("instance")))
        known = cut(seeds.unionByName(edges.where(seeded).select("kind", F.explode("instances").alias("instance"))).distinct())
        parts = edges.select("kind", "pattern", "n", "instances", F.explode(F.array_distinct("instances")).alias("instance"))
        scores, sure = None, known.where("kind <> 'name'")
        for _ in range(self.rounds):
            # a pattern is as good as the share of its occurrences whose parts are all known
            marked = join_small(parts, known.withColumn("known", F.lit(1)), ["kind", "instance"], how="left", spread="pattern").groupBy("kind", "pattern", "instances").agg(F.first("n").alias("n"), F.min(F.coalesce("known", F.lit(0))).alias("known"))
            scores = cut(marked.groupBy("kind", "pattern").agg(F.count("*").alias("spans"), (F.sum(F.col("n") * F.col("known")) / F.sum("n")).alias("score")).where((F.col("spans") >= self.least) & (F.col("score") >= self.share)).select("kind", "pattern", "score"))
            # an instance is trusted if it is unlikely that all its patterns are wrong, and a name part if it is hardly ever anything else
            trusted = parts.select("kind", "pattern", "instance", "n").join(scores, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.sum(F.log(F.lit(1.0) - F.col("score") * 0.9)).alias("doubt"), F.sum(F.when(F.col("pattern").startswith("L2"), F.col("n"))).alias("n")).where(F.exp("doubt") <= 1 - self.score)
            special = trusted.where("kind = 'name' AND length(instance) > 2").join(self.words, "instance").where(F.col("n") >= F.col("all") * self.special).select("kind", "instance")
            known = cut(sure.unionByName(special).unionByName(trusted.where("kind <> 'name'").select("kind", "instance")).distinct())
        return scores, known

    def _filter(self, names: DataFrame) -> np.ndarray:
        """A bit filter of the known name parts, 16 bits a part within its bounds; it only proposes, an exact join follows."""
        size = _LEAST_BITS
        count = names.count()
        while size < _MOST_BITS and size < 16 * count:
            size *= 2

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x for t in batch.column(0).to_pylist() for x in _bits(t, size)], pa.int32())], names=["bit"])

        # whole words of the filter come back: at most size / 32
        words = names.select("instance").mapInArrow(places, "bit int").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("bits"))
        packed = np.zeros(size // 32, dtype="<u4")
        for batch in words.toArrow().to_batches():
            packed[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype("<u4")
        return packed

    def _names(self) -> DataFrame:
        """Runs of known name parts in all texts."""
        names = self.instances.where("kind = 'name'").select("instance")
        shared = self.texts.sparkSession.sparkContext.broadcast(self._filter(names).tobytes())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = _Seen(shared.value)
            known = seen.__getitem__
            kept: dict[str, list] = {}

            for batch in batches:
                rows, starts, ends, parts = [], [], [], []
                for row, text in enumerate(batch.column(2).to_pylist()):
                    spans = kept.get(text)
                    if spans is None:
                        if len(kept) >= _KEPT_TEXTS:
                            kept.clear()
                        spans = kept[text] = [*known_runs(text, known)] if sum(map(known, _WORDS.findall(text.lower()))) > 1 else []
                    for start, end, found in spans:
                        rows.append(row)
                        starts.append(start)
                        ends.append(end)
                        parts.append(found)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.list_(pa.string()))], names=["id", "field_name", "start_pos", "end_pos", "instances"])

        spans = self.texts.mapInArrow(read, f"id {self.kind}, field_name string, start_pos int, end_pos int, instances array<string>")
        keys = ["id", "field_name", "start_pos", "end_pos"]
        parts = spans.distinct().select(*keys, F.explode("instances").alias("instance"))
        checked = join_small(parts, names.withColumn("known", F.lit(1)), ["instance"], how="left", spread="id")
        return checked.groupBy(*keys).agg(F.min(F.coalesce("known", F.lit(0))).alias("known")).where("known = 1").select(*keys, F.lit("name").alias("kind"))

    def _found(self) -> DataFrame:
        keys = ["id", "field_name", "start_pos", "end_pos", "kind"]
        sure = self.candidates.where("sure").select(*keys)
        weak = self.candidates.where("NOT sure").select(*keys, "patterns", "instances")
        # numbers of a doubtful shape take the kind that their contexts introduce elsewhere, else that of their shape
        numbers = weak.where("kind IN ('phone', 'id_number')")
        votes = self.patterns.where("kind IN ('phone', 'id_number')").groupBy("pattern").agg(F.sum(F.when(F.col("kind") == "phone", F.col("score")).otherwise(-F.col("score"))).alias("vote"))
        voted = join_small(numbers.select(*keys, F.explode("patterns").alias("pattern")), votes, ["pattern"], how="left", spread="id").groupBy(*keys).agg(F.sum("vote").alias("vote"))
        numbers = voted.withColumn("kind", F.when(F.col("vote") > 0.2, "phone").when(F.col("vote") < -0.2, "id_number").otherwise(F.col("kind"))).select(*keys)
        # streets of an unknown type, and names of unknown parts, count where trusted contexts introduce them
        rest = weak.where("kind IN ('address', 'name')").select(*keys, F.explode("patterns").alias("pattern"))
        trusted = self.patterns.where(F.col("score") >= 0.9).select("kind", "pattern")
        context = join_small(rest, trusted, ["kind", "pattern"], spread="id").groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").select(*keys)
        streets = self.instances.where("kind = 'address'")
        typed = join_small(weak.where("kind = 'address'").select(*keys, F.explode("instances").alias("instance")), streets, ["kind", "instance"], spread="id").select(*keys)
        names = self._names()
        every = sure.unionByName(numbers).unionByName(context).unionByName(typed).unionByName(names.select(*keys))
        return every.groupBy("id", "field_name", "kind", "start_pos").agg(F.max("end_pos").alias("end_pos"))

    def arms(self) -> DataFrame:
        """(kind, arm, details): the certain shapes among the details as `seed`, as `learned` from contexts or as a `prior` that the graph does not know; the others are `context`."""
        keys = ["id", "field_name", "kind", "start_pos"]
        sure = self.candidates.where("sure").select(*keys, F.col("instances")[0].alias("instance"))
        known = self.instances.select("kind", "instance", F.lit(True).alias("known"))
        seed = F.array_contains(F.create_map(*[x for k, v in SEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")], F.col("instance"))
        shaped = join_small(sure, known, ["kind", "instance"], how="left", spread="id").select(*keys, F.when(seed, "seed").when(F.col("known"), "learned").otherwise("prior").alias("arm"))
        return self.found.select(*keys).join(shaped.dropDuplicates(keys), keys, "left").groupBy("kind", F.coalesce("arm", F.lit("context")).alias("arm")).agg(F.count("*").alias("details"))

    def masked(self) -> DataFrame:
        """(id, field_name, masked_text): every text with its details as [KIND]; of overlapping details the first counts."""
        details = self.found.groupBy("id", "field_name").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("details"))
        texts = self.texts.groupBy("id", "field_name").agg(F.min("text").alias("text")).join(details, ["id", "field_name"], "left")
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        fold = F.aggregate(
            F.coalesce("details", F.array().cast("array<struct<start_pos:int,end_pos:int,kind:string>>")),
            start,
            lambda acc, x: F.when(x["start_pos"] < acc["at"], acc).otherwise(
                F.struct(F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["start_pos"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end_pos"].alias("at"))
            ),
        )
        return texts.withColumn("acc", fold).select("id", "field_name", F.concat("acc.out", F.expr("substring(text, acc.at + 1)")).alias("masked_text"))
