"""Keyword-stuffed and link-list pages.

A page is read line by line. Its list parts are lines of links, tags and product
entries, runs of keywords, short lines without function words, and sentences
around one phrase. The phrase shingles of all list parts (five words, a shorter
phrase whole, or the pairs that a run of keywords repeats) are exploded and
counted by distinct hosts over the shingles of all documents, prose or list; a
part stitched mostly from phrases that other hosts hold too counts. Parts that
repeat themselves, and links, tags and entries, count by themselves as a prior.
A page is spam if its counted parts make up its greater part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.template_residue import FUNCTION_WORDS, HINDI_FUNCTION_WORDS
from docketry.runtime import cut, join_small

# ---- fixed values ----
PRODUCT = r"\b(?:SKU|EAN|art\.? ?no)\b|\b(?:buy now|add to cart|order now|in stock|shop now|comprar ahora|añadir al carrito|acheter|ajouter au panier|jetzt kaufen|in den warenkorb|अभी खरीदें)\b"
#: Every pattern of PRODUCT holds one of these words.
_SHOP = frozenset("sku ean art buy cart order stock shop comprar carrito acheter panier kaufen warenkorb खरीदें".split())
LABEL = r"^\W*(?:tags?|keywords?|searches|related searches|topics|stichwörter|mots-clés|etiquetas)\b"
TOP_LEVEL = "example test invalid com org net info biz io shop xyz online site top".split()

_FUNCTION = FUNCTION_WORDS | HINDI_FUNCTION_WORDS
_URL = re.compile(rf"(?:https?://|www\.)[^\s<>\"')\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:{'|'.join(TOP_LEVEL)})\b(?:/[^\s<>\"')\]]*)?", re.I)
_ENDING = re.compile(rf"\.(?:{'|'.join(TOP_LEVEL)})\b", re.I)
_ANCHOR = re.compile(r"</?a\b[^>]*>|\[[^\[\]\n]*\]\([^()\n]*\)", re.I)
# What stands between words: of ASCII as a table of bytes, which also makes capitals small, and beyond ASCII.
_BREAKS = r"\s\d.,;:!?()\[\]|/\\\"#<>=&@*{}+_~-"
_PARTED = bytes(32 if re.match(f"[{_BREAKS}]", chr(i)) else ord(chr(i).lower()) for i in range(128)) + bytes(range(128, 256))
_PARTED_WIDE = re.compile(r"[।“”„…•·☐→–—\d]")
# Each begins with the rarer character and looks back from it: a search then passes over all others.
_SENTENCE, _TAG, _CAMEL = re.compile(r"\s(?<=[.!?।]\s)\s*(?=\S)"), re.compile(r"#\w+"), re.compile(r"[A-Z](?<=[a-z][A-Z])")
_PRODUCT, _LABEL = re.compile(PRODUCT, re.I), re.compile(LABEL, re.I)
#: Phrases end at what these leave out, and at a dash between spaces.
_ENDS, _ENDS_WIDE, _DASH = bytes(10 if chr(i) in ',;:|=>\n()[]"#0123456789' else i for i in range(256)), re.compile(r"[·•→\d]"), re.compile(r"\s[-–—]\s")
_TABLE = re.compile(r"\|\s*[\d.,]+")

SHINGLE = 5
#: Share of a page's sentence words that one repeated pair must make up.
STUFFED = 0.2
#: A labelled line with fewer entries is a short line of tags, as guidance has it.
LONG_LABEL = 8


def _mapped(text: str, table: bytes) -> str:
    """`text` with its ASCII characters mapped; all others have only bytes that the tables keep."""
    return text.encode("utf-8", "surrogatepass").translate(table).decode("utf-8", "surrogatepass")


def _words(text: str) -> list[str]:
    if text.isascii():
        return _mapped(text, _PARTED).split()
    return _PARTED_WIDE.sub(" ", _mapped(text.lower(), _PARTED)).split()


def _pieces(text: str) -> set[str]:
    """The pieces of a text between the signs at which phrases end."""
    ended = _mapped(text, _ENDS)
    found = set((ended if text.isascii() else _ENDS_WIDE.sub("\n", ended)).split("\n"))
    found.discard("")
    return found


def _function_words(words: list[str]) -> int:
    return sum(map(_FUNCTION.__contains__, words))


def phrases(text: str) -> set[str]:
    """The phrase shingles of a text: five words running, shorter phrases whole."""
    return set(chain.from_iterable(map(_shingles, _pieces(text))))


def _shingles(piece: str) -> list[str]:
    found = []
    for phrase in _DASH.split(piece) if "-" in piece or "–" in piece or "—" in piece else (piece,):
        words = _words(phrase if phrase.islower() else _CAMEL.sub(r" \g<0>", phrase))
        if len(words) > SHINGLE:
            found += map(" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        elif words:
            found.append(" ".join(words))
    return found


def _again(words: list[str]) -> set[str]:
    """The phrases that a run of keywords marks off by repeating them: pairs of words, no function words among them."""
    pairs = Counter((a, b) for a, b in zip(words, words[1:]) if a not in _FUNCTION and b not in _FUNCTION)
    return {f"{a} {b}" for (a, b), n in pairs.items() if n > 1}


def _is_links(line: str) -> bool:
    if "://" not in line and not _ENDING.search(line) and "www." not in line.lower():
        return False
    links = len(_URL.findall(line))
    if not links:
        return False
    words = _words(_URL.sub(" ", _ANCHOR.sub(lambda m: re.sub(r"</?a\b[^>]*>|\]\([^()]*\)", " ", m.group()), line)))
    few = _function_words(words)
    return few <= 1 and len(words) <= 8 or len(words) <= 5 * links and few <= links


def _is_row(line: str) -> bool:
    """A row of a table with figures."""
    return "|" in line and _TABLE.search(line) is not None


def _repeats(words: list[str]) -> bool:
    """Keywords in a row: hardly a function word, and the same words again and again."""
    return len(words) >= 8 and len(set(words)) <= 0.75 * len(words) and _function_words(words) <= 0.12 * len(words)


def _stuffed(parts: list[tuple[str, list[str]]]) -> list[str]:
    """The sentences around one phrase with which the rest of a page is stuffed."""
    common = Counter(chain.from_iterable(words for _, words in parts))
    total = common.total()
    if not any(n >= 4 and 2 * n > STUFFED * total and w not in _FUNCTION for w, n in common.items()):
        return []
    pairs: Counter = Counter()
    own: list[set] = []
    twice: Counter = Counter()
    for _, words in parts:
        here = Counter((a, b) for a, b in zip(words, words[1:]) if a not in _FUNCTION and b not in _FUNCTION)
        pairs.update(here)
        twice.update(k for k, n in here.items() if n > 1)
        own.append(set(here))
    if not pairs:
        return []
    pair, n = max(pairs.items(), key=lambda x: (x[1], x[0]))
    held = sum(pair in x for x in own)
    if n < 4 or 2 * n <= STUFFED * total or 3 * twice[pair] < held:
        return []
    return [text for (text, _), x in zip(parts, own) if pair in x]


def evidence(text: str, prior: bool = True) -> tuple[int, list[tuple[int, bool, set[str]]]]:
    """(characters, list parts as (characters, counts by itself, phrases)).

    A list part is a run of lines or words that form no sentences: links, tags,
    product entries, keywords in a row, labelled and short lines without
    function words, and sentences around one phrase. The phrases of a part are
    its shingles, those of repeating keywords the pairs that come again. Links, tags, entries,
    repeating keywords and stuffed sentences count by themselves; without
    `prior` product entries and labels are not recognised by their words.
    """
    total = 0
    found: list[tuple[int, bool, set[str]]] = []
    block: list[str] = []
    sentences: list[tuple[str, list[str]]] = []

    def close() -> None:
        """A block of short lines without function words is one list."""
        if not block:
            return
        joined = "\n".join(block)
        words = _words(joined)
        if (own := _repeats(words)) or len(words) >= 3:
            found.append((sum(map(len, block)), own, own and _again(words) or phrases(joined)))
        block.clear()

    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        total += len(line)
        parts = _SENTENCE.split(line)
        each = [_words(part) for part in parts]
        words = [*chain.from_iterable(each)]
        tags = _TAG.findall(line) if "#" in line else ()
        if _is_links(line) or len(tags) >= 2 and 2 * len(tags) >= len(line.split()) or prior and not _SHOP.isdisjoint(words) and _PRODUCT.search(line):
            close()
            found.append((len(line), True, phrases(_unlinked(line))))
            continue
        if prior and _LABEL.match(line):
            close()
            if len(re.split(r"[,;|·•]", line)) >= LONG_LABEL:
                found.append((len(line), False, phrases(line.partition(":")[2] or line)))
            continue
        if len(words) <= 6 and words and _FUNCTION.isdisjoint(words) and not _is_row(line) and line[-1] not in ".?!।":
            block.append(line)
            continue
        close()
        for part, words in zip(parts, each):
            if not _is_row(part) and ((own := _repeats(words)) or _strung(part, words)):
                found.append((len(part), own, own and _again(words) or phrases(part)))
            elif words:
                sentences.append((part, words))
    close()
    if around := _stuffed(sentences):
        found.append((sum(map(len, around)), True, _again(_words(" ".join(around)))))
    return total, found


def _unlinked(line: str) -> str:
    """A line with its addresses replaced by the words of their paths."""
    line = re.sub(r"</?a\b[^>]*>|\]\([^()]*\)", " , ", line)
    return _URL.sub(lambda m: " , " + re.sub(r"[/?._=+-]", " ", m.group().partition("://")[2].partition("/")[2] if "://" in m.group() else m.group().partition("/")[2]), line)


def _strung(part: str, words: list[str]) -> bool:
    """Words strung together without function words, longer than a line of a list."""
    return len(words) >= 12 and part[-1] not in ".?!।" and _function_words(words) <= 0.12 * len(words)


def _hash(phrase: str) -> int:
    return xxhash.xxh3_64_intdigest(phrase.encode("utf-8", "replace")) - (1 << 63)


def list_evidence(docs: DataFrame, id_col: str, text_col: str, host_col: str, prior: bool = True) -> DataFrame:
    """(id, host, total, parts) of each page that has list parts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_type = pa.list_(pa.struct([("size", pa.int32()), ("own", pa.bool_()), ("phrases", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64()))]))
        for batch in batches:
            rows, totals, parts = [], [], []
            for row, text in enumerate(batch.column(2)):
                total, found = evidence(text.as_py(), prior)
                if found:
                    rows.append(row)
                    totals.append(total)
                    parts.append([{"size": size, "own": own, "phrases": sorted(map(_hash, p)), "firsts": sorted(map(_hash, {x.partition(" ")[0] for x in p}))} for size, own, p in found])
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(totals, pa.int32()), pa.array(parts, part_type)], names=["id", "host", "total", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(read, f"id {kind}, host string, total int, parts array<struct<size int, own boolean, phrases array<bigint>, firsts array<bigint>>>")


#: Bits of a filter that goes to every worker: 512 KB at least, 32 MB at most, whatever the data.
_LEAST_BITS, _MOST_BITS = 1 << 22, 1 << 28
_KEPT = 100_000  # pieces of text whose shingles a worker keeps at a time


def _bits(wanted: DataFrame) -> bytes:
    """The filter of the hashes in the one column of `wanted`: 16 bits a hash within its bounds, collected as words of 32 bits. It only proposes, a join follows."""
    size, count = _LEAST_BITS, wanted.count()
    while size < _MOST_BITS and size < 16 * count:
        size *= 2
    h = F.col(wanted.columns[0])
    places = F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(size - 1)))
    words = wanted.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("bits"))
    found = np.zeros(size // 32, dtype="<u4")
    for batch in words.toArrow().to_batches():
        found[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype("<u4")
    return found.tobytes()


class _Starts(dict):
    """word -> whether a wanted phrase may begin with it, filled as words come up."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) >= 500_000:
            self.clear()
        h = _hash(word)
        found = self[word] = _held(self.bits, h)
        return found


def _held(bits: bytes, h: int) -> bool:
    last = 8 * len(bits) - 1
    a, b = h & last, h >> 32 & last
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


def phrase_hosts(docs: DataFrame, text_col: str, host_col: str, wanted: DataFrame, firsts: DataFrame) -> DataFrame:
    """(host, phrase): the shingles of whole texts among the hashes `wanted`, and a few others; a pair may come again.

    `firsts` holds the hashes of the first words of the wanted phrases: other
    places of a text are passed over without a hash.
    """
    packed, packed_firsts = _bits(wanted), _bits(firsts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = _Starts(packed_firsts).__getitem__
        kept: dict[str, list[int]] = {}

        def hits_of(piece: str) -> list[int]:
            hits = []
            for phrase in _DASH.split(piece) if "-" in piece or "–" in piece or "—" in piece else (piece,):
                words = _words(phrase if phrase.islower() else _CAMEL.sub(r" \g<0>", phrase))
                if len(words) > SHINGLE:
                    hits += [_hash(" ".join(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1) if begins(words[i])]
                elif words and begins(words[0]):
                    hits.append(_hash(" ".join(words)))
            return [h for h in hits if _held(packed, h)]

        for batch in batches:
            pairs = set()
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in _pieces(text.as_py()):
                    hits = kept.get(piece)
                    if hits is None:
                        if len(kept) >= _KEPT:
                            kept.clear()
                        hits = kept[piece] = hits_of(piece)
                    for h in hits:
                        pairs.add((host, h))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.int64())], names=["host", "phrase"])

    rows = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).where("host IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(read, "host string, phrase long")


class SpamPages:
    """Densities of list parts of pages, found when the object is made.

    A list part is stitched if at least `stitched` of its phrases occur, in lists
    or as shingles of any other text, on at least `hosts` distinct hosts.
    pages: (id, stitched_density, own_density, density): the shares of a page's
    characters in stitched parts, in parts that count by themselves, and in either.
    Rows with null id or text, and texts without list parts, are left out; a null
    host counts for no host; a repeated row is given once, and if rows of one id
    differ the densest counts. Whole texts are read, at any length.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, host_col: str, hosts: int = 3, stitched: float = 0.5, prior: bool = True):
        found = cut(list_evidence(docs, id_col, text_col, host_col, prior))
        phrases = found.select("host", F.explode("parts.phrases").alias("p")).select("host", F.explode("p").alias("phrase"))
        wanted = cut(phrases.select("phrase").distinct())
        firsts = cut(found.select(F.explode("parts.firsts").alias("p")).select(F.explode("p").alias("first")).distinct())
        # lists hold their phrases themselves; the other texts are searched for them
        held = phrases.where("host IS NOT NULL").unionByName(phrase_hosts(docs.where(F.col(id_col).isNotNull()), text_col, host_col, wanted, firsts))
        pairs = held.distinct()
        spread = join_small(pairs, wanted, ["phrase"], how="left_semi", spread="host").groupBy("phrase").agg(F.count("*").alias("hosts"))
        shared = cut(spread.where(F.col("hosts") >= hosts).select("phrase", F.lit(1.0).alias("shared")))
        rows = found.withColumn("row", F.monotonically_increasing_id())
        parts = rows.select("row", F.posexplode("parts").alias("part", "x")).select("row", "part", "x.size", "x.own", F.explode_outer("x.phrases").alias("phrase"))
        judged = join_small(parts, shared, ["phrase"], how="left", spread="row").groupBy("row", "part", "size", "own").agg(F.avg(F.coalesce("shared", F.lit(0.0))).alias("share"))
        over = F.col("share") >= stitched
        sums = judged.groupBy("row").agg(F.sum(F.when(over, F.col("size"))).alias("stitched"), F.sum(F.when(F.col("own"), F.col("size"))).alias("own"), F.sum(F.when(over | F.col("own"), F.col("size"))).alias("either"))
        shares = [(F.coalesce(n, F.lit(0)) / F.col("total")).alias(a) for n, a in (("stitched", "stitched_density"), ("own", "own_density"), ("either", "density"))]
        self.pages = rows.select("row", "id", "total").join(sums, "row").select("id", *shares).groupBy("id").agg(*[F.max(a).alias(a) for a in ("stitched_density", "own_density", "density")])


def spam_pages(docs: DataFrame, id_col: str, text_col: str, host_col: str, part: float = 0.5, hosts: int = 3, stitched: float = 0.5, prior: bool = True) -> DataFrame:
    """(id, stitched_density, own_density, density) of pages that lists make up for more than `part`; without `prior` only stitched lists count."""
    return SpamPages(docs, id_col, text_col, host_col, hosts, stitched, prior).pages.where(F.col("density" if prior else "stitched_density") > part)
