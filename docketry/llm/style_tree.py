"""Main content of pages by a site style tree over their lines.

The pages of one host are merged into a tree. Below the host stand presentation
nodes (how a line is set: mark, joiner, cells, end sign, length, figures), below
them openings (the first two words), lines, and the cells of lines that are set
side by side. A node's importance falls with the share of its occurrences that
stand in the frame of a page: the run of repeated lines from its first or last
line inwards. It falls too if what stands next to the node is nearly always the
same (a fixed block has one presentation, guidance has many), and if the node is
always followed by titles of other pages (the head of a link box). Importance
is passed up, from cells to their line and from lines to their presentation,
and a line that is too rare to be judged has that of the nodes above it. Nodes
are judged within their host, or, where they are too rare there, over all hosts.
Low-importance branches leave the page.

Lists of lines that name their own function (consent, share, pager, footer) are
a prior beside the tree; `prior=False` leaves them out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.template_residue import SHORT, hinted, judge, segments
from docketry.runtime import cut, join_small

# ---- fixed values: lines that name their function on a page, whole lines without bullets and end marks ----
FURNITURE = [
    # skip links, menus, switches
    r"(?:skip|jump|go) (?:to )?(?:main |the )?(?:content|navigation|menu)|skip navigation|menu|main menu|navigation|search",
    r"a ?[-−–] ?a ?a ?\+?|text size.{0,20}|(?:print|mail|bookmark|share)(?: ?[|·•/,] ?(?:print|mail|bookmark|share|copy link|copy))+",
    r"(?:language|sprache|langue|idioma) ?: ?\w+.{0,3}|(?:[a-z]{2} ){2,}[a-z]{2}|(?:english|français|deutsch|español|हिन्दी|हिंदी)(?: ?[|/·•] ?(?:english|français|deutsch|español|हिन्दी|हिंदी))+",
    r"«? ?previous\b.*\bnext.*|(?:previous|next)(?: page)?|page \d+ of \d+|(?:\d+ ){3,}.{0,12}",
    # consent
    r".*\b(?:cookies?|témoins de connexion)\b.*(?:visits|notices|statisti\w*|comfort|language|idioma|setting|form open|pages are read|agree|allow|stimmen|refuser|site|settings).*",
    r".*\bstores? small files on your device\b.*|consent choices.*|choose what you allow.*|by browsing on.*|usamos cookies.*",
    r"(?:accept|reject|decline|allow)(?: all)?|i (?:accept|agree)|agree(?: ?\| ?.*)?|ok,? got it|settings|manage (?:choices|settings|cookies|consent)|save (?:selection|settings)|more options|(?:tout )?accepter.*refuser|aceptar todo|zustimmen oder ablehnen.*",
    # sharing, signing up, ratings
    r"share(?: (?:on|this|with)\b.*|: .*)|tell a friend.*|follow .{2,60} for .*|follow us.*|like us.*",
    r"(?:subscribe|sign up)(?: (?:to|for) .*)?|your e-?mail(?: address)?|newsletter|never miss .*",
    r"rate this page.*|was this page.*(?:useful|helpful).*|report a problem(?: .*)?|(?:send )?feedback|comments? ?\(\d+\)",
    # link boxes
    r"related (?:pages|links|topics)|see also|quick links|in this section|latest (?:notices|news)|most read|you may also like|on other pages|popular pages|read more",
    # bylines, stamps, counters
    r"(?:posted|published|updated) (?:on|by) .*|by the .{2,60} (?:editorial|web|press) (?:desk|team|office)|(?:page )?last (?:changed|updated|reviewed|modified)\b.*|page last .*|last reviewed on .*",
    r"site (?:kept|maintained|run) by .*|visitors?: ?[\d.,]+|best viewed (?:at|with|in) .*|powered by .*|document served by .*|\d+ (?:visits|views)",
    # footers and standing notices
    r"(?:©|\(c\)|copyright ).*|.*\ball rights reserved",
    r"(?:terms of (?:use|service)|privacy(?: statement| policy| notice)?|accessibility(?: statement)?|copyright policy|hyperlinking policy|imprint|legal notice|disclaimer|site ?map|back to top)",
    r"privacy ?[|/·•] ?terms.*|(?:terms|imprint|accessibility)(?: ?[|/·•] ?[a-z ]+)+",
    r"reproduction is (?:allowed|permitted|forbidden).*|the information on .* is given without liability.*|this text is a courtesy translation.*|beware of agents.*|need help\?.*help ?(?:line|desk).*|for the hard of hearing.*",
]
BOX = r"related (?:pages|links|topics)|see also|quick links|in this section|latest (?:notices|news)|most read|you may also like|on other pages|popular pages"
#: Words of site menus.
MENU = (
    "home news gallery fees forms contact visa passport register archive community holidays services downloads tenders careers faq notices feedback attestation search help about menu login settings"
    " about us,my account,book a slot,track a file,site map,overseas card,log in,basket,contact us,press,"
    "accueil,actualités,formulaires,tarifs,visas,passeport,plan du site,services,contact,"
    "startseite,aktuelles,formulare,gebühren,visum,reisepass,leistungen,kontakt,impressum,"
    "inicio,noticias,formularios,tasas,visados,pasaporte,mapa del sitio,servicios,contacto"
)
_MENU = frozenset(x.strip() for part in [MENU.partition(" about us")[0].replace(" ", ","), "about us" + MENU.partition(" about us")[2]] for x in part.split(",") if x.strip())

_OWN = re.compile("|".join(f"(?:{p})" for p in FURNITURE), re.I)
_BOX = re.compile(BOX, re.I)
_START_MARKS, _END_MARKS = " -–—*•·»›«☐>", " .!?:;,|»›-–—▾+↑→"
_BULLET = re.compile(r"^\s*([-–—*•·»›☐>]|\d+[.)])\s+")
_NUMBERS = re.compile(r"[0-9]+")
_PARTS, _JOIN = re.compile(r"\s*([/|·•›»>]|\s{3,})\s*"), re.compile(r"[/|·•›»>]|\s{3}")
#: Every pattern of FURNITURE begins with one of the first words or holds one of the others.
_FIRST = frozenset(
    "skip jump go menu main navigation search a a- a−  a– text print mail bookmark share language sprache langue idioma english français deutsch español हिन्दी हिंदी previous next page"
    " consent choose by usamos accept reject decline allow i agree ok ok, settings manage save more tout aceptar zustimmen tell follow like subscribe sign your newsletter never rate was report send feedback"
    " comment comments related see quick in latest most you on popular read posted published updated last site visitor visitors visitors: best powered document © (c) copyright terms privacy"
    " accessibility hyperlinking imprint legal disclaimer sitemap back reproduction beware need".split()
)
_WITHIN = re.compile("cookie|témoins de conn|small files|rights reserved|liability|courtesy trans|hard of hearing|visits|views|choices|stimmen|previous")
_LISTED = re.compile(r"(?:[a-z]{2} ){2}|\d+ \d", re.I)
_MENU_WORDS = frozenset(w for x in _MENU for w in x.split()) | {"(0)"}
_MENU_LONGEST = sorted(_MENU, key=len, reverse=True)
_MARKED = re.compile(r"[\d.,:;!?।|]")
_COUNT = re.compile(r"\s*\(\d+\)")
_LETTER = re.compile(r"[^\W\d_]")
_UNTITLED = re.compile(r"[\d,:;|()।]|[.!?]$")

#: What is known of a line, as bits.
PRIOR, BOX_HEAD, TITLED, PHRASE, RESIDUE, NUMBERED, JOINED = 1, 2, 4, 8, 16, 32, 64
_KEPT_LINES = 50_000  # distinct lines whose features a worker keeps at a time


def _bare_key(key: str) -> str:
    """Without what is neither letter nor digit at both ends."""
    i, j = 0, len(key)
    while i < j and not key[i].isalnum():
        i += 1
    while j > i and not key[j - 1].isalnum():
        j -= 1
    return key[i:j]


def _own(text: str, lower: str) -> bool:
    """The line names its function."""
    return (text.split(" ", 1)[0].lower().rstrip(":") in _FIRST or _LISTED.match(text) is not None or _WITHIN.search(lower) is not None) and _OWN.fullmatch(text) is not None


def _label(text: str) -> bool:
    """A menu label: one to three words without digits (but a count in brackets) and sentence marks."""
    if "(" in text:
        text = _COUNT.sub("", text)
    return 0 < len(text.split()) <= 3 and len(text) <= 30 and not _MARKED.search(text)


def _titled(text: str) -> bool:
    """Set like the title of another page."""
    return 0 < len(text.split()) <= 14 and not _UNTITLED.search(text) and _LETTER.match(text) is not None and (text[0].isupper() or not text[0].islower())


def _hash(key: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace"), seed) - (1 << 63)


def _is_menu(line: str, bare: str, parts: list[str]) -> bool:
    """A menu or trail of menu labels, by the list of labels."""
    if len(parts) >= 3 and not re.search(r"\d", re.sub(r"\(\d+\)", "", line)):
        known = sum(_COUNT.sub("", p).lower() in _MENU for p in parts)
        if known >= 0.6 * len(parts) or known >= 2 and all(_label(p) for p in parts[:-1]):
            return True
    words = bare.lower()
    if _COUNT.sub("", words) in _MENU:
        return True
    tokens = words.split()
    if len(tokens) >= 3 and _MENU_WORDS.issuperset(tokens):  # a menu in one line without separators
        rest, hits = words, 0
        for name in _MENU_LONGEST:
            rest, n = re.subn(rf"\b{re.escape(name)}\b", "", rest)
            hits += n
        return hits >= 3 and not rest.strip()
    return False


def features(line: str) -> tuple[int, int, tuple[int, ...], int, int, str]:
    """(line node, opening node, cell nodes, presentation, flags, mark) of a line that is not blank; a line of one cell has no cell nodes."""
    flat = " ".join(line.split())
    bare = flat.lstrip(_START_MARKS).rstrip(_END_MARKS) or flat
    lower = flat.lower()
    plain = _NUMBERS.sub("0", lower)
    key = _bare_key(plain) or lower
    m = _BULLET.match(line)
    mark = m.group(1) if m else ""
    core = line[m.end() :] if m else line
    core = core.strip().strip(_START_MARKS + _END_MARKS)
    joined = _PARTS.search(core) if _JOIN.search(core) else None
    parts = [x for x in _PARTS.split(core)[::2] if x] if joined else []
    cells = tuple(_hash(_bare_key(_NUMBERS.sub("0", " ".join(p.lower().split()))), 1) for p in parts) if len(parts) > 1 else ()
    tokens, end = bare.lower().split(), flat[-1]
    words, digits = len(tokens), "0" in plain
    style = "|".join((mark[-1:] if mark[:1].isdigit() else mark, (joined.group(1).strip() or "_") if cells else "", str(min(len(cells), 4)), "d" if digits else "", end if end in ".?!।:" else "", str(min(words, 4) if words < 8 else 8), "U" if bare.isupper() else "T" if bare[:1].isupper() else "t" if bare[:1].islower() else ""))
    opening = f"{' '.join(key.split()[:2])}|{end if end in '.?!।:' else ''}"
    flags = 0
    if _own(bare, lower) or (words <= 3 or len(parts) >= 3 or tokens[0] in _MENU_WORDS) and _is_menu(line, bare, parts):
        flags |= PRIOR
        if _BOX.fullmatch(bare):
            flags |= BOX_HEAD
    if not cells and flat[-1] not in ".?!।" and _titled(bare):
        flags |= TITLED | (PHRASE if words >= 3 else 0)
    if mark[:1].isdigit():
        flags |= NUMBERED
    if cells:
        flags |= JOINED
    if hinted(lower) and any(len(x.split()) <= 2 * SHORT and judge(x) not in (None, "strange", "doubt") for x in segments(line) if hinted(x.lower())):
        flags |= RESIDUE
    return _hash(key, 1), _hash(opening, 2), cells, _hash(style, 3), flags, mark


class _Features(dict):
    """line -> features, kept as lines come up."""

    def __missing__(self, line: str):
        if len(self) >= _KEPT_LINES:
            self.clear()
        found = self[line] = features(line)
        return found


def entries(flags: list[int], marks: list, heads: list[bool]) -> list[int]:
    """Lines that stand in the box of a head: the titles after it that are set with the same mark, however many."""
    found, mark, within = [], None, False
    for i, flag in enumerate(flags):
        if heads[i]:
            mark, within = None, True
        elif within:
            if mark is None:
                mark = marks[i]
            within = flag & TITLED and not flag & NUMBERED and marks[i] == mark
            if within:
                found.append(i)
    return found


_PAGE = "id string, site long, text_hash long, line_no array<int>, line array<long>, opening array<long>, style array<long>, flags array<int>, mark array<int>, cell_at array<int>, cell array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Features()
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = [x.split()[0] for x in _PAGE.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for text in batch.column(3):
            lines = text.as_py().split("\n")
            nos = [k for k, x in enumerate(lines) if x.strip()]
            seen = [known[lines[k]] for k in nos]
            flags, marks = [x[4] for x in seen], [x[5] for x in seen]
            for i in entries(flags, marks, [bool(f & BOX_HEAD) for f in flags]):
                flags[i] |= PRIOR
            at = [i for i, x in enumerate(seen) for _ in x[2]]
            row = (nos, [x[0] for x in seen], [x[1] for x in seen], [x[3] for x in seen], flags, [ord(m[-1:] or " ") for m in marks], at, [c for x in seen for c in x[2]])
            for column, value in zip(out, row):
                column.append(value)
        kinds = (ints, longs, longs, longs, ints, ints, ints, longs)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, kinds))], names=names)


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.xxhash64(F.coalesce("site", F.lit(""))).alias("site"), F.xxhash64("text").alias("text_hash"), "text")


def _surely(n: Column, hits: Column, z: float = 2.58) -> Column:
    """The share hits / n less its doubt: Wilson's lower bound at 99.5 %."""
    e = hits / n
    return (e + z * z / (2 * n) - z * F.sqrt(e * (1 - e) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class StyleTree:
    """The furniture lines of pages, found when the object is made.

    `pages` has id, text and site (all text); other columns are ignored. Rows
    with null id or null text hold no lines, a null site is a host of its own;
    of rows that differ under one id one counts, the one whose text has the least
    hash, so that repeated deliveries change nothing. Texts are read whole.
    Nodes are named by 64-bit hashes. A line that holds template residue or an
    error message is no furniture to the tree.

    site_share, share: a line is repeated if at least this share of its host's
    pages (and `least` of them), or of all pages (and `often`), holds it.
    frame: the share of a node's occurrences, less its doubt, that must stand in
    the frame of their pages (pages of repeated lines alone tell nothing); nodes with under `often` occurrences are not judged.
    own_share, own_entropy: a node that this share of a host's pages holds is low if
    its entropy over hosts is at most this part of the greatest possible.
    kinds: the different titles that must follow the head of a link box.
    fixed: the share of a repeated line's occurrences that have the same neighbour.
    styled: the share of low lines that makes a presentation low. Only presentations
    of joined cells decide lines: a text keeps too little of how single lines were set.

    lines: (id, line_no, prior, tree); tree says what found a line: `node`,
    `presentation` or `box`, null for one that only the prior found.
    """

    def __init__(self, pages: DataFrame, site_share: float = 0.02, least: int = 6, share: float = 0.002, often: int = 20, frame: float = 0.75, own_share: float = 0.2, own_entropy: float = 0.5, kinds: int = 10, fixed: float = 0.5, styled: float = 0.7, prior: bool = True):
        self.often, self.frame, self.prior = often, frame, prior
        read = cut(_keyed(pages).mapInArrow(_read, _PAGE)).withColumn("pid", F.monotonically_increasing_id())
        several = cut(read.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "site", "pid")).alias("x")).where("n > 1").select("id", F.col("x.pid").alias("kept")))
        read = join_small(read, several, ["id"], how="left", spread="pid").where("kept IS NULL OR pid = kept").drop("kept", "text_hash")
        self.pages = cut(self._framed(read, site_share, least, share))
        self._judge(fixed, own_share, own_entropy, kinds)
        self.lines = self._found(styled)

    def _framed(self, read: DataFrame, site_share: float, least: int, share: float) -> DataFrame:
        """`read` with the places of the first and last line that is not repeated (null if all are)."""
        nodes = read.select("site", F.explode(F.array_distinct(F.concat("line", "cell"))).alias("node"))
        # at most the nodes of a mean page / share
        self.wide = cut(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= max(self.often, share * read.count())).select("node", F.lit(True).alias("wide")))
        sizes = read.groupBy("site").agg(F.count("*").alias("pages"))
        local = nodes.groupBy("site", "node").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(sizes, "site").where(F.col("n") >= F.col("pages") * site_share)
        # at most the nodes of a mean page / site_share a host
        self.local = cut(local.select("site", "node", "n", "pages"))
        self.hosts = sizes.count()
        local = self.local.select("site", "node", F.lit(True).alias("local"))

        def repeated(rows: DataFrame) -> DataFrame:
            rows = join_small(join_small(rows, self.wide, ["node"], how="left", spread="pid"), local, ["site", "node"], how="left", spread="pid")
            return rows.withColumn("hit", F.coalesce("wide", "local", F.lit(False)))

        lines = read.select("pid", "site", "flags", F.posexplode("line").alias("i", "node")).withColumn("joined", F.get("flags", F.col("i")).bitwiseAND(JOINED) > 0).drop("flags")
        cells = repeated(read.select("pid", "site", F.explode(F.arrays_zip("cell_at", "cell")).alias("x")).select("pid", "site", F.col("x.cell_at").alias("i"), F.col("x.cell").alias("node")))
        joined = repeated(lines.where("joined")).select("pid", "i", F.col("hit").alias("whole"), F.lit(None).cast("int").alias("part")).unionByName(cells.select("pid", "i", F.lit(None).cast("boolean").alias("whole"), F.col("hit").cast("int").alias("part")))
        joined = joined.groupBy("pid", "i").agg(F.max("whole").alias("whole"), F.avg("part").alias("part")).where("NOT whole AND part < 0.66")
        new = repeated(lines.where("NOT joined")).where("NOT hit").select("pid", "i").unionByName(joined.select("pid", "i")).groupBy("pid").agg(F.min("i").alias("first_new"), F.max("i").alias("last_new"))
        return read.join(new, "pid", "left")

    def _lines(self) -> DataFrame:
        """One row a line, with its neighbours and whether it stands in the frame of its page."""
        at = lambda column, shift: F.get(column, F.col("i") + shift)
        rows = self.pages.select("*", F.posexplode("line").alias("i", "node"))
        return rows.select("id", "pid", "site", "i", "node", at("line_no", 0).alias("line_no"), at("opening", 0).alias("opening"), at("style", 0).alias("style"), at("flags", 0).alias("flags"),
                           at("line", 1).alias("next"), at("flags", 1).alias("next_flags"), at("line", -1).alias("before"), _framed_at(F.col("i")).alias("framed"))

    def _cells(self) -> DataFrame:
        """One row a cell of the lines that have several."""
        rows = self.pages.select("*", F.explode(F.arrays_zip("cell_at", "cell")).alias("x")).withColumn("i", F.col("x.cell_at"))
        return rows.select("id", "pid", "site", "i", F.col("x.cell").alias("node"), F.get("line_no", F.col("i")).alias("line_no"), F.get("style", F.col("i")).alias("style"), F.get("flags", F.col("i")).alias("flags"), _framed_at(F.col("i")).alias("framed"))

    def _judge(self, fixed: float, own_share: float, own_entropy: float, kinds: int) -> None:
        """The nodes of low importance: low_site (site, node) and low_any (node); heads of link boxes."""
        lines = self._lines()
        residue = (F.col("flags").bitwiseAND(RESIDUE) > 0).alias("residue")
        seen = lines.select("site", F.explode(F.array("node", "opening")).alias("node"), "framed", residue).unionByName(self._cells().select("site", "node", "framed", residue))
        held = [F.count("framed").alias("n"), F.sum(F.col("framed").cast("long")).alias("hits"), F.max("residue").alias("residue")]
        low = (F.col("n") >= self.often) & (_surely(F.col("n"), F.col("hits")) >= self.frame) & ~F.col("residue")
        # what a host says on many pages and hardly any other host says
        spread = self.local.groupBy("node").agg(_entropy(F.col("n")).alias("over_hosts")).where(F.col("over_hosts") <= own_entropy * math.log(max(2, self.hosts)))
        own = self.local.where(F.col("n") >= own_share * F.col("pages")).join(spread, "node", "left_semi").select("site", "node")
        seen = cut(seen.groupBy("site", "node").agg(*held))
        self.low_site = cut(seen.where(low).select("site", "node").unionByName(own).distinct().withColumn("low_site", F.lit(True)))
        framed = seen.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("n", "hits")], F.max("residue").alias("residue")).where(low).select("node")
        # lines repeated all over the corpus: what stands next to them
        wide = join_small(lines, self.wide, ["node"], spread="pid").where(~residue)
        titles = F.col("flags").bitwiseAND(TITLED) > 0
        phrases = (F.coalesce("next_flags", F.lit(0)).bitwiseAND(PHRASE) > 0).cast("long")
        counted = cut(wide.groupBy("node").agg(F.count("*").alias("n"), F.count_if(titles).alias("titled"), F.sum(F.when(titles, phrases)).alias("titles"), F.approx_count_distinct(F.when(titles, F.col("next"))).alias("kinds")))
        beside = wide.select("node", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("next").alias("other")), F.struct(F.lit(0).alias("side"), F.col("before").alias("other")))).alias("x")).select("node", "x.*").where("other IS NOT NULL")
        beside = join_small(beside, self.wide.withColumnRenamed("node", "other"), ["other"], how="left_semi").groupBy("node", "side", "other").agg(F.count("*").alias("together"))
        bound = beside.groupBy("node").agg(F.max("together").alias("together")).join(counted, "node").where((F.col("n") >= self.often) & (F.col("together") >= F.col("n") * fixed)).select("node")
        self.heads = cut(counted.where((F.col("titled") >= self.often) & (_surely(F.col("titled"), F.col("titles")) >= 0.8) & (F.col("kinds") >= kinds)).select("node"))
        self.low_any = cut(framed.unionByName(bound).unionByName(self.heads).distinct().withColumn("low_any", F.lit(True)))

    def _low(self, rows: DataFrame, node: str) -> DataFrame:
        rows = join_small(rows, self.low_any.withColumnRenamed("node", node), [node], how="left", spread="pid")
        rows = join_small(rows, self.low_site.withColumnRenamed("node", node), ["site", node], how="left", spread="pid")
        return rows.withColumn(f"low_{node}", F.coalesce("low_any", "low_site", F.lit(False))).drop("low_any", "low_site")

    def _judged(self) -> tuple[DataFrame, DataFrame]:
        """(id, site, line_no, style, flags, low) of the lines of one cell, by their own nodes and openings, and of the joined ones, by their cells too."""
        names = ["id", "site", "line_no", "style", "flags"]
        own = F.col("low_node") | F.col("low_opening")

        def lines(joined: bool) -> DataFrame:
            rows = self._lines().where((F.col("flags").bitwiseAND(JOINED) > 0) == joined)
            return self._low(self._low(rows.select("pid", *names, "node", "opening"), "node"), "opening")

        cells = self._low(self._cells(), "node").select(*names, F.lit(None).cast("boolean").alias("whole"), F.col("low_node").cast("int").alias("part"))
        joined = lines(True).select(*names, own.alias("whole"), F.lit(None).cast("int").alias("part")).unionByName(cells)
        joined = joined.groupBy(*names).agg(F.max("whole").alias("whole"), F.avg("part").alias("part"))
        return lines(False).select(*names, own.alias("low")), cut(joined.select(*names, (F.col("whole") | (F.col("part") >= 0.6)).alias("low")))

    def _entries(self) -> DataFrame:
        """(id, line_no) of the entries of link boxes; their heads are few, under the nodes of a mean page / share."""
        heads = frozenset(self.heads.toArrow().column(0).to_pylist())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, nos = [], []
                for row, (line, flags, marks, line_no) in enumerate(zip(*(batch.column(c) for c in range(1, 5)))):
                    line = line.values.to_pylist()
                    if not heads.isdisjoint(line):
                        no = line_no.values.to_pylist()
                        for i in entries(flags.values.to_pylist(), marks.values.to_pylist(), [x in heads for x in line]):
                            rows.append(row)
                            nos.append(no[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(nos, pa.int32())], names=["id", "line_no"])

        return self.pages.select("id", "line", "flags", "mark", "line_no").mapInArrow(read, "id string, line_no int")

    def _found(self, styled: float) -> DataFrame:
        single, joined = self._judged()
        # presentation nodes have the importance of what stands below them; rare ones of a host that of all hosts
        counted = cut(joined.groupBy("site", "style").agg(F.count("*").alias("n"), F.sum(F.col("low").cast("long")).alias("hits")))
        every = counted.groupBy("style").agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
        by_site, by_all = _surely(F.col("n"), F.col("hits")), _surely(F.col("all_n"), F.col("all_hits"))
        judge_by = F.when(F.col("n") >= self.often, by_site).when(F.col("all_n") >= self.often, by_all)
        styles = cut(counted.join(every, "style").where(judge_by >= styled).select("site", "style", F.lit(True).alias("low_style")))
        lines = single.withColumn("low_style", F.lit(None).cast("boolean")).unionByName(join_small(joined, styles, ["site", "style"], how="left", spread="id"))
        residue = F.col("flags").bitwiseAND(RESIDUE) > 0
        arm = F.when(residue, None).when(F.col("low"), "node").when(F.col("low_style"), "presentation")
        lines = lines.select("id", "line_no", (F.col("flags").bitwiseAND(PRIOR) > 0).alias("prior"), arm.alias("tree")).where("prior OR tree IS NOT NULL")
        boxes = self._entries().select("id", "line_no", F.lit(False).alias("prior"), F.lit("box").alias("tree"))
        return lines.unionByName(boxes).groupBy("id", "line_no").agg(F.max("prior").alias("prior"), F.max("tree").alias("tree"))

    @property
    def furniture(self) -> DataFrame:
        return self.lines.where("prior OR tree IS NOT NULL" if self.prior else "tree IS NOT NULL").select("id", "line_no")

    def main_content(self, pages: DataFrame) -> DataFrame:
        """(id, main_text) of each distinct id with a text: its lines that are not furniture, in order."""
        gone = self.furniture.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
        texts = _keyed(pages).groupBy("id").agg(F.min_by("text", F.struct("text_hash", "site")).alias("text"))
        kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
        return texts.join(gone, "id", "left").select("id", F.array_join(kept, "\n").alias("main_text"))


def _entropy(n: Column) -> Column:
    """Entropy (nats) of a distribution given by counts, as an aggregate."""
    x = n.cast("double")
    return F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x)


def _framed_at(i: Column) -> Column:
    """Everything between the line and an end of the page is repeated; null where that tells nothing (no other line is new)."""
    alone = (F.col("first_new") == F.col("last_new")) & (F.col("first_new") == i)
    return F.when(~alone, (i <= F.col("first_new")) | (i >= F.col("last_new")))
