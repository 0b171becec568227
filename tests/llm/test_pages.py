from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.llm.keyword_spam import evidence, spam_pages
from docketry.llm.ocr_repair import ScanRepair, header_key, is_scan, look, rebuild
from docketry.llm.pii_bootstrap import Details, email_key, phone_key
from docketry.llm.template_residue import TemplateResidue, judge


@pytest.mark.parametrize(
    "segment, want",
    [
        ("Welcome to {{ name }}!", "placeholder"),
        ("Due on %DUE_DATE%", "placeholder"),
        ("Dear [OFFICE CITY],", "placeholder"),
        ("[insert fee here]", "placeholder"),
        ("Details such as [PASSPORT_NO] are hidden.", None),
        ("Leave the box [ ] empty if the rate is 5% or 10% and <b>not</b> more", None),
        ("tbd tbd tbd", "filler"),
        ("A- A A+", None),
        ("This is sample text.", "filler"),
        ("Error 404: the page you asked for could not be found.", "message"),
        ("If the portal shows error 503, load the page again and keep your slip number at hand.", None),
        ("Please enable JavaScript to continue.", "script"),
        ("The booking form works best when JavaScript is turned on, so check this before you choose a slot.", None),
        ("The page on visas was not found useful by some readers.", None),
        ("Incident 77", "doubt"),
        ("", None),
    ],
)
def test_judge(segment, want):
    assert judge(segment) == want


def test_residue_host_evidence_and_edges(spark):
    rows = [(f"r{h}", "Good guidance about the passport.\nIncident 12", f"https://h{h}.x/visa", "s") for h in range(3)]
    rows += [("one", "Reload", "https://h0.x/y", "s"), ("p", "x" * 100_000 + " {{name}}", None, None), ("p", "x" * 100_000 + " {{name}}", None, None), ("n", None, "https://h0.x", "s"), (None, "{{x}}", "https://h0.x", "s"), ("e", "", "https://h0.x", "s")]
    rows += [(f"k{i}", f"It is said that the words of the page are in use here, number {i}.", "https://h1.x", "s") for i in range(30)] + [("g", "dolorem quandis teturo vitaro sulta mensa pasquil.", "https://h1.x", "s")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id string, t string, u string, k string, segment string")
    titles = spark.createDataFrame([("s", "Visa"), ("s", "Visa"), (None, "x")], "key string, title string")
    found = TemplateResidue(df, "id", "t", "u", "k", titles).findings().select("id").distinct()
    assert {r.id for r in found.collect()} == {"r0", "r1", "r2", "p", "g"}
    assert TemplateResidue(df.limit(0), "id", "t", "u", "k", titles).findings().count() == 0


GATED = {
    "message": ["पृष्ठ नहीं मिला", "पेज नहीं मिला", "यह सेवा उपलब्ध नहीं है", "Upstream said HTTP 502: try later", "Upstream status 503 - try later", "StackTrace follows", "A NullPointer came up", "It stopped at a.b (c:12)", "Cause: internal-server error, bad gateway", "The system is down for planned work"],
    "filler": ["A pre-test text stands in its place", "tbd-tbd-tbd"],
    "placeholder": ["See the text [paragraph 3] of the page", "See [Para 3] of it", "The fee (FIXME amount) is due", "The fee (TODO amount) is due", "XXX name XXX"],
    "script": ["Please re-enable client-side scripting", "A script-capable viewer and a script-capable browser"],
    "doubt": ["A time-out", "The plug-in", "A re-try: retry"],
}


@pytest.mark.parametrize("want, segment", [(k, x) for k, v in GATED.items() for x in v])
def test_gates_of_judge_let_pass_what_the_patterns_match(want, segment):
    assert judge(segment) == want


@pytest.mark.parametrize("text", ["AB-123-456", "A-123456", "ABC1234", "AB12CD34", "A1BCD23", "ABCD1xy22z", "123-45-6789", "1234 5678 9012", "1234-5678-9012", "A 123456"])
def test_gate_of_ids_lets_pass_every_alternative(text):
    from docketry.llm.pii_bootstrap import _DIGITS, _ID, _MAYBE_ID, propose

    assert _ID.fullmatch(text) and _MAYBE_ID.search(text) and len(_DIGITS.findall(text)) > 2
    line = f"It is {text} here"
    found = list(propose(line, line.lower(), line.lower().split(), dict.fromkeys(["email", "phone", "address", "name"], frozenset())))
    assert [x[0] for x in found] == ["id_number"]


FILLER = "dolorem quandis teturo vitaro sulta mensa pasquil"


def test_a_hot_source_switches_off_no_findings_elsewhere(spark):
    """An unlisted language on one host, in most of all rows, spares that host's pages and no others."""
    talk = "It is said that the words of the page are in use here"
    rows = [(f"k{i}", f"{talk}, number {i}.", f"https://h{i % 3}.x/p") for i in range(30)]
    rows += [("mixed", f"{talk}. {FILLER}.", "https://h1.x/q"), ("whole", f"{FILLER}.", "https://h2.x/q"), ("small", f"{FILLER} ipsor.", "https://small.x"), ("bare", f"{FILLER}.", None)]
    hot = "permohonan paspor diajukan kepada petugas sebelum keberangkatan"
    rows += [(f"u{i}", f"{hot} nomor {'abcdefghij'[i % 10] * (2 + i // 10)}.", "https://hot.x/p") for i in range(60)] * 2
    # a filler paragraph within a page that is otherwise in a listed language is found on the hot host too
    rows += [("within", "\n".join([*[f"{talk} {w}." for w in ("one", "two", "three", "four")], f"{FILLER}."]), "https://hot.x/q")]
    df = spark.createDataFrame([(*r, None) for r in rows], "id string, t string, u string, k string")
    titles = spark.createDataFrame([], "key string, title string")
    found = TemplateResidue(df, "id", "t", "u", "k", titles).findings()
    assert sorted((r.id, r.verdict) for r in found.collect()) == [(x, "strange") for x in ("bare", "mixed", "small", "whole", "within")]


SPAM = ["visa agent\ncheap visa\nvisa agent\ncheap visa\nvisa agent\ncheap visa\ncheap visa", "www.a-visa.example/x\nhttps://b.test/y\nc.invalid/z", "#VisaFee #FastVisa #VisaFee #CheapVisa", "Wallet | SKU AB-1234 | 8.50 | buy now\nFolder | SKU AB-9 | 3 | buy now", "Fast visa in A: fast visa, best fast visa. Looking for fast visa? Our fast visa is the fast visa for you. Fast visa B, fast visa price B."]
HAM = ["The fee is paid to the cashier in person. See https://a.example/x for the form.\nTags: visa, fee", "Service | Days | Crowns\nA visa | 3 | 20.50\nDeath registration | 2 | 8.00\nPassport renewal | 7 | 9.00\nMarriage registration | 7 | 9.00", "- The old passport\n- Two photographs for the visa\n- A letter from the employer", "When do I apply for a visa?\nYou apply for a visa before you travel."]


def test_spam_pages(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(SPAM)] + [(100 + i, t, "s0") for i, t in enumerate(HAM)]
    shared = "Searches: " + ", ".join(f"word{k} city" for k in range(20))
    rows += [(200 + k, f"One short sentence of guidance is here.\n{shared}", f"h{k}") for k in range(4)] + [(300, "One short sentence of guidance is here.\nSearches: " + ", ".join(f"own{k} term" for k in range(20)), "h0")]
    rows += [(400, None, "s"), (401, "", "s"), (402, " \n ", None), (None, SPAM[0], "s"), (0, SPAM[0], "s0"), (500, "x" * 300_000, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, density int")
    got = {r.id for r in spam_pages(df, "doc_id", "text", "source").collect()}
    assert got == {0, 1, 2, 3, 4, 200, 201, 202, 203}
    assert spam_pages(df.limit(0), "doc_id", "text", "source").count() == 0
    assert evidence("")[0] == 0


def test_spam_lists_whose_phrases_stand_in_prose_elsewhere(spark):
    """A doubtful list on one host, its phrases in running text of others; a phrase on two hosts in all does not count."""
    terms = [f"term{chr(97 + k)} visa{chr(97 + k)}" for k in range(10)]
    listed = "One short sentence of guidance is here.\nSearches: " + ", ".join(terms)
    own = "One short sentence of guidance is here.\nSearches: " + ", ".join(f"rare{x}" for x in terms)
    prose = "The office keeps, as it is said, " + ", ".join(terms) + ", and it is the clerk who sees to them before noon."
    rows = [(1, listed, "h0"), (2, prose, "h1"), (3, prose, "h2"), (4, own, "h0"), (5, own.replace("Searches: ", "It is said, "), "h1"), (6, prose, None), (7, own.replace("Searches: ", "It is said, "), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.id for r in spam_pages(df, "doc_id", "text", "source").collect()} == {1}
    assert {r.id for r in spam_pages(df.where("doc_id <> 3"), "doc_id", "text", "source").collect()} == set()


SCAN = ["Notice to travellers", "The records room keeps the signed declaration for the regis-", "tration of all travellers; the fee of 2O.50 crowns is paid at", "— 14 —", "N0tice to travellers    15", "the couhter by first-", "time applicants who bring the offlcer a letter from the", "employer before they travel to the district on Monday."]


def test_scan_repair(spark):
    native = " ".join(x for x in ["The registration of travellers is kept by the records room.", "A first-time applicant brings the officer a letter to the counter."] * 3)
    rows = [(1, "d", "\n".join(SCAN), True), (1, "d", "\n".join(SCAN), True), (2, "e", native, False), (3, None, None, None), (4, "d", "", True), (None, "d", "\n".join(SCAN), True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "extract_id long, raw_content_path string, text string, used_ocr boolean, kind string")
    repair = ScanRepair(df)
    got = {(r.extract_id, r.line_no, r.kind) for r in repair.found.collect()}
    assert got == {(1, 0, "running_header"), (1, 1, "word_break"), (1, 2, "misread"), (1, 3, "page_number"), (1, 4, "running_header"), (1, 6, "misread")}
    text = {r.extract_id: r.repaired_text for r in repair.paragraphs().collect()}
    assert text[1] == "The records room keeps the signed declaration for the registration of all travellers; the fee of 2O.50 crowns is paid at the couhter by first- time applicants who bring the officer a letter from the employer before they travel to the district on Monday."
    assert text[2] == native and text[4] == "" and 3 not in text
    assert ScanRepair(df.limit(0)).found.count() == 0


def test_scan_words_beyond_the_frequent_ones_are_joined(spark, monkeypatch):
    from docketry.llm import ocr_repair

    native = "The registration of travellers is kept by the records room. An officer has the letter. " * 3
    df = spark.createDataFrame([(1, "d", "\n".join(SCAN)), (2, "e", native)], "extract_id long, raw_content_path string, text string")
    rows = []
    for n in (20_000, 1):
        monkeypatch.setattr(ocr_repair, "FREQUENT", n)
        rows.append(sorted(map(tuple, ScanRepair(df).found.collect())))
    assert rows[0] == rows[1] and (1, 6, "misread") in rows[0]


def test_looks():
    assert look("agreernent") == look("agreement") and look("0ffice") == look("office") and look("cl0se") != look("open")
    assert header_key("C0nsular Handb00k, Volume 25") == header_key("Consular Handbook, V0lume 7")
    assert not is_scan("") and not is_scan("one line") and rebuild("a\n\nb", set(), set(), {}) == "a b"


def offices(spark):
    return spark.createDataFrame([("Tolmere", "office1@tolmere-mission.example", "+999 2016 0100", "116 Harbour Road, Tolmere")], "office string, email string, phone string, address string")


def details(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, question string, answer string, start_pos int")
    return Details(df, "id", {"question": F.col("question"), "answer": F.col("answer")}, offices(spark))


def test_details(spark):
    names = ["Quelana Jorwick", "Rusavi Tavmora", "Naravi Thalwick", "Sevika Jorwick"]
    rows = [(i, f"My name is {names[i % 4]}. The fee is 12.50 crowns on 12.03.2031.", None) for i in range(12)]
    rows += [(20 + i, f"the booklet of my son {names[i]} was never sent", "") for i in range(4)]
    rows += [
        (40, "mail a.b+c@d.co.example or x at d dot example, call +1 (404) 555-0123.", None),
        (41, "I live at Flat 2, 14B Heron St., Tolmere. Passport: K1424390", "Call 00999 2016 0100 or office1 at tolmere-mission dot example, 116 Harbour Rd, Tolmere."),
        (42, "my name is quelana tavmora", "Dear RUSAVI JORWICK, your file VC-6639-75992 is here"),
        (43, "😀 ssn 666-31-7182 and [EMAIL] [REFERENCE_NO]", None),
        (44, None, None), (None, "a@b.example", None), (45, "", "x" * 200_000 + " q@r.example"),
        (40, "mail a.b+c@d.co.example or x at d dot example, call +1 (404) 555-0123.", None),
    ]
    op = details(spark, rows)
    got = {(r.id, r.field_name, r.kind, r.start_pos) for r in op.found.where("id >= 40").collect()}
    assert got == {
        (40, "question", "email", 5), (40, "question", "email", 27), (40, "question", "phone", 52),
        (41, "question", "address", 10), (41, "question", "id_number", 52),
        (42, "question", "name", 11), (42, "answer", "name", 5), (42, "answer", "id_number", 31),
        (43, "question", "id_number", 6), (45, "answer", "email", 200_001),
    }
    assert op.found.where("id < 40 AND kind = 'name'").count() == 16 and op.found.where("id < 40").count() == 16
    masked = {(r.id, r.field_name): r.masked_text for r in op.masked().collect()}
    assert masked[40, "question"] == "mail [EMAIL] or [EMAIL], call [PHONE]." and masked[42, "answer"] == "Dear [NAME], your file [ID_NUMBER] is here"
    assert details(spark, []).found.count() == 0


def test_keys():
    assert phone_key("00999 2016 0100") == phone_key("+999-2016-0100") and email_key("A [at] b [dot] c") == "a@b.c"


def test_long_runs_of_names_and_texts_that_differ_under_one_id(spark):
    names = ["Quelana Jorwick", "Rusavi Tavmora", "Naravi Thalwick", "Sevika Jorwick"]
    rows = [(i, f"My name is {names[i % 4]}. The fee is 12.50 crowns.", None) for i in range(12)]
    rows += [(20 + i, f"the booklet of my son {names[i]} was never sent", "") for i in range(4)]
    rows += [(50, "it is Quelana Rusavi Naravi Sevika Jorwick Tavmora Thalwick who came", None)]
    rows += [(51, "call me at once please", None), (51, "to me at a.b@c.example please", None)]
    op = details(spark, rows)
    assert [(r.start_pos, r.end_pos) for r in op.found.where("id = 50").collect()] == [(6, 59)]
    masked = {r.masked_text for r in op.masked().where("id = 51").collect()}
    assert masked in ({"call me at once please"}, {"to me at [EMAIL] please"})


@pytest.mark.parametrize("text", ["{{" + "x" * 61 + "}}", "${" + "y" * 200 + "}", "[insert " + "z " * 80 + "here]", "@@" + "a" * 90 + "@@", "<%= " + "b" * 90 + " %>"])
def test_placeholders_of_any_length(text):
    assert judge(f"The fee is {text} here.") == "placeholder"


def test_filler_with_accents_is_strange():
    assert judge("dolorém quandis tétura vitaro sulta ménsa pasquil") == "strange"
    assert judge("आवेदन के लिए दो फ़ोटो और पुराना पासपोर्ट साथ लाना होता है") is None


WORDS = "the fee is paid at the counter before the visit and the form is kept with the letter of the office".split()


def test_responses_by_hosts_without_lists(spark):
    """Replies in wordings that no list holds: rare words, several hosts, nothing in common with slug and title."""
    rows = [(f"t{i}", f"It is said that {' '.join(WORDS[i % 7 : i % 7 + 9])} {i}.", f"https://h{i % 8}.x/visa-fee", "s") for i in range(3000)]
    rows += [(f"r{i}", f"Zorp kelled, brint again.\nIt is said that the fee is paid at the counter before the visit {i}.", f"https://h{i}.x/visa-fee", "s") for i in range(3)]
    rows += [("one", "Zorp kelled.", "https://h5.x/visa-fee", "s")]
    rows += [(f"slug{i}", "Quimb varding.", f"https://h{i}.x/quimb", "s") for i in range(3)] + [(f"same{i}", "Plov untel.", "https://h7.x/y", "s") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, t string, u string, k string")
    titles = spark.createDataFrame([("s", "Visa")], "key string, title string")
    found = TemplateResidue(df, "id", "t", "u", "k", titles, prior=False).findings().collect()
    # what the slug names, and what one host alone says, is no response
    assert {r.id for r in found} == {"r0", "r1", "r2", "one"} and {r.verdict for r in found} == {"response"}


def test_spam_without_lists_is_stitched_from_phrases_of_other_hosts(spark):
    random.seed(2)
    terms = [f"{a} {b}" for a in ("fast", "cheap", "best", "urgent") for b in ("visa", "stamp", "photo", "slot")]
    run = lambda: " ".join(random.choices(terms, k=60))
    links = lambda: "\n".join(f"{t} -> https://{t[0]}{k}.example" for k, t in enumerate(random.sample(terms, 8)))
    rows = [(i, run() if i % 2 else links(), f"h{i}") for i in range(8)]
    rows += [(100, "\n".join(f"own{k} thing -> https://o{k}.example" for k in range(8)), "h1"), (101, "The fee is paid at the counter. It is kept with the form.\nfast visa -> https://a.example", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.id for r in spam_pages(df, "doc_id", "text", "source", prior=False).collect()} == set(range(8))


def test_scans_of_any_width_headers_with_lost_letters_and_number_sequences(spark):
    from docketry.llm.ocr_repair import number_of

    wide = "\n".join(["the records room keeps the signed declaration for the registration of all travellers and the fee of the office is paid at the counter by first"] * 2 + ["time applicants who bring the officer a letter from the employer before they travel to the district on the first Monday of the month or later."])
    assert max(map(len, wide.split("\n"))) > 130 and is_scan(wide)
    narrow = "the fee of the\noffice is paid by\nall who come here."
    assert not is_scan(narrow) and is_scan(narrow, marked=True) and is_scan("the fee of the office is paid\nat the counter.", marked=True)
    head = "Consular Handbook of the District Offices and of the Records Rooms Abroad, Second Edition"
    own = iter("amber birch cedar dune ember flint".split())

    def page(h, n, cut):
        w = next(own)
        body = [f"the records room keeps the {w} declaration for the office and", f"the fee of the {w} counter is paid at the window by the first", f"of all who come to the {w} district with a letter of the post"]
        return "\n".join([body[0], *([h, n] if h else []), body[1] + cut, *([] if h else [n]), body[2].capitalize() if cut else body[2], body[0]])

    rows = [(1, "d", page(head, "12345", "")), (2, "d", page(head, "12346", "")), (3, "d", page(head.replace("Handbook", "Handbok"), "12347", ""))]
    rows += [(4, "d", page("", "12348", ".")), (5, "d", page("", "77", ".")), (6, "e", page("", "12348", "."))]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "extract_id long, raw_content_path string, text string, used_ocr boolean, line_no int")
    got = {(r.extract_id, r.line_no, r.kind) for r in ScanRepair(df).found.where("kind <> 'misread'").collect()}
    # the header with a letter lost too; the number that continues the document's numbers, no lone amount, none of another document
    assert got == {(i, 1, "running_header") for i in (1, 2, 3)} | {(i, 2, "page_number") for i in (1, 2, 3)} | {(4, 2, "page_number")}
    assert [number_of(x) for x in ("— 14 —", "Page 2O of 44", "xiv", "[3S]", "iv", "text")] == [14, 20, 14, 35, 4, None]


def test_spam_words_and_pieces_are_split_as_their_patterns_say():
    """The fast splits of words, pieces, sentences and capitals give what the plain patterns give, in any script."""
    from docketry.llm import keyword_spam as k

    word, piece = re.compile(r"[^\s\d.,;:!?।()\[\]|/\\\"“”„…#<>=&@*•·☐→{}+_~–—-]+"), re.compile(r"[^,;:|·•→=>\n()\[\]\"#\d]+")
    sentence, camel = re.compile(r"(?<=[.!?।])\s+(?=\S)"), re.compile(r"(?<=[a-z])(?=[A-Z])")
    bits = ["Visa", "visa", " ", "\n", ". ", "।  ", "!", "?\t", "\x1c", "\x85", "\xa0", "\u3000", "12.50", "१२", "٣", "²", "|", "-", " – ", "—", "“", "…", "·", "•", "☐", "→", "#Fee", "é", "ÉTÉ", "ß", "İ", "ΑΣ", "K", "वीज़ा", "\udc80", "😀", "aBcD", "_", "'", "\x00"]
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 24)))
        assert k._words(text) == word.findall(text.lower()), repr(text)
        assert k._pieces(text) == set(piece.findall(text)), repr(text)
        assert k._SENTENCE.split(text) == sentence.split(text), repr(text)
        assert k._CAMEL.sub(r" \g<0>", text) == camel.sub(" ", text), repr(text)
    links = ["see office.COM now", "WWW.office", "https://a", "a.teſt"]
    assert [x for x in [*links, "a.community", "One. Two.", "a www b", "://"] if k._is_links(x)] == links


def test_spam_evidence_and_phrases_cost_little_beside_a_plain_search_for_words():
    """CPU time beside that of finding the words of the same texts: 6 times as much before, 2.2 since (measured when this was written)."""
    from docketry.llm.keyword_spam import phrases

    prose = "The fee of 12.50 crowns is paid to the cashier in person. If you live outside the district, the courier brings the letter back free of charge. Parents of a minor sign in front of the clerk; the old passport is kept on file. Le guichet reste fermé chaque jeudi après-midi. Présentez la déclaration signée à l'entrée, puis le reçu au caissier."
    texts, plain = ["\n\n".join([f"{prose} No {k}."] * 8) for k in range(40)], re.compile(r"[^\W\d_]+")

    def cpu(f) -> float:
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    runs = [(cpu(lambda t: plain.findall(t.lower())), cpu(evidence), cpu(phrases)) for _ in range(9)]
    words, *read = map(min, zip(*runs))
    assert sum(read) < 4 * words


def test_shapes_are_learned_from_the_contexts_of_seeds(spark):
    """Kinds of addresses, numbers and e-mails that are no seeds are known from the company they keep."""
    kinds = [("Road", "a.b@c.example", "+1 404 555 0123"), ("Street", "a.b@c.example", "+1 404 555 0123"), ("Lane", "a.b@c.example", "+1 404 555 0123"), ("Close", "a.b[at]c.example", "404-555-0123"), ("Mews", "a.b at c dot example", "(404) 555-0123")]
    rows = [(i, f"I live at {i + 1} Heron {t}, thanks. Write to {m}, please. Call {p}, please.", None) for i, (t, m, p) in enumerate(kinds * 20)]
    found = {(r.kind, r.arm): r.details for r in details(spark, rows).arms().collect()}
    assert found == {(k, arm): n for k in ("address", "email", "phone") for arm, n in (("seed", 60), ("learned", 40))}
