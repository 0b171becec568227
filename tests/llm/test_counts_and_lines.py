from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docketry.llm.heavy_hitters import frequent_items, normal_item
from docketry.llm.lines import line_key, site_of
from docketry.llm.site_lines import SiteLines
from docketry.llm.style_tree import BOX_HEAD, PRIOR, StyleTree, entries, features


def items(df, **k):
    return {(r.field_name, r.item): (r.n, r.ids) for r in frequent_items(df, "id", {"q": normal_item(F.col("q")), "o": normal_item(F.col("o"))}, **k).collect()}


SCHEMA = "id long, q string, o string, n long, ids long"  # extra columns with clashing names


def test_frequent_items_against_brute_force(spark):
    random.seed(1)
    rows = [(i, random.choice(["How  are\tyou?! ", "how are you", "x" * 5000, None, "", f"rare {i}"]), random.choice(["A", "a.", "b"]), 7, 8) for i in range(400)]
    rows += rows[:50] + [(None, "how are you", "a", 1, 1)]
    truth = Counter()
    for r in set(rows):
        if r[0] is not None:
            for f, v in (("q", r[1]), ("o", r[2])):
                if v is not None:
                    truth[f, re.sub(r"[?!. ]+$", "", re.sub(r"[ \t\r\n]+", " ", v.lower()).strip(" "))] += 1
    got = items(spark.createDataFrame(rows, SCHEMA), share=0.1)
    assert got == {k: (n, 400) for k, n in truth.items() if n >= 40}
    best = sorted(((f, k) for f, k in truth if f == "q"), key=lambda x: (-truth[x], x[1]))[:3]
    assert {k for k in items(spark.createDataFrame(rows, SCHEMA), top=3) if k[0] == "q"} == set(best)


def test_frequent_items_edges(spark):
    assert items(spark.createDataFrame([], SCHEMA), share=0.1) == {}
    differing = [(1, "b", None, 0, 0), (1, "a", None, 0, 0), (2, "a", None, 0, 0)]
    assert items(spark.createDataFrame(differing, SCHEMA), share=0.5) == {("q", "a"): (2, 2)}
    ties = [(i, c, None, 0, 0) for i, c in enumerate("cab")]
    assert set(items(spark.createDataFrame(ties, SCHEMA), top=2)) == {("q", "a"), ("q", "b")}


def test_keys_and_sites(spark):
    df = spark.createDataFrame([("  – Page  12 of 345! ",), ("12",), ("É2b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(line_key(F.col("t"))).collect()] == ["page 0 of 0", None, "é0b", None, None]
    df = spark.createDataFrame([("HTTPS://www.A.b:443/x",), ("http://u@a.b?q",), ("a.b/x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(site_of(F.col("t"))).collect()] == ["a.b", "a.b", "a.b", None, None]


def lines_of(spark, rows, **k):
    df = spark.createDataFrame(rows, "id string, t string, u string, site string, lines string, n int")
    return SiteLines(df, "id", "t", site_of(F.col("u")), **k), df


def test_site_lines_against_brute_force(spark):
    random.seed(2)
    rows = []
    for i in range(240):
        site = f"s{min(i % 7, 2)}.x"
        body = [f"own {i} {chr(97 + k)}{i % 9} text" for k in range(3)]
        if random.random() < 0.4:
            body = ["Share THIS page", "Mail · Print"] + body
        if random.random() < 0.06:
            body.append("Rare line here")
        rows.append((f"d{i}", "\n".join(body + ["", "***"]), f"https://www.{site}/p{i}", "c", "c", 1))
    rows += rows[:30] + [("n1", None, "https://s0.x", "", "", 0), ("n2", "Share this page", None, "", "", 0), (None, "Share this page", "https://s0.x", "", "", 0), ("e", "", "https://s0.x/", "", "", 0)]
    held, docs = defaultdict(set), defaultdict(set)
    key = lambda x: re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\s+", " ", re.sub("[0-9]+", "0", x.lower())))
    texts = {}
    for i, t, u, *_ in rows:
        if i and u:
            s = u.split("/")[2].removeprefix("www.")
            docs[s].add(i)
            texts[i] = (s, (t or "").split("\n"))
    for i, (s, ls) in texts.items():
        for x in ls:
            if re.search("[a-z]", key(x)):
                held[s, key(x)].add(i)
    truth = {(i, n) for i, (s, ls) in texts.items() for n, x in enumerate(ls) if (k := (s, key(x))) in held and len(held[k]) >= 6 and len(held[k]) >= 0.05 * len(docs[s])}
    op, df = lines_of(spark, rows)
    assert {(r.id, r.line_no) for r in op.occurrences.collect()} == truth
    blocks = {(r.site, r.block) for r in op.blocks.where("site = 's0.x'").collect()}
    assert len(blocks) < op.blocks.where("site = 's0.x'").count()  # the two lines that follow each other are one block
    clean = {r.id: r.clean_text for r in op.cleaned(df, "id", "t").collect()}
    assert clean["d0"] == "\n".join(x for n, x in enumerate(texts["d0"][1]) if ("d0", n) not in truth) and clean["n1"] is None and clean["e"] == ""


def test_site_lines_empty(spark):
    op, df = lines_of(spark, [])
    assert op.occurrences.count() == 0 and op.cleaned(df, "id", "t").count() == 0


PAGE = "Skip navigation\nHome\nNews\nContact\nFees for a visa\nBring the old passport and two photographs to the counter.\nBlack ink only.\nSee also\n- Rules for students\n- Rules for families\nThe fee is 20 crowns.\nWe use cookies to count visits. Choose what you allow below.\nAccept all\nSettings\n« Previous   1 2 3 ... 9   Next »\n© 2031 Tolmere Mission. All rights reserved."


def test_prior_of_a_page():
    def prior(text):
        nos = [k for k, x in enumerate(text.split("\n")) if x.strip()]
        seen = [features(text.split("\n")[k]) for k in nos]
        flags = [x[4] for x in seen]
        found = {i for i, f in enumerate(flags) if f & PRIOR} | set(entries(flags, [x[5] for x in seen], [bool(f & BOX_HEAD) for f in flags]))
        return {nos[i] for i in found}

    assert prior(PAGE) == {0, 1, 2, 3, 7, 8, 9, 11, 12, 13, 14, 15}
    assert prior("") == set() and prior("word " * 200_000) == set()
    # a box has as many entries as it has, and a line may have any length
    assert prior("See also\n" + "\n".join(f"- Rules for {x}" for x in "abcdefghi") + "\nThe fee is due.") == set(range(10))
    assert prior("Our partners place cookies " + "and more of them " * 30 + "to measure how pages are read, as you allow.") == {0}


def test_style_tree_sites_and_edges(spark):
    rows = [(f"{s}{i}", f"Guidance {chr(97 + i) * 4} about {s} matters, see below.\nFollowing is said on {s} only by the mission\nAll originals are returned.\nFees {chr(97 + i) * 3} of {s} are due.", s) for s in ("aa", "bb", "cc", "dd") for i in range(12)]
    rows += rows[:5] + [("x", None, "aa"), (None, "Subscribe", "aa"), ("y", "Subscribe", None), ("z", "", "aa")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, site string, line_no int")
    got = {(r.id, r.line_no) for r in StyleTree(df).furniture.collect()}
    # the line of one site goes, the sentence that all sites repeat within their pages stays
    assert got == {(f"{s}{i}", 1) for s in ("aa", "bb", "cc", "dd") for i in range(12)} | {("y", 0)}
    main = {r.id: r.main_text for r in StyleTree(df).main_content(df).collect()}
    assert main["aa0"] == "Guidance aaaa about aa matters, see below.\nAll originals are returned.\nFees aaa of aa are due." and main["y"] == ""
    assert StyleTree(df.limit(0)).furniture.count() == 0


def test_style_tree_without_lists(spark):
    """Furniture in wordings that no list holds: frame, fixed block, box, menu cells, rare lines of a known opening; guidance stays."""
    random.seed(5)
    word = lambda: "".join(random.choices("bdfgklmnprstvz", k=1)[0] + random.choice("aeiou") for _ in range(3))
    cells = [word() for _ in range(12)]
    common = ["Zolu ravi is kept by the clerk.", "Mepa is shown to all at the desk."]
    rows, truth = [], set()
    for i in range(240):
        s = f"h{i % 4}"
        body = [" ".join(word() for _ in range(9)) + "." for _ in range(4)] + [random.choice(common)] + [f"{word()} {word()} {word()} {word()}."]
        box = ["Veda noma"] + [f"» {word().title()} {word()} {word()}" for _ in range(random.randint(2, 9))]
        page = [(" | ".join(random.sample(cells, 5)), 1), ("Dago peli", 1), *[(x, 0) for x in body[:3]], ("Bomi tesa", 1), ("Luka sami reno", 1), *[(x, 0) for x in body[3:]], *[(x, 1) for x in box], (f"{word()} {word()} {word()} it is.", 0), (f"Ridu kano {word()} Pages, sefu {i}.{i}", 1), ("Tola", 1)]
        rows.append((f"p{i}", "\n".join(x for x, _ in page), s))
        truth |= {(f"p{i}", n) for n, (_, y) in enumerate(page) if y}
    got = {(r.id, r.line_no) for r in StyleTree(spark.createDataFrame(rows, "id string, text string, site string"), prior=False).furniture.collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.01 * len(truth)


def test_rows_that_differ_under_one_id_are_read_and_cleaned_alike(spark):
    rows = [(f"d{i}", f"{'abcdefghijkl'[i] * 5} stands here alone today.\nSubscribe", "s") for i in range(12)]
    rows += [("two", "Subscribe\nThe body of one version is this.", "s"), ("two", "The body of the other version is that.\nSubscribe", "s")]
    df = spark.createDataFrame(rows, "id string, text string, site string")
    main = {r.id: r.main_text for r in StyleTree(df).main_content(df).collect()}
    assert main["two"] in ("The body of one version is this.", "The body of the other version is that.")


def test_cleaned_takes_the_row_that_was_read(spark):
    tail = ("https://s.x/a", "s", "l", 1)
    rows = [(f"d{i}", f"{'abcdefghijkl'[i] * 5} alone\nShare this page", *tail) for i in range(12)]
    rows += [("two", "Share this page\nBody of one version", *tail), ("two", "Body of the other version\nShare this page", *tail)]
    op, df = lines_of(spark, rows)
    clean = {r.id: r.clean_text for r in op.cleaned(df, "id", "t").collect()}
    assert clean["two"] in ("Body of one version", "Body of the other version")
