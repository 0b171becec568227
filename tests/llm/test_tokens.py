from __future__ import annotations

import random
from collections import defaultdict

import pytest

from docketry.llm.bpe import TOKENIZERS, Encoder, encode_table
from docketry.llm.packing import BestFit, pack

TEXTS = ["Hello world", "", " \n\n x", "<|endoftext|> hi", "é̃ᾳ 😀😀 नमस्ते", "a" * 20_000, "it's 12,345.67 — ok", "\x00\t" * 5, "abc" * 999, "don't  won't"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(99, None, 0), (99, None, 0), (None, "x", 0)], "doc_id long, text string, ids int")
    got = encode_table(df, "doc_id", "text").collect()
    want = {i: x.ids for i, x in enumerate(reference().encode_batch(TEXTS, add_special_tokens=False))}
    assert {r.doc_id: r.ids for r in got if r.doc_id not in (99, None)} == want
    assert [r.ids for r in got if r.doc_id == 99] == [[], []] and len([r for r in got if r.doc_id is None]) == 1
    assert encode_table(df.limit(0), "doc_id", "text").count() == 0


def test_random_texts_equal_the_library():
    random.seed(4)
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        own = Encoder(f.read())
    texts = ["".join(random.choice("abé ्न\n'st1 .—x漢😀") for _ in range(random.randrange(60))) for _ in range(800)]
    assert [list(own.encode(t)) for t in texts] == [x.ids for x in reference().encode_batch(texts, add_special_tokens=False)]


def test_best_fit_takes_the_tightest_compatible_bin():
    b = BestFit(10)
    assert [b.put(6, 1, 1), b.put(7, 2, 2), b.put(3, 4, 4), b.put(4, 8, 1), b.put(4, 1, 8)] == [0, 1, 1, 2, 2]


@pytest.mark.parametrize("per_task", [40, 10_000])
def test_containers(spark, per_task):
    random.seed(5)
    rows = [(i, " ".join(["word"] * random.choice([3, 20, 90, 400, 5000])) + f" {i % 50}", random.choice(["a", "b", "c", None]), "x") for i in range(300)]
    rows += [(1000, None, "a", "x"), (1001, "", "a", "x"), (None, "two words", None, "x")] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, container string")
    got = pack(df, "doc_id", "text", "source", capacity=512, task_pieces=per_task).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        pieces[r.id].append(r)
        if r.container is not None:
            fill[r.container] += r.tokens
    assert max(fill.values()) <= 512
    assert {r.id for r in got} == {r[0] for r in rows}
    for i, own in pieces.items():
        if len({(r.piece) for r in own}) > 1:
            assert sum(r.tokens for r in own) > 512  # only what does not fit is cut
    assert [r.container for r in got if r.id in (1000, 1001)] == [None, None]
    assert sum(fill.values()) / (512 * len(fill)) > 0.9
    assert pack(df.limit(0), "doc_id", "text", "source").count() == 0


def test_copies_are_kept_apart_unless_too_many(spark):
    few = [(i, f"text number {i} " * 20, "s") for i in range(60)] + [(100 + i, "the same text " * 20, "s") for i in range(5)]
    got = {r.id: r.container for r in pack(spark.createDataFrame(few, "doc_id long, text string, source string"), "doc_id", "text", "source", capacity=128).collect()}
    assert len({got[100 + i] for i in range(5)}) == 5
    many = [(i, "the same text", "s") for i in range(500)]
    got = pack(spark.createDataFrame(many, "doc_id long, text string, source string"), "doc_id", "text", "source", capacity=128).select("container").distinct().count()
    assert got <= 20


def test_only_the_excess_of_too_many_copies_shares_containers(spark):
    rows = [(i, f"text number {i} " * 14, None) for i in range(200)] + [(1000 + i, "the same text " * 20, None) for i in range(150)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", capacity=128).collect()
    held = defaultdict(int)
    for r in got:
        held[r.container] += r.id >= 1000
    needed = sum(r.tokens for r in got) / 128
    # half the containers' worth of copies stand alone among copies, at least
    assert sum(n > 0 for n in held.values()) >= 0.8 * needed * 0.5 and sum(held.values()) == 150 and len(held) <= 1.3 * needed
