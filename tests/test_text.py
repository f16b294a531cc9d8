"""Text expressions against plain loops, on edge cases and random conversations."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from memlake.functions import (
    context_query_text,
    fallback_query_text,
    last_user_content,
    normalise_fact,
    sentences,
    transcript_text,
    trim_space,
    trim_user_key,
)
from memlake.operators import encode

SCHEMA = "id int, messages array<struct<role:string,content:string>>"
WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0        "
    "        　"
)


def run(spark, talks, *columns):
    rows = [(i, t) for i, t in enumerate(talks)]
    out = spark.createDataFrame(rows, SCHEMA).select("id", *columns).collect()
    return [tuple(r)[1:] for r in sorted(out)]


def said(*texts):
    return [("user", t) for t in texts]


def split(text):
    return [m.group(0) for m in re.finditer(r"[^.!?]+[.!?]+(?:[\t\n\f\r ]|\Z)", text)]


def context_loop(talk, limit):
    blocks, total = [], 0
    for _, content in reversed(talk):
        body = content.strip(WHITE)
        if not body:
            continue
        block = []
        for unit in reversed(split(body) or [body]):
            block.append(unit.strip(WHITE))
            total += len(block[-1].encode())
            if total >= limit:
                break
        blocks.append(" ".join(reversed(block)))
        if total >= limit:
            break
    return "\n".join(reversed(blocks))


def fallback_loop(talk, limit):
    out = b""
    for _, content in reversed(talk):
        out += content.encode() + b"\n"
        if len(out) + len(content.encode()) > limit:
            break
    return out.decode()


@pytest.mark.parametrize(
    "texts, limit, want",
    [
        ([], 500, ""),
        (["One. Two. Three."], 1, "Three."),
        (["One. Two. Three."], 0, "Three."),
        (["One. Two. Three."], 7, "Two. Three."),
        (["One. Two.", "  ", "no end"], 500, "One. Two.\nno end"),
        (["a b. v1.2 is out. tail"], 500, "a b. 2 is out."),
        (["Été.", "Là."], 4, "Là."),
        (["...", "?!"], 500, "...\n?!"),
        (["  　Hi there. "], 500, "Hi there."),
    ],
)
def test_context_query(spark, texts, limit, want):
    assert run(spark, [said(*texts)], context_query_text("messages", limit)) == [(want,)]


def _random_talks(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "bb", "é", "漢字", " ", "  ", "\n", "\t", ".", "!", "?", "...", " ", "v1.2", "\x0b"]
    return [
        [
            (rng.choice(["user", "assistant", "system", "tool"]),
             "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))))
            for _ in range(rng.randint(0, 8))
        ]
        for _ in range(n)
    ]


@pytest.mark.parametrize("limit", [0, 1, 9, 60, 5000])
def test_budgets_equal_loops(spark, limit):
    talks = _random_talks(limit, 150)
    got = run(
        spark, talks, context_query_text("messages", limit), fallback_query_text("messages", limit)
    )
    assert got == [(context_loop(t, limit), fallback_loop(t, limit)) for t in talks]


def test_fallback_goldens(spark):
    a, b, c = "a" * 10, "b" * 900, "c" * 20
    long, longer = "d" * 990, "e" * 1990
    talks = [said(a, b, c), said(a, long, c), said(a, longer, c)]
    want = [f"{c}\n{b}\n{a}\n", f"{c}\n{long}\n", f"{c}\n{longer}\n"]
    assert run(spark, talks, fallback_query_text("messages")) == [(w,) for w in want]


def test_sentences_stay_linear_without_terminators(spark):
    text = "word " * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(sentences("t"))).first()[0] == 1


def test_transcript_roles(spark):
    talk = [("user", "hi"), ("model", "yo"), ("assistant", "x"), ("tool", "y"), ("system", "z"), (None, "n")]
    loose, strict = transcript_text("messages"), transcript_text("messages", {})
    assert run(spark, [talk], loose, strict) == [
        ("User: hi\nAssistant: yo\nAssistant: x\nSystem: z\n", "User: hi\nAssistant: yo\nSystem: z\n")
    ]


def test_last_user_turn(spark):
    talks = [said("a", "b") + [("model", "c")], [("model", "c")], []]
    assert run(spark, talks, last_user_content("messages")) == [("b",), (None,), (None,)]


def test_trims(spark):
    rows = [(WHITE + "a b" + WHITE, "\"u1' "), ("\n", "\"' "), ("x", "u'2")]
    df = spark.createDataFrame(rows, "t string, k string")
    got = df.select(trim_space("t"), trim_user_key("k")).collect()
    assert [tuple(r) for r in got] == [("a b", "u1"), ("", ""), ("x", "u'2")]


def test_normalised_facts(spark):
    df = spark.createDataFrame([("  Likes  TEA!. ",), ("likes tea",)], "t string")
    assert {r[0] for r in df.select(normalise_fact("t")).collect()} == {"likes tea"}


def test_terms_weighed_by_broadcast_and_by_shuffle_make_the_same_vectors(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    # Some words are in most texts, most in few; ids repeat, texts can be empty or null.
    said = [(i % 180, " ".join(w for n, w in enumerate(words) if draw.random() < 3 / (n + 3))) for i in range(200)]
    texts = spark.createDataFrame([*said, (900, ""), (901, None)], "doc_id long, text string")
    postings = encode.sparse_postings(texts, "doc_id", "text")
    idf = encode.inverse_document_frequency(postings, texts.agg(F.count(F.lit(1))))

    def rows(vectors):
        return {r.id: (list(r.sparse.indices), [round(x, 5) for x in r.sparse.values]) for r in vectors.collect()}

    for normalise in (False, True):
        want = rows(encode.gather_vectors(postings, idf, normalise))
        for frequent in (1, 20, 1 << 18):
            assert rows(encode.weighted_vectors(texts, "doc_id", "text", normalise, frequent)) == want
    nothing = encode.weighted_vectors(texts.where("false"), "doc_id", "text")
    assert nothing.count() == 0
