"""Row-local operators: against plain versions, on random and on awkward texts."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from memlake.llm import bpe, chunks, html, linear, pii, quality, stages, token_counts, toxicity
from memlake.llm.queries import PIECES, RANKS

RANK_PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN

AWKWARD = [
    None,
    "",
    " ",
    "\n\n\t",
    "one",
    "one",
    "a\x1cb\u00a0c\u3000d",
    "é" * 3000,
    "word " * 40_000,
    "x" * 150_000,
    "日本語 \U0001f600 text",
    "'s 's  \n 've\r\n  end  ",
    "mail a@b.co, ip 10.0.0.1",
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, text, "x", 1.5, [1], "y") for i, text in enumerate(AWKWARD)] + [(None, "null id", "x", 1.5, [1], "y")]
    schema = "doc_id long, text string, score string, N_TOKENS double, ids array<int>, kept string"
    return spark.createDataFrame(rows, schema)


# --- op1


def test_bpe_equals_the_library(spark, awkward):
    encoding = bpe.load(RANK_PATH, PATTERN)
    rows = bpe.digests(bpe.encode(awkward, RANK_PATH, PATTERN, decoded=True)).collect()
    assert len(rows) == len(AWKWARD) + 1
    for row in rows:
        want = encoding.encode_ordinary(row.text or "")
        assert list(row.ids) == want and row.n_tokens == len(want)
        assert bytes(row.decoded).decode() == (row.text or "")
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_bpe_long_white_space_is_one_match():
    encoding = bpe.load(RANK_PATH, PATTERN)
    draw = random.Random(13)
    alphabet = [" ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u3000", "\xa0", "a", "é1", "!", "'s", "\u200b"]
    for _ in range(5000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(30)))
        parts = list(bpe.long_blanks(text, 3))
        assert "".join(part for part, _ in parts) == text
        ids = []
        for part, single in parts:
            ids += encoding._encode_single_piece(part) if single else encoding.encode_ordinary(part)
        assert ids == encoding.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t \n", "\u3000\r\n"])
def test_bpe_encodes_millions_of_blanks(run):
    encoding = bpe.load(RANK_PATH, PATTERN)
    for before, after in (("", ""), ("word", "word"), ("word ", "!")):
        text = before + run * (3_000_000 // len(run)) + after
        ids = bpe.encode_text(encoding, text)
        assert encoding.decode_bytes(ids.tolist()).decode() == text


def test_bpe_parts_are_safe():
    encoding = bpe.load(RANK_PATH, PATTERN)
    draw = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", "a", "é", "1", "!", "'s", "\x1c", "\u3000", "word", "\x85", "’"]
    for _ in range(500):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 40)))
        parts = list(bpe.safe_parts(text, draw.randint(1, 8)))
        assert "".join(parts) == text
        assert [i for part in parts for i in encoding.encode_ordinary(part)] == encoding.encode_ordinary(text)


def test_bpe_decodes_tokens_within_characters(spark):
    df = spark.createDataFrame([([220, 1],), ([],), (None,)], "ids array<int>")
    encoding = bpe.load(RANK_PATH, PATTERN)
    got = [bytes(row.decoded) for row in bpe.decode(df, RANK_PATH, PATTERN).collect()]
    assert got == [encoding.decode_bytes([220, 1]), b"", b""]


# --- op2

_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, found):
        only = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(only))]
            return 14 <= len(only) <= 19 and sum(doubled) % 10 == 0
        return kind != "phone" or 10 <= len(only) <= 15

    spans = [(*m.span(), kind) for kind, p in _BASE.items() for m in p.finditer(text) if good(kind, m[0])]
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_equals_the_patterns():
    draw = random.Random(5)
    alphabet = ["a", "@", ".", "-", " ", "+", "1", "4111 1111 1111 1111", "12", "255", "b.c", "(", "%", "9", "\n", "é", "1.2.3.4"]
    for _ in range(3000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "found", "kind"),
    [
        ("write to bob [at] example [dot] com now", "bob [at] example [dot] com", "email"),
        ("or bob at example dot com.", "bob at example dot com", "email"),
        ("jоhn＠exаmple.com", "jоhn＠exаmple.com", "email"),
        ("jo\u200bhn@example.com.", None, None),
        ("call plus one five five five two three four five six seven eight", "plus one five five five two three four five six seven eight", "phone"),
        ("pay " + "four two " * 8, ("four two " * 8).strip(), "card"),
        ("one nine two dot one six eight dot one dot one", "one nine two dot one six eight dot one dot one", "ip"),
        ("ip １９２.168.1.1", "１９２.168.1.1", "ip"),
        ("meet at noon, dot the i", None, None),
        ("one two three four", None, None),
    ],
)
def test_pii_reads_disguises(text, found, kind):
    base, added = pii.spans_of(text)
    if found is None:
        assert not added
    else:
        assert [(text[s:e], k) for s, e, k in added] == [(found, kind)]


@pytest.mark.parametrize(
    ("text", "found", "kind"),
    [
        ("call +1 415 555 two six 71 today", "+1 415 555 two six 71", "phone"),
        ("call +1 (415) 555 two 671", "+1 (415) 555 two 671", "phone"),
        ("call plus one 415 555 2671.", "plus one 415 555 2671", "phone"),
        ("pay 4111 1111 1111 11 one one", "4111 1111 1111 11 one one", "card"),
        ("pay four 111 1111 1111 1111", "four 111 1111 1111 1111", "card"),
        ("pay 4111 1111 1111, one  111", "4111 1111 1111, one  111", "card"),
        ("ip 192.168.one.1 is up", "192.168.one.1", "ip"),
        ("ip 192 dot 168 dot 1 dot one", "192 dot 168 dot 1 dot one", "ip"),
        ("mail jane at example.com.", "jane at example.com", "email"),
        ("mail jane.doe at mail.example.org now", "jane.doe at mail.example.org", "email"),
        ("I have one 2 and 3 more", None, None),
        ("pay 4111 1111 1111 11 one two", None, None),
        ("ip 192.168.one.999", None, None),
        ("look at example.com", None, None),
        ("we left at noon.Then it rained", None, None),
        ("one", None, None),
    ],
)
def test_pii_reads_single_spelled_digits_and_bare_at(text, found, kind):
    base, added = pii.spans_of(text)
    assert [(text[s:e], k) for s, e, k in added] == ([(found, kind)] if found else [])
    assert found is None or pii.masked(text, [*base, *added]) == text.replace(found, f"<{kind.upper()}>")


def test_pii_look_alikes_are_single_characters():
    assert all(len(char) == 1 and len(plain) == 1 for char, plain in pii._PLAIN.items())
    assert pii._PLAIN["а"] == "a" and pii._PLAIN["＠"] == "@" and pii._PLAIN["４"] == "4"


def test_pii_on_awkward_rows(awkward):
    rows = {row.doc_id: row for row in pii.find(awkward).collect() if row.doc_id is not None}
    assert len(rows) == len(AWKWARD)
    assert rows[0].masked is None and rows[0].n_email == 0 and rows[1].masked == ""
    last = rows[len(AWKWARD) - 1]
    assert (last.n_email, last.n_ip) == (1, 1) and last.masked == "mail <EMAIL>, ip <IP>"


# --- op3


def test_chunks_cover_texts_and_resist_insertions(awkward):
    for row in chunks.chunks(awkward, keep=["text"]).collect():
        data = (row.text or "").encode()
        assert [c.start for c in row.chunks] == [0, *(c.end for c in row.chunks)][: len(row.chunks)]
        assert (row.chunks[-1].end if row.chunks else 0) == len(data)
        assert all(c.end - c.start <= chunks.MAX for c in row.chunks)
        assert sum(c.words for c in row.chunks) == len(data.split())
    draw = random.Random(2)
    text = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(400)).encode()
    (plain,), (shifted,) = (list(chunks.cut([t])) for t in (text, b"some words before " + text))
    moved = {end - 18 for end in shifted}
    assert len(set(plain) - moved) <= 2


def test_passages_are_found_and_others_left_alone(spark):
    draw = random.Random(11)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghijklm", k=draw.randint(2, 9))) for _ in range(n))
    passage, line = prose(60), prose(8)
    texts = [f"{prose(draw.randint(0, 90))} {line} {passage} {prose(draw.randint(0, 90))}" for _ in range(20)]
    texts += [f"{line} {prose(120)}" for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = chunks.passages(df).collect()
    assert {row.doc_id for row in found} == set(range(20))
    assert {row.doc_id for row in found if not row.duplicate} == {0}


def test_passages_of_51_words_are_all_found(spark):
    draw = random.Random(51)
    prose = lambda n: ["".join(draw.choices("abcdefghijklm", k=draw.choice((1, 2, 2, 3, 4, 9)))) for _ in range(n)]
    texts = []
    for _ in range(3000):
        passage = prose(51)
        texts += [" ".join(prose(draw.randint(0, 60)) + passage + prose(draw.randint(0, 60))) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row for row in chunks.passages(df).collect()}
    assert set(found) == set(range(6000))
    for i in range(0, 6000, 2):
        first, second = found[i], found[i + 1]
        one, two = (texts[row.doc_id].encode()[row.start_byte : row.end_byte] for row in (first, second))
        assert one == two and 27 <= first.n_words == len(one.split()) <= 51
        assert not first.duplicate and second.duplicate and second.first_doc_id == i


def test_kept_runs_meet_every_window():
    import numpy as np

    draw = np.random.default_rng(9)
    for values in (1, 2, 3, 50, 1 << 40):
        for n in (1, 5, 13, 14, 40, 300):
            hashes = draw.integers(0, values, n).astype(np.uint64)
            kept = chunks.kept_runs(hashes)
            for a in range(max(1, n - chunks.NEIGHBOURS + 1)):
                window = hashes[a : a + chunks.NEIGHBOURS]
                here = kept[(kept >= a) & (kept < a + chunks.NEIGHBOURS)]
                assert window.min() in hashes[here]
    assert len(chunks.kept_runs(np.zeros(13_000, np.uint64))) < 1100


# --- op4


def test_token_counts_equal_a_plain_search(spark, awkward):
    pieces = token_counts.load(public_tokenizers.path(PIECES))
    longest = max(map(len, pieces))

    def plain(word):
        token = "▁" + word
        best = [(0.0, 0)] + [None] * len(token)
        for end in range(1, len(token) + 1):
            size = len(token[end - 1].encode())
            best[end] = (best[end - 1][0] + token_counts.BYTE_SCORE * size, best[end - 1][1] + size)
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                if token[start:end] in pieces:
                    score = best[start][0] + pieces[token[start:end]]
                    if score > best[end][0]:
                        best[end] = (score, best[start][1] + 1)
        return best[-1][1]

    for row in token_counts.count(awkward, public_tokenizers.path(PIECES)).collect():
        words = [w.decode() for w in (row.text or "").encode().split()]
        assert row.n_words == len(words)
        if len(row.text or "") < 5000:
            assert row.n_tokens == sum(map(plain, words))


def test_trie_shares_prefixes_and_keeps_terminal_counts():
    trie = token_counts.Trie({"a": -1.0, "ab": -1.5, "b": -1.0})
    assert [trie.insert(w) for w in ("ab", "abb", "ab", "é")] == [1, 2, 1, 2]
    assert len(trie.scores) == 1 + 3 + 1 and sorted(trie.terminal) == [0, 0, 1, 1, 2]


def test_trie_looks_up_no_substring_that_ends_no_piece():
    class Watched(dict):
        looked_up = 0

        def get(self, *key):
            Watched.looked_up += 1
            return super().get(*key)

    trie = token_counts.Trie(Watched({"a": -1.0, "b" * 16: -1.0}))
    assert trie.insert("acac" * 8) == 32 and Watched.looked_up <= 32


def test_words_in_bulk_equal_words_alone():
    draw = random.Random(4)
    letters = ["a", "b", "é", "日", "🙂", "\x00", "▁"]
    text = lambda most: "".join(draw.choices(letters, k=draw.randint(1, most)))
    # Few different scores, so that many segmentations are equally good.
    pieces = {text(5): -draw.randint(1, 3) * 1.0 for _ in range(60)}
    matches = token_counts.Matches(pieces)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            now = (best[-1][0] + token_counts.BYTE_SCORE * size, best[-1][1] + size)
            for start in range(end - 1, -1, -1):
                score = best[start][0] + pieces.get(word[start:end], -1e9)
                if score > now[0]:
                    now = (score, best[start][1] + 1)
            best.append(now)
        return best[-1][1]

    trie = token_counts.Trie(pieces)
    for _ in range(20):
        words = sorted({text(12) for _ in range(50)})
        want = [plain(word) for word in words]
        assert trie.insert_all(words, [1] * len(words)) == want
        assert [token_counts.count_alone(word, matches) for word in words] == want


# --- op5


def test_quality_facts_equal_a_plain_count():
    draw = random.Random(9)
    for _ in range(400):
        text = "".join(draw.choices(["a", "b", "a b a b a", " ", "\n", "\t", "#", "é", "\x0b", "\u2003", "line one\n"], k=draw.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        repeated = sum(line in lines[:i] for i, line in enumerate(lines))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
        assert quality.facts(text) == want


def test_quality_keeps_clean_and_rejects_poor_rows(spark):
    draw = random.Random(1)
    prose = lambda: " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 8))) for _ in range(draw.randint(30, 90)))
    rows = [(i, prose() if i % 5 else prose().upper().replace(" ", "!! "), int(i % 5 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:400]] + [(None, 1), (3, None)], "doc_id long, quality int")
    judged = {row.doc_id: row for row in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert all(judged[i].kept == bool(q) for i, _, q in rows[400:])


def test_quality_without_labels_uses_base_limits_alone(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(awkward, none)
    rows = quality.judge(awkward, model).collect()
    assert all(row.kept == (not row.base_failed) for row in rows) and len(rows) == len(AWKWARD) + 1


# --- op6


def test_html_tree_fits_its_table():
    tree = html.grow(html.LABELLED)
    assert all(tree.ask(row[:-1]) == row[-1] for row in html.LABELLED)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<script>var a = '</p>'; if (a < b) {}", ""),
        ("<article><h1>T &amp; U</h1><p><b>One<br>two  three\n<p>f<i>o</i>ur &lt;x&gt; &copy</article>", "T & U One two three four <x> ©"),
        ("<nav><a href='/'>Home</a></nav><article><p>Text.</p><div class='share-bar'>Share</div><p>More.</p></article><footer>F</footer>", "Text. More."),
        ("<article><p>A</p><section id='comments'><article><p>first!</p></article></section></article><aside>x</aside>", "A"),
        ("<header><p>Site</p></header><main><header><h1>Title</h1></header><p>Body</p><form>q<input></form></main>", "Title Body"),
        ("<div class='cookie-notice'>We use cookies</div><p>" + "word " * 30 + "</p><ul><li><a href=x>a</a><li><a href=y>b</a></ul>", ("word " * 30).strip()),
        ("<article><p>open <a href='x>y'>link</a> end<!-- <p>no</p> --><style>p{}</style></article", "open link end"),
    ],
)
def test_html_main_text(page, text):
    assert html.main_text(page, html.grow(html.LABELLED)) == text


@pytest.mark.parametrize("n", [10, 3000, 5000, 300_000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_attributes_of_any_length(n, quote):
    page = f"<main><p data-x={quote}{'x' * n}> leaked <nav> words{quote}>main</p></main>"
    assert [(b.text, b.main, b.aside) for b in html.blocks_of(page)] == [("main", True, False)]
    # A quote that is never closed ends with the first `>`.
    assert [b.text for b in html.blocks_of(f"<p title={quote}{'x' * n}>main</p>")] == ["main"]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article>é", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html.extract(df).collect()] == [("é", 1), ("", 0)]


# --- op10


def test_clause_grammar():
    lexicon = toxicity.Lexicon({"fool": 4.0})
    weigh = lambda text: toxicity.weight_of(text, lexicon)[0]
    assert weigh("what a fool") == 4.0 and weigh("you fool") == 5.0
    assert 0 < weigh("he is not a fool") < weigh("he is a fool")
    assert weigh("she said he is a fool") < weigh("she is a fool")
    assert weigh("they will kill you") == toxicity.THREAT_WEIGHT and weigh("they kill time") == 0
    assert weigh("kill. time") == 0 and weigh(None) == weigh("") == 0
    assert weigh("fool " * 100_000) == toxicity.FULL


def test_toxicity_learns_what_explains_the_labels(spark):
    draw = random.Random(4)
    prose = lambda: " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 8))) for _ in range(40))
    rows = [(i, prose() + (f" grump{draw.choice('xyz')} and zorkle. " if i % 7 == 0 else " ") + prose(), int(i % 7 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert 150 < len(held) < 300
    assert all(got[i].predicted == y for i, _, y in rows)
    assert all(0 <= got[i].score <= 1 for i in (5000, 5001)) and got[5000].predicted == 0
    secret = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.judge(docs, toxicity.train(docs, secret)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.judge(awkward, toxicity.train(awkward, none)).collect()
    assert len(rows) == len(AWKWARD) + 1 and not any(row.predicted for row in rows)


def test_a_fit_takes_little_memory_besides_its_rows():
    draw = np.random.default_rng(1)
    rows = [(draw.integers(0, 1 << 16, 500).astype(np.int32), draw.random(500).astype(np.float32)) for _ in range(2000)]
    labels = draw.integers(0, 2, len(rows))
    tracemalloc.start()
    linear.fit(linear.Rows(rows, 1 << 16), labels, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Each of the million cells needs 12 bytes: row, column, value.
    assert peak < 22e6


# --- empty tables


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        bpe.digests(bpe.encode(docs, RANK_PATH, PATTERN, decoded=True)),
        pii.find(docs),
        chunks.passages(docs),
        token_counts.count(docs, public_tokenizers.path(PIECES)),
        quality.judge(docs, quality.train(docs, labels)),
        html.extract(docs, "text"),
        toxicity.judge(docs, toxicity.train(docs, labels)),
        stages.pii_masked(spark, docs, ""),
    ):
        assert result.count() == 0
