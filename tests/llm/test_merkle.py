"""The Merkle manifest: against whole trees built by hand, and against proofs that were tampered with."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from memlake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, rank int, Size double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0):
    chars = None if row["n_chars"] is None else row["n_chars"] + more
    out = ""
    for value in (row["doc_id"], row["source"], row["lang"], chars, row["text"]):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def plain_tree(leaves):
    """The root, and for each leaf its siblings as (before, after) from the leaf up."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, place in enumerate(at):
            first = place - place % 2
            paths[i].append(("".join(leaves[first:place]), "".join(leaves[place + 1 : first + 2])))
            at[i] = place // 2
        leaves = [sha("".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0], paths


def plain_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row)))
        trees[lang] = plain_tree([plain_leaf(row) for row in groups[lang]])
    root, above = plain_tree([trees[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        subroot, paths = trees[lang]
        for row, path in zip(groups[lang], paths, strict=True):
            changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            digest = plain_leaf(row, int(changed))
            for before, after in path + upper:
                digest = sha(before + digest + after)
            proof = sha("".join(before + after for before, after in path + upper))
            out.append((row["doc_id"], plain_leaf(row), subroot, root, proof, digest, digest == root))
    return out


def audited(df):
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.audit(df, seventh)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(row) for row in got.collect()]


def ordered(rows):
    return sorted(rows, key=lambda row: tuple(map(str, row)))


def made(seed, sizes):
    draw, rows = random.Random(seed), []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append(
                {
                    "doc_id": draw.choice([None, *range(-5, 400)]),
                    "text": draw.choice([None, "", "é日\U0001f600", "some text", "x" * draw.randrange(3000)]),
                    "lang": lang,
                    "source": draw.choice([None, "web", "ü"]),
                    "n_chars": draw.choice([None, 0, 12, -3]),
                    "root": "clash",
                    "rank": 1,
                    "Size": 0.5,
                }
            )
        rows += [dict(rows[-1]) for _ in range(n // 3)]  # repeated rows
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {None: 1, "de": 2},
        {"": 3, None: 1, "en": 64, "￿": 1, "\U0001f600": 5, "=": 2},
        {"en": 150, "de": 49, None: 4},
    ],
)
def test_audit_equals_whole_trees(spark, sizes):
    rows = made(len(sizes), sizes)
    df = spark.createDataFrame([tuple(row.values()) for row in rows], SCHEMA).repartition(3)
    assert ordered(audited(df)) == ordered(plain_audit(rows))


def test_many_groups_make_pages_above(spark):
    rows = made(5, {f"l{i}": 1 for i in range(70)})
    df = spark.createDataFrame([tuple(row.values()) for row in rows], SCHEMA)
    assert ordered(audited(df)) == ordered(plain_audit(rows))


def test_tables_without_rows(spark):
    assert audited(spark.createDataFrame([], SCHEMA)) == []


def test_page_records_lead_to_every_leaf():
    for n in range(1, merkle.PAGE + 1):
        digests = [sha(str(i)) for i in range(n)]
        levels = merkle.levels_of(n)
        top, records = merkle.page_records(digests, levels)
        assert top == plain_tree(digests)[0]
        children = {record["digest"]: record["children"] for record in records}
        for i in range(n):
            reached, path = merkle.steps_down(top, children, i, levels)
            assert reached == digests[i]
            assert [(p["before"], p["after"]) for p in reversed(path)] == plain_tree(digests)[1][i]


def test_proofs_of_some_leaves(spark):
    rows = made(9, {"en": 100, "de": 30})
    df = spark.createDataFrame([tuple(row.values()) for row in rows], SCHEMA)
    leaves = df.select("doc_id", "lang", merkle.leaf().alias("leaf"))
    manifest = merkle.build(leaves, "lang", ["doc_id"])
    asked = manifest.leaves.filter("rank % 13 = 5").select("group", "rank", "leaf")
    out = merkle.proofs(manifest, asked, "leaf").collect()
    assert len(out) == asked.count()
    for row in out:
        assert row.carried == row.digest
        digest = row.digest
        for step in row.path:
            digest = sha(step["before"] + digest + step["after"])
        assert digest == manifest.root
