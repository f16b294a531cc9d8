"""A Merkle manifest of a dataset: digest-to-children records, and proofs read by descending from the root.

Each group of rows (a language, say) is a tree over its leaves in order; the groups' roots are the leaves of one tree
above. A tree is kept in pages of PAGE_LEVELS levels: a page's records lead from its top digest down to at most
FANOUT ** PAGE_LEVELS digests. A descent joins one page per PAGE_LEVELS levels, and all requests below a page share its row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import map_batches, stored

FANOUT, PAGE_LEVELS = 2, 6
PAGE = FANOUT**PAGE_LEVELS

#: The columns of documents that make a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The group of the tree over all groups' roots.
_TOP = "top"
_RECORDS = "array<struct<digest:string,children:array<string>>>"
_PATH = "array<struct<before:string,after:string>>"


def node(children: Sequence[str]) -> str:
    """The digest over its children's digests as hex text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """The digest of LEAF_COLUMNS; `changed` gives other values for some. Each is `-` if null, else its UTF-8 bytes'
    number, a colon, and it."""

    def written(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(written, LEAF_COLUMNS)), 256)


# --- ranks -----------------------------------------------------------------


def ranked(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`df`, written and read again, with `rank` (from 0) in its group by `order` (nulls first), and the group's `size`.

    A range sort places the rows, so a group may lie in many partitions; only the numbers of rows for each (partition,
    group) are added up, one row for each, so no group is ever in one task.
    """
    placed = F.col("_at").bitwiseAND((1 << 33) - 1)
    by = [F.col(name).asc_nulls_first() for name in (group, *order)]
    # The written rows carry their place: what is read again doesn't depend on how files are split.
    rows = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    )
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", placed)
    counts = rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    in_group = Window.partitionBy(group)
    before = F.sum("_n").over(in_group.orderBy("_part")) - F.col("_n")
    starts = counts.select(
        F.col("_part").alias("_p"),
        F.col(group).alias("_g"),
        (before - F.col("_first")).alias("_shift"),
        F.sum("_n").over(in_group).alias("size"),
    )
    joined = rows.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_p", "_g", "_at", "_shift")


# --- pages -----------------------------------------------------------------


def levels_of(size: int) -> int:
    """How many levels of runs a tree of `size` leaves has."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def page_records(digests: Sequence[str], levels: int) -> tuple[str, list[dict]]:
    """The top digest over `digests` after `levels` levels, and the records that lead down from it."""
    records = []
    for _ in range(levels):
        runs = [digests[i : i + FANOUT] for i in range(0, len(digests), FANOUT)]
        above = [node(run) for run in runs]
        records += [{"digest": digest, "children": run} for digest, run in zip(above, runs, strict=True)]
        digests = above
    return digests[0], records


def _pages(nodes: DataFrame, done: int) -> DataFrame:
    """One row for each page over `nodes` (group, rank, size, digest): group, page, size, top, records.

    `size` is the number of leaves of the whole tree, of which `done` levels lie below `nodes`.
    """
    page = F.floor(F.col("rank") / PAGE).cast("long")
    grouped = nodes.groupBy("group", page.alias("page")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run")
    )

    def start():
        def work(sizes, runs):
            made = [
                page_records([one["digest"] for one in run], min(PAGE_LEVELS, levels_of(size) - done))
                for size, run in zip(sizes, runs, strict=True)
            ]
            return [[top for top, _ in made], [records for _, records in made]]

        return work

    return map_batches(grouped, ["group", "page", "size"], ["size", "run"], f"top string, records {_RECORDS}", start)


class Forest(NamedTuple):
    """`pages`: for each level of pages, from the leaves up, (group, page, size, top, records); `tops`: (group, size, digest)."""

    pages: list[DataFrame]
    tops: DataFrame


def forest(nodes: DataFrame, name: str) -> Forest:
    """The trees over `nodes` (group, rank, size, digest); a group's only leaf is its own root."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    pages, tops = [], None
    for done in range(0, max(levels_of(largest), 1), PAGE_LEVELS):
        made = stored(_pages(nodes, done), f"{name}_pages")
        pages.append(made)
        last = F.col("size") <= FANOUT ** (done + PAGE_LEVELS)
        ready = made.filter(last).select("group", "size", F.col("top").alias("digest"))
        tops = ready if tops is None else tops.unionByName(ready)
        nodes = made.filter(~last).select("group", F.col("page").alias("rank"), "size", F.col("top").alias("digest"))
    return Forest(pages, tops)


# --- descent ---------------------------------------------------------------


def steps_down(top: str, children: dict[str, Sequence[str]], low: int, levels: int) -> tuple[str, list[dict]]:
    """Follow `low`'s `levels` digits from `top`; the digest reached, and what lay before and after each choice."""
    path, digest = [], top
    for level in range(levels - 1, -1, -1):
        digit, run = low // FANOUT**level % FANOUT, children[digest]
        path.append({"before": "".join(run[:digit]), "after": "".join(run[digit + 1 :])})
        digest = run[digit]
    return digest, path


def descend(grown: Forest, roots: DataFrame, asked: DataFrame, carry: str | None = None) -> DataFrame:
    """(group, rank, digest, path, origin) for every row of `asked`, each found from the root down.

    `asked` holds each (group, rank) once, so a page has at most PAGE requests; its column `carry` (strings) is put out as `carried`.
    `roots` is (group, size, digest, path): where each tree's descent starts and what was collected above; its digest
    comes out as `origin`. `path` runs from the root down. Of all requests below a page one row goes on, so the root's
    page is read once, not once for each leaf.
    """
    asked = asked.select("group", "rank", (F.col(carry) if carry else F.lit(None).cast("string")).alias("carried"))
    at, reached = len(grown.pages) - 1, None
    for k in range(at, -1, -1):
        unit = FANOUT ** (PAGE_LEVELS * k)
        starting = F.col("size") > unit if k else F.lit(True)
        if k < at:
            starting &= F.col("size") <= unit * PAGE
        page = F.lit(0).cast("long").alias("page")
        frontier = roots.filter(starting).select("group", page, "size", "digest", "path", F.col("digest").alias("origin"))
        if reached is not None:
            frontier = frontier.unionByName(reached)
        prefix = F.floor(F.col("rank") / unit).cast("long")
        wanted = (
            asked.select("group", prefix.alias("rank"), F.lit(None).cast("string").alias("carried") if k else "carried")
            .groupBy("group", F.floor(F.col("rank") / PAGE).cast("long").alias("page"))
            .agg(F.collect_set(F.struct("rank", "carried")).alias("wanted"))
        )
        # Equal digests have equal children: a record is kept once.
        held = grown.pages[k].select(F.col("top").alias("digest"), "records").dropDuplicates(["digest"])
        joined = frontier.join(wanted, ["group", "page"]).join(held, "digest")
        found = f"array<struct<rank:long,carried:string,digest:string,path:{_PATH}>>"

        def start(k=k):
            def work(sizes, tops, above, records, wanted):
                out = []
                for size, top, path, rows, asks in zip(sizes, tops, above, records, wanted, strict=True):
                    children = {row["digest"]: row["children"] for row in rows}
                    levels = min(PAGE_LEVELS, levels_of(size) - PAGE_LEVELS * k)
                    one = []
                    for ask in asks:
                        digest, more = steps_down(top, children, ask["rank"] % PAGE, levels)
                        one.append({**ask, "digest": digest, "path": [*path, *more]})
                    out.append(one)
                return [out]

            return work

        needs = ["size", "digest", "path", "records", "wanted"]
        down = map_batches(joined, ["group", "size", "origin"], needs, f"found {found}", start)
        down = down.select("group", "size", "origin", F.inline("found"))
        reached = down.select("group", F.col("rank").alias("page"), "size", "digest", "path", "origin")
    return down.select("group", "rank", "carried", "digest", "path", "origin")


# --- manifest --------------------------------------------------------------


class Manifest(NamedTuple):
    """`leaves`: the rows given, with group, rank, size; `lower` and `upper`: the trees of the groups and the one over them;
    `subroots`: (of, digest, rank); `root`: the digest over all, None for no rows."""

    leaves: DataFrame
    lower: Forest
    upper: Forest
    subroots: DataFrame
    root: str | None


def build(leaves: DataFrame, group: str, order: Sequence[str]) -> Manifest:
    """The manifest of `leaves`: one tree for each value of `group` over the column `leaf` by `order`, nulls first.

    Groups go by null first, then UTF-8 bytes. Rows that tie in `order` go by `leaf`, so rows that repeat have neighbouring
    places and any order of them gives the same digests.
    """
    leaves = stored(leaves, "leaves")  # so that the range sort's sample doesn't hash all rows once more
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    ordered = ranked(leaves.withColumn("group", key), "group", [*order, "leaf"])
    lower = forest(ordered.select("group", "rank", "size", F.col("leaf").alias("digest")), "lower")
    tops = lower.tops.select(F.lit(_TOP).alias("group"), F.col("group").alias("of"), "digest")
    subroots = ranked(tops, "group", ["of"])
    upper = forest(subroots.select("group", "rank", "size", "digest"), "upper")
    root = upper.tops.select("digest").first()
    return Manifest(ordered, lower, upper, subroots, root and root[0])


def proofs(manifest: Manifest, asked: DataFrame, carry: str | None = None) -> DataFrame:
    """For every row of `asked`, each (group, rank) once: group, rank, carried, digest (the leaf's), subroot, and path.

    `path` (array of before, after) goes from the leaf to the root: what precedes and follows the node in its run, as
    concatenated digests. It is collected from the root down, through the records alone, then reversed.
    """
    sizes = manifest.lower.tops.select(F.col("group").alias("of"), F.col("size").alias("_size"))
    wanted = asked.select(F.col("group").alias("of")).distinct().join(sizes, "of").join(
        manifest.subroots.select("of", "rank"), "of"
    )
    above = manifest.upper.tops.select("group", "size", "digest", F.expr(f"cast(array() as {_PATH})").alias("path"))
    # Written: it enters each level of the descent below.
    tops = descend(manifest.upper, above, wanted.select(F.lit(_TOP).alias("group"), "rank")).select("rank", "digest", "path")
    roots = tops.join(wanted, "rank").select(F.col("of").alias("group"), F.col("_size").alias("size"), "digest", "path")
    found = descend(manifest.lower, stored(roots, "subroots"), asked, carry)
    path = F.reverse("path").alias("path")
    return found.select("group", "rank", "carried", "digest", F.col("origin").alias("subroot"), path)


def fold(df: DataFrame, start: str, path: str, keep: Sequence[str]) -> DataFrame:
    """The columns `keep`, folded_root (from the digest `start` and the `path`) and proof_sha256 (of the siblings in order)."""

    def begin():
        def work(starts, paths):
            roots, written = [], []
            for digest, path in zip(starts, paths, strict=True):
                for step in path:
                    digest = node((step["before"], digest, step["after"]))
                roots.append(digest)
                written.append(node([part for step in path for part in (step["before"], step["after"])]))
            return [roots, written]

        return work

    return map_batches(df, keep, [start, path], "folded_root string, proof_sha256 string", begin)


def audit(docs: DataFrame, changed: Column) -> DataFrame:
    """Every row's leaf proven against the manifest of `docs`: the columns of op12, for all rows.

    `changed` says of which rows a copy with n_chars one higher is held against the proof of the row as it was
    (null: the row itself; a null n_chars stays). Only rows whose presented leaf is the manifest's come out verified.

    Trees are by lang, leaves by doc_id (nulls first, then leaf digest); null fields are `-`, empty texts `0:`. Repeated rows are
    leaves of their own. Other columns do not enter. An empty table gives an empty result.
    """
    other = F.when(changed & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars").cast("long") + 1))
    manifest = build(docs.select("doc_id", "lang", leaf().alias("leaf"), other.alias("other")), "lang", ["doc_id"])
    # What is shown with a leaf's request: its id, and the other digest where there is one.
    shown = F.to_json(F.struct("doc_id", "other"))
    proven = proofs(manifest, manifest.leaves.select("group", "rank", shown.alias("shown")), "shown")
    proven = proven.withColumn("shown", F.from_json("carried", "doc_id long, other string"))
    proven = proven.select(F.col("shown.doc_id").alias("doc_id"), F.col("shown.other").alias("other"), "digest", "subroot", "path")
    folded = fold(proven.withColumn("_start", F.coalesce("other", "digest")), "_start", "path", ["doc_id", "digest", "subroot"])
    root = F.lit(manifest.root).cast("string")
    return folded.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
