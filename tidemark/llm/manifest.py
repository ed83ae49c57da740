"""Merkle dataset manifest kept as a postorder append log, with proofs read from it by position.

Every row becomes a leaf; the leaves of a group, in key order, form a binary hash tree, and the roots of
the groups form another one.  Leaves are dealt to *aligned builders* of ``2 ** BITS`` consecutive leaves.  A
builder holds a whole subtree and appends its nodes in the order in which they complete, which is
postorder.  The roots of the builders are the leaves of the next tier, built in the same way, so the number
of tiers is the logarithm of the largest group and no task ever holds more than one builder.

In postorder the place of a node follows from sizes alone: before leaf r lie r leaves and the
``r - popcount(r)`` inner nodes that they have completed, and a node of level h completes h places
after its last leaf.  So a sibling is found without any pointer (``position``).  Proofs are read from the
top tier downwards: each builder passes every root below it the path from there to the root of all.

A node alone at the end of its level is hashed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, renamed

#: A builder holds two to the power of this many leaves.
BITS = 12
#: Rows that a task hands over at a time.
ROWS = 1024
DIGEST = 32

LOG_SCHEMA = "grp string, block long, size long, n long, levels int, nodes binary"
PATH_SCHEMA = "grp string, block long, path array<string>, subroot string, root string"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def position(level: int, index: int, n: int) -> int:
    """Postorder place of a node in a tree of ``n`` leaves."""
    last = min((index + 1) << level, n) - 1
    return 2 * last - last.bit_count() + level


def appended(leaves: Sequence[bytes], levels: int) -> bytes:
    """The append log of a subtree ``levels`` high: 32 bytes a node, in the order of completion."""
    log, waiting, last = [], {}, len(leaves) - 1
    for r, node in enumerate(leaves):
        log.append(node)
        for h in range(levels):
            second = (r >> h) & 1
            if not second and r < last:
                waiting[h] = node
                break
            node = bytes.fromhex(hashed(waiting[h].hex(), node.hex()) if second else hashed(node.hex()))
            log.append(node)
    return b"".join(log)


def path_from(log: bytes, r: int, n: int, levels: int) -> list[str]:
    """Per level the sibling of leaf ``r``'s ancestor: '<' and its digest if it stands left, '>' if right, '' if none."""
    path = []
    for h in range(levels):
        sibling = (r >> h) ^ 1
        if sibling > (n - 1) >> h:
            path.append("")
            continue
        at = DIGEST * position(h, sibling, n)
        path.append(("<" if (r >> h) & 1 else ">") + log[at:at + DIGEST].hex())
    return path


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        sibling = step[1:]
        leaf = hashed(sibling, leaf) if step[:1] == "<" else hashed(leaf, sibling)
    return leaf


@dataclass
class Tree:
    tiers: list[DataFrame]  # append logs, one row a builder, the lowest tier first
    roots: DataFrame  # grp, digest


@dataclass
class Manifest:
    leaves: DataFrame  # the rows with grp, rank (from 0), n (leaves of the group) and digest
    groups: DataFrame  # the same of the groups' roots, which are the leaves of the upper tree
    lower: Tree
    upper: Tree
    bits: int

    def log(self) -> DataFrame:
        """The whole log: tree, tier, group, builder, place of its first node in the tree's log, nodes.

        Nodes of tier 0 lie together from ``first_position`` on; higher tiers fill the places between.
        """
        parts = []
        for name, tree in (("rows", self.lower), ("groups", self.upper)):
            for t, logs in enumerate(tree.tiers):
                first = F.col("block") * F.lit(1 << (self.bits * (t + 1)))
                start = 2 * first - F.bit_count(first)
                parts.append(logs.select(F.lit(name).alias("tree"), F.lit(t).alias("tier"), "grp", "block", start.alias("first_position"), "size", "levels", "nodes"))
        return reduce(DataFrame.unionByName, parts)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hash of the fields in turn, each with its length in bytes; a null is a dash."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds rank (from 0) and n within ``grp``; a range sort deals the order, so a large group is spread out."""
    laid = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    laid = cut(laid.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq")))
    sizes = laid.groupBy("__part", "grp").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    per = Window.partitionBy("grp")
    before = per.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", "grp", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(per).alias("n"))
    joined = laid.join(offsets, ["__part", "grp"])
    return joined.withColumn("rank", F.col("__seq") + F.col("__shift")).drop("__part", "__seq", "__shift")


def build(leaves: DataFrame, bits: int = BITS) -> Tree:
    """Append logs of all tiers over (grp, rank, n, digest), and the groups' roots."""

    def append(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = int(pdf["n"].iloc[0])
        levels = bits if n > 1 << bits else (n - 1).bit_length()
        row = (key[0], key[1], len(pdf), n, levels, appended(list(pdf["digest"]), levels))
        return pd.DataFrame([row], columns=["grp", "block", "size", "n", "levels", "nodes"])

    level, tiers, roots = leaves.select("grp", "rank", "n", "digest"), [], []
    largest = level.agg(F.max("n")).first()[0] or 0
    while True:
        logs = cut(level.withColumn("block", F.shiftright("rank", bits)).groupBy("grp", "block").applyInPandas(append, LOG_SCHEMA))
        tops = logs.select("grp", "block", "n", F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})").alias("digest"))
        tiers.append(logs)
        roots.append(tops.where(F.col("n") <= 1 << bits).select("grp", "digest"))
        if largest <= 1 << bits:
            return Tree(tiers, reduce(DataFrame.unionByName, roots))
        above = tops.where(F.col("n") > 1 << bits)
        level = above.select("grp", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), "digest")
        largest = -(-largest >> bits)


def _children(logs: DataFrame, bits: int) -> DataFrame:
    """The paths of all roots below a builder that has its own."""

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        names = ["grp", "block", "path", "subroot", "root"]
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                for i in range(r.size):
                    held.append((r.grp, (r.block << bits) + i, path_from(r.nodes, i, r.size, r.levels) + list(r.path), r.subroot, r.root))
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return logs.mapInPandas(below, PATH_SCHEMA)


def _paths(tree: Tree, root_paths: DataFrame, bits: int) -> DataFrame:
    """For every builder of the lowest tier the path from its root up (grp, block, path, subroot, root).

    ``root_paths`` has, per group, the path above its root.
    """
    below = None
    for t in range(len(tree.tiers) - 1, -1, -1):
        logs = tree.tiers[t]
        tops = logs.where(F.col("n") <= 1 << bits).select("grp", "block").join(root_paths, "grp")
        upper = tops.select("grp", "block", "path", "subroot", "root")
        upper = upper if below is None else upper.unionByName(below)
        if t == 0:
            return upper
        below = cut(_children(logs.join(upper, ["grp", "block"]), bits))
    raise ValueError("a tree has one tier at least")


def manifest(rows: DataFrame, fields: Sequence[str], group: str, key: str, bits: int = BITS) -> Manifest:
    """The tree over ``rows``: leaves from ``fields``, a subtree per value of ``group``, leaves in order of ``key``.

    Nulls: a null field is a dash in its leaf, a null group comes before all others, null keys come first.
    Empty texts are fields of length 0; a long text is hashed where it is read and never shuffled.  Rows that
    share a key follow each other by their digest; rows that are equal are leaves of their own.  An empty
    table gives empty logs.  Columns named like the ones added (grp, rank, n, digest) are dropped.
    """
    rows = renamed(rows, [c for c in ("grp", "rank", "n", "digest") if c not in (*fields, group, key)])
    digest = F.unhex(leaf_digest([F.col(f"`{c}`") for c in fields]))
    # '-' sorts before '=', so a null group is the first, and the rest keep their order by bytes
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    kept = [c for c in rows.columns if c not in fields or c == key]
    leaves = rows.select(*[F.col(f"`{c}`") for c in kept], name.alias("grp"), digest.alias("digest"))
    leaves = _numbered(leaves, [key, "digest"])
    lower = build(leaves, bits)
    groups = _numbered(lower.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    return Manifest(leaves, groups, lower, build(groups, bits), bits)


def proofs(m: Manifest, claimed: str = "digest") -> DataFrame:
    """Every leaf with its proof and the root that the proof gives for the digest in column ``claimed``.

    Adds leaf, subroot, root, proof_sha256 (hash of the siblings, lowest first), folded_root and verified.
    """
    bits = m.bits
    keep = [c for c in m.leaves.columns if c not in ("grp", "rank", "n", "digest", claimed)]
    fields = {f.name: f.dataType.simpleString() for f in m.leaves.schema}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in keep],
                        "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"])

    def proven(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right) and len(left):
            log = right.iloc[0]
            for rank, digest, claim in zip(left["rank"], left["digest"], left[claimed]):
                path = path_from(log.nodes, int(rank) & ((1 << bits) - 1), int(log["size"]), int(log.levels)) + list(log.path)
                found = folded(claim.hex(), path)
                out.append((digest.hex(), log.subroot, log.root, hashed(*[s[1:] for s in path]), found, found == log.root))
        done = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return pd.concat([left[keep].reset_index(drop=True), done], axis=1)

    # the upper tree: the root of all, then the path above each group's root
    top = m.upper.roots.select("grp", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    over = _children(m.upper.tiers[0].join(_paths(m.upper, top, bits), ["grp", "block"]), bits)
    named = m.groups.select(F.col("rank").alias("block"), "name", F.lower(F.hex("digest")).alias("sub"))
    root_paths = cut(over.join(named, "block").select(F.col("name").alias("grp"), "path", F.col("sub").alias("subroot"), "root"))
    logs = m.lower.tiers[0].join(_paths(m.lower, root_paths, bits), ["grp", "block"])
    left = m.leaves.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "rank", "digest", claimed])], "grp", F.shiftright("rank", bits).alias("block"))
    return left.groupBy("grp", "block").cogroup(logs.groupBy("grp", "block")).applyInPandas(proven, schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def audited(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Manifest of documents, with each one's proof tried on a copy in which 1 is added to some n_chars.

    Where 7 divides the crc32 of doc_id as text the copy differs (a null n_chars or doc_id stays as it is).
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    copy = F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = leaf_digest([copy if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = docs.select(*FIELDS, F.unhex(claimed).alias("claimed"))
    return proofs(manifest(rows, FIELDS, "lang", "doc_id", bits), "claimed")
