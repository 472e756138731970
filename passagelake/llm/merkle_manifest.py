"""Operator 12: Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf: the hash of its columns. The leaves of a source, in order of ``doc_id``, form a tree of arity three whose
root is the source's subroot; the subroots, in order of source, form the tree above them. The work runs in aligned blocks:

1. Leaves are hashed in one scan; texts never leave it. A range sort by (source, doc_id) numbers them; a source's size only
   decides how many tasks its leaves lie in.
2. ``BLOCK`` consecutive nodes of a tree, aligned at a multiple of ``BLOCK``, are one block. A block holds each level as one hex
   string: the next level is the hash of each fixed-width substring of it, and the substrings before and after a node in its run
   are the node's siblings. A block ends in one node.
3. The blocks' last nodes are the next round's nodes, ``BLOCK`` times fewer, until each tree is one node. The subroots go through
   the same rounds as one more tree.

A row's proof is the siblings of its own block, then those of the blocks above, then those of the tree of sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.sources.stores import materialise

ARITY = 3
#: Levels inside a block, and the nodes that a block takes in: 243, a level string of 15 552 characters.
LEVELS = 5
BLOCK = ARITY**LEVELS
DIGEST = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

SIDES = "array<struct<before:string,after:string>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of the columns in order, each ``-`` if null, else its number of UTF-8 bytes, a colon and its value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return _hash(*[field(c) for c in columns.values()])


def _numbered(nodes: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``pos``, the position from 0 within ``keys``, and ``size``, the number of rows of the key.

    One range sort over keys and order: a key with a third of all rows lies in as many tasks as its share. Only the counts of
    (task, key) meet in a window.
    """
    tie = nodes.withColumn("_tie", F.monotonically_increasing_id())  # rows alike in every column of the order lie apart, too
    ranged = tie.repartitionByRange(*keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie")
    rows = materialise(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"),
        F.sum("_n").over(own).alias("size"),
    )
    starts = materialise(starts, f"{name}-starts")
    same = [rows[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys] + [F.shiftright(rows["_at"], 33) == starts["_p"]]
    joined = rows.join(starts, reduce(lambda a, b: a & b, same))
    return joined.select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "size")


def _level_up(level: Column) -> Column:
    runs = F.ceil(F.length(level) / (ARITY * DIGEST)).cast("int")
    parents = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (ARITY * DIGEST) + 1, F.lit(ARITY * DIGEST)), 256))
    return F.array_join(parents, "")


def _sides(levels: list[str], depth: Column, at: Column) -> Column:
    """The flanking substrings of node ``at`` of a block, level by level; levels from ``depth`` on have none."""
    found = []
    for k, level in enumerate(levels):
        own = F.floor(at / ARITY**k).cast("int")
        first = own - own % ARITY
        before = F.substring(level, first * DIGEST + 1, (own - first) * DIGEST)
        after = F.substring(level, (own + 1) * DIGEST + 1, (first + (ARITY - 1) - own) * DIGEST)
        found.append(F.struct(before.alias("before"), after.alias("after")))
    return F.slice(F.array(*found), F.lit(1), depth)


def _block_round(nodes: DataFrame, payload: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """One round over ``tree, pos, size, hash`` and ``payload``: the nodes with ``block`` and ``sides``, and ``tree, pos, size, hash`` of the blocks.

    A tree of one block stops at its root; in a larger tree every block climbs all levels, the last and shorter one too.
    """
    member = F.struct("pos", "hash", *payload)
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("size").alias("size"))
    climb = F.when(F.col("size") > BLOCK, F.lit(LEVELS)).otherwise(sum((F.when(F.col("size") > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0)))
    held = blocks.withColumn("depth", climb.cast("int")).withColumn("level0", F.array_join("members.hash", ""))
    for k in range(LEVELS):
        held = held.withColumn(f"level{k + 1}", F.when(F.col("depth") > k, _level_up(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    levels = [f"level{k}" for k in range(LEVELS)]
    at = lambda m: (m["pos"] - F.col("block") * BLOCK).cast("int")
    sided = F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in ("hash", *payload)], _sides(levels, F.col("depth"), at(m)).alias("sides")))
    size = F.ceil(F.col("size") / BLOCK).cast("long")
    done = materialise(held.select("tree", "block", size.alias("size"), F.col(f"level{LEVELS}").alias("top"), sided.alias("members")), name)
    below = done.select("tree", "block", F.explode("members").alias("m")).select("tree", "block", "m.*")
    return below, done.select("tree", F.col("block").alias("pos"), "size", F.col("top").alias("hash"))


def _paths(nodes: DataFrame, payload: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``tree, hash, payload, sides`` of all nodes, sides up to the root of their tree, and ``tree, root``.

    Rounds until the largest tree is one node: their number grows with the logarithm of its size to base ``BLOCK``.
    """
    below, above = _block_round(nodes, payload, f"{name}-blocks")
    largest = above.agg(F.max("size")).first()[0]
    if (largest or 0) <= 1:
        return below.drop("block"), above.select("tree", F.col("hash").alias("root"))
    upper, roots = _paths(above.withColumn("node", F.col("pos")), ["node"], name)
    upper = materialise(upper.select(F.col("tree").alias("_t"), F.col("node").alias("_b"), F.col("sides").alias("_up")), f"{name}-up")
    joined = below.join(upper, below["tree"].eqNullSafe(upper["_t"]) & (below["block"] == upper["_b"]))
    return joined.select("tree", "hash", *payload, F.concat("sides", "_up").alias("sides")), roots


def _fold(leaf: Column, sides: Column) -> Column:
    return F.aggregate(sides, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_text(sides: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(sides, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, checked: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, checked, subroot, root, sides``: the manifest row of each row of ``docs``.

    ``sides`` holds the siblings before and after the path at each level up to ``root``. ``checked`` is the leaf to fold along
    the path, by default the row's own leaf; an expression over ``docs`` gives the leaf of a copy that is to be verified.

    A null value has its own mark and so differs from an empty text. Rows without source are a source of their own, before all
    others; rows without doc_id come first in their source. Rows with equal source and doc_id are ordered by their leaf, equal
    rows are leaves of their own. A table without rows gives no rows. Columns that are not named are not part of a leaf.
    """
    leaf = leaf_hash({c: F.col(c) for c in columns})
    own = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("tree"), leaf.alias("hash"), (leaf if checked is None else checked).alias("checked"))
    leaves = _numbered(materialise(own, "leaves"), ["tree"], ["doc_id", "hash"], "numbered")
    paths, subroots = _paths(leaves, ["doc_id", "checked"], "sources")
    named = subroots.select(F.lit(0).alias("all"), F.col("tree").alias("source"), F.col("root").alias("hash"))
    sources = _numbered(materialise(named, "subroots"), ["all"], ["source"], "sources")
    top, roots = _paths(sources.withColumnRenamed("all", "tree"), ["source"], "top")
    above = top.join(roots, "tree").select(F.col("source").alias("_s"), F.col("hash").alias("subroot"), "root", F.col("sides").alias("_up"))
    above = materialise(above, "above")
    joined = paths.join(above, paths["tree"].eqNullSafe(above["_s"]))
    return joined.select(
        "doc_id", F.col("tree").alias("source"), F.col("hash").alias("leaf"), "checked", "subroot", "root", F.concat("sides", "_up").alias("sides")
    )


def verified(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, the root that ``checked`` gives along the path, and whether it is the root."""
    folded = rows.withColumn("folded_root", _fold(F.col("checked"), F.col("sides")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf() -> Column:
    """The leaf of a row that lost the line ends of its text where 2 divides the crc32 of its doc_id; a null doc_id is untouched."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf_hash({c: F.col(c) for c in COLUMNS} | {"text": text})


def manifest_check(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row, after tampering with half of them."""
    rows = verified(manifest(docs, checked=tampered_leaf()))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("sides")), 256).alias("proof_sha256"), "folded_root", "verified")
