"""Merkle manifest of a dataset: nodes are grouped away digit by digit within blocks, and proofs unfold from the nested structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.session import materialize

#: A run of nodes becomes one: 2^BITS of them.
BITS = 4
#: Digits of a rank that are grouped away within a block; a block nests at most 2^(BITS * DIGITS) nodes.
DIGITS = 3
BLOCK = BITS * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``nodes`` with their rank (from 0) in their tree by ``order`` and the tree's number of nodes, written down.

    Rows are dealt to ranges of (tree, order) and sorted there, so a tree of any size spreads over many tasks. Only one
    row for each tree in a range is counted up; a row's rank is its place in the range plus what the ranges before hold.
    """
    place = nodes.repartitionByRange(*[F.col(c) for c in (tree, *order)]).sortWithinPartitions(tree, *order)
    place = materialize(place.withColumns({"m_part": F.spark_partition_id(), "m_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    held = place.groupBy(F.col(tree).alias("m_tree"), F.col("m_part").alias("m_of")).agg(F.count(F.lit(1)).alias("m_n"), F.min("m_at").alias("m_first"))
    whole = Window.partitionBy("m_tree")
    held = held.withColumns({"m_base": F.sum("m_n").over(whole.orderBy("m_of")) - F.col("m_n") - F.col("m_first"), "m_all": F.sum("m_n").over(whole)})
    held = materialize(held.drop("m_first", "m_n"))
    on = place[tree].eqNullSafe(held["m_tree"]) & (place["m_part"] == held["m_of"])
    return place.join(held, on).select(*nodes.columns, (F.col("m_at") + F.col("m_base")).alias("rank"), F.col("m_all").alias("nodes"))


def nested(nodes: DataFrame, tree: str, hash_: str, keep: list[str]) -> DataFrame:
    """One row per block of a tree: tree, block (its number), nodes (of the tree), top and the nested children.

    The digits of ``rank`` go one after the other, the last first: rows that agree in all others become an array of structs
    in the order of the digit, and their digest a node of the next level. All groupings lie within a block, so the rows
    move once, by (tree, block). A level on which the tree has a single node has no digest: the node goes up as it is.
    """
    digits = [f"m_d{i}" for i in range(DIGITS)]
    cells = nodes.select(F.col(tree), F.shiftright("rank", BLOCK).alias("block"), F.col("nodes"), F.col(hash_).alias("m_h"), F.struct(*keep).alias("m_row"),
                         *[F.shiftright("rank", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(d) for i, d in enumerate(digits)])
    level = cells.repartition(tree, "block")
    inner = "m_row"
    for i, digit in enumerate(digits):
        left = [tree, "block", *digits[i + 1:]]
        run = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), F.col("m_h").alias("hash"), F.col(inner).alias("inner")))).alias("m_kids")
        level = level.groupBy(*left).agg(F.max("nodes").alias("nodes"), run)
        up = F.when(F.col("nodes") > (1 << BITS * i), digest(F.array_join(F.col("m_kids")["hash"], ""))).otherwise(F.col("m_kids")[0]["hash"])
        level, inner = level.withColumn("m_h", up), "m_kids"
    return level.select(tree, "block", "nodes", F.col("m_h").alias("top"), F.col("m_kids").alias("kids"))


def _beside(kid: Column, at: Column, hashed: Column) -> Column:
    """A child's inner struct, and what stands left and right of it in its run if its level has a digest."""
    side = lambda part: F.array_join(part["hash"], "")
    sides = F.struct(side(F.slice("kids", F.lit(1), at)).alias("left"), side(F.slice("kids", at + 2, F.lit(1 << BITS))).alias("right"))
    return F.struct(kid["inner"].alias("inner"), F.when(hashed, sides).alias("beside"))


def unfolded(blocks: DataFrame, names: list[str]) -> DataFrame:
    """The rows of all blocks with ``path``: for each level with a digest, what stands left and right of the row's node in its run."""
    carried = [c for c in blocks.columns if c != "kids"]
    level = blocks.withColumn("m_path", F.array().cast(PATH))
    for i in reversed(range(DIGITS)):
        hashed = F.col("nodes") > (1 << BITS * i)
        level = level.withColumn("m_kid", F.explode(F.transform("kids", lambda kid, at: _beside(kid, at, hashed))))  # noqa: B023
        path = F.when(F.col("m_kid.beside").isNull(), F.col("m_path")).otherwise(F.concat(F.array("m_kid.beside"), "m_path"))
        level = level.select(*carried, F.col("m_kid.inner").alias("kids" if i else "m_row"), path.alias("m_path"))
    return level.select(*[c for c in carried if c not in names], *[F.col(f"m_row.{c}").alias(c) for c in names], F.col("m_path").alias("path"))


def forest(nodes: DataFrame, tree: str, hash_: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of ranked ``nodes``; for each block (tree, block) its path ``above`` to the top of the tree; and the tops (tree, hash).

    Blocks are written down; their tops are the nodes of the next pass, which has 2^BLOCK times fewer of them, until every tree is
    one block. Nothing but one row for each block is ever joined: the paths of the nodes in it unfold from the block itself.
    """
    blocks = materialize(nested(nodes, tree, hash_, keep))
    if blocks.filter("block > 0").isEmpty():
        return blocks, blocks.select(tree, "block", F.array().cast(PATH).alias("above")), blocks.select(tree, F.col("top").alias("hash"))
    fewer = F.shiftright(F.col("nodes") + ((1 << BLOCK) - 1), BLOCK).alias("nodes")
    over, above, ends = forest(blocks.select(tree, F.col("block").alias("rank"), fewer, "top"), tree, "top", ["rank"])
    return blocks, materialize(paths_of(over, above, tree, ["rank"]).select(tree, F.col("rank").alias("block"), F.col("path").alias("above"))), ends


def paths_of(blocks: DataFrame, above: DataFrame, tree: str, names: list[str]) -> DataFrame:
    """The rows of all blocks with the tree, their whole path, and the further columns of ``above``."""
    more = [c for c in above.columns if c not in (tree, "block")]
    over = above.select(F.col(tree).alias("m_tree"), F.col("block").alias("m_block"), *more)
    met = blocks.join(over, blocks[tree].eqNullSafe(over["m_tree"]) & (blocks["block"] == over["m_block"])).select(*blocks.columns, *more)
    return unfolded(met, names).withColumn("path", F.concat("path", "above")).drop("above", "top", "block", "nodes")


def manifest(docs: DataFrame, leaves: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root and path, the siblings on its way to the root.

    Needs the columns of ``FIELDS``; others are left out. ``leaves`` names further digests to carry along. In a source leaves
    ascend by doc_id (nulls first), equal ids by their leaf, so the order of equal rows does not show. Sources ascend bytewise,
    null first. A null text and an empty one have different leaves. Without documents there is no row. ``path`` has, level by
    level, the joined digests left and right of the node in its run; ``folded`` recomputes the root from it.
    """
    extra = leaves or {}
    rows = docs.select("doc_id", F.col("source").alias("m_source"), leaf_of(*[F.col(c) for c in FIELDS]).alias("leaf"), *[c.alias(n) for n, c in extra.items()])
    names = ["doc_id", "leaf", *extra]
    blocks, above, subroots = forest(ranked(rows, "m_source", ["doc_id", "leaf"]), "m_source", "leaf", names)
    sources, over, roots = forest(ranked(subroots.withColumn("m_whole", F.lit(0)), "m_whole", ["m_source"]), "m_whole", "hash", ["m_source", "hash"])
    ends = paths_of(sources, over, "m_whole", ["m_source", "hash"]).join(roots.withColumnRenamed("hash", "root"), "m_whole")
    ends = materialize(ends.select(F.col("m_source").alias("m_of"), F.col("hash").alias("subroot"), "root", "path"))
    above = above.join(ends, above["m_source"].eqNullSafe(ends["m_of"])).select("m_source", "block", F.concat("above", "path").alias("above"), "subroot", "root")
    return paths_of(blocks, materialize(above), "m_source", names).select(*names, "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def siblings(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf to the root, left to right."""
    return digest(F.lit(""), F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))
