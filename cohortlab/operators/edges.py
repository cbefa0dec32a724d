"""Effects along a graph of weighted edges, of any depth: genes, pathways, phenotypes, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def edge_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 12) -> DataFrame:
    """For each source and each node it reaches: the sum of the products of weights over all paths, their number, and the shortest.

    ``edges`` holds ``src, dst, weight`` (the sign is part of the weight), ``sources`` holds ``node``. A path visits no node twice, so
    cycles end by themselves; ``max_depth`` bounds the length. Repeated sources count once, repeated edges are paths of their own,
    edges without an end or weight are left out. The graph of the inner nodes is meant here: cases and their genes are joined to the result.
    """
    sound = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("weight").isNotNull()).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    starts = sources.filter(F.col("node").isNotNull()).select("node").distinct()
    return edges.sparkSession.sql("""
        WITH RECURSIVE walk(source, node, weight, depth, seen) AS (
          SELECT node, node, 1.0D, 0, array(node) FROM {starts}
          UNION ALL
          SELECT w.source, e.dst, w.weight * e.weight, w.depth + 1, array_append(w.seen, e.dst)
          FROM walk w JOIN {edges} e ON w.node = e.src
          WHERE w.depth < {depth} AND NOT array_contains(w.seen, e.dst))
        SELECT source, node AS target, sum(weight) AS weight, count(*) AS n_paths, min(depth) AS depth
        FROM walk WHERE depth > 0 GROUP BY source, node""", starts=starts, edges=sound, depth=max_depth)


def edge_effects(genes: DataFrame, first: DataFrame, paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Per case and target: the summed shift, the modifier exp(shift), and how many genes take part.

    ``genes`` holds ``case_id, gene, effect``, ``first`` the edges ``gene, node, weight`` into the graph, ``paths`` is from ``edge_paths`` and
    ``targets`` holds ``target``. Gene rows are first added up per case and gene; a gene's way to the targets is computed
    once for all cases.
    """
    ways = first.join(paths.withColumnRenamed("weight", "path_weight"), first["node"] == paths["source"]).join(targets, "target").groupBy("gene", "target").agg(
        F.sum(F.col("weight") * F.col("path_weight")).alias("way"))
    met = genes.groupBy("case_id", "gene").agg(F.sum("effect").alias("effect")).join(ways, "gene")
    got = met.groupBy("case_id", "target").agg(F.sum(F.col("effect") * F.col("way")).alias("shift"), F.count("*").alias("n_genes"))
    return got.withColumn("modifier", F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("shift")))))


def missing_drivers(genes: DataFrame, first: DataFrame) -> DataFrame:
    """One row per case and gene that no edge knows."""
    return genes.select("case_id", "gene").distinct().join(first.select("gene").distinct(), "gene", "left_anti").select("case_id", "gene")
