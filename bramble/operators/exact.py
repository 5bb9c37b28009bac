"""Exact alpha_k of small graphs: all vertex subsets as bit masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions import average_degree_ceiling
from bramble.sources.graph import Graph

DEFAULT_MAX_N, HARD_MAX_N = 15, 20


def _subsets(g: Graph, max_n: int) -> DataFrame:
    """graph_id, n, s (mask by rank of vid), size, edges_in for every non-empty subset of the graphs of at most max_n vertices."""
    if max_n > HARD_MAX_N:
        raise ValueError(f"exact values need 2^n subsets; max_n is at most {HARD_MAX_N}")
    small = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") <= max_n)
    ranked = g.vertices.join(small, "graph_id").select("graph_id", "vid", "n", (F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")) - 1).alias("bit"))
    a = ranked.select("graph_id", F.col("vid").alias("src"), F.expr("shiftleft(1L, bit)").alias("ma"))
    b = ranked.select("graph_id", F.col("vid").alias("dst"), F.expr("shiftleft(1L, bit)").alias("mb"))
    masks = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).groupBy("graph_id").agg(F.collect_list(F.col("ma").bitwiseOR(F.col("mb"))).alias("masks"))
    graphs = small.join(masks, "graph_id", "left").withColumn("masks", F.coalesce("masks", F.array().cast("array<bigint>")))
    every = graphs.select("graph_id", "n", "masks", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, cast(n as int)) - 1"))).alias("s"))
    inside = F.size(F.filter("masks", lambda m: m.bitwiseAND(F.col("s")) == m)).cast("long")
    return every.select("graph_id", "n", "s", F.bit_count("s").cast("long").alias("size"), inside.alias("edges_in"))


def alpha_exact(g: Graph, max_n: int = DEFAULT_MAX_N) -> DataFrame:
    """graph_id, k, alpha_exact for k = 0 .. n - 1 of graphs of at most max_n vertices."""
    best = _subsets(g, max_n).groupBy("graph_id", "size").agg(F.max(average_degree_ceiling(F.col("edges_in"), F.col("size"))).alias("best"))
    w = Window.partitionBy("graph_id").orderBy(F.desc("size"))
    return best.select("graph_id", (F.col("size") - 1).alias("k"), F.max("best").over(w).alias("alpha_exact"))


def exact_witness(g: Graph, k: int, max_n: int = DEFAULT_MAX_N) -> DataFrame:
    """graph_id, alpha_exact, vids: the first best subset with more than k vertices, smaller sizes first, then in the order of combinations."""
    at = _subsets(g, max_n).filter(F.col("size") > max(k, 0))
    # Combinations are in the order of their sorted members; with bits by rank that is the reversed mask, descending.
    turned = F.reverse(F.lpad(F.bin("s"), HARD_MAX_N, "0"))
    best = at.groupBy("graph_id").agg(F.max(F.struct(average_degree_ceiling(F.col("edges_in"), F.col("size")).alias("alpha"), (-F.col("size")).alias("small"), turned.alias("order"), F.col("s"))).alias("b"))
    members = best.select("graph_id", F.col("b.alpha").alias("alpha_exact"), F.col("b.s").alias("s"))
    ranked = g.vertices.select("graph_id", "vid", (F.row_number().over(Window.partitionBy("graph_id").orderBy("vid")) - 1).alias("bit"))
    chosen = ranked.join(members, "graph_id").filter(F.expr("(s & shiftleft(1L, bit)) <> 0"))
    return chosen.groupBy("graph_id", "alpha_exact").agg(F.sort_array(F.collect_list("vid")).alias("vids"))
