"""Everything per k from one peel trace: three proxies d_k, alpha by removal, witnesses.

The row with s vertices answers k = s - 1. Windows partition by graph.
- dk_density: the largest ceil(2 m / n) of a peeled subgraph with more than k vertices; 0 for k >= n.
- dk_tail_degree: the largest degree at removal among the last k removals; all of them for k >= n; 0 for k <= 0.
- dk_degeneracy: the same among the removals that leave at least k vertices; the (n - k)-th smallest core number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions import average_degree_ceiling
from bramble.operators import clean, stats
from bramble.sources.graph import Graph


def _by():
    return Window.partitionBy("graph_id")


def _large_first():
    return _by().orderBy(F.desc("vertices_before")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _small_first():
    return _by().orderBy("vertices_before").rowsBetween(Window.unboundedPreceding, -1)


def _ceiling():
    return average_degree_ceiling(F.col("edges_before"), F.col("vertices_before"))


def dk_all(trace: DataFrame) -> DataFrame:
    """graph_id, k, dk_density, dk_tail_degree, dk_degeneracy for k = 0 .. n - 1."""
    return trace.select(
        "graph_id",
        (F.col("vertices_before") - 1).alias("k"),
        F.max(_ceiling()).over(_large_first()).alias("dk_density"),
        F.coalesce(F.max("deg_at_removal").over(_small_first()), F.lit(0)).alias("dk_tail_degree"),
        F.max("deg_at_removal").over(_large_first()).alias("dk_degeneracy"),
    )


def dk_at(trace: DataFrame, k: int) -> DataFrame:
    """The three values at one k of any size, by plain aggregates: graph_id, k, dk_density, dk_tail_degree, dk_degeneracy."""
    low, n = max(k, 0), F.col("vertices_before")
    return trace.groupBy("graph_id").agg(
        F.lit(k).cast("long").alias("k"),
        F.coalesce(F.max(F.when(n > low, _ceiling())), F.lit(0)).alias("dk_density"),
        F.coalesce(F.max(F.when(n <= k, F.col("deg_at_removal"))), F.lit(0)).alias("dk_tail_degree"),
        F.coalesce(F.max(F.when(n > low, F.col("deg_at_removal"))), F.lit(0)).alias("dk_degeneracy"),
    )


def alpha_removal(trace: DataFrame) -> DataFrame:
    """graph_id, k, alpha_removal for k = 0 .. n - 1: the best ceil(2 m / n) of a peeled state with at least k vertices; 0 at k = 0."""
    best = trace.select("graph_id", F.col("vertices_before").alias("k"), F.max(_ceiling()).over(_large_first()).alias("alpha_removal"), F.max("vertices_before").over(_by()).alias("n"))
    zero = trace.filter("step = 1").select("graph_id", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("alpha_removal"))
    return best.filter("k < n").select("graph_id", "k", "alpha_removal").union(zero)


def removal_witness(trace: DataFrame, k: int) -> DataFrame:
    """graph_id, step, vid: the vertices of the first state with at least k (> 0) vertices that has the best density."""
    states = trace.filter(F.col("vertices_before") >= min(k, 1) if k <= 0 else F.col("vertices_before") >= k)
    first = states.groupBy("graph_id").agg(F.max_by("step", F.struct(_ceiling(), -F.col("step"))).alias("first_step"))
    return trace.join(first, "graph_id").filter("step >= first_step").select("graph_id", F.col("first_step").alias("step"), "vid")


def tail_order(trace: DataFrame, k: int) -> DataFrame:
    """graph_id, removal_order: the last k removed vertices, in order (a report for small k)."""
    last = trace.filter(F.col("vertices_before") <= k)
    return last.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "vid"))), lambda s: s["vid"]).alias("removal_order"))


def degeneracy_witness(trace: DataFrame, k: int) -> DataFrame:
    """graph_id, step, dk, vid: from the first removal at degree dk_degeneracy(k) on, all later ones."""
    head = trace.filter(F.col("vertices_before") > max(k, 0))
    first = head.groupBy("graph_id").agg(F.max_by("step", F.struct("deg_at_removal", -F.col("step"))).alias("first_step"), F.max("deg_at_removal").alias("dk"))
    return trace.join(first, "graph_id").filter("step >= first_step").select("graph_id", F.col("first_step").alias("step"), "dk", "vid")


def witness_report(g: Graph, trace: DataFrame, k: int) -> DataFrame:
    """graph_id, k, dk, step, n_witness, m_witness, min_degree, avg_degree of the degeneracy witness."""
    w = degeneracy_witness(trace, k)
    h = clean.induced_subgraph(g, w)
    head = w.groupBy("graph_id").agg(F.first("step").alias("step"), F.first("dk").alias("dk"))
    return (
        head.join(stats.size(h), "graph_id")
        .join(stats.min_degree(h).select("graph_id", "min_degree"), "graph_id")
        .select("graph_id", F.lit(k).cast("long").alias("k"), "dk", "step", F.col("n").alias("n_witness"), F.col("m").alias("m_witness"), "min_degree", "avg_degree")
    )


def half_density_ceiling(dk: DataFrame) -> DataFrame:
    """graph_id, half_density_ceiling: ceil(dk_density(0) / 2); no bound on arboricity, K5 has 2 and arboricity 3."""
    return dk.filter("k = 0").select("graph_id", F.floor((F.col("dk_density") + 1) / 2).cast("bigint").alias("half_density_ceiling"))


def analyze(g: Graph, trace: DataFrame) -> DataFrame:
    """graph_id, n, m, density, d0, half_density_ceiling."""
    dk = dk_all(trace)
    d0 = dk.filter("k = 0").select("graph_id", F.col("dk_density").alias("d0"))
    return stats.size(g).select("graph_id", "n", "m", "density").join(d0, "graph_id", "left").join(half_density_ceiling(dk), "graph_id", "left")
