"""Cleaning: self-loops, components, induced subgraphs, single vertices, k ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.operators.connect import connected
from bramble.sources.graph import Graph
from bramble.sources.store import stored


def count_self_loops(g: Graph) -> DataFrame:
    """graph_id, self_loops; graphs without edges included."""
    loops = g.edges.groupBy("graph_id").agg(F.count_if(F.col("src") == F.col("dst")).alias("n"))
    return g.vertices.select("graph_id").distinct().join(loops, "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).alias("self_loops"))


def remove_self_loops(g: Graph) -> Graph:
    """Drops the edges; the vertices stay."""
    return Graph(g.vertices, g.edges.filter("src <> dst"))


def induced_subgraph(g: Graph, members: DataFrame) -> Graph:
    """The graph on the (graph_id, vid) rows of members."""
    m = members.select("graph_id", "vid").distinct()
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(m.withColumnRenamed("vid", end), ["graph_id", end], "left_semi")
    return Graph(g.vertices.join(m, ["graph_id", "vid"], "left_semi"), edges.select("graph_id", "src", "dst"))


def remove_vertex(g: Graph, vid: int) -> Graph:
    """Without one vertex and its edges, in every graph."""
    return Graph(g.vertices.filter(F.col("vid") != vid), g.edges.filter((F.col("src") != vid) & (F.col("dst") != vid)))


def components(g: Graph) -> DataFrame:
    """graph_id, vid, component: the smallest vid that can be reached."""
    found = connected(g.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["graph_id"])
    return g.vertices.select("graph_id", "vid").join(found.withColumnRenamed("id", "vid"), ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("component", "vid").alias("component"))


def largest_component(g: Graph) -> Graph:
    """Per graph the component with most vertices; of equal ones that with the smallest vid."""
    placed = stored(components(g), "placed")
    sizes = placed.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    top = sizes.groupBy("graph_id").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    return induced_subgraph(g, placed.join(top, ["graph_id", "component"], "left_semi"))


def k_range(vertices: DataFrame, k_min: int = 0, k_max: int | None = None, step: int = 1) -> DataFrame:
    """graph_id, k for k_min <= k <= min(k_max, n - 1)."""
    n = vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    last = F.col("n") - 1 if k_max is None else F.least(F.col("n") - 1, F.lit(k_max).cast("long"))
    first = F.lit(max(0, k_min)).cast("long")
    return n.filter(last >= first).select("graph_id", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("k"))


#: Which rows a report shows: k up to 5, every tenth k and the last; every fifth row from k = 0; every tenth row from the first k and the last.
SHOWN = {"ends": "k <= 5 OR k % 10 = 0 OR k = last_k", "fifths": "(k + 1) % 5 = 0", "tenths": "(k - first_k + 1) % 10 = 0 OR k = last_k"}


def shown(rows: DataFrame, rule: str = "ends") -> DataFrame:
    """The rows of each graph that a report shows, by one of the rules SHOWN."""
    ends = rows.groupBy("graph_id").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))
    return rows.join(ends, "graph_id").filter(SHOWN[rule]).drop("first_k", "last_k")


def at_k(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The rows of an explicit list of k."""
    return rows.filter(F.col("k").isin([int(k) for k in ks]))
