"""Graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.operators import clean
from bramble.sources.graph import Graph


def degrees(g: Graph) -> DataFrame:
    """graph_id, vid, degree; isolated vertices have 0."""
    n = g.symmetric().groupBy("graph_id", F.col("u").alias("vid")).agg(F.count("*").alias("d"))
    return g.vertices.join(n, ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("d", F.lit(0)).alias("degree"))


def size(g: Graph) -> DataFrame:
    """graph_id, n, m, avg_degree, density (NULL below two vertices)."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = g.edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    both = n.join(m, "graph_id", "left").select("graph_id", "n", F.coalesce("m", F.lit(0)).alias("m"))
    return both.select("*", F.try_divide(2.0 * F.col("m"), F.col("n")).alias("avg_degree"), F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def clustering(g: Graph, max_nodes: int | None = 10_000) -> DataFrame:
    """graph_id, avg_clustering: the mean over vertices of 2 triangles / (d (d - 1)), 0 below degree 2; graphs of more than max_nodes vertices are left out.

    Each triangle is found once from its vertex that comes first by (degree, vid): paths of two edges are
    only made at the ends that come first, which keeps hubs from squaring.
    """
    if max_nodes is not None:
        small = g.vertices.groupBy("graph_id").count().filter(F.col("count") <= max_nodes).select("graph_id")
        g = Graph(g.vertices.join(small, "graph_id", "left_semi"), g.edges.join(small, "graph_id", "left_semi"))
    deg = degrees(g)
    a, b = (deg.select("graph_id", F.col("vid").alias(end), F.struct(F.col("degree"), F.col("vid")).alias(f"r_{end}")) for end in ("src", "dst"))
    ranked = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("graph_id", F.least("r_src", "r_dst").alias("lo"), F.greatest("r_src", "r_dst").alias("hi"))
    e1, e2, e3 = ranked.alias("e1"), ranked.alias("e2"), ranked.alias("e3")
    forks = e1.join(e2, (F.col("e1.graph_id") == F.col("e2.graph_id")) & (F.col("e1.lo") == F.col("e2.lo")) & (F.col("e1.hi") < F.col("e2.hi")))
    forks = forks.select(F.col("e1.graph_id").alias("graph_id"), F.col("e1.lo").alias("x"), F.col("e1.hi").alias("y"), F.col("e2.hi").alias("z"))
    closed = forks.join(e3, (forks["graph_id"] == F.col("e3.graph_id")) & (F.col("y") == F.col("e3.lo")) & (F.col("z") == F.col("e3.hi"))).select(forks["graph_id"], "x", "y", "z")
    per = closed.select("graph_id", F.explode(F.array("x.vid", "y.vid", "z.vid")).alias("vid")).groupBy("graph_id", "vid").agg(F.count("*").alias("t"))
    local = F.when(F.col("degree") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return deg.join(per, ["graph_id", "vid"], "left").groupBy("graph_id").agg(F.avg(local).alias("avg_clustering"))


def connected(g: Graph) -> DataFrame:
    """graph_id, n_components, connected."""
    n = clean.components(g).groupBy("graph_id").agg(F.countDistinct("component").alias("n_components"))
    return n.withColumn("connected", F.col("n_components") == 1)


def graph_stats(g: Graph, max_nodes: int | None = 10_000) -> DataFrame:
    """graph_id, n, m, avg_degree, density, connected, avg_clustering."""
    return size(g).join(connected(g).select("graph_id", "connected"), "graph_id", "left").join(clustering(g, max_nodes), "graph_id", "left")


def min_degree(g: Graph) -> DataFrame:
    """graph_id, n, min_degree."""
    return degrees(g).groupBy("graph_id").agg(F.count("*").alias("n"), F.min("degree").alias("min_degree"))
