"""Graphs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.sources.graph import Graph, canonical, from_labels
from bramble.sources.store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_ends(edges: DataFrame) -> Graph:
    """The edges are stored: both ends, degrees and the peel read them, the tables behind only once."""
    edges = stored(edges, "edges")
    ends = edges.select("graph_id", F.col("src").alias("vid")).union(edges.select("graph_id", "dst")).distinct()
    return Graph(ends.withColumn("label", F.col("vid").cast("string")), edges)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and the parts they delivered; a part's vid is 1,000,000 more than its key."""
    rows = _table(spark, sf_dir, "lineitem").select(F.lit("supply").alias("graph_id"), F.col("l_suppkey").alias("src"), (F.lit(1_000_000) + F.col("l_partkey")).cast("long").alias("dst"))
    return _with_ends(rows.filter("src IS NOT NULL AND dst IS NOT NULL").distinct())


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of customers and suppliers with more deliveries one way than the mean of all such pairs."""
    t = lambda name: _table(spark, sf_dir, name)
    rows = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey <> s_nationkey")
        .groupBy("c_nationkey", "s_nationkey").count()
    )
    rows = stored(rows, "deliveries")
    # As whole numbers, so that no rounding decides.
    mean = rows.agg(F.sum("count").alias("all"), F.count("*").alias("pairs"))
    rows = rows.join(F.broadcast(mean)).filter("count * pairs > all")
    return _with_ends(canonical(rows.select(F.lit("trade").alias("graph_id"), F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))))


def region_star(spark: SparkSession, sf_dir: str) -> Graph:
    """One star per region: its nations around the region, whose vid is 100 more than its key."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return _with_ends(rows.select(F.col("r_name").alias("graph_id"), F.col("n_nationkey").cast("long").alias("src"), (F.lit(100) + F.col("r_regionkey")).cast("long").alias("dst")))


def links(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and the targets of their href attributes, numbered in the order of labels."""
    hrefs = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    pairs = hrefs.select(F.lit("links").alias("graph_id"), F.concat(F.lit("p:"), "page_id").alias("a"), F.concat(F.lit("h:"), "href").alias("b")).distinct()
    return from_labels(stored(pairs, "pairs"))
