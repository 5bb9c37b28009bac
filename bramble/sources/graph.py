"""Graphs as DataFrames: vertices(graph_id, vid, label) and edges(graph_id, src, dst) with src < dst."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.sources.store import stored

VERTICES = T.StructType([T.StructField("graph_id", T.StringType(), False), T.StructField("vid", T.LongType(), False), T.StructField("label", T.StringType())])
EDGES = T.StructType([T.StructField("graph_id", T.StringType(), False), T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])


@dataclass(frozen=True)
class Graph:
    """Any number of undirected graphs; isolated vertices only exist in vertices."""

    vertices: DataFrame
    edges: DataFrame

    def symmetric(self) -> DataFrame:
        """Both directions of every edge: graph_id, u, v."""
        e = self.edges
        return e.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("graph_id", "dst", "src"))

    def validate(self) -> Graph:
        """Raises unless the edges are simple: src < dst, no repeats, both ends among the vertices."""
        if not self.edges.filter("src >= dst OR src IS NULL OR dst IS NULL").isEmpty():
            raise ValueError("edges must have src < dst: remove self-loops and order the ends")
        if not self.edges.groupBy("graph_id", "src", "dst").count().filter("count > 1").isEmpty():
            raise ValueError("edges repeat")
        ends = self.symmetric().select("graph_id", F.col("u").alias("vid"))
        if not ends.join(self.vertices, ["graph_id", "vid"], "left_anti").isEmpty():
            raise ValueError("an edge has an end that is no vertex")
        return self

    def union(self, other: Graph) -> Graph:
        return Graph(self.vertices.unionByName(other.vertices), self.edges.unionByName(other.edges))

    def add_edges(self, more: DataFrame) -> Graph:
        """The graph with more edges (graph_id, src, dst), repeated ones once."""
        return Graph(self.vertices, canonical(self.edges.unionByName(more)))


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, with its smaller end first; self-loops stay."""
    return edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def from_edges(edges: DataFrame) -> Graph:
    """From (graph_id, src, dst) rows: vertices are the ends that occur, self-loops included, labels their numbers."""
    edges = canonical(edges)
    ends = edges.select("graph_id", F.col("src").alias("vid")).union(edges.select("graph_id", "dst")).distinct()
    return Graph(ends.withColumn("label", F.col("vid").cast("string")), edges)


def from_edge_list(spark: SparkSession, rows: Iterable[tuple[int, int]], n: int | None = None, graph_id: str = "graph") -> Graph:
    """From pairs of numbers; vertices are 0..n-1, where n is the largest number + 1 if not given."""
    rows = list(rows)
    n = max((max(r) for r in rows), default=-1) + 1 if n is None else n
    edges = spark.createDataFrame([(graph_id, int(a), int(b)) for a, b in rows], EDGES)
    vertices = spark.range(n).select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("vid"), F.col("id").cast("string").alias("label"))
    return Graph(vertices, canonical(edges))


def from_labels(edges: DataFrame, order: str | Column | None = None) -> Graph:
    """From (graph_id, a, b) rows with string labels; vids are dense per graph in label order, or by the smallest `order`."""
    key = F.lit(0) if order is None else (F.col(order) if isinstance(order, str) else order)
    seen = edges.select("graph_id", F.col("a").alias("label"), key.alias("at")).union(edges.select("graph_id", "b", key))
    labels = seen.groupBy("graph_id", "label").agg(F.min("at").alias("at"))
    vertices = _numbered(labels)
    a = vertices.select("graph_id", F.col("label").alias("a"), F.col("vid").alias("src"))
    b = vertices.select("graph_id", F.col("label").alias("b"), F.col("vid").alias("dst"))
    return Graph(vertices, canonical(edges.join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"]).select("graph_id", "src", "dst")))


def _numbered(labels: DataFrame) -> DataFrame:
    """graph_id, vid, label: dense numbers by (at, label) within each graph, from sorted ranges and the sizes of those before; no task holds a graph's labels."""
    spark = labels.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = labels.repartitionByRange(ranges, "graph_id", "at", "label").sortWithinPartitions("graph_id", "at", "label")
    at = F.monotonically_increasing_id()
    placed = stored(placed.select("graph_id", "label", F.shiftright(at, 33).alias("part"), at.alias("row")), "labels")
    # One row for each range and graph in it.
    sizes = placed.groupBy("graph_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("graph_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("graph_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(offsets, ["graph_id", "part"]).select("graph_id", (F.col("row") + F.col("offset")).alias("vid"), "label")


_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds kind ('edge', 'comment', 'blank', 'short', 'bad') and, for edges, src and dst as written.

    A line is stripped; blank lines and those that begin with # are skipped; the first two
    tokens between white space must be whole numbers (digit groups may be joined by _);
    later tokens do not matter. Numbers beyond 64 bits make a line bad.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split(line, r"\s+")

    def number(i: int) -> Column:
        token = F.get(parts, F.lit(i))
        return F.when(token.rlike(_INT), F.replace(token, F.lit("_"), F.lit("")).try_cast("bigint"))

    src, dst = number(0), number(1)
    kind = (
        F.when(line == "", "blank")
        .when(line.startswith("#"), "comment")
        .when(F.size(parts) < 2, "short")
        .when(src.isNull() | dst.isNull(), "bad")
        .otherwise("edge")
    )
    return lines.withColumns({"kind": kind, "src": F.when(kind == "edge", src), "dst": F.when(kind == "edge", dst)})


def parse_edge_list(lines: DataFrame, graph_id: str = "graph") -> Graph:
    """A graph from text lines (column value); self-loops stay until clean.remove_self_loops."""
    return from_edges(classify_lines(lines).filter("kind = 'edge'").select(F.lit(graph_id).alias("graph_id"), "src", "dst"))


def catalog_lines(known: DataFrame) -> DataFrame:
    """category and line: a catalog entry as a listing shows it."""
    grouped = lambda c, width: F.lpad(F.format_number(c, 0), width, " ")
    return known.select("category", F.concat(F.rpad("name", 20, " "), F.lit(" n~"), grouped("n", 7), F.lit("  m~"), grouped("m", 9), F.lit("  "), "description").alias("line"))


def described(spark: SparkSession, found: DataFrame) -> DataFrame:
    """found (name and more) with the catalog's category, n, m and description; a name that is not in it is its own description."""
    known = catalog(spark).select("name", "category", F.col("n").alias("catalog_n"), F.col("m").alias("catalog_m"), "description")
    joined = found.join(known, "name", "left")
    return joined.withColumns({"category": F.coalesce("category", F.lit("other")), "description": F.coalesce("description", "name")})


def read_edge_list(spark: SparkSession, path: str, graph_id: str | None = None) -> Graph:
    """A plain or gzip text file of any file system that Spark reads."""
    return parse_edge_list(spark.read.text(path), graph_id or os.path.basename(path))


# The catalog of public datasets, by category: name, vertices, edges (both approximate), description.
CATALOG = {
    "Collaboration Networks": [
        ("ca-GrQc", 5242, 14496, "General Relativity collaboration"),
        ("ca-HepTh", 9877, 25998, "High Energy Physics Theory collaboration"),
        ("ca-HepPh", 12008, 118521, "High Energy Physics Phenomenology"),
        ("ca-AstroPh", 18772, 198110, "Astrophysics collaboration"),
        ("ca-CondMat", 23133, 93497, "Condensed Matter collaboration"),
    ],
    "Social Networks": [
        ("ego-Facebook", 4039, 88234, "Facebook social circles"),
        ("ego-Gplus", 107614, 13673453, "Google+ social circles"),
        ("ego-Twitter", 81306, 1768149, "Twitter social circles"),
        ("soc-Epinions1", 75879, 508837, "Epinions trust network"),
        ("soc-Slashdot0811", 77360, 905468, "Slashdot social network"),
        ("soc-Slashdot0902", 82168, 948464, "Slashdot social network"),
    ],
    "Communication Networks": [
        ("email-Enron", 36692, 183831, "Enron email network"),
        ("email-EuAll", 265214, 420045, "EU email network"),
        ("wiki-Vote", 7115, 103689, "Wikipedia voting network"),
    ],
    "P2P Networks": [
        ("p2p-Gnutella04", 10876, 39994, "Gnutella P2P network"),
        ("p2p-Gnutella08", 6301, 20777, "Gnutella P2P network"),
        ("p2p-Gnutella09", 8114, 26013, "Gnutella P2P network"),
    ],
    "Product Networks": [
        ("amazon0302", 262111, 1234877, "Amazon product network"),
        ("amazon0312", 400727, 3200440, "Amazon product network"),
        ("amazon0505", 410236, 3356824, "Amazon product network"),
        ("amazon0601", 403394, 3387388, "Amazon product network"),
    ],
}
_RENAMED = {"ego-Facebook": "facebook_combined", "ego-Gplus": "gplus_combined", "ego-Twitter": "twitter_combined"}
DATA_URL = "https://snap.stanford.edu/data/"


def catalog(spark: SparkSession) -> DataFrame:
    """The dataset catalog: name, category, url, n, m, description."""
    rows = [(name, category, f"{DATA_URL}{_RENAMED.get(name, name)}.txt.gz", n, m, text) for category, group in CATALOG.items() for name, n, m, text in group]
    return spark.createDataFrame(rows, "name string, category string, url string, n long, m long, description string")


def read_graph(spark: SparkSession, name: str, cache_dir: str = "graph_cache", largest_component: bool = True, remove_self_loops: bool = True) -> Graph:
    """A catalogued dataset from <cache_dir>/<name>.txt.gz; files are put there from outside, nothing is downloaded."""
    from bramble.operators import clean

    names = [r["name"] for r in catalog(spark).select("name").collect()]
    if name not in names:
        raise ValueError(f"unknown dataset {name!r}; known are: {', '.join(names)}")
    path = f"{cache_dir.rstrip('/')}/{name}.txt.gz"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{path} is missing; fetch the dataset's url of the catalog into it")
    g = read_edge_list(spark, path, name)
    g = clean.remove_self_loops(g) if remove_self_loops else g
    return clean.largest_component(g) if largest_component else g
