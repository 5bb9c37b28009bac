"""Analysis of any number of graphs in one run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.operators import clean, density, exact, peel, stats, verify
from bramble.sources import generators
from bramble.sources.graph import Graph, read_edge_list, read_graph
from bramble.sources.store import stored


@dataclass(frozen=True)
class Analysis:
    """The tables of one run; every one has graph_id."""

    trace: DataFrame
    dk: DataFrame
    alpha: DataFrame
    checked: DataFrame

    @property
    def ratios(self) -> DataFrame:
        return verify.ratio_summary(self.checked)

    def across(self) -> DataFrame:
        """One row per graph: ratio figures where alpha is known, else least and greatest dk."""
        dk = self.dk.groupBy("graph_id").agg(F.min("dk_degeneracy").alias("min_dk"), F.max("dk_degeneracy").alias("max_dk"))
        return dk.join(self.ratios.select("graph_id", "mean_ratio", "min_ratio", "max_ratio"), "graph_id", "left")


def load(spark: SparkSession, source: str, **args) -> Graph:
    """source: 'catalog' (name=...), 'file' (path=...) or 'synthetic' (kind=..., and what the generator takes)."""
    if source == "catalog":
        return read_graph(spark, **args)
    if source == "file":
        return read_edge_list(spark, **args)
    if source == "synthetic":
        return generators.make(spark, **args)
    raise ValueError(f"unknown source {source!r}; known are: catalog, file, synthetic")


def alpha_table(g: Graph, trace: DataFrame, max_exact_n: int = exact.DEFAULT_MAX_N) -> DataFrame:
    """graph_id, k, alpha_removal, alpha_exact (NULL beyond max_exact_n vertices)."""
    return density.alpha_removal(trace).join(exact.alpha_exact(g, max_exact_n), ["graph_id", "k"], "left")


def analyze(g: Graph, k_min: int = 0, k_max: int | None = None, max_exact_n: int = exact.DEFAULT_MAX_N, dk_variant: str = "dk_degeneracy", alpha_variant: str = "alpha_exact", zero_policy: str = "inf") -> Analysis:
    """Peels once and derives everything; only k from k_min to min(k_max, n - 1)."""
    trace = stored(peel.peel_trace(g), "trace")
    wanted = clean.k_range(g.vertices, k_min, k_max)
    dk = stored(density.dk_all(trace).join(wanted, ["graph_id", "k"], "left_semi"), "dk")
    alpha = stored(alpha_table(g, trace, max_exact_n).join(wanted, ["graph_id", "k"], "left_semi"), "alpha")
    return Analysis(trace, dk, alpha, verify.verify(dk, alpha, dk_variant, alpha_variant, zero_policy))


def report(g: Graph, k: int = 0) -> DataFrame:
    """One row per graph at one k: size, d_k, exact alpha, ratio and witness."""
    trace = stored(peel.peel_trace(g), "trace")
    checked = verify.verify(density.dk_all(trace), exact.alpha_exact(g)).filter(F.col("k") == k)
    return stats.size(g).join(density.witness_report(g, trace, k).drop("avg_degree"), "graph_id", "left").join(checked.select("graph_id", "alpha_k", "ratio"), "graph_id", "left")


def compare_peels(g: Graph) -> dict:
    """Times the grouped peel against the rounds of core_numbers, and whether their dk_degeneracy agree."""
    start = time.perf_counter()
    one = stored(density.dk_all(peel.peel_trace(g)).select("graph_id", "k", "dk_degeneracy"), "one")
    middle = time.perf_counter()
    two = stored(peel.dk_degeneracy_from_cores(peel.core_numbers(g)), "two")
    end = time.perf_counter()
    same = one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    return {"peel_s": middle - start, "rounds_s": end - middle, "speedup": (end - middle) / max(middle - start, 1e-9), "equal": same}
