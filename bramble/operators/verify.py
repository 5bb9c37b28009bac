"""Bound checks, ratios and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.functions import mark, ratio

DK_VARIANTS = ("dk_density", "dk_tail_degree", "dk_degeneracy")
ALPHA_VARIANTS = ("alpha_removal", "alpha_exact")


def verify(dk: DataFrame, alpha: DataFrame, dk_variant: str = "dk_degeneracy", alpha_variant: str = "alpha_exact", zero_policy: str = "inf") -> DataFrame:
    """graph_id, k, dk, alpha_k, lower_bound_ok, upper_bound_ok, ratio. The bounds dk <= alpha <= 2 dk are columns, not assertions; all NULL where alpha is unknown."""
    if dk_variant not in DK_VARIANTS or alpha_variant not in ALPHA_VARIANTS:
        raise ValueError(f"dk_variant is one of {DK_VARIANTS}, alpha_variant one of {ALPHA_VARIANTS}")
    both = dk.select("graph_id", "k", F.col(dk_variant).alias("dk")).join(alpha.select("graph_id", "k", F.col(alpha_variant).alias("alpha_k")), ["graph_id", "k"], "left")
    d, a = F.col("dk"), F.col("alpha_k")
    return both.select("graph_id", "k", F.when(a.isNotNull(), d).alias("dk"), "alpha_k", (d <= a).alias("lower_bound_ok"), (a <= 2 * d).alias("upper_bound_ok"), ratio(a, d, zero_policy).alias("ratio"))


def result_table(checked: DataFrame) -> DataFrame:
    """The rows of verify as a table of text: graph_id, k, dk, alpha_k, two_dk, ratio, lower, upper."""
    shown = F.when(F.col("ratio") == float("inf"), "inf").otherwise(F.format_string("%.3f", "ratio"))
    return checked.select("graph_id", "k", "dk", "alpha_k", (2 * F.col("dk")).alias("two_dk"), shown.alias("ratio"), mark(F.col("lower_bound_ok")).alias("lower"), mark(F.col("upper_bound_ok")).alias("upper"))


def ratio_summary(checked: DataFrame) -> DataFrame:
    """graph_id, min/max/mean/median ratio, n_infinite, all bounds, class."""
    r = F.col("ratio")
    kind = F.when(F.max(r) == 2.0, "worst case").when(F.max(r) == 1.0, "optimal").otherwise("neither")
    return (
        checked.filter(r.isNotNull())
        .groupBy("graph_id")
        .agg(
            F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"), F.avg(r).alias("mean_ratio"), F.median(r).alias("median_ratio"),
            F.count_if(r == float("inf")).alias("n_infinite"),
            F.every("lower_bound_ok").alias("all_lower_ok"), F.every("upper_bound_ok").alias("all_upper_ok"), kind.alias("class"),
        )
    )


def dk_summary(dk: DataFrame, variant: str = "dk_degeneracy") -> DataFrame:
    """graph_id, min_dk, max_dk, final_dk."""
    return dk.groupBy("graph_id").agg(F.min(variant).alias("min_dk"), F.max(variant).alias("max_dk"), F.max_by(variant, "k").alias("final_dk"))


def alpha_summary(alpha: DataFrame, variant: str = "alpha_exact") -> DataFrame:
    """graph_id, min_alpha, max_alpha, delta, trend (CONSTANT or VARYING)."""
    lo, hi = F.min(variant), F.max(variant)
    return alpha.filter(F.col(variant).isNotNull()).groupBy("graph_id").agg(lo.alias("min_alpha"), hi.alias("max_alpha"), (hi - lo).alias("delta"), F.when(lo == hi, "CONSTANT").otherwise("VARYING").alias("trend"))


def alpha_interval(dk: DataFrame, variant: str = "dk_degeneracy") -> DataFrame:
    """graph_id, alpha_lo, alpha_hi: [max dk, 2 max dk], for graphs without exact values."""
    return dk.groupBy("graph_id").agg(F.max(variant).alias("alpha_lo"), (2 * F.max(variant)).alias("alpha_hi"))


def max_ratio(checked: DataFrame) -> DataFrame:
    """graph_id, max_alpha, max_dk, max_alpha / max_dk."""
    return checked.groupBy("graph_id").agg(F.max("alpha_k").alias("max_alpha"), F.max("dk").alias("max_dk"), ratio(F.max("alpha_k"), F.max("dk")).alias("max_alpha_by_dk"))


def alpha_or_dk(dk: DataFrame, alpha: DataFrame, dk_variant: str = "dk_tail_degree") -> DataFrame:
    """graph_id, k, dk, alpha for k >= 1: dk stands in where alpha is unknown."""
    both = dk.filter("k >= 1").join(alpha.select("graph_id", "k", "alpha_exact"), ["graph_id", "k"], "left")
    return both.select("graph_id", "k", F.col(dk_variant).alias("dk"), F.coalesce("alpha_exact", dk_variant).alias("alpha"))


def ratio_histogram(checked: DataFrame, max_bins: int = 10) -> DataFrame:
    """graph_id, bin, bin_lo, bin_hi, count, mean, median: as many equal bins as distinct finite ratios, at most max_bins; the last one is closed."""
    finite = checked.filter(F.col("ratio").isNotNull() & (F.col("ratio") < float("inf")))
    shape = finite.groupBy("graph_id").agg(
        F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.least(F.lit(max_bins), F.countDistinct("ratio")).cast("int").alias("bins"), F.avg("ratio").alias("mean"), F.median("ratio").alias("median")
    )
    # Equal values form one bin of width 1 around them.
    shape = shape.select("graph_id", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "bins", "mean", "median")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    placed = finite.join(shape, "graph_id").select("graph_id", F.least(F.col("bins") - 1, F.floor((F.col("ratio") - F.col("lo")) / width)).cast("int").alias("bin"))
    counts = placed.groupBy("graph_id", "bin").agg(F.count("*").alias("count"))
    every = shape.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, ["graph_id", "bin"], "left").select(
        "graph_id", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), F.coalesce("count", F.lit(0)).alias("count"), "mean", "median"
    )
