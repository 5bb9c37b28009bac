"""Chart data: the tables behind each chart, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.functions import ratio
from bramble.operators import verify as v


def alpha_lines(dk: DataFrame, alpha: DataFrame, dk_variant: str = "dk_tail_degree", alpha_variant: str = "alpha_removal") -> DataFrame:
    """graph_id, k, dk, alpha, band_lo, band_hi: the lines and the band [dk, 2 dk]."""
    both = dk.join(alpha.select("graph_id", "k", alpha_variant), ["graph_id", "k"], "left")
    d = F.col(dk_variant)
    return both.select("graph_id", "k", d.alias("dk"), F.col(alpha_variant).alias("alpha"), d.alias("band_lo"), (2 * d).alias("band_hi"))


def quality_line(points: DataFrame, zero_policy: str = "zero") -> DataFrame:
    """graph_id, k, ratio with the reference lines 1 and 2, from columns dk and alpha."""
    return points.select("graph_id", "k", ratio(F.col("alpha"), F.col("dk"), zero_policy).alias("ratio"), F.lit(1.0).alias("line_lo"), F.lit(2.0).alias("line_hi"))


def scatter(checked: DataFrame) -> DataFrame:
    """graph_id, dk, alpha, k."""
    return checked.filter(F.col("alpha_k").isNotNull()).select("graph_id", "dk", F.col("alpha_k").alias("alpha"), "k")


def dk_panel(dk: DataFrame, variant: str = "dk_density") -> DataFrame:
    """graph_id, k, dk, min_dk, max_dk, final_dk."""
    return dk.select("graph_id", "k", F.col(variant).alias("dk")).join(v.dk_summary(dk, variant), "graph_id")


def configured(dk: DataFrame, alpha: DataFrame, dk_variant: str = "dk_degeneracy", alpha_variant: str = "alpha_exact") -> DataFrame:
    """graph_id, k, alpha, dk, label, min_alpha, max_alpha, delta, trend."""
    points = dk.select("graph_id", "k", F.col(dk_variant).alias("dk")).join(alpha.select("graph_id", "k", F.col(alpha_variant).alias("alpha")), ["graph_id", "k"])
    return points.select("graph_id", "k", "alpha", "dk", F.format_string("α=%d, d=%d", "alpha", "dk").alias("label")).join(v.alpha_summary(alpha, alpha_variant), "graph_id")


def correlation(dk: DataFrame, alpha: DataFrame, dk_variant: str = "dk_degeneracy") -> DataFrame:
    """graph_id, k, dk, alpha, band_lo, band_hi, alpha_lo, alpha_hi: lines, band and interval box."""
    return alpha_lines(dk, alpha, dk_variant, "alpha_exact").join(v.alpha_interval(dk, dk_variant), "graph_id")


# Where an information box stands, as shares of width and height.
BOX_POSITIONS = {"upper left": (0.02, 0.98), "upper right": (0.98, 0.98), "lower left": (0.02, 0.02), "lower right": (0.98, 0.02)}


def info_box(summary: DataFrame, position: str = "upper left") -> DataFrame:
    """The rows of verify.alpha_summary with the place of their box: x, y, horizontal and vertical alignment. An unknown position is the upper left."""
    x, y = BOX_POSITIONS.get(position, BOX_POSITIONS["upper left"])
    sides = {"x": F.lit(x), "y": F.lit(y), "align": F.lit("left" if "left" in position else "right"), "valign": F.lit("top" if "upper" in position else "bottom")}
    return summary.withColumns(sides)


def four_panels(dk: DataFrame, alpha: DataFrame, checked: DataFrame) -> dict[str, DataFrame]:
    """The tables of the four-panel chart."""
    lines = alpha_lines(dk, alpha, "dk_degeneracy", "alpha_exact")
    return {"lines": lines, "ratio": quality_line(lines, "inf"), "scatter": scatter(checked), "histogram": v.ratio_histogram(checked)}


def file_name(graph: str, kind: str = "alpha_k_correlation", configured_name: str = "", ending: str = "parquet") -> str:
    """<graph>_<kind>.<ending>, or the configured name; spaces and slashes become underscores."""
    stem = configured_name or f"{graph.replace(' ', '_').replace('/', '_')}_{kind}"
    return stem if stem.lower().endswith(f".{ending}") else f"{stem}.{ending}"


def write_chart(df: DataFrame, directory: str, name: str, ending: str = "parquet") -> str:
    """Writes chart data as parquet or csv; returns the path."""
    path = f"{directory.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    writer.parquet(path) if ending == "parquet" else writer.option("header", True).csv(path)
    return path
