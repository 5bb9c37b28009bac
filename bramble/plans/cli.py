"""Command line: python -m bramble.plans.cli list | stats | report ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from bramble.operators import charts, clean, stats, verify
from bramble.plans import api, config
from bramble.sources.graph import catalog, read_edge_list, read_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bramble")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the dataset catalog")
    for name, text in (("stats", "statistics of a graph"), ("report", "d_k and alpha_k of a graph")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--graph", help="a catalog name, or a file with --file")
        s.add_argument("--file", action="store_true", help="--graph is the path of an edge list")
        s.add_argument("--cache-dir", default="graph_cache")
        if name == "report":
            s.add_argument("--config", help="a YAML file")
            s.add_argument("--max-k", type=int)
            s.add_argument("--out", help="where the chart table goes; the configuration's output_dir by default")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("bramble").getOrCreate()
    if args.command == "list":
        catalog(spark).orderBy("category", "name").show(100, truncate=False)
        return
    settings = config.load(getattr(args, "config", None), args.graph)
    g = read_edge_list(spark, settings.graph.name) if args.file else read_graph(spark, settings.graph.name, args.cache_dir)
    if args.command == "stats":
        stats.graph_stats(g).show(truncate=False)
        return
    n = g.vertices.count()
    last = min(n - 1, args.max_k) if args.max_k is not None else settings.k_max(n)
    found = api.analyze(g, k_max=last, max_exact_n=settings.computation.max_nodes_for_exact)
    if settings.computation.print_table:
        clean.shown(verify.result_table(found.checked)).orderBy("k").show(100, truncate=False)
    name = charts.file_name(settings.graph.name, configured_name=settings.output.filename, ending=settings.output.format)
    charts.write_chart(charts.configured(found.dk, found.alpha), args.out or settings.output.output_dir, name, settings.output.format)


if __name__ == "__main__":
    main()
