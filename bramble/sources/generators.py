"""Standard and random graphs."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bramble.sources.graph import EDGES, Graph, canonical, from_edge_list

Pairs = list[tuple[int, int]]


def complete_pairs(n: int) -> Pairs:
    return list(combinations(range(n), 2))


def path_pairs(n: int) -> Pairs:
    return [(i, i + 1) for i in range(n - 1)]


def cycle_pairs(n: int) -> Pairs:
    return [*path_pairs(n), (0, n - 1)]


def star_pairs(leaves: int) -> Pairs:
    return [(0, i + 1) for i in range(leaves)]


def grid_pairs(rows: int, cols: int) -> Pairs:
    """Vertex (i, j) has number cols * i + j."""
    at = [(i, j) for i in range(rows) for j in range(cols)]
    return [(cols * i + j, cols * i + j + 1) for i, j in at if j + 1 < cols] + [(cols * i + j, cols * (i + 1) + j) for i, j in at if i + 1 < rows]


def circulant_pairs(n: int, steps: list[int]) -> Pairs:
    return sorted({tuple(sorted((i, (i + s) % n))) for i in range(n) for s in steps})


def cubical_pairs() -> Pairs:
    """Bit vectors of length 3, adjacent where one bit differs."""
    return [(a, a | 1 << b) for a in range(8) for b in range(3) if not a >> b & 1]


def petersen_pairs() -> Pairs:
    """Outer cycle 0-4, inner star 5-9, spokes."""
    return [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)]


def dodecahedral_pairs() -> Pairs:
    """A cycle of 20 with chords whose offsets repeat every five vertices."""
    offsets = (10, 7, 4, -4, -7, 10, -4, 7, -7, 4)
    return sorted({tuple(sorted(e)) for e in cycle_pairs(20)} | {tuple(sorted((i, (i + offsets[i % 10]) % 20))) for i in range(20)})


def chorded_cycle_pairs(n: int, chords: Pairs) -> Pairs:
    return [*cycle_pairs(n), *chords]


def preferential_pairs(n: int, m: int, seed: int = 0) -> Pairs:
    """Each new vertex takes m distinct partners, drawn in proportion to degree; it begins with a star of m leaves."""
    rng, pairs = random.Random(seed), star_pairs(m)
    ends = [v for e in pairs for v in e]
    for v in range(m + 1, n):
        partners: set[int] = set()
        while len(partners) < m:
            partners.add(rng.choice(ends))
        for p in sorted(partners):
            pairs.append((p, v))
            ends += [p, v]
    return pairs


#: Expected edges of a piece of the pairs.
_PIECE_EDGES = 100_000


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0, graph_id: str = "er") -> Graph:
    """Each pair is an edge with probability p. Pairs are numbered; pieces of them are drawn side by side, each from gap to gap, so the work follows the edges and not the pairs. The same on any cluster."""
    pairs = n * (n - 1) // 2
    size = max(1, min(pairs, int(_PIECE_EDGES / p))) if p > 0 else 1
    pieces = -(-pairs // size) if p > 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in b.column("id").to_pylist():
                begin, end = piece * size, min(pairs, (piece + 1) * size)
                rng = np.random.Generator(np.random.Philox(key=[seed, piece]))
                parts, last = [], begin - 1
                while last < end:
                    got = last + np.cumsum(rng.geometric(p, max(16, int((end - last) * p * 1.1))))
                    parts.append(got[got < end])
                    last = int(got[-1])
                at = np.concatenate(parts)
                # Number at = dst * (dst - 1) / 2 + src; the root is exact or one off.
                dst = ((1 + np.sqrt(8.0 * at + 1)) / 2).astype(np.int64)
                dst -= dst * (dst - 1) // 2 > at
                dst += (dst + 1) * dst // 2 <= at
                yield pa.RecordBatch.from_arrays([pa.array([graph_id] * len(at), pa.string()), pa.array(at - dst * (dst - 1) // 2), pa.array(dst)], names=["graph_id", "src", "dst"])

    edges = spark.range(pieces).mapInArrow(run, EDGES)
    vertices = spark.range(n).select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("vid"), F.col("id").cast("string").alias("label"))
    return Graph(vertices, edges)


#: name -> (family, vertices, edges) of the standard test graphs
FIXTURES: dict[str, tuple[str, int, Pairs]] = {
    **{f"K{n}": ("complete", n, complete_pairs(n)) for n in (4, 5, 6, 10)},
    **{f"C{n}": ("cycle", n, cycle_pairs(n)) for n in (5, 6, 7, 8, 15)},
    **{f"P{n}": ("path", n, path_pairs(n)) for n in (5, 6, 7, 10)},
    **{f"star{n}": ("star", n + 1, star_pairs(n)) for n in (5, 8)},
    "petersen": ("regular", 10, petersen_pairs()),
    "circulant6": ("regular", 6, circulant_pairs(6, [1, 2])),
    "cubical": ("regular", 8, cubical_pairs()),
    "dodecahedral": ("regular", 20, dodecahedral_pairs()),
    "grid3x3": ("grid", 9, grid_pairs(3, 3)),
    "C8_chords": ("chords", 8, chorded_cycle_pairs(8, [(0, 4), (2, 6)])),
    "C6_chords": ("chords", 6, chorded_cycle_pairs(6, [(0, 3), (1, 4)])),
    "two_edges": ("small", 4, [(0, 1), (2, 3)]),
    "single": ("small", 1, []),
    "lollipop": ("varied", 10, [*complete_pairs(5), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9)]),
    "two_dense": ("varied", 11, [*complete_pairs(5), *[(a + 5, b + 5) for a, b in complete_pairs(4)], (4, 5), (8, 9), (9, 10)]),
    "k4_isolated": ("varied", 7, complete_pairs(4)),
    "bound_break": ("varied", 7, [(0, 3), (0, 6), (1, 6), (2, 3), (2, 4), (2, 6), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)]),
    "tie_a": ("varied", 7, [(0, 6), (1, 2), (1, 4), (1, 5), (3, 4), (3, 6), (4, 5), (5, 6)]),
    "tie_b": ("varied", 7, [(6, 0), (5, 4), (5, 2), (5, 3), (1, 2), (1, 0), (2, 3), (3, 0)]),
    "atie_a": ("varied", 9, [(1, 7), (2, 3), (2, 8), (3, 5), (3, 8), (4, 5), (5, 8)]),
    "atie_b": ("varied", 9, [(2, 6), (5, 7), (4, 7), (1, 5), (4, 5), (0, 1), (1, 4)]),
}


def fixture_graphs(spark: SparkSession, names: list[str] | None = None) -> Graph:
    """Standard graphs as one multi-graph; graph_id is the name."""
    use = {k: FIXTURES[k] for k in (names or FIXTURES)}
    vertices = spark.createDataFrame([(k, v, str(v)) for k, (_, n, _) in use.items() for v in range(n)], "graph_id string, vid long, label string")
    edges = spark.createDataFrame([(k, a, b) for k, (_, _, e) in use.items() for a, b in e], "graph_id string, src long, dst long")
    return Graph(vertices, canonical(edges))


def make(spark: SparkSession, kind: str, **args) -> Graph:
    """A graph by kind: petersen, complete, cycle, path, star, grid, circulant, cubical, dodecahedral, random, preferential."""
    if kind == "random":
        return random_graph(spark, **args)
    makers = {
        "petersen": petersen_pairs, "complete": complete_pairs, "cycle": cycle_pairs, "path": path_pairs, "star": star_pairs, "grid": grid_pairs,
        "circulant": circulant_pairs, "cubical": cubical_pairs, "dodecahedral": dodecahedral_pairs, "preferential": preferential_pairs,
    }
    if kind not in makers:
        raise ValueError(f"unknown graph {kind!r}; known are: {', '.join(sorted([*makers, 'random']))}")
    return from_edge_list(spark, makers[kind](**args), graph_id=kind)
