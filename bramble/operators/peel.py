"""Minimum-degree peeling, and core numbers by rounds.

The peel removes, again and again, the vertex of least (degree, vid). This order is
sequential, so one task holds one graph; many graphs run side by side. All that can be split
is done before: neighbours are sorted and packed to arrays by many tasks, and the last one keeps
them in a file on its local disk, of which it reads each vertex's part once, when the vertex goes.
Its memory grows with the vertices only, so there is no limit on edges. The rounds of
core_numbers are joins and aggregates; they give dk_degeneracy for every k.
"""

from __future__ import annotations

import heapq
import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.sources.graph import Graph
from bramble.sources.store import dropped, stored

TRACE = "graph_id string, step long, vid long, vertices_before long, edges_before long, deg_at_removal long"
_PACKED = "graph_id string, ends binary, counts binary, others binary"
_PACK = 1024  # neighbours in a packed row: 10,000 rows, an Arrow batch, are at most 250 MB
_ROWS = 100_000
_SPAN = 100_000


def _removals(left: np.ndarray, near: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Removal order of vertices 0..n-1 with degrees `left`, which is used up, and the degree of each when it goes; near(v) gives all neighbours of v."""
    n = len(left)
    order, at = np.empty(n, np.int64), np.empty(n, np.int64)
    # The heap holds the living vertices of at most `level` neighbours, one number for (degree, vertex); others wait until none of these is left.
    heap, living, level = [], np.arange(n), -1
    for step in range(n):
        while True:
            if not heap:
                living = living[left[living] >= 0]
                level = int(left[living].min())
                heap = (level * n + living[left[living] == level]).tolist()  # in order, so a heap
            d, v = divmod(heapq.heappop(heap), n)
            if left[v] == d:  # else an entry that a later one replaced, or a removed vertex
                break
        order[step], at[step] = v, d
        left[v] = -1
        if not d:
            continue
        others = near(v)
        others = others[left[others] > 0]
        fewer = left[others] - 1
        left[others] = fewer
        low = fewer <= level
        if low.any():
            for entry in (fewer[low] * n + others[low]).tolist():
                heapq.heappush(heap, entry)
            if len(heap) > 2 * (n - step) + 64:  # mostly replaced entries: a heap of the living only
                living = living[left[living] >= 0]
                low = living[left[living] <= level]
                heap = (left[low] * n + low).tolist()
                heapq.heapify(heap)
    return order, at


def peel_order(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removal order of vertices 0..n-1 and the degree of each when it goes."""
    ends, others = np.concatenate([src, dst]), np.concatenate([dst, src])
    others = others[np.argsort(ends, kind="stable")]
    degree = np.bincount(ends, minlength=n)
    starts = np.append(0, np.cumsum(degree))
    return _removals(degree, lambda v: others[starts[v] : starts[v + 1]])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (graph_id, u, v) sorted by u, v NULL for the vertex itself: arrays of u, of the number of their neighbours in this row, and of these."""
    for batch in batches:
        ids = batch.column("graph_id").dictionary_encode()
        code, u = ids.indices.to_numpy(), batch.column("u").to_numpy()
        v, lone = batch.column("v").fill_null(0).to_numpy(), batch.column("v").is_null().to_numpy(zero_copy_only=False)
        by = np.lexsort((u, code))
        code, u, v, lone = code[by], u[by], v[by], lone[by]
        rows = []
        for group in np.split(np.arange(len(by)), np.flatnonzero(np.diff(code)) + 1):
            for at in range(0, len(group), _PACK):
                some = group[at : at + _PACK]
                ends, first = np.unique(u[some], return_index=True)
                counts = np.add.reduceat((~lone[some]).astype(np.int64), first)
                rows.append((ids.dictionary[int(code[some[0]])].as_py(), ends.tobytes(), counts.tobytes(), v[some][~lone[some]].tobytes()))
        if rows:
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["graph_id", "ends", "counts", "others"])


def _trace(name: str | None, ends: np.ndarray, counts: np.ndarray, others: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The removals of one graph from the pieces of its vertices: `others` has counts[i] neighbours of ends[i], piece after piece."""
    vids, piece = np.unique(ends, return_inverse=True)
    n = len(vids)
    for at in range(0, len(others), 1 << 20):
        others[at : at + (1 << 20)] = np.searchsorted(vids, others[at : at + (1 << 20)])
    degree = np.zeros(n, np.int64)
    np.add.at(degree, piece, counts)
    stops = np.cumsum(counts)
    filled = np.flatnonzero(counts)
    filled = filled[np.argsort(piece[filled], kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(piece[filled], minlength=n)))
    start, stop = (stops - counts)[filled], stops[filled]
    del piece, stops, filled

    def near(v: int) -> np.ndarray:
        a, b = first[v], first[v + 1]
        return others[start[a] : stop[a]] if b == a + 1 else np.concatenate([others[start[i] : stop[i]] for i in range(a, b)])

    order, degree = _removals(degree, near)
    m = len(others) // 2
    before = m - np.cumsum(degree) + degree
    for a in range(0, n, _ROWS):
        b = min(n, a + _ROWS)
        yield pa.RecordBatch.from_pydict({
            "graph_id": pa.array([name] * (b - a), pa.string()), "step": np.arange(a + 1, b + 1), "vid": vids[order[a:b]],
            "vertices_before": n - np.arange(a, b), "edges_before": before[a:b], "deg_at_removal": degree[a:b],
        })


def _peel(max_edges: int | None):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, counts, size = [], [], 0
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for e, c, o in zip(batch.column("ends"), batch.column("counts"), batch.column("others"), strict=True):
                    ends.append(np.frombuffer(e.as_buffer(), np.int64).copy())
                    counts.append(np.frombuffer(c.as_buffer(), np.int64).copy())
                    size += file.write(o.as_buffer())
                if max_edges is not None and size > 16 * max_edges:  # both ends of an edge, of 8 bytes each
                    raise ValueError(f"graph {key[0].as_py()!r} has more than {max_edges} edges, which one task should not hold; use core_numbers")
            file.flush()
            others = np.frombuffer(mmap.mmap(file.fileno(), size), np.int64) if size else np.empty(0, np.int64)
            if ends:
                yield from _trace(key[0].as_py(), np.concatenate(ends), np.concatenate(counts), others)

    return run


def peel_trace(g: Graph, max_edges: int | None = None) -> DataFrame:
    """One row per removal. Edges must be simple (see Graph.validate). A graph of more than max_edges edges is an error where that is set."""
    lone = g.vertices.select("graph_id", F.col("vid").alias("u"), F.lit(None).cast("long").alias("v"))
    rows = g.symmetric().union(lone).repartition("graph_id", "u").sortWithinPartitions("u")
    return rows.mapInArrow(_pack, _PACKED).groupBy("graph_id").applyInArrow(_peel(max_edges), TRACE)


def core_numbers(g: Graph) -> DataFrame:
    """graph_id, vid, core: every round lowers each estimate to the h-index of its neighbours' until nothing changes.

    Neighbours' estimates are pre-aggregated to counts per value, so no neighbour list is gathered.
    """
    from pyspark.sql import Window

    both = stored(g.symmetric(), "symmetric")
    deg = both.groupBy("graph_id", F.col("u").alias("vid")).agg(F.count("*").alias("core"))
    now = stored(g.vertices.select("graph_id", "vid").join(deg, ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("core", F.lit(0)).alias("core")), "core")
    old = now
    down = Window.partitionBy("graph_id", "u").orderBy(F.desc("c"))
    while True:
        seen = both.join(now.select("graph_id", F.col("vid").alias("v"), F.col("core").alias("c_v")), ["graph_id", "v"])
        own = now.select("graph_id", F.col("vid").alias("u"), F.col("core").alias("c_u"))
        seen = seen.join(own, ["graph_id", "u"]).groupBy("graph_id", "u", F.least("c_u", "c_v").alias("c")).agg(F.count("*").alias("n"))
        h = seen.withColumn("upto", F.sum("n").over(down)).groupBy("graph_id", F.col("u").alias("vid")).agg(F.max(F.least("c", "upto")).alias("h"))
        new = now.join(h, ["graph_id", "vid"], "left").select("graph_id", "vid", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("moved"))
        new = stored(new, "core")
        dropped(old)
        old, now = new, new.select("graph_id", "vid", "core")
        if new.filter("moved").isEmpty():
            dropped(both)
            return now


def dk_degeneracy_from_cores(cores: DataFrame) -> DataFrame:
    """graph_id, k, dk_degeneracy: the (n - k)-th smallest core number. Ranges of k come from counts by core number; no vertex is ranked."""
    from pyspark.sql import Window

    counts = cores.groupBy("graph_id", "core").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("graph_id").orderBy(F.desc("core")))
    spans = counts.select("graph_id", F.col("core").alias("dk_degeneracy"), (upto - F.col("n")).alias("first"), upto.alias("end"))
    # Long spans are cut before they are written out, so that a core of very many vertices is spread over tasks.
    pieces = spans.select("graph_id", "dk_degeneracy", "end", F.explode(F.sequence("first", F.col("end") - 1, F.lit(_SPAN).cast("long"))).alias("first"))
    return pieces.select("graph_id", F.explode(F.sequence("first", F.least(F.col("first") + _SPAN, "end") - 1)).alias("k"), "dk_degeneracy")
