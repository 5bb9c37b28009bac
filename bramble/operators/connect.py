"""Connected components by contraction, in a number of rounds that grows with the logarithm of the vertices.

In each round every vertex points to the neighbour (or itself) that comes first in an order drawn
anew for the round, by a hash; pointers are followed twice, and edges move to where their ends
point. A chain shrinks to a constant share of its length whatever its numbering. Each round's
pointers are a stored table, smaller from round to round; in the end labels are carried back
through them. Once LOCAL_EDGES edges or fewer are left, one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.sources.store import dropped, stored

#: A task holds this many edges in dictionaries (about 200 MB).
LOCAL_EDGES = 400_000


def _round(edges: DataFrame, keys: list[str], number: int) -> tuple[DataFrame, DataFrame]:
    """The pointers (keys, id, to) of all ends, and the edges that are left."""
    both = edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select(*keys, "b", "a"))
    drawn = lambda c: F.struct(F.xxhash64(F.lit(number), *keys, c).alias("at"), F.col(c).alias("id"))
    first = stored(both.groupBy(*keys, "id").agg(F.min(drawn("other")).alias("m")).select(*keys, "id", F.least(F.col("m"), drawn("id"))["id"].alias("to")), "pointers")
    then = first.select(*keys, F.col("id").alias("to"), F.col("to").alias("to2"))
    to = stored(first.join(then, [*keys, "to"]).select(*keys, "id", F.col("to2").alias("to")), "pointers")
    dropped(first)
    a, b = to.select(*keys, F.col("id").alias("a"), F.col("to").alias("a2")), to.select(*keys, F.col("id").alias("b"), F.col("to").alias("b2"))
    left = edges.join(a, [*keys, "a"]).join(b, [*keys, "b"]).filter("a2 <> b2").select(*keys, F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
    return to, stored(left.distinct(), "edges")


def _finish(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) of the last edges, in one task."""
    fields = [edges.schema[c] for c in (*keys, "a")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in (*keys, "a", "a")]
            *group, a, b = (batch.column(c).to_pylist() for c in (*keys, "a", "b"))
            for *key, x, y in zip(*group, a, b, strict=True):
                x, y = find((*key, x)), find((*key, y))
                parent[max(x, y)] = min(x, y)
        if parent:
            rows = [(*x, find(x)[-1]) for x in parent]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*keys, "id", "root"])

    kinds = [f.dataType.simpleString() for f in fields]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip((*keys, "id", "root"), (*kinds, kinds[-1]), strict=True))
    return edges.select(*keys, "a", "b").coalesce(1).mapInArrow(run, schema)


def connected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, component) of all ids in edges (keys, a, b); the component is its smallest id. Edges with equal or null ends are left out; edges may repeat; keys are not null."""
    keys = list(keys)
    edges = stored(edges.select(*keys, "a", "b").filter("a <> b"), "edges")
    passed: list[DataFrame] = []
    while edges.count() > LOCAL_EDGES:
        to, fewer = _round(edges, keys, len(passed))
        dropped(edges)
        edges = fewer
        passed.append(to)
    found = stored(_finish(edges, keys), "roots")
    dropped(edges)
    # Pointers of a round lead to ids that later rounds point on from, or to roots.
    for to in reversed(passed):
        further = found.select(*keys, F.col("id").alias("to"), "root")
        nearer = stored(to.join(further, [*keys, "to"], "left").select(*keys, "id", F.coalesce("root", "to").alias("root")), "roots")
        dropped(found, to)
        found = nearer
    if not passed:
        return found.select(*keys, "id", F.col("root").alias("component"))
    least = stored(found.groupBy(*keys, "root").agg(F.min("id").alias("component")), "least")  # stored, so that the join can be split at a large component
    return found.join(least, [*keys, "root"]).select(*keys, "id", "component")
