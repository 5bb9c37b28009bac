"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. A text's set is its distinct word shingles as 64-bit hashes. One permutation fills
   all bins of its signature; empty bins borrow by optimal densification. Rows with the
   same full set (compared by a 128-bit digest) form a class; only its smallest id goes on.
2. Bands of the signature are buckets. A pair at the threshold shares some bucket with a
   probability of at least 1 - 1e-8.
3. In a bucket only star edges are made: its most central member with each other member.
   Links are confirmed on the full sets and contracted into components.
4. Stars could miss links between two other members. So while a bucket joins several
   components, its members are compared by what they differ in from their common hub: a link
   that leaves a component shares some of the first of these elements, in one order for all
   (the bound is in _prefixes). Only pairs that meet there, and could still share enough by the
   places where they met and by a bitmap of each, are confirmed. No link of a bucket is lost, and the pairs of a
   group are not enumerated.

Hot buckets and classes are pre-aggregated or met by joins whose large partitions Spark
splits; no group is gathered.

Defined results
- null text counts as empty; without words the set is empty, n_shingles 0 and the document is linked with nothing; with fewer words than a shingle has, the whole sequence is the one shingle.
- rows without doc_id are not linked: component_id null, kept true. Rows that repeat doc_id and text get the same result; of a doc_id with several texts each text is a document of its own.
- ties: the smallest doc_id of a component stays; drop_near_duplicates leaves one row of it. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import dropped, materialize
from bramble.operators.connect import connected

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MISS = 1e-8
_MAX_BINS = 512
_KEPT_WORDS = 400_000
_SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"


@dataclass(frozen=True)
class Params:
    """words per shingle; a link needs 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Most rows per band that leave room for enough bands: long bands keep texts apart that only share a passage."""
        return max([r for r in range(1, 17) if r * self._bands(r) <= _MAX_BINS], default=1)

    @property
    def bands(self) -> int:
        return self._bands(self.rows)

    def _bands(self, rows: int) -> int:
        """Bands for which a pair at the threshold shares none with a probability of at most _MISS."""
        hit = min(self.percent / 100, 1 - 1e-9) ** rows
        return max(1, math.ceil(math.log(_MISS) / math.log1p(-hit)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
@functools.cache
def _tries(bins: int, block: int) -> np.ndarray:
    """For each empty bin the bins it tries, one row for each of 32 attempts."""
    at = np.arange(32 * bins, dtype=np.uint64) + np.uint64(32 * bins * block + 1)
    return (_mix(at * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(32, bins)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z-lower-cased words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > _KEPT_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(hashes: np.ndarray, n_bins: int) -> np.ndarray:
    """Bin values of a non-empty set given as sorted hashes."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(n_bins)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(n_bins, dtype=np.uint64)
    full = np.zeros(n_bins, dtype=bool)
    filled = bins[first].astype(np.int64)
    out[filled], full[filled] = hashes[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        tries = _tries(n_bins, block)[:, empty]
        hit = full[tries]
        some = hit.any(axis=0)
        lender = tries[hit.argmax(axis=0), np.arange(len(empty))]
        out[empty[some]] = out[lender[some]]
        empty, block = empty[~some], block + 1
    return out


def band_hashes(sig: np.ndarray, p: Params) -> np.ndarray:
    rows = sig.reshape(p.bands, p.rows)
    out = np.arange(1, p.bands + 1, dtype=np.uint64)
    for i in range(p.rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def _lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, dtype)))


def signatures(docs: DataFrame, p: Params, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        for b in batches:
            sets = [shingles(t, p.words) for t in b.column("text").to_pylist()]
            sigs = [signature(s, p.bands * p.rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    _lists([none if s is None else band_hashes(s, p) for s in sigs], np.int64),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, _SIGNATURE)


def _digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def shingle_sets(docs: DataFrame, p: Params, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, p.words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets], np.int64)], names=["doc_id", "digest", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, digest binary, hashes array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    linked = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("i"), total.alias("t"))
    return linked.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * p.percent).select("a", "b")


def _hubs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, hub) of all buckets, and (hub, top): the hub of all buckets that a hub is in.

    A hub is the most central member, the one with the most places in common with others (the
    sizes of its buckets summed), so that most of a group of copies links to few hubs. A hub is a
    struct (central, minus, id, n).
    """
    central = rows.groupBy("id").agg(F.sum("size").alias("central"))
    central = rows.join(central, "id").select("bucket", "id", F.struct("central", (-F.col("id")).alias("minus"), "id", "n").alias("own"))
    hubs = materialize(central.groupBy("bucket").agg(F.max("own").alias("hub")), "hubs")
    chosen = hubs.select(F.col("hub.id").alias("id")).distinct()
    tops = rows.join(chosen, "id").join(hubs, "bucket").groupBy("id").agg(F.max("hub").alias("top")).filter("id <> top.id")
    return hubs, materialize(tops, "tops")


def _prefixes(cells: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The elements by which a member differs from its hub, as far as a link across components must share one of them.

    c shared elements of two differences of a and b elements leave a + b - 2 c between the texts,
    so a link needs 2 q c >= q (a + b) - r (n + n'), with q = 100 + percent and r = 100 - percent.
    All differences are in one order (what the hub lacks, then what the member lacks, by hash);
    two that share c elements share one among the first a - c + 1 and b - c + 1 of them.
    ``near`` is that length beside any member that is not linked to the hub, ``far`` beside any
    member, for one that is not linked itself. Two that are both linked to the hub need no test.
    ``bits0`` to ``bits3`` are a bit for each difference: two texts differ in at least as many
    elements as these bits do.
    """
    q, r = 100 + p.percent, 100 - p.percent
    left = sets.select(F.col("doc_id").alias("hub"), F.col("hashes").alias("hub_set"))
    right = sets.select(F.col("doc_id").alias("id"), F.col("hashes").alias("own_set"))
    both = cells.join(right, "id").join(left, "hub")
    both = both.select("hub", "id", "n", "hub_n", "component", F.concat(F.array_except("own_set", "hub_set"), F.array_except("hub_set", "own_set")).alias("differ"))
    both = both.withColumn("d", F.size("differ").cast("long")).withColumn("linked", F.expr(f"{q} * d <= {r} * (n + hub_n)"))
    both = both.withColumn("near", F.expr(f"d - ({q} * d + {r} * (hub_n - n)) div {2 * q}"))
    both = both.withColumn("far", F.expr(f"CASE WHEN linked THEN near ELSE greatest(near, d - ({q} * d - {r} * (n + hub_n) + {2 * q - 1}) div {2 * q} + 1) END"))
    kept = ["hub", "id", "n", "component", "d", "linked", "near"]
    bits = [F.expr(f"aggregate(differ, 0L, (m, e) -> IF((shiftrightunsigned(e, 6) & 3L) = {k}, m | shiftleft(1L, CAST(e & 63L AS INT)), m))").alias(f"bits{k}") for k in range(4)]
    return both.select(*kept, *bits, F.posexplode(F.slice("differ", F.lit(1), F.col("far").cast("int"))).alias("place", "element"))


def _across(rows: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) across components that may be links, from the rows of _prefixes."""
    q, r = 100 + p.percent, 100 - p.percent
    mixed = rows.groupBy("hub", "element").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("linked").alias("all_linked"))
    rows = materialize(rows.join(mixed.filter("low < high AND NOT all_linked").select("hub", "element"), ["hub", "element"], "left_semi"), "shared")
    x = rows.filter("NOT linked").alias("x")
    y = rows.filter("place < near").alias("y")
    apart = " + ".join(f"bit_count(x.bits{k} ^ y.bits{k})" for k in range(4))
    met = x.join(
        y,
        F.expr(
            f"""x.hub = y.hub AND x.element = y.element AND x.component <> y.component
            AND (y.linked OR (x.id < y.id AND x.place < x.near))
            AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {p.percent}
            AND {2 * q} * least(x.d - x.place, y.d - y.place) >= {q} * (x.d + y.d) - {r} * (x.n + y.n)
            AND {q} * ({apart}) <= {r} * (x.n + y.n)"""
        ),
    )
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _classes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """class_digest, class_id (its smallest doc_id), id, n, bands; and whether id is another number for some, where texts of one doc_id make several classes."""
    by_set = signed.groupBy(F.col("digest").alias("class_digest")).agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    by_set = materialize(by_set, "classes")
    shared = materialize(by_set.groupBy("class_id").agg(F.min("class_digest").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("class_id", "lead"), "shared-ids")
    if shared.isEmpty():
        return by_set.withColumn("id", F.col("class_id")), False
    other = by_set.join(shared, "class_id", "left").withColumn("id", F.when(F.col("lead") != F.col("class_digest"), F.xxhash64("class_digest")).otherwise(F.col("class_id")))
    return materialize(other.drop("lead"), "classes"), True


def links(docs: DataFrame, classes: DataFrame, renamed: bool, p: Params, text: str = "text") -> DataFrame:
    """Confirmed links between classes, enough to connect what is connected."""
    rows = classes.select("id", "n", F.explode("bands").alias("bucket"))
    # Stored, so that the join below has an exchange on either side and Spark can split it at a large bucket.
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    sizes = materialize(sizes.select("bucket", "size"), "bucket-sizes")
    rows = materialize(rows.join(sizes, "bucket"), "buckets")
    dropped(sizes)
    inside = rows.select("id").distinct()
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    if renamed:
        inside = materialize(classes.join(inside, "id", "left_semi").select("id", "class_id", "class_digest"), "inside")
        sets = shingle_sets(once.join(inside.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), p)
        sets = sets.join(inside, [sets["doc_id"] == inside["class_id"], sets["digest"] == inside["class_digest"]]).select(F.col("id").alias("doc_id"), "hashes")
    else:
        sets = shingle_sets(once.join(inside.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), p).select("doc_id", "hashes")
    sets = materialize(sets, "sets")

    central, tops = _hubs(rows)
    # A hub that links to a more central one leaves its bucket to that: fewer hubs for a member of many buckets.
    moved = materialize(_confirm(tops.select(F.col("top.id").alias("a"), F.col("id").alias("b")), sets, p), "moved")
    to = tops.join(moved.select(F.col("b").alias("id")), "id", "left_semi").select(F.col("id").alias("from"), "top")
    hubs = central.join(to, F.col("hub.id") == F.col("from"), "left").select("bucket", F.coalesce("top", "hub").alias("hub"))
    others = rows.join(hubs, "bucket").select("bucket", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")).filter("id <> hub")
    others = materialize(others, "members")
    dropped(rows, central, tops, moved)
    may_link = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * p.percent
    star = others.filter(may_link).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    found = materialize(_confirm(star, sets, p), "links")
    comps = connected(found).select("id", "component")
    placed = others.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    cells = placed.join(split.select("bucket"), "bucket", "left_semi").select("hub", "id", "n", "hub_n", "component").distinct()
    prefixes = materialize(_prefixes(cells, sets, p), "prefixes")
    dropped(others)
    every = materialize(found.union(_confirm(_across(prefixes, p), sets, p)), "links")
    dropped(prefixes, found, sets)
    return every


def _placed(docs: DataFrame, p: Params, text: str) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component (the smallest doc_id; the row's own if it is linked to none, null without doc_id), group.

    group tells components apart, which may have the same smallest doc_id where that has several texts; null without words or doc_id.
    """
    signed = materialize(signatures(docs, p, text), "signatures")
    usable = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes, renamed = _classes(usable)
    comps = connected(links(docs, classes, renamed, p, text))
    of_class = classes.join(comps, "id", "left").select("class_digest", "class_id", F.coalesce("component", "id").alias("group"))
    if renamed:  # the smallest id of a component need not be its smallest doc_id
        of_class = materialize(of_class, "class-components")
        of_class = of_class.join(materialize(of_class.groupBy("group").agg(F.min("class_id").alias("component")), "least"), "group").select("class_digest", "component", "group")
    else:
        of_class = of_class.select("class_digest", F.col("group").alias("component"), "group")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("class_digest"), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"), F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    placed = _placed(docs, p, text)
    return placed.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each component, and every row without doc_id or without words."""
    placed = materialize(_placed(docs, p, text).filter("group IS NOT NULL").select("doc_id", "text_hash", "group"), "placed")
    row = F.struct("doc_id", "text_hash")
    leads = materialize(placed.groupBy("group").agg(F.min(row).alias("lead"), F.count("*").alias("rows")).filter("rows > 1"), "leads")
    members = placed.join(leads, "group")
    gone = members.filter(row != F.col("lead")).select("doc_id", "text_hash").distinct()
    repeated = materialize(members.filter(row == F.col("lead")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return _without(docs, gone, text, "left_anti")
    one = _without(docs, repeated, text, "left_semi").withColumn("_body", F.coalesce(F.col(text), F.lit(""))).dropDuplicates(["doc_id", "_body"])
    return _without(docs, gone.union(repeated), text, "left_anti").unionByName(one.select(*docs.columns))


def _without(docs: DataFrame, rows: DataFrame, text: str, how: str) -> DataFrame:
    rows = rows.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    same = (docs["doc_id"].cast("long") == rows["_doc_id"]) & (F.xxhash64(docs[text]) == rows["_text_hash"])
    return docs.join(rows.hint("shuffle_hash"), same, how).select(*docs.columns)
