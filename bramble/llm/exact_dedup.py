"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each source partition sorts the 48-bit fingerprints of its texts and sends
   them to their owners (ranges of the fingerprint space) as Golomb-Rice codes
   of the gaps; row ids, fingerprints and digests go to the shared folder.
2. An owner decodes what all sources sent, and answers each with a bitmap: which
   of its fingerprints some other source has as well.
3. The sources turn bitmaps into suspects (fingerprints that are also repeated
   within one source count too). Only texts with suspect fingerprints are shuffled;
   grouping them by their bytes decides what is equal.
4. Every row gets the group of its text.

A fingerprint or copy that a third of all rows share is sent once per source and
pre-aggregated to one row per map task. The groups are stored before they meet the rows
again: so that join has an exchange on either side, and Spark splits its large partitions.

Defined results
- null text counts as empty, and all empty texts are equal.
- of equal texts the row with the largest doc_id stays; null ids only stay where a group has no other. Rows that repeat doc_id and text are one document: all carry the same flags. drop_duplicates leaves one of them, and every row without doc_id.
- an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import materialize, partitions

_BITS = 48
#: A source is a partition, or each so many rows of a large one.
SOURCE_ROWS = 1_000_000
#: Rows whose fingerprints one owner holds.
OWNER_ROWS = 4_000_000
#: Up to so many suspect fingerprints (8 bytes each) are broadcast to filter the texts; more are joined by a shuffle.
BROADCAST_SUSPECTS = 1_000_000


def golomb_encode(values: np.ndarray, least: int = 0) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct values from ``least`` on: the remainder's width, and all remainders followed by all unary quotients."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(least))
    k = max(0, int(np.log2(max(1.0, float(values[-1] - np.uint64(least)) / len(values)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    unary = np.ones(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    return k, np.packbits(np.concatenate([low, unary])).tobytes()


def golomb_decode(n: int, k: int, code: bytes, least: int = 0) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    low = bits[: n * k].reshape(n, k).astype(np.uint64)
    gaps = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, dtype=np.uint64)
    ends = np.flatnonzero(bits[n * k :] == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    return np.cumsum(gaps + (quotients.astype(np.uint64) << np.uint64(k)), dtype=np.uint64) + np.uint64(least)


def least_of(owner: int, owners: int) -> int:
    """The least fingerprint of an owner; all have equal ranges."""
    return -(-(owner << _BITS) // owners)


_SENT = "src long, owner int, n int, k int, code binary, doc_id {id}, fp long, sha binary"
_SCHEMA = ("src", "owner", "n", "k", "code", "doc_id", "fp", "sha")


def _send(owners: int, id_type: pa.DataType):
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.binary())

    def batch(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(size, t)) for c, t in zip(_SCHEMA, types, strict=True)], names=list(_SCHEMA))

    def codes(src: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.unique(np.concatenate(parts)).astype(np.uint64)
        owner = (values.astype(np.uint64) * np.uint64(owners) >> np.uint64(_BITS)).astype(np.int32)  # owners < 2**16
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = [(int(owner[a]), len(v := values[a:b]), *golomb_encode(v, least_of(int(owner[a]), owners))) for a, b in zip(at, [*at[1:], len(values)], strict=True)]
        o, n, k, code = zip(*rows, strict=True)
        return batch(len(rows), src=pa.array([src] * len(rows), pa.int64()), owner=pa.array(o, pa.int32()), n=pa.array(n, pa.int32()), k=pa.array(k, pa.int32()), code=pa.array(code, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            src = task << 24 | piece
            yield batch(b.num_rows, src=pa.array(np.full(b.num_rows, src, dtype=np.int64)), doc_id=b.column("doc_id"), fp=b.column("fp"), sha=b.column("sha"))
            held.append(b.column("fp").to_numpy())
            rows += b.num_rows
            if rows >= SOURCE_ROWS:
                yield codes(src, held)
                piece, held, rows = piece + 1, [], 0
        if held:
            yield codes(task << 24 | piece, held)

    return run


def _answer(pdf: pd.DataFrame, owners: int) -> pd.DataFrame:
    """At an owner: for each source a bitmap over what it sent, set where another source sent the same."""
    least = least_of(int(pdf["owner"].iloc[0]), owners)
    parts = [golomb_decode(n, k, c, least) for n, k, c in zip(pdf["n"], pdf["k"], pdf["code"], strict=True)]
    flat = np.concatenate(parts)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    ends = np.cumsum([len(p) for p in parts])
    maps = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
    return pd.DataFrame({"src": pdf["src"], "owner": pdf["owner"], "n": pdf["n"], "bitmap": maps})


def _suspects(rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
    """At a source: its fingerprints that an owner has marked or that it has more than once."""
    values, counts = np.unique(rows["fp"].to_numpy(dtype=np.int64), return_counts=True)
    maps = maps.sort_values("owner")
    marked = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for n, b in zip(maps["n"], maps["bitmap"], strict=True)]
    shared = np.concatenate(marked).astype(bool) if marked else np.zeros(len(values), dtype=bool)
    return pd.DataFrame({"fp": values[shared | (counts > 1)]})


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    owners = min(max(partitions(spark), math.ceil(docs.count() / OWNER_ROWS)), (1 << (64 - _BITS)) - 1)
    body = F.coalesce(F.col(text), F.lit(""))
    fp = F.shiftrightunsigned(F.xxhash64(body), 64 - _BITS)
    keyed = docs.select("doc_id", fp.alias("fp"), F.unhex(F.sha2(body, 256)).alias("sha"))
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    sent = materialize(keyed.mapInArrow(_send(owners, to_arrow_type(id_type)), _SENT.format(id=id_type.simpleString())), "fingerprints")
    rows, codes = sent.filter("owner IS NULL"), sent.filter("owner IS NOT NULL")
    maps = codes.select("src", "owner", "n", "k", "code").groupBy("owner").applyInPandas(lambda rows: _answer(rows, owners), "src long, owner int, n int, bitmap binary")
    suspects = (
        rows.select("src", "fp")
        .groupBy("src")
        .cogroup(maps.groupBy("src"))
        .applyInPandas(_suspects, "fp long")
        .distinct()
    )
    suspects = materialize(suspects, "suspects")
    if suspects.count() <= BROADCAST_SUSPECTS:
        suspects = F.broadcast(suspects)
    verified = (
        docs.select("doc_id", body.alias("body"), fp.alias("fp"))
        .join(suspects, "fp", "left_semi")
        .select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("sha"))
        .groupBy("sha", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .groupBy("sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")))
    )
    return (
        rows.select("doc_id", "sha")
        .join(materialize(verified.select("sha", "keep_id", "group_size"), "copies"), "sha", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each text that has a doc_id, with all columns, and the rows without doc_id."""
    groups = materialize(duplicate_groups(docs, text).filter("group_size > 1 AND doc_id IS NOT NULL"), "groups")
    gone = groups.filter("NOT kept").select("doc_id", "text_sha256").distinct()
    repeated = groups.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "text_sha256")

    def on(rows: DataFrame) -> Column:
        return (docs["doc_id"] == rows["doc_id"]) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == rows["text_sha256"])

    if repeated.isEmpty():
        return docs.join(gone.hint("shuffle_hash"), on(gone), "left_anti").select(*docs.columns)
    others = gone.union(repeated)
    single = docs.join(others.hint("shuffle_hash"), on(others), "left_anti")
    # Each repeated text is that of one doc_id here, and null counts as empty.
    one = docs.join(repeated.hint("shuffle_hash"), on(repeated), "left_semi").withColumn("_body", F.coalesce(F.col(text), F.lit(""))).dropDuplicates(["doc_id", "_body"])
    return single.select(*docs.columns).unionByName(one.select(*docs.columns))
