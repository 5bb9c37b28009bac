"""Benchmark decontamination with spaced seeds.

A window is SPAN tokens, in four parts. Each fixed mask leaves out two of the parts and
hashes the other two; windows of documents and of benchmark items that agree under a mask
meet in an equi-join. Around the hit the whole windows are then compared:
at least NEED tokens must be equal, so a substituted token does not hide a copy.
Two substitutions lie in two parts at most, so some mask leaves out both: every window that
passes the comparison is found. An item of fewer than SPAN tokens, but SHORT at least, is one
window of its own length, of which every token must be equal.

Tokens are the runs of letters and digits of the lower-cased text. Two bitmaps of
fixed size, made from the benchmark, drop positions that cannot hit: one over the
pairs of neighbouring tokens that masks start with, one over the masks' hashes. They
only drop misses. Everything is built-in SQL functions.

Defined results
- null text counts as empty; items of fewer than SHORT tokens, which ordinary text has by chance, have no window and never hit.
- repeated rows hit alike; items with equal text are reported each; a null id is reported as null.
- an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, NEED, SHORT = 12, 10, 5
#: For each mask: the required offsets, and where two neighbours among them begin. SPAN - NEED is 2, the number of parts left out.
_PARTS = tuple(tuple(range(p, p + SPAN // 4)) for p in range(0, SPAN, SPAN // 4))
MASKS = tuple((one + two, one[0]) for i, one in enumerate(_PARTS) for two in _PARTS[i + 1 :])
_PAIR_BITS, _KEY_BITS = 1 << 18, 1 << 20
#: Benchmark windows up to this number are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000


def _tokens(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _pair(h: Column, p: Column) -> Column:
    return F.xxhash64(F.get(h, p), F.get(h, p + 1))


def _key(h: Column, start: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, start + o) for o in MASKS[mask][0]])


def _short_key(h: Column, start: Column, span: Column) -> Column:
    return F.xxhash64(F.lit("short"), F.slice(h, start + 1, span))


def _bitmap(rows: DataFrame, hashed: str, bits: int) -> Column:
    """A literal bitmap (array of longs) with the bits of all values of a column; its size is fixed."""
    at = F.pmod(F.col(hashed), F.lit(bits))
    words = {
        r["word"]: r["bits"]
        for r in rows.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .collect()
    }
    return F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")


def _test(bitmap: Column, value: Column, bits: int) -> Column:
    at = F.pmod(value, F.lit(bits))
    word = F.get(bitmap, F.shiftright(at, 6).cast("int"))
    return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _starts(n: Column) -> Column:
    return F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).when(n >= SHORT, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and item that share a window: doc_id, text_hash, item_id, n_windows, best_match."""
    items = benchmark.select("item_id", _tokens(F.col("text")).alias("h")).withColumn("start", F.explode(_starts(F.size("h"))))
    short = F.size("h") < SPAN
    masked = F.array(*[_key(F.col("h"), F.col("start"), m) for m in range(len(MASKS))])
    windows = items.select(
        "item_id",
        F.slice("h", F.col("start") + 1, SPAN).alias("item_window"),
        F.explode(F.when(short, F.array(_short_key(F.col("h"), F.col("start"), F.size("h")))).otherwise(masked)).alias("key"),
        F.when(short, F.array(_pair(F.col("h"), F.lit(0)))).otherwise(F.array(*[_pair(F.col("h"), F.col("start") + a) for _, a in MASKS])).alias("pairs"),
    )
    # At most SPAN - SHORT lengths; most benchmarks have none.
    spans = sorted(r["n"] for r in items.filter(short).select(F.size("h").alias("n")).distinct().collect())
    pair_map = _bitmap(windows.select(F.explode("pairs").alias("pair")), "pair", _PAIR_BITS)
    key_map = _bitmap(windows, "key", _KEY_BITS)
    windows = windows.select("key", "item_id", "item_window")

    hashed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _tokens(F.col(text)).alias("h"))
    h, n = F.col("h"), F.size("h")
    # No filter on these columns and no plain explode: Catalyst would push a condition below the projection and so compute h again for each position.
    places = F.filter(F.when(n >= min(spans, default=SPAN), F.sequence(F.lit(0), n - 2)), lambda p: _test(pair_map, _pair(h, p), _PAIR_BITS))

    def keys(p: Column) -> Column:
        one = [F.struct((p - a).alias("start"), F.lit(SPAN).alias("span"), F.when((p >= a) & (p - a <= n - SPAN), _key(h, p - a, m)).alias("key")) for m, (_, a) in enumerate(MASKS)]
        one += [F.struct(p.alias("start"), F.lit(k).alias("span"), F.when(p <= n - k, _short_key(h, p, F.lit(k))).alias("key")) for k in spans]
        return F.array(*one)

    hits = F.filter(F.flatten(F.transform("places", keys)), lambda c: c["key"].isNotNull() & _test(key_map, c["key"], _KEY_BITS))
    found = (
        hashed.withColumn("places", places)
        .select("doc_id", "text_hash", "h", F.explode_outer(hits).alias("hit"))
        .select("doc_id", "text_hash", F.col("hit.start").alias("start"), F.col("hit.key").alias("key"), F.slice("h", F.col("hit.start") + 1, F.col("hit.span")).alias("window"))
    )
    if windows.count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    equal = F.aggregate(F.zip_with("window", "item_window", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        found.join(windows, "key")
        .filter(F.size("window") == F.size("item_window"))
        .select("doc_id", "text_hash", "item_id", "start", equal.alias("match"), F.when(F.size("window") == SPAN, NEED).otherwise(F.size("window")).alias("need"))
        .filter("match >= need")
        .groupBy("doc_id", "text_hash", "item_id", "start")
        .agg(F.max("match").alias("match"))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.count("*").alias("n_windows"), F.max("match").alias("best_match"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that share no window with the benchmark, with all their columns."""
    gone = contaminated(docs, benchmark, text).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs[text]) == gone["_gone_hash"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
