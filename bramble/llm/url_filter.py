"""URL rules over host suffixes and path prefixes.

Every URL is expanded into (host suffix, path prefix) expressions; expressions
and rules meet in an equi-join on a short hash prefix, the full digest then
confirms the hit, and the most specific rule wins.

Defined results
- null URL or no ``://``: host and path are empty, no rule fits, the default verdict holds.
- the host keeps ports and user info as they stand; only A-Z are lower-cased.
- rules with a null or empty host fit nothing; a null path counts as empty.
- precedence: longest host + path, then the longer host, then block before allow.
- repeated rows are judged alike and all returned; an empty table gives an empty result.
- a host and path that many rows share are judged once; the rows meet the verdicts in a join that Spark can split.
- other columns of the input are kept, unless they are called as one of the new columns: those are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import ascii_lower, materialize

#: Rule tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000
_HASH_PREFIX = 8
_NEW = ("host", "path", "rule", "verdict")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(raw) + 1)
    return df.withColumns({"host": ascii_lower(raw), "path": F.regexp_extract(tail, r"^[^?#]*", 0)})


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str | None, str | None, str]]) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame, from literals."""
    kind = "array<struct<host string, path string, verdict string>>"
    return spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, r)) for r in rules]).cast(kind)))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of df.

    rules: columns host, path, verdict ('allow' or 'block').
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).filter("r_host <> ''")
    # What must be expanded: only as many labels and such prefix lengths as some rule has.
    shape = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    keyed = rules.withColumn("digest", F.sha2(F.concat_ws("\u0000", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, _HASH_PREFIX))

    parts = url_parts(df.drop(*[c for c in _NEW if c in df.columns and c != url]), url)
    keys = parts.filter("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    most = F.lit(int(shape["labels"]))
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        keys.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("x_digest", F.sha2(F.concat_ws("\u0000", "suffix", "prefix"), 256))
        .select("host", "path", "x_digest", F.substring("x_digest", 1, _HASH_PREFIX).alias("short"))
    )
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    rank = F.struct(
        F.length("r_host") + F.length("r_path"),
        F.length("r_host"),
        (F.col("r_verdict") == "block").cast("int"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = (
        expressions.join(keyed, "short")
        .filter(F.col("x_digest") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    # Stored, so that the join has an exchange on either side: rows without a host, or of one page, may be very many.
    out = parts.join(materialize(best, "judged"), ["host", "path"], "left")
    kept = [c for c in df.columns if c not in _NEW or c == url]
    return out.select(*kept, *[c for c in ("host", "path") if c not in kept], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
