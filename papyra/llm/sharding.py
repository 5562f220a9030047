"""Sharding by extendible hashing: a directory on hash-prefix bits, split only where a shard is too large.

A row's key is 60 bits of MD5 over its id and text, so null and repeated ids spread as well. Bytes per
prefix are counted at a depth chosen from the total (combined map-side), and the directory's leaves are
the shallowest prefixes that fit. Bins still too large at that depth go on with 8 more bits, alone.

Nulls: a null text has 0 bytes. A prefix with a single row is not split further. Rows that agree in all 60
bits (identical rows) can't be parted; if they exceed the limit together, or one row does alone, they form a
shard marked over_limit. Ties don't arise; very long texts are but their size. An empty table
gives no rows. Every row is returned once, repeated rows included; extra columns are left behind.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

BITS = 60


def key60(id_col: str, text_col: str):
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, shard (the prefix as a bit string, '' for the only shard), depth, shard_bytes,
    shard_docs, over_limit."""
    left = save(
        docs.select(F.col(id_col), key60(id_col, text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")),
        "shard",
    )
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    done, start, depth = [], -1, min(BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + 4)
    while True:
        bins = save(left.groupBy(F.shiftright("key", BITS - depth).alias("bin")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "bins")
        at = bins.select("*", F.explode(F.sequence(F.lit(start + 1), F.lit(depth))).alias("d"))
        at = at.withColumn("prefix", F.expr(f"shiftright(bin, {depth} - d)"))
        sums = at.groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.col("d") == BITS)
        # the shallowest prefix that fits, per bin
        leaf = (
            at.join(sums, ["d", "prefix"]).where(fits).groupBy("bin")
            .agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_docs")).alias("leaf"))
        )
        rows = left.withColumn("bin", F.shiftright("key", BITS - depth))
        done.append(rows.join(leaf, "bin").select(id_col, "n_bytes", "leaf.*"))
        if depth == BITS or not bins.join(leaf, "bin", "left_anti").limit(1).count():
            break
        left = save(rows.join(bins.join(leaf, "bin", "left_anti").select("bin"), "bin", "left_semi").drop("bin"), "shard")
        start, depth = depth, min(BITS, depth + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), d, '0')"))
    return out.select(
        id_col, "n_bytes", bits.alias("shard"), F.col("d").cast("int").alias("depth"), "shard_bytes", "shard_docs",
        (F.col("shard_bytes") > max_bytes).alias("over_limit"),
    )
