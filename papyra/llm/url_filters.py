"""URL filters: host-suffix and path-prefix expressions against a hashed rule list.

A url is expanded into the expressions `host suffix + path prefix`; each is looked up by the first
32 bits of its SHA-256 (an equi-join), then the full digest is compared, then the longest rule wins.
Only suffixes with as many labels, and prefixes as long, as some rule has can match, so only these
are made. Urls are looked up once per distinct (host, leading path); hosts with a large share of all
pages get their rule by broadcast, so their pages stay where they are.

Nulls: a null url, or one without `://`, has empty host and path, and gets the default verdict.
Rules with a null or empty host, or a null verdict, match nothing. Among equally long rules the one
with the longer host wins, then `block` before `allow`; repeated rules count once. Rows are neither
dropped nor merged, repeated rows stay, and extra columns of the input are left behind. An empty table of
pages gives no rows, an empty list of rules the default; urls may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules (each row under about 200 bytes) the rule side is broadcast; beyond, it is shuffled.
BROADCAST_RULES = 50_000


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    has = F.instr(F.col("u"), "://") > 0
    return (
        pages.withColumn("u", F.coalesce(F.col(url_col), F.lit("")))
        .withColumn("u", F.when(has, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("u", r"^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("u", r"^[^/?#]*([^?#]*)", 1))
        .drop("u")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """rules: (host, path, verdict). Returns id_col, host, path, rule, verdict."""
    rules = (
        rules.where("host <> '' and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict"))
        .withColumn("rule", F.concat("rhost", "rpath"))
        .groupBy("rule", "rhost", "rpath").agg(F.max("rverdict").alias("rverdict"))
    )
    # what the rules need: scalars and two short lists, whatever the number of pages
    need = rules.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("rhost", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rpath"))).alias("lengths"),
    ).first()
    top = max(need["lengths"], default=0)
    rows = with_host_path(pages.select(F.col(id_col), F.col(url_col).alias("u0")), "u0").select(
        id_col, "host", "path", F.substring("path", 1, top).alias("lead")
    )
    ints = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")
    met = save(rows.groupBy("host", "lead").agg(F.count("*").alias("met")), "url-keys")
    keys = met.where("host <> ''").select("host", "lead").withColumn("parts", F.split("host", r"\."))
    n = F.size("parts")
    suffixes = F.transform(
        F.filter(ints(need["labels"]), lambda k: k <= n), lambda k: F.array_join(F.slice("parts", n - k + 1, k), ".")
    )
    prefixes = F.transform(
        F.filter(ints(need["lengths"]), lambda k: k <= F.length("lead")), lambda k: F.substring(F.col("lead"), F.lit(1), k)
    )
    made = keys.select("host", "lead", F.explode(suffixes).alias("s"), prefixes.alias("ps"))
    made = made.select("host", "lead", F.length("s").alias("slen"), "s", F.explode("ps").alias("p"))
    made = made.select("host", "lead", "slen", F.sha2(F.concat("s", "p"), 256).alias("digest"))
    made = made.withColumn("short", F.substring("digest", 1, 8))
    listed = rules.withColumn("rdigest", F.sha2("rule", 256)).withColumn("short", F.substring("rdigest", 1, 8))
    if need["n"] <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    best = (
        made.join(listed, "short")
        .where((F.col("digest") == F.col("rdigest")) & (F.col("slen") == F.length("rhost")))
        .groupBy("host", "lead")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rhost").alias("h"), "rverdict", "rule")).alias("best"))
    )
    ruled = save(met.join(best, ["host", "lead"], "left"), "url-rules")
    return join_by_key(rows, ruled, ["host", "lead"], "met").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rverdict"), F.lit(default)).alias("verdict"),
    )
