"""Quality rules whose cutoffs carry a guarantee: exact binomial bounds on labelled holdouts.

Rules look at per-document statistics (rates of symbols, of repeated lines and words, mean word length,
share of one-letter words). Documents labelled good, each text once (copies are no independent trials),
are halved by a hash of their text. One half proposes cutoffs: for each stratum (length of the text) a
ladder of steps from lenient to strict, each with a cutoff for every rule, its quantile at that step. The
other half tests the steps in this order and keeps the last for which the exact binomial test rejects
"more than alpha of the good documents fall to one of the rules"; it stops at the first that does not
(fixed sequence). Strata share delta equally, and one whose ladder holds to its end passes its share on to
the rest (Holm), so with probability 1 - delta at most alpha of good documents go, in every stratum. With
too few labelled documents nothing can be certified (80 in the testing half are the least) and the rules
stay silent for that stratum.

Nulls: a null text has no words and fails the base rule; rows of labels with a null id or quality are
not used; of repeated labels all must say good. Rows are never merged, and extra columns are left behind. A
value equal to a cutoff is not rejected. Very long texts are taken whole; empty tables give no rows, and
labels without rows no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, save

#: name, column, and side on which a document is rejected
RULES = (
    ("symbols", "symbol_rate", 1), ("dup_lines", "dup_line_rate", 1), ("repeats", "repeat_rate", 1),
    ("long_words", "mean_word", 1), ("short_words", "mean_word", -1), ("shouting", "upper_rate", 1),
)
LEVELS = (1.0, 0.9995, 0.999, 0.998, 0.997, 0.996, 0.995)
STRATA = (50, 400)  # words: short, middle, long
ALPHA, DELTA = 0.05, 0.05


def bind(value: Column, body) -> Column:
    """body(v) with value computed once: lambda variables, unlike repeated expressions, are not inlined."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more in the text. Windows are compared by 64-bit hash."""
    at = lambda w, i, k: F.get(w, i + k)
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - window)
    hashes = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[at(w, i, k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        twice = bind(pairs, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        gaps = bind(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    found = bind(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(found).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    bare = F.translate(text, SPACE, "")
    length = F.length(bare).cast("long")
    line_counts = bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u")))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    word_counts = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    rows = docs.select(
        F.col(id_col), length.alias("word_chars"), (F.length(bare) - F.length(F.translate(bare, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(bare) - F.length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        line_counts.alias("lines"), word_counts.alias("words"), F.xxhash64(text).alias("text_hash"),
    )
    rows = rows.select(
        id_col, F.col("words.n").alias("n_words"), "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.u")).cast("long").alias("n_dup_lines"),
        F.col("words.r").alias("n_repeat_words"), "n_upper", F.col("lines.n").alias("n_lines"), "text_hash",
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "*", rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("word_chars", "n_words").alias("mean_word"),
        rate("n_upper", "word_chars").alias("upper_rate"), sum((F.col("n_words") >= c).cast("int") for c in STRATA).alias("stratum"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms."""
    if k >= n:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def rejected(rule: tuple, cutoff: float) -> Column:
    _, col, side = rule
    return F.col(col) > cutoff if side > 0 else F.col(col) < cutoff


def climbed(rejections: dict[int, list[int]], n: dict[int, int], alpha: float, delta: float) -> dict[int, int]:
    """{stratum: steps certified}. rejections: good documents rejected at each step, n: all good ones. Each open
    stratum has an equal share of delta; a ladder that holds to its end leaves its share to the others."""
    open_ = set(rejections)
    while True:
        level = delta / max(1, len(open_))
        got = {}
        for s, counts in rejections.items():
            got[s] = len(counts)
            for i, k in enumerate(counts):
                if s in open_ and (not n[s] or binomial_tail(k, n[s], alpha) > level):
                    got[s] = i
                    break
        left = {s for s in open_ if got[s] < len(rejections[s])}
        if left == open_ or not left:
            return got
        open_ = left


def cutoffs(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """{(rule name, stratum): cutoff}. What comes to the driver is one row a stratum, whatever the input."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = known.where("least = 1 and most = 1").select(id_col)
    cols = sorted({r[1] for r in RULES})
    good = feats.where("not base_failed").join(good, id_col).groupBy("text_hash").agg(F.first("stratum").alias("stratum"), *[F.first(c).alias(c) for c in cols])
    good = good.withColumn("half", F.pmod(F.xxhash64("text_hash"), F.lit(2)))
    quantiles = {
        r["stratum"]: r
        for r in good.where("half = 0").groupBy("stratum")
        .agg(*[F.percentile_approx(c, [p for x in LEVELS for p in (x, 1 - x)], 20_000).alias(c) for c in cols]).collect()
    }
    if not quantiles:
        return {}
    step = {s: [{r[0]: row[r[1]][2 * i + (r[2] < 0)] for r in RULES} for i in range(len(LEVELS))] for s, row in quantiles.items()}
    fails = lambda cut: F.array_contains(F.array(*[rejected(r, cut[r[0]]) for r in RULES]), F.lit(True))
    aggs = [F.count_if((F.col("stratum") == s) & fails(cut)).alias(f"{s}:{i}") for s, steps in step.items() for i, cut in enumerate(steps)]
    seen = good.where("half = 1").agg(*aggs, *[F.count_if(F.col("stratum") == s).alias(f"n:{s}") for s in step]).first()
    got = climbed({s: [seen[f"{s}:{i}"] for i in range(len(LEVELS))] for s in step}, {s: seen[f"n:{s}"] for s in step}, alpha, delta)
    return {(name, s): cut for s, steps in step.items() if got[s] for name, cut in steps[got[s] - 1].items()}


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    feats = save(features(docs, id_col, text_col), "quality")
    found = cutoffs(feats, labels, id_col)
    by = {r[0]: r for r in RULES}
    fails = [F.when((F.col("stratum") == s) & rejected(by[name], c), F.lit(name)) for (name, s), c in sorted(found.items())]
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    return feats.withColumn("failed_rules", failed).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
