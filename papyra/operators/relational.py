"""The document operators that are relations: lookups, recursion, windows, sets and scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protect import RIGHTS
from ..functions.structure import value_range
from .store import saved

# fixed values: Roman numerals by decimal place
ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
TENS = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
HUNDREDS = ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")
THOUSANDS = ("", "m", "mm", "mmm")


def roman(n: Column) -> Column:
    """Lower-case numeral of 1 to 3,999, decimal outside."""
    digit = lambda words, unit: F.element_at(F.array(*map(F.lit, words)), (F.floor(n / unit) % 10 + 1).cast("int"))
    made = F.concat(digit(THOUSANDS, 1000), digit(HUNDREDS, 100), digit(TENS, 10), digit(ONES, 1))
    return F.when((n >= 1) & (n <= 3999), made).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a to z, aa to az and so on: bijective base 26, for up to four letters; decimal below 1."""
    digit = lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26 + 1).cast("int"), 1)
    out = F.lit("")
    for place in range(4):
        # numbers of fewer letters come first: 26 + 26^2 + ...
        below = sum(26**i for i in range(1, place + 1))
        rest = n - 1 - below
        own = F.expr("''")
        for k in range(place + 1):
            own = F.concat(digit(F.floor(rest / 26**k)), own)
        out = F.when((n > below) & (n <= below + 26 ** (place + 1)), own).otherwise(out)
    return F.when(n < 1, n.cast("string")).otherwise(out)


def page_labels(pages: DataFrame, ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """pages (keys, idx), ranges (keys, start, style, prefix, first): the last range that starts at or before
    a page labels it. An as-of join by one sort within each document: pages and ranges in one order, the
    last range carried on."""
    keys = keys or []
    what = F.struct("start", "style", "prefix", "first")
    both = pages.select(*keys, "idx", F.lit(None).cast(ranges.select(what.alias("r")).schema["r"].dataType).alias("r"), F.lit(1).alias("page"))
    both = both.unionByName(ranges.select(*keys, F.col("start").alias("idx"), what.alias("r"), F.lit(0).alias("page")))
    w = Window.partitionBy(*keys).orderBy("idx", "page").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("page = 1").select(*keys, "idx", "r.*")
    n = F.coalesce("first", F.lit(1)) + F.col("idx") - F.col("start")
    style = F.col("style")
    body = F.when(style == "D", n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n)))
    body = body.when(style == "a", letters(n)).when(style == "A", F.upper(letters(n))).otherwise("")
    return got.select(*keys, "idx", F.when(F.col("start").isNull(), (F.col("idx") + 1).cast("string")).otherwise(F.concat(F.coalesce("prefix", F.lit("")), body)).alias("label"))


def right_angle(turn: Column) -> Column:
    return F.pmod(F.floor((turn + 45) / 90) * 90, F.lit(360)).cast("int")


def find_count(text: Column, needle: Column) -> Column:
    """Non-overlapping matches, case-insensitive; none for an empty needle."""
    low, n = F.lower(text), F.lower(needle)
    return F.when(F.length(n) > 0, ((F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(F.lit(0))


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes reachable from roots (keys, node) over edges (keys, src, dst), cycles included: each round
    expands the nodes that the last one found and keeps those not seen before, until there are none. Rounds
    are saved, so a plan never grows; there are as many as the longest shortest path."""
    keys = keys or []
    seen = front = saved(roots.select(*keys, "node").distinct(), "reachable")
    while True:
        new = front.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        front = saved(new.join(seen, [*keys, "node"], "left_anti"), "reachable")
        if not front.limit(1).count():
            return seen
        seen = saved(seen.unionByName(front), "reachable")


def dangling(refs: DataFrame, objects: DataFrame, key: str | list[str]) -> DataFrame:
    return refs.join(objects, key, "left_anti")


def newest(rows: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The last revision of each key, without a window: max_by combines map-side."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(revision, *[c for c in cols if c != revision])).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in cols])


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1 - v) * (1 - k) for v in (c, m, y)]


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def blend(mode: str, b: Column, s: Column) -> Column:
    """Separable blend functions of backdrop and source in [0, 1]."""
    root = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return {
        "Normal": s,
        "Compatible": s,
        "Multiply": b * s,
        "Screen": b + s - b * s,
        "Darken": F.least(b, s),
        "Lighten": F.greatest(b, s),
        "Difference": F.abs(b - s),
        "Exclusion": b + s - 2 * b * s,
        "ColorDodge": F.when(b == 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / (1 - s))),
        "ColorBurn": F.when(b >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s)),
        "HardLight": F.when(s <= 0.5, b * (2 * s)).otherwise(b + (2 * s - 1) - b * (2 * s - 1)),
        "Overlay": F.when(b <= 0.5, s * (2 * b)).otherwise(s + (2 * b - 1) - s * (2 * b - 1)),
        "SoftLight": F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (root - b)),
    }[mode]


def luminosity(c: list[Column]) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _clipped(c: list[Column]) -> list[Column]:
    light, low, high = luminosity(c), F.least(*c), F.greatest(*c)
    c = [F.when(low < 0, light + (v - light) * light / (light - low)).otherwise(v) for v in c]
    return [F.when(high > 1, light + (v - light) * (1 - light) / (high - light)).otherwise(v) for v in c]


def with_luminosity(c: list[Column], light: Column) -> list[Column]:
    d = light - luminosity(c)
    return _clipped([v + d for v in c])


def with_saturation(c: list[Column], amount: Column) -> list[Column]:
    low, high = F.least(*c), F.greatest(*c)
    return [F.when(high > low, (v - low) * amount / (high - low)).otherwise(F.lit(0.0)) for v in c]


def blend_hsl(mode: str, b: list[Column], s: list[Column]) -> list[Column]:
    """Hue, Saturation, Color and Luminosity of backdrop and source, three channels each."""
    amount = lambda c: F.greatest(*c) - F.least(*c)
    return {
        "Hue": lambda: with_luminosity(with_saturation(s, amount(b)), luminosity(b)),
        "Saturation": lambda: with_luminosity(with_saturation(b, amount(s)), luminosity(b)),
        "Color": lambda: with_luminosity(s, luminosity(b)),
        "Luminosity": lambda: with_luminosity(b, luminosity(s)),
    }[mode]()


def source_over(b: Column, ab: Column, s: Column, as_: Column, mixed: Column) -> tuple[Column, Column]:
    """(colour, alpha) of a source over a backdrop; mixed is the blend function's value."""
    alpha = ab + as_ - ab * as_
    return F.when(alpha > 0, (as_ * (1 - ab) * s + as_ * ab * mixed + (1 - as_) * ab * b) / alpha).otherwise(F.lit(0.0)), alpha


def rgba8(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")


def sorted_patches(patches: DataFrame, part: list[str]) -> DataFrame:
    """Patches (start, end) in order with whether each covers bytes of an earlier one."""
    w = Window.partitionBy(*part).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return patches.withColumn("overlaps", F.coalesce(F.col("start") < before, F.lit(False)))


def balance(ops: DataFrame, part: list[str], order: str, up: str, down: str, op: str) -> DataFrame:
    """Whether `up` and `down` operators pair: never below zero and zero at the end."""
    step = F.when(F.col(op) == up, 1).when(F.col(op) == down, -1).otherwise(0)
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("level", F.sum(step).over(w)).withColumn("step", step).groupBy(*part).agg(F.min("level").alias("lowest"), F.sum("step").alias("last")).withColumn("balanced", (F.col("lowest") >= 0) & (F.col("last") == 0))


def word_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(F.split(F.lower(text), " ")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))


def f1(rows: DataFrame, reference: DataFrame, key: str, text: str) -> DataFrame:
    """(key, common, own, f1): word bags of rows (key, text) against the one bag of all of reference (text)."""
    a = word_counts(rows, key, text)
    b = word_counts(reference.withColumn("k", F.lit(0)), "k", text).select("word", F.col("n").alias("m"))
    total = b.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"))  # one row
    got = a.join(b, "word", "left").groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.least("n", "m"))), F.lit(0)).alias("common"), F.sum("n").alias("own"))
    return got.crossJoin(F.broadcast(total)).select(key, "common", "own", (2.0 * F.col("common") / (F.col("own") + F.col("total"))).alias("f1"))


def calculated(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The standard calculations of forms over the values of a key: SUM, PRD, AVG, MIN, MAX."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.sum(v).alias("SUM"), F.product(v.cast("double")).alias("PRD"), (F.sum(v) / F.count("*")).alias("AVG"), F.min(v).alias("MIN"), F.max(v).alias("MAX"))


def range_verdict(value: Column, script: str) -> Column:
    """below, above or ok by a range check's script; ok where it has none."""
    low, high = value_range(script) or (None, None)
    out = F.when(F.lit(False), "")
    if low is not None:
        out = out.when(value < low, "below")
    if high is not None:
        out = out.when(value > high, "above")
    return out.otherwise("ok")


def scrub(text: Column, tokens: list[str]) -> Column:
    """Every occurrence of each token taken out, one token after another."""
    for token in filter(None, tokens):
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def duplicates(rows: DataFrame, body: str, key: str) -> DataFrame:
    """Equal bodies by SHA-256: (hash, n, kept: the least key)."""
    return rows.groupBy(F.sha2(body, 256).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("kept"))


def permitted(p: Column) -> dict[str, Column]:
    return {name: p.bitwiseAND(F.lit(bit)) != 0 for name, bit in RIGHTS.items()}


def denied(p: Column) -> Column:
    return F.concat_ws(", ", *[F.when(~ok, name) for name, ok in permitted(p).items()])


def shown_annotation(flags: Column, printing: bool = False) -> Column:
    """Not hidden, and fit for the screen or the printer."""
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    return ~bit(2) & (bit(4) if printing else ~bit(32))


def digests(body: Column) -> dict[str, Column]:
    return {"md5": F.md5(body), "sha1": F.sha1(body), **{f"sha{n}": F.sha2(body, n) for n in (256, 384, 512)}, "crc32": F.crc32(body)}


def report(rows: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """(keys, n, mean, median, worst, below_i): how a measure is spread, and how many fall below each threshold."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("worst"),
        *[F.count_if(v < x).alias(f"below_{i}") for i, x in enumerate(thresholds)],
    )


def worst(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """A top-k report: the n greatest, ties by key."""
    return rows.orderBy(F.desc(value), key).limit(n)


def laid_out(parts: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """Rank in drawing order, and where each part begins when all are laid end to end."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size
    return parts.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("offset", before.cast("long"))


def overlaid(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """base and changes (key, value, gone): changed objects lie over the base, new ones are added, removed ones go."""
    rows = base.select(key, F.col(value).alias("old")).join(changes.select(key, F.col(value).alias("new"), "gone", F.lit(True).alias("over")), key, "full")
    return rows.where(~F.coalesce("gone", F.lit(False))).select(key, F.when(F.col("over"), F.col("new")).otherwise(F.col("old")).alias(value))


def replies(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """annotations (keys, num, parent): each reply or popup with the annotation that it belongs to. One pass over
    the annotations: each comes under its own number and, as a reply, under its parent's."""
    reply = F.struct(*[c for c in annotations.columns if c not in (*keys, "parent")])
    own = F.struct(F.col("subtype").alias("parent_subtype"))
    none = lambda c: F.when(F.lit(False), c)
    ends = F.array(F.struct(F.col("num").alias("parent"), own.alias("own"), none(reply).alias("reply")), F.struct("parent", none(own).alias("own"), reply.alias("reply")))
    both = annotations.dropna(subset=keys).select(*keys, F.inline(ends)).where("parent is not null")
    met = both.groupBy(*keys, "parent").agg(F.collect_list("own").alias("owns"), F.collect_list("reply").alias("replies"))
    rows = met.select(*keys, "parent", "owns", F.inline("replies"))
    return rows.select(*[c for c in rows.columns if c != "owns"], F.inline("owns"))
