"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Each source has a target in words; a document's expected copies are target / source size, at most 3.
Whole copies are certain; the fraction, as words, is its mass. Documents of a source are paired: mass
moves one way or the other, at random and in proportion, so that expectations hold, until one of the
two is empty or whole. A pair's sum of words never changes. Buckets of about FAN rows reduce to one
residual each, these again, and so on: a tree of log_FAN(n) levels in which no task holds more than a
few buckets at once, whatever a source's share.

The one left at the root is settled by a coin, which errs by up to its size; so large documents are
rounded first, and what their coin adds or takes is spread over the fractions of the smaller documents
still open (the coin's expected error is nil, so theirs hold, too). Up to ROUNDS such rounds leave a small
document for the last coin. Where the smaller documents can't take the error in, the round is the last, and
a root of over COIN of its target goes to its nearer end.

Equal rows (id, source, size, text, carried columns) enter the tree as one: of n of them, with fraction f
each, floor(n f) are taken for certain and one is open, so a group of copies is one row whatever its size.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Documents of size 0
take 0. An empty table gives no rows. Choices come from hashes of (id, size, text), so reruns agree, ties
among them go by the other columns, and very long texts are but their size. Extra columns are left
behind unless named in `carry`; a carried name that the result has itself is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, save

FAN = 48
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
COIN = 0.02
ROUNDS = 3
#: Equal rows that one task writes; more are dealt out.
EXPAND = 1 << 16


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `nr` from 0 in this order: places within sorted partitions, plus the rows before each
    partition (a table of one row a partition), so that no task holds all rows."""
    placed = save(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "numbered", False)
    part = F.shiftright("place", 33)
    n = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = n.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("all"))
    before = before.select(F.explode("all").alias("x"), "all").select(
        F.col("x.part").alias("part"), F.aggregate(F.filter("all", lambda y: y["part"] < F.col("x.part")), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("before")
    )
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("nr"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, ...) to the same with target: all words shared by weight; sources above cap
    times their size stop there and the excess is shared again, until none is above. Each round is one
    aggregate over the sources."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nr", F.lit(len(weights))) + 1).cast("int"))
    s = numbered(sizes, F.col("source").asc_nulls_last()).withColumn("w", w).withColumn("limit", F.lit(cap) * F.col("source_size")).drop("nr")
    s = save(s, "sources", False)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("limit") < F.col("w") * F.lit(level)
        now = s.agg(F.count_if(over), F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(~over, F.col("w")).otherwise(0.0))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (total - now[1]) / now[2]
    return s.withColumn("target", F.least("limit", F.col("w") * F.lit(level))).drop("w", "limit")


def _coin(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _fold(level: int) -> Column:
    """A bucket's sorted rows to (done: array, rest: row): the pivotal steps, one after another."""

    def step(state: Column, x: Column) -> Column:
        i, j = state["rest"], x
        up = F.least(i["size"] - i["mass"], j["mass"])  # as much as can go from j to i
        down = F.least(i["mass"], j["size"] - j["mass"])
        to_i = _coin(i["h"], j["h"], F.lit(level)) * (up + down) < down
        mass = i["mass"] + j["mass"]
        # each case: (the one that is settled, whether whole), the one that goes on with what is left
        i_whole, j_whole = mass >= i["size"], mass >= j["size"]
        settle_i = (to_i & i_whole) | (~to_i & ~j_whole)
        whole = F.when(to_i, i_whole).otherwise(j_whole)
        settled, other = F.when(settle_i, i).otherwise(j), F.when(settle_i, j).otherwise(i)
        left = F.when(whole, mass - settled["size"]).otherwise(mass)
        return F.struct(
            F.concat(state["done"], F.array(settled.withField("mass", F.when(whole, settled["size"]).otherwise(F.lit(0.0))))).alias("done"),
            other.withField("mass", left).alias("rest"),
        )

    first = F.struct(F.expr("slice(rows, 1, 0)").alias("done"), F.col("rows")[0].alias("rest"))
    return F.aggregate(F.expr("slice(rows, 2, size(rows))"), first, step)


def _next_bound(sources: DataFrame, hist: DataFrame) -> DataFrame:
    """sources (with f: the fraction now, top: the largest size class still open) with `next`: rows of size
    classes (powers of two) over it are rounded now, the others later; -1 where all are rounded now. It is
    the least class whose rows, with all smaller ones, can take in a coin's error for the largest row now open."""
    h = hist.groupBy(F.col("source").alias("source2")).agg(F.sort_array(F.collect_list(F.struct("k", "words", "most"))).alias("hist"))
    s = sources.join(h, F.col("source").eqNullSafe(F.col("source2")), "left").drop("source2")
    open_ = F.filter("hist", lambda x: x["k"] <= F.col("top"))
    words = lambda k: F.aggregate(F.filter("hist", lambda y: y["k"] <= k), F.lit(0).cast("long"), lambda a, y: a + y["words"])
    most, room = F.array_max(F.transform(open_, lambda x: x["most"])), 0.95 * F.least("f", 1 - F.col("f"))
    fit = F.filter(open_, lambda x: words(x["k"]) * room >= most)
    return s.withColumn("next", F.coalesce(F.array_min(F.transform(fit, lambda x: x["k"])), F.lit(-1))).drop("hist")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple = WEIGHTS, cap: float = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each distinct (id, source, size, text, carried columns): id, source, size, carry, n (rows),
    h, source_size, target, base and more: of the n rows, `more` are taken base + 1 times, the others base times."""
    types = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("t"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    rows = save(rows.groupBy("id", "source", "size", "t", "carry").agg(F.count("*").alias("n")), "mix")
    rows = rows.withColumn("h", F.xxhash64("id", "size", "t"))
    k = F.ceil(F.log2(F.col("size") + 1)).cast("int")
    hist = save(rows.groupBy("source", k.alias("k")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("size").alias("most")), "sizes", False)
    sources = source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    f = F.col("target") / F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("f", F.when(F.col("source_size") > 0, f - F.floor(f)).otherwise(0.0)).withColumn("top", F.lit(99))
    done = []
    for turn in range(ROUNDS):
        bounded = _next_bound(sources, hist) if turn < ROUNDS - 1 else sources.withColumn("next", F.lit(-1))
        sources = save(bounded, "targets", False)
        if turn and not sources.where("top >= 0").limit(1).count():
            break
        s = sources.select(F.col("source").alias("source2"), "source_size", "target", "f", "top", "next")
        now = rows.join(s, F.col("source").eqNullSafe(F.col("source2"))).where((k <= F.col("top")) & (k > F.col("next")))
        mean = F.col("n") * F.col("f")
        copies = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(cap)))).otherwise(F.lit(0))
        now = now.select(
            "h", "id", F.col("size").cast("double").alias("size"), ((mean - F.floor(mean)) * F.col("size")).alias("mass"), F.floor(mean).alias("sure"),
            copies.alias("base"), "n", "source_size", "target", "carry", "t", "next", "source",
        )
        now = save(now, "open")
        cols = [c for c in now.columns if c != "source"]
        open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
        done.append(now.where(~open_))
        per = now.where(open_).groupBy(F.col("source").alias("source2")).agg(F.count("*").alias("left"))
        todo = now.where(open_).join(per, F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
        most, level = per.agg(F.max("left")).first()[0] or 0, 0
        while most > 1:
            fewer = F.ceil(F.col("left") / FAN).cast("long")
            got = todo.groupBy("source", "left", F.pmod(F.xxhash64("h", F.lit(level)), fewer).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))
            got = save(got.select("source", fewer.alias("left"), _fold(level).alias("x")), "pivot", level == 0)
            done.append(got.select("source", F.explode("x.done").alias("r")).select("source", "r.*"))
            todo = got.select("source", "left", "x.rest.*")
            # a residual can come out whole or empty; it then is settled like the rest
            done.append(todo.where(~open_).drop("left"))
            todo, most, level = todo.where(open_), -(-most // FAN), level + 1
        coin = _coin(F.col("h"), F.lit(f"root {turn}")) * F.col("size") < F.col("mass")
        end = F.when((F.col("next") >= 0) | (F.col("size") <= COIN * F.col("target")), coin).otherwise(F.col("mass") * 2 >= F.col("size"))
        last = save(todo.drop("left").withColumn("was", F.col("mass")).withColumn("mass", F.when(end, F.col("size")).otherwise(F.lit(0.0))), "roots", False)
        done.append(last.drop("was"))
        error = last.select(F.col("source").alias("source3"), (F.col("mass") - F.col("was")).alias("error"))
        pool = hist.join(sources.select(F.col("source").alias("source2"), "next"), F.col("source").eqNullSafe(F.col("source2")))
        pool = pool.where("k <= next").groupBy("source2").agg(F.sum("words").alias("pool"))
        new = sources.join(error, F.col("source").eqNullSafe(F.col("source3")), "left").join(pool, F.col("source").eqNullSafe(F.col("source2")), "left")
        shift = F.coalesce(F.col("error") / F.col("pool"), F.lit(0.0))
        sources = new.withColumn("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f") - shift))).withColumn("top", F.col("next")).drop("source2", "source3", "error", "pool", "next")
    out = reduce(DataFrame.unionByName, done)
    more = F.col("sure") + F.when((F.col("mass") > 0) & (F.col("size") > 0), 1).otherwise(0)
    return out.select(
        F.col("id").cast(types[id_col]).alias("id"), "source", F.col("size").cast("long").alias("size"), "carry", "t", "n", F.col("source_size").cast("long").alias("source_size"),
        "target", F.col("base").cast("long").alias("base"), F.when(F.col("size") > 0, more).otherwise(0).cast("long").alias("more"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, cap: float = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, size, source_size, target, taken, and the columns in carry (small ones: they travel along)."""
    if clash := {c.lower() for c in carry} & {id_col.lower(), "size", "source_size", "target", "taken"}:
        raise ValueError(f"the result has columns of these names itself: {sorted(clash)}")
    got = groups(docs, id_col, text_col, source_col, weights, cap, carry)
    one = got.where("n = 1").withColumn("i", F.lit(1).cast("long"))
    some = got.where(f"n between 2 and {EXPAND}").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    many = got.where(F.col("n") > EXPAND).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EXPAND)))).repartition("id", "t", "block")
    many = many.withColumn("i", F.explode(F.sequence(F.col("block") * EXPAND + 1, F.least("n", (F.col("block") + 1) * EXPAND)))).drop("block")
    out = one.unionByName(some).unionByName(many)
    taken = (F.col("base") + (F.col("i") <= F.col("more")).cast("long")) * F.col("size")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), *[F.col("carry")[c].alias(c) for c in carry])
