"""Suffix-array dedup: removes every byte covered by a string of SPAN bytes that starts elsewhere too.

Finding candidates. A window of SPAN bytes is represented by its least hashed GRAM-byte string (the
leftmost of equals), its anchor. Equal windows have equal anchors at equal offsets, so only windows
around anchors with one hash need be compared; about one position in 170 is an anchor. An anchor's
context is what the windows that contain it can reach. Contexts are told apart by a 128-bit BLAKE2b
digest of their bytes; those that occur twice are repeats as a whole, so only one of each goes on, and
only where its anchor has other contexts. (Comparing the bytes of all equal contexts instead would send
each copied byte four times through a shuffle.)

Comparing. For the contexts of an anchor two suffix orders are made, of what follows it and of what
precedes it reversed: merge sorts whose comparisons find the common extension by binary search over
prefix polynomial hashes; the extensions of neighbours are then verified byte by byte (on a collision
all is done again with another base). Windows are equal if they fall in one class of both orders.

An anchor with more than RUN_LIMIT contexts is split: a window that begins lo to hi - 1 bytes before the
anchor holds the lo bytes before it and SPAN - hi + 1 bytes from it on, so for each of RANGES ranges only
contexts that agree in these bytes meet, and these smaller groups are sorted like the others. A group that
is still too large agrees in nearly all of a window; then whole windows' digests are counted, which
combines map-side. No task holds more than RUN_LIMIT contexts.

Passages (on request). Fifty words are often shorter than SPAN bytes. With words, bytes from the first to the
last of PASSAGE words in a row that occur elsewhere too, whatever white space is between them, are lost as well.
Each word is written as a code of CODE bytes, its XXH64; PASSAGE words are then SPAN bytes, and the codes go the
same way as texts. What covers a part of a code only doesn't count. This is a pass of its own after the first, so
that their intermediate tables are not on the disk together.

Lost bytes are judged on the input. Nulls: a null text is empty; null or repeated ids do no harm, since
rows are told apart by id and text, and equal rows are repeats of each other. Texts shorter than SPAN
lose nothing; long ones are read in segments. Rows come out as often as they went in; an empty table
gives no rows. Extra columns are left behind unless named in `carry`; a carried name that the result has
itself is refused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_by_key, save, small_batches, trimmed

SPAN = 400
GRAM = 64
WIDTH = SPAN - GRAM + 1  # gram positions in a window, and the number of its places around an anchor
SEGMENT = 1 << 18
BLOCK = 2048
RUN_LIMIT = 6_000
CODE = 8
PASSAGE = SPAN // CODE  # words
CODES_HELD = 50_000
RANGES = 8
EDGES = [WIDTH * i // RANGES for i in range(RANGES + 1)]
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)


class Codes(dict):
    """Words to codes; words seen are held up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CODES_HELD:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code

    def of(self, raw: bytes) -> bytes:
        return np.fromiter(map(self.__getitem__, raw.split()), np.uint64).tobytes()


@lru_cache(4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        f = np.full(n, b, np.uint64)
        f[0] = 1
        out.append(np.multiply.accumulate(f))
    return out[0], out[1]


@lru_cache(8)
def byte_values(base: int) -> np.ndarray:
    return np.random.default_rng(base & 0xFFFFFFFF).integers(1, 1 << 63, 256, dtype=np.uint64)


class PrefixHash:
    """Polynomial hashes of substrings of data in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASES[0], starts: np.ndarray | None = None):
        """starts: where each text begins; powers count from there, so few are needed."""
        self.at = np.arange(len(data) + 1, dtype=np.int32)
        if starts is not None:
            self.at -= np.repeat(starts, np.diff(np.append(starts, len(data) + 1))).astype(np.int32)
        self.up, self.down = powers(base, 1 << max(12, int(self.at.max()).bit_length()))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        terms = byte_values(base)[data]
        for i in range(0, len(data), SEGMENT):
            terms[i : i + SEGMENT] *= self.up[self.at[i : i + SEGMENT][: len(data) - i]]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[self.at[start]]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all windows."""
    data = np.frombuffer(raw, np.uint8)
    where, hashes = [], []
    for s in range(0, len(data) - SPAN + 1, SEGMENT):
        part = data[s : s + SEGMENT + SPAN - 1]
        n = len(part) - GRAM + 1
        ph = PrefixHash(part)
        h = (ph.sums[GRAM:] - ph.sums[:n]) * ph.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        packed = (h & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
        rows = np.full(-(-n // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
        rows[:n] = packed
        rows = rows.reshape(-1, WIDTH)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(rows, axis=1).ravel()
        low = np.minimum(after[: n - WIDTH + 1], before[WIDTH - 1 : n]) & np.uint64((1 << 21) - 1)
        at = low[np.concatenate(([True], low[1:] != low[:-1]))].astype(np.int64)
        where.append(at + s)
        hashes.append(h[at].view(np.int64))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(where), return_index=True)
    return at, np.concatenate(hashes)[first]


def digest(data: bytes, mark: int) -> tuple[int, int]:
    """128 bits of BLAKE2b as two signed numbers."""
    d = hashlib.blake2b(data, digest_size=16, key=mark.to_bytes(8, "little", signed=True)).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


@trimmed
def _find(batches: Iterator[pa.RecordBatch], words: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["rk", "ah", "ch", "cv", "pos", "right"]
    codes = Codes()
    for b in batches:
        out: list[list] = [[] for _ in names]
        for rk, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            raw = codes.of(raw) if words else raw
            if len(raw) < SPAN:
                continue
            at, h = anchors(raw)
            ctx = np.array([digest(raw[max(0, a - WIDTH + 1) : a + SPAN], min(a, WIDTH - 1)) for a in at.tolist()], np.int64)
            for column, x in zip(out, (np.full(len(at), rk, np.int64), h, ctx[:, 0], ctx[:, 1], at, np.minimum(len(raw) - at, SPAN))):
                column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)


#: Rows of contexts: the anchor's hash (or that of a part of it), the context's digest, bytes before the anchor, bytes.
CTX = "ah long, ch long, cv long, left int, ctx binary"
CTX_NAMES = ["ah", "ch", "cv", "left", "ctx"]
CTX_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _contexts(batches: Iterator[pa.RecordBatch], words: bool = False) -> Iterator[pa.RecordBatch]:
    """(text, wanted: [(ah, ch, cv, pos)]) to rows of contexts. A context is compressed by itself: in a
    shuffle to many partitions few rows travel together, so the shuffle's own compression hardly acts."""
    codes = Codes()
    for b in batches:
        for text, wanted in zip(b.column(0), b.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            raw = codes.of(raw) if words else raw
            w = wanted.values
            pos = w.field("pos").to_pylist()
            ctx = [zlib.compress(raw[max(0, p - WIDTH + 1) : p + SPAN], 6, -15) for p in pos]
            left = [min(p, WIDTH - 1) for p in pos]
            yield pa.RecordBatch.from_arrays([w.field("ah"), w.field("ch"), w.field("cv"), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())], CTX_NAMES)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context once for every range of window starts that it has windows in, under a hash of the
    bytes that all such windows share."""
    for b in batches:
        rows = []
        for ah, ch, cv, left, packed in zip(*(c.to_pylist() for c in b.columns)):
            ctx = zlib.decompress(packed, -15)
            for part, (lo, hi) in enumerate(zip(EDGES, EDGES[1:])):
                if lo <= left and len(ctx) - left >= SPAN - hi + 1:
                    rows.append((digest(ctx[left - lo : left + SPAN - hi + 1], ah ^ lo)[0], ch, cv, left, packed, part))
        yield columns(rows, [*CTX_NAMES, "part"], [*CTX_KINDS, pa.int32()])


class Suffixes:
    """What follows (or, reversed, precedes) the anchors of a block of contexts, in sorted order."""

    def __init__(self, data: np.ndarray, ph: PrefixHash, at: np.ndarray, reach: np.ndarray, run: np.ndarray, back: bool):
        self.data, self.ph, self.at, self.reach, self.run, self.back = data, ph, at, reach, run, back
        self.order = self.merge_sort()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.reach[a], self.reach[b])
        pa_, pb = self.at[a], self.at[b]
        while (low < high).any():
            mid = (low + high + 1) // 2
            step = mid if self.back else 0
            same = self.ph.of(pa_ - step, mid) == self.ph.of(pb - step, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        end = n >= np.minimum(self.reach[a], self.reach[b])
        off = -n - 1 if self.back else n
        last = len(self.data) - 1
        x, y = (self.data[np.clip(self.at[k] + off, 0, last)] for k in (a, b))
        ra, rb = self.reach[a], self.reach[b]
        inside = np.where(end, np.where(ra != rb, ra < rb, a < b), x < y)
        return np.where(self.run[a] != self.run[b], self.run[a] < self.run[b], inside)

    def merge_sort(self) -> np.ndarray:
        order, n, w = np.arange(len(self.at)), len(self.at), 1
        while w < n:
            place = np.arange(n)
            start = place - place % (2 * w)
            is_left = place % (2 * w) < w
            left = place[is_left]
            # elements of the right half below each of the left half, all by one binary search
            lo = np.minimum(start[left] + w, n)
            base, hi = lo.copy(), np.minimum(start[left] + 2 * w, n)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                i = np.flatnonzero(open_)
                below = self.less(order[mid[i]], order[left[i]])
                lo[i] = np.where(below, mid[i] + 1, lo[i])
                hi[i] = np.where(below, hi[i], mid[i])
            new, taken = np.empty_like(order), np.zeros(n, bool)
            to = left + (lo - base)
            new[to], taken[to] = order[left], True
            new[~taken] = order[~is_left]
            order, w = new, 2 * w
        return order

    def neighbours(self) -> np.ndarray | None:
        """Common extension of each with the one before, -1 between anchors; None on a hash collision."""
        a, b = self.order[:-1], self.order[1:]
        n = self.common(a, b)
        for i in range(0, len(n), BLOCK):
            m = n[i : i + BLOCK]
            row = np.repeat(np.arange(i, i + len(m)), m)
            k = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            k = -k - 1 if self.back else k
            if (self.data[self.at[a[row]] + k] != self.data[self.at[b[row]] + k]).any():
                return None
        return np.concatenate(([-1], np.where(self.run[a] == self.run[b], n, -1)))


def compare(run: np.ndarray, left: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For contexts sorted by run: how far before and after its anchor each one's repeated windows go
    (0, 0: none). All repeated windows hold the anchor, so what they cover is one piece."""
    sizes = np.array([len(c) for c in ctx], np.int64)
    data = np.frombuffer(b"".join(ctx), np.uint8)
    at = np.cumsum(sizes) - sizes + left
    n, ident = len(ctx), np.arange(len(ctx))
    for base in BASES:
        ph = PrefixHash(data, base, at - left)
        ahead, behind = Suffixes(data, ph, at, sizes - left, run, False), Suffixes(data, ph, at, left, run, True)
        near = ahead.neighbours(), behind.neighbours()
        if near[0] is not None and near[1] is not None:
            break
    else:
        raise RuntimeError("prefix hashes collide for every base")
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(WIDTH):
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[ahead.order] = np.cumsum(near[0] < SPAN - d)
        two[behind.order] = np.cumsum(near[1] < d)
        key = one * (n + 1) + two
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(n, bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit = ident[twice]
        lo[hit] = d
        hi[hit] = np.maximum(hi[hit], SPAN - d)
    return lo, hi


@trimmed
def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of contexts sorted by ah, ch, cv: whole runs, about BLOCK rows at a time."""

    def out(t: pa.Table) -> pa.RecordBatch:
        ah, ch, cv = (t.column(c).to_numpy() for c in ("ah", "ch", "cv"))
        again = (ah[1:] == ah[:-1]) & (ch[1:] == ch[:-1]) & (cv[1:] == cv[:-1])
        if again.any():
            t = t.filter(pa.array(np.concatenate(([True], ~again))))
            ah, ch, cv = (t.column(c).to_numpy() for c in ("ah", "ch", "cv"))
        lo, hi = compare(np.cumsum(np.concatenate(([0], ah[1:] != ah[:-1]))), t.column("left").to_numpy().astype(np.int64), [zlib.decompress(c, -15) for c in t.column("ctx").to_pylist()])
        some = hi > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ch, cv, lo, hi)], ["ch", "cv", "lo", "hi"])

    held = None
    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            held = pa.Table.from_batches([*(held.to_batches() if held else []), b.slice(s, BLOCK)])
            if held.num_rows >= BLOCK:
                ah = held.column("ah").to_numpy()
                cut = int(np.searchsorted(ah != ah[0], True)) if ah[0] == ah[-1] else int(np.flatnonzero(ah != ah[-1])[-1] + 1)
                if cut < len(ah):
                    yield out(held.slice(0, cut))
                    held = held.slice(cut)
    if held is not None and held.num_rows:
        yield out(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context that begins in the part's range as (ch, cv, d, digest)."""
    for b in batches:
        for ch, cv, left, ctx, part in zip(*(c.to_pylist() for c in b.columns)):
            ctx = zlib.decompress(ctx, -15)
            ds = range(max(EDGES[part], SPAN - (len(ctx) - left)), min(EDGES[part + 1], left + 1))
            yield columns([(ch, cv, d, *digest(ctx[left - d : left - d + SPAN], d)) for d in ds], ["ch", "cv", "d", "h1", "h2"], [pa.int64()] * 5)


def coverage(docs: DataFrame, run_limit: int = RUN_LIMIT, words: bool = False) -> DataFrame:
    """docs: (rk, text) to (rk, ranges: array of (s, e)): what repeated windows cover, by anchor. words: of its
    words' codes, not of the text."""
    found = save(docs.mapInArrow(partial(_find, words=words), "rk long, ah long, ch long, cv long, pos long, right long"), "anchors")
    per = save(found.groupBy("ah").agg(F.count("*").alias("all")).where("all > 1"), "anchors-met")
    again = join_by_key(found, per, ["ah"], "all")
    distinct = save(again.groupBy("ch", "cv").agg(F.first("ah").alias("ah"), F.count("*").alias("n"), F.min(F.struct("rk", "pos")).alias("rep")), "contexts")
    drop(per)
    k = save(distinct.groupBy("ah").agg(F.count("*").alias("k")).where("k > 1"), "contexts-met")
    wanted = join_by_key(distinct, k, ["ah"], "k").groupBy("rep.rk").agg(F.collect_list(F.struct("ah", "ch", "cv", "rep.pos")).alias("wanted"))
    wanted = save(wanted, "contexts-wanted")
    # a repeated row gives its contexts again; _compare_runs passes over them
    ctx = docs.join(wanted, "rk").select("text", "wanted").mapInArrow(partial(_contexts, words=words), CTX)
    compared = lambda rows: rows.repartition("ah").sortWithinPartitions("ah", "ch", "cv").mapInArrow(_compare_runs, "ch long, cv long, lo long, hi long")
    # anchors with over run_limit contexts: how many there are is bounded by the contexts over the limit
    hot = k.where(F.col("k") > run_limit)
    if hot.limit(1).count():
        ctx = save(ctx, "context-bytes")
        split = save(join_by_key(ctx, hot, ["ah"], "k").mapInArrow(_split, CTX + ", part int"), "context-parts")
        size = save(split.groupBy("ah").agg(F.count("*").alias("k")), "context-parts-met")
        w = join_by_key(split, size.where(F.col("k") > run_limit), ["ah"], "k").select("ch", "cv", "left", "ctx", "part").mapInArrow(_windows, "ch long, cv long, d long, h1 long, h2 long")
        w = save(w.distinct(), "context-windows")
        twice = save(w.groupBy("d", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1"), "context-windows-met")
        counted = join_by_key(w, twice, ["d", "h1", "h2"], "k").groupBy("ch", "cv").agg(F.max("d").alias("lo"), (SPAN - F.min("d")).alias("hi"))
        some = compared(ctx.join(k.where(F.col("k") <= run_limit).select("ah"), "ah", "left_semi"))
        part = compared(split.drop("part").join(size.where(F.col("k") <= run_limit).select("ah"), "ah", "left_semi"))
        once = some.unionByName(part).unionByName(counted).groupBy("ch", "cv").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    else:
        once = compared(ctx)
    whole = distinct.where("n > 1").select("ch", "cv", F.lit(SPAN).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"), "n")
    once = once.join(distinct.where("n = 1").select("ch", "cv", "n"), ["ch", "cv"])
    cover = save(whole.unionByName(once.select(*whole.columns)), "windows")
    for table in (distinct, k, wanted):
        drop(table)
    start = F.col("pos") - F.least("lo", "pos", F.lit(WIDTH - 1))
    ranges = join_by_key(found, cover, ["ch", "cv"], "n").select("rk", F.struct(start.alias("s"), (F.col("pos") + F.least("hi", "right")).alias("e")).alias("r"))
    # saved, so that the join with the texts is of two plain tables, whose skew (many equal rows) Spark splits
    return save(ranges.groupBy("rk").agg(F.collect_set("r").alias("ranges")), "ranges")


def merge(ranges: list[tuple[int, int]], gap: int = 0) -> list[list[int]]:
    """Sorted, those that meet as one; with a gap only those that overlap by so much."""
    merged: list[list[int]] = []
    for s, e in sorted(ranges):
        if merged and s + gap <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return merged


def passages(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of the codes of raw's words to ranges of its bytes. White space between two that only touch is in
    neither."""
    data = np.frombuffer(raw, np.uint8)
    word = np.diff(((data != 32) & ((data < 9) | (data > 13))).astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(word == 1), np.flatnonzero(word == -1)
    whole = [(-(-s // CODE), e // CODE) for s, e in merge(ranges, CODE)]
    return [(int(first[s]), int(end[e - 1])) for s, e in whole if e - s >= PASSAGE]


@trimmed
def _apply(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """(text, ranges, coded ranges, ...) to (n_bytes, n_removed, spans, kept, ...)."""
    pairs = lambda ranges: [(r["s"], r["e"]) for r in ranges or []]
    for b in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, ranges, coded in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = text.as_py()
            raw = (own or "").encode("utf-8", "replace")
            merged = merge(pairs(ranges) + (passages(raw, pairs(coded)) if coded else []))
            at, left = 0, []
            for s, e in merged:
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(e - s for s, e in merged))
            spans.append([{"s": s, "e": e} for s, e in merged])
            if as_text:
                kept.append(b"".join(left).decode("utf-8", "ignore") if merged else own)
            else:
                kept.append(b"".join(left))
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string() if as_text else pa.binary()), *b.columns[3:]],
            ["n_bytes", "n_removed", "spans", "kept", *b.schema.names[3:]],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), run_limit: int = RUN_LIMIT, as_text: bool = False, words: bool = False) -> DataFrame:
    """n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the other bytes), id_col and the columns in carry.
    as_text: kept is a string without characters cut in half; a text that lost nothing is as it was, null included.
    words: passages of PASSAGE words that occur elsewhere are removed, too."""
    if clash := {c.lower() for c in carry} & {id_col.lower(), "n_bytes", "n_removed", "spans", "kept"}:
        raise ValueError(f"the result has columns of these names itself: {sorted(clash)}")
    small_batches(docs.sparkSession)
    rk = F.xxhash64(F.col(id_col), F.col(text_col))
    cols = [id_col, *carry]
    # narrow names inside, so that a column called text or rk can be carried
    rows = docs.select(rk.alias("__rk"), F.col(text_col).alias("__text"), *cols)
    texts = rows.select(F.col("__rk").alias("rk"), F.col("__text").alias("text"))
    cover = coverage(texts, run_limit)
    if words:
        coded = coverage(texts, run_limit, True).withColumnRenamed("ranges", "coded")
        both = save(cover.join(coded, "rk", "full"), "ranges-both")
        drop(cover)
        drop(coded)
        cover = both
    else:
        cover = cover.withColumn("coded", F.lit(None).cast(cover.schema["ranges"].dataType))
    cover = cover.select(F.col("rk").alias("__rk"), F.col("ranges").alias("__ranges"), F.col("coded").alias("__coded"))
    types = dict(docs.dtypes)
    schema = "n_bytes long, n_removed long, spans array<struct<s: long, e: long>>, kept " + ("string" if as_text else "binary") + "".join(f", `{c}` {types[c]}" for c in cols)
    return rows.join(cover, "__rk", "left").select("__text", "__ranges", "__coded", *cols).mapInArrow(partial(_apply, as_text=as_text), schema)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
