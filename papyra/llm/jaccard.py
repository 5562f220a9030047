"""Near-duplicates by exact similarity: shingle sets whose Jaccard similarity is 0.8 or more are linked.

Candidates come from min-hash keys: BANDS keys of ROWS minima each, so a pair at similarity s shares none
with probability (1 - s^ROWS)^BANDS: 7e-10 at 0.8. Documents that share a key are compared in full, by the
sets of their shingles' 64-bit hashes; the keys choose what is compared and never decide a link. In keys
with few documents pairs are formed; larger ones are compared as a whole, in chunks where they are long,
breadth first by rarest shingles, so dense groups take few steps.

Equal sets are one entry from the start. Nulls: a null text has no shingle, like an empty one, and these
equal each other; a row with a null id takes part through rows with an equal set, and stays. Rows that
share an id are one document. A text shorter than a shingle is one shingle; very long ones are taken whole,
their minima in chunks. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, keep_ids, save, small_batches, trimmed

BANDS, ROWS = 40, 4
SMALL_RUN = 32
RUN_LIMIT = 200_000
#: Shingles compared in one step of a task, a chunk of 8 bytes each.
TOKENS = 2_000_000
CHUNK = 4096
_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MUL = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles' XXH64, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes, as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in joined], np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), CHUNK):
        low = np.minimum(low, ((h[at : at + CHUNK, None] ^ _XOR) * _MUL).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL[0]
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * _MUL[1]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signature(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def _prints(shingle: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(t.as_py(), shingle) for t in b.column(1))
            rows = [(signature(h), len(h), band_keys(h)) for h in sets]
            sig, n, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "sig", "n", "keys"])

    return run


def _sets(shingle: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(signature, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "sig", "hashes"])

    return run


def candidates(key: np.ndarray, sig: np.ndarray, rep: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of equal key (sorted) to rows (group, sig, rep, n) of what must be compared: a pair is a group
    named by its first member, so that the pairs of one member meet; a larger run is one by its members."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    size = np.repeat(sizes, sizes)
    rows = np.stack((sig, rep, n))
    out = [np.zeros((4, 0), np.int64)]
    for s, m in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
        part = rows[:, s : s + m]
        name = signature(np.sort(part[0]))
        out.append(np.concatenate((np.full((1, m), name), part)))
    small = np.flatnonzero((size > 1) & (size <= SMALL_RUN))
    k, r = key[small], rows[:, small]
    for d in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
        a, b = r[:, d:], r[:, :-d]
        fits = (k[d:] == k[:-d]) & (5 * np.minimum(a[2], b[2]) >= 4 * np.maximum(a[2], b[2]))
        a, b = a[:, fits], b[:, fits]
        first = np.where(a[0] < b[0], a[0], b[0])
        out += [np.concatenate((first[None], a)), np.concatenate((first[None], b))]
    return np.unique(np.concatenate(out, 1), axis=1)


@trimmed
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["grp", "sig", "rep", "n"])

    held, gone = [np.zeros(0, np.int64)] * 4, None
    for batch in batches:
        cols = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        if gone is not None and len(cols[0]):  # the rest of a run that was too long to hold
            m = int((cols[0] == gone).sum())
            yield out(np.stack([c[:m] for c in cols]))
            cols = [c[m:] for c in cols]
            gone = None if len(cols[0]) else gone
        if not len(cols[0]):
            held = cols
            continue
        last = int(np.argmax(cols[0] == cols[0][-1]))
        if last:
            yield out(candidates(*(c[:last] for c in cols)))
        held = [c[last:] for c in cols]
        if len(held[0]) > RUN_LIMIT:
            gone = held[0][0]
            yield out(np.stack(held))
            held = [h[:0] for h in held]
    if len(held[0]):
        yield out(candidates(*held))


def similar(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (as positions) that join exactly what chains of pairs at 0.8 or more join."""
    alive = np.arange(len(sets))
    while True:  # who shares under 0.8 of its shingles with all the others together has no link
        n = np.array([len(sets[i]) for i in alive], np.int64)
        if len(alive) < 2:
            return [], []
        _, tok, count = np.unique(np.concatenate([sets[i] for i in alive]), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(alive)), n)
        keep = 5 * np.bincount(doc[count[tok] > 1], minlength=len(alive)) >= 4 * n
        if keep.all():
            break
        alive = alive[keep]
    tok = tok[np.lexsort((count[tok], doc))]  # each document's shingles, the rarest first
    ends = np.cumsum(n)
    own = [tok[e - m : e] for e, m in zip(ends.tolist(), n.tolist())]
    posted = doc[np.argsort(tok, kind="stable")]
    post_ends = np.cumsum(count)
    free, mark = np.ones(len(alive), bool), np.zeros(len(count), bool)
    a, b = [], []
    for seed in range(len(alive)):
        front = [seed] if free[seed] else []
        free[seed] = False
        while front:
            at = front.pop()
            if (rest := np.flatnonzero(free[seed:]) + seed).size > 64:
                # 0.8 of its shingles are in any other that is similar, so one of these is
                first = own[at][: len(own[at]) - (4 * len(own[at]) + 4) // 5 + 1]
                met = np.concatenate([posted[e - m : e] for e, m in zip(post_ends[first].tolist(), count[first].tolist())])
                rest = np.unique(met[free[met]])
            rest = rest[5 * np.minimum(n[rest], n[at]) >= 4 * np.maximum(n[rest], n[at])]
            if not len(rest):
                continue
            mark[own[at]] = True
            both = np.array([np.count_nonzero(mark[own[i]]) for i in rest.tolist()])
            mark[own[at]] = False
            hit = rest[9 * both >= 4 * (n[at] + n[rest])]
            free[hit] = False
            front += hit.tolist()
            a += alive[hit].tolist()
            b += [int(alive[at])] * len(hit)
    return a, b


@trimmed
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, sig, rep, hashes), sorted by grp, to links between reps."""
    found: list[tuple[int, int]] = []

    def compare(run: dict) -> None:
        reps = [r for r, _ in run.values()]
        a, b = similar([np.frombuffer(h, np.uint64) for _, h in run.values()])
        found.extend((reps[x], reps[y]) for x, y in zip(a, b))

    name, run = None, {}
    for batch in batches:
        for g, s, r, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if g != name:
                compare(run)
                name, run = g, {}
            run[s] = r, h.as_py()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
            found.clear()
    compare(run)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def links(docs: DataFrame, entries: DataFrame, id_col: str, text_col: str, shingle: int, tokens: int = TOKENS) -> DataFrame:
    """entries: (sig, rep, n, keys), each sig once, rep a long id. Returns links (a, b) between reps."""
    rows = entries.select(F.explode("keys").alias("key"), "sig", "rep", "n").repartition("key").sortWithinPartitions("key")
    saved = groups = save(rows.mapInArrow(_candidates, "grp long, sig long, rep long, n long").distinct(), "jaccard-groups")
    sizes = groups.groupBy("grp").agg(F.sum("n").alias("total")).where(F.col("total") > tokens)
    parts = sizes.select("grp", F.ceil(F.col("total") / (tokens / 2)).cast("int").alias("parts"))
    if parts.limit(1).count():
        own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("grp", F.least(own, j), F.greatest(own, j)))
        chunks = groups.join(parts, "grp").select(F.explode(pairs).alias("grp"), "sig", "rep")
        groups = groups.join(parts, "grp", "left_anti").select("grp", "sig", "rep").union(chunks)
    needed = save(groups.select(F.col("rep").alias(id_col)).distinct(), "jaccard-needed", False)
    sets = keep_ids(docs.select(id_col, text_col), needed, id_col).mapInArrow(_sets(shingle), "rep long, sig long, hashes binary")
    rows = groups.join(sets, ["rep", "sig"]).select("grp", "sig", "rep", "hashes")
    found = save(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verified, "a long, b long").distinct(), "jaccard-links")
    drop(saved)
    return found


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, among: DataFrame | None = None) -> DataFrame:
    """id_col: the least id of each component, as a table of its own; what it was made from is deleted.
    among: the ids (id_col) that take part, where not all do."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    prints = save(docs.select(id_col, text_col).mapInArrow(_prints(shingle), f"id {kind}, sig long, n long, keys array<long>"), "jaccard")
    if among is not None:
        all_, prints = prints, save(keep_ids(prints, among.withColumnRenamed(id_col, "id"), "id"), "jaccard-among")
        drop(all_)
    entries = save(prints.where("id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "jaccard-entries")
    found = links(docs, entries, id_col, text_col, shingle)
    roots = connected_components(found)
    of_sig = entries.join(roots, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("root", "rep").alias("least"))
    kept = save(prints.select("id", "sig").join(of_sig, "sig").where("id = least").select(F.col("id").alias(id_col)).distinct(), "jaccard-kept")
    for table in (prints, entries, found):
        drop(table)
    return kept


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs that stay when the document of least id of each component does."""
    kept = kept_ids(docs, id_col, text_col, shingle)
    return keep_ids(docs, kept, id_col).unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
