"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint's 64 bits are cut into max_distance + 3 blocks. Two fingerprints within max_distance
agree in at least three of these, so each distinct fingerprint is listed under every choice of three
blocks, and only fingerprints with a common key are compared: with 20 keys of about 32 bits for
distance 3, hardly any other pair meets. Rows with one key are compared as they stream by, sorted by
key; a key's links come out as a spanning forest, never as all pairs. Keys with more than RUN_LIMIT
fingerprints are found first (by a count over a part of them) and dealt in chunks from the start, every pair
of chunks to a bounded task of its own.

Equal fingerprints (copies above all) are one entry from the start, whatever their number. Nulls: a
null text has no words and fingerprint zero, like an empty one. A row with a null id takes part through
rows that share its fingerprint, and its component is theirs (null if there are none). Repeated rows
come out as often as they went in; extra columns are left behind. An empty table gives no rows. Very long
texts are hashed in chunks of shingles; ties (a bit set in just half of them) count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, forest, join_by_key, keep_ids, save, small_batches, trimmed

RUN_LIMIT = 200_000
#: Rows of a key at the limit that the counted part holds, on average.
SEEN = 200
SMALL_RUN = 32
CHUNK = 50_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits as a signed integer: bit i is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    small_batches(docs.sparkSession)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp long")


def block_masks(max_distance: int) -> list[int]:
    """Masks of all choices of three among max_distance + 3 blocks, as signed 64-bit numbers."""
    n = max_distance + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(blocks, 3)]


def link_large(fp: np.ndarray, rep: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth first: whatever is reached leaves the set of candidates, so dense groups take few steps."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        seed, left, front = left[0], left[1:], [fp[left[:1]]]
        while front and len(left):
            f = front.pop()
            if len(f) > 16:
                front.append(f[16:])
            hit = (np.bitwise_count(f[:16, None] ^ fp[left][None, :]) <= max_distance).any(0)
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(rep[new])
                b.append(np.full(len(new), rep[seed]))
                front.append(fp[new])
    return (np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])


def link_runs(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (rows sorted by key), as a forest."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    size = np.repeat(sizes, sizes)
    a, b = [rep[:0]], [rep[:0]]
    for s, n in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
        x, y = link_large(fp[s : s + n], rep[s : s + n], max_distance)
        a.append(x)
        b.append(y)
    small = np.flatnonzero((size > 1) & (size <= SMALL_RUN))
    k, f, r = key[small], fp[small], rep[small]
    for d in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
        i = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= max_distance))
        a.append(r[i + d])
        b.append(r[i])
    a, b = np.concatenate(a), np.concatenate(b)
    return forest(a, b) if len(a) else (a, b)


def _linker(max_distance: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, fp, rep), sorted by key, to links (a, b)."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            last = int(np.searchsorted(cols[0] == cols[0][-1], True)) if len(cols[0]) else 0
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in link_runs(*(c[:last] for c in cols), max_distance)], ["a", "b"])
            held = [c[last:] for c in cols]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in link_runs(*held, max_distance)], ["a", "b"])

    return run


def links(entries: DataFrame, max_distance: int, run_limit: int = RUN_LIMIT) -> DataFrame:
    """entries: (fp, rep), each fp once, rep a long id. Returns links (a, b) between reps."""
    small_batches(entries.sparkSession)
    masks = F.array(*map(F.lit, block_masks(max_distance)))
    keys = F.transform(masks, lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
    rows = entries.select(F.explode(keys).alias("key"), "fp", "rep")
    # keys with over run_limit rows, found by counting the keys of a part of the fingerprints; the list holds at
    # most a key for each run_limit rows. It only decides how rows are dealt: a key that it misses is linked too
    part = min(1.0, SEEN / run_limit)
    some = rows.where(F.pmod(F.xxhash64("fp", F.lit("part")), F.lit(1 << 20)) < int(part * (1 << 20)))
    hot = save(some.groupBy("key").agg(F.count("*").alias("met")).where(F.col("met") > run_limit * part), "simhash-hot", False)
    plain = rows
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
        n = F.broadcast(hot.select("key", F.ceil(F.col("met") / part / (run_limit / 4)).cast("int").alias("n")))
        chunks = rows.join(n, "key").select(F.explode(pairs).alias("key"), "fp", "rep")
        plain = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").select("key", "fp", "rep").unionByName(chunks)
    found = plain.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(max_distance), "a long, b long")
    return save(found, "simhash-links")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3,
               run_limit: int = RUN_LIMIT) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (least id reachable by links), fp (as a long)."""
    prints = save(fingerprints(docs, id_col, text_col, shingle), "simhash")
    entries = save(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-entries")
    found = links(entries.where("rep is not null").select("fp", "rep"), max_distance, run_limit)
    roots = connected_components(found)
    drop(found)
    of_fp = save(entries.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n"), "simhash-components")
    drop(entries)
    # a fingerprint of very many rows (copies, empty texts) gets its component by broadcast
    return join_by_key(prints, of_fp, ["fp"], "n").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 6) -> DataFrame:
    """id_col: the ids that stay when one document of each component does, as a table of its own. Distance 6
    of 64 stands for a similarity of shingle sets well above 0.8 (cosine about 0.96)."""
    return save(components(docs, id_col, text_col, shingle, max_distance).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct(), "simhash-kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 6) -> DataFrame:
    """The rows of docs with such an id. Rows that share an id are one document; rows without one stay."""
    kept = kept_ids(docs, id_col, text_col, shingle, max_distance)
    return keep_ids(docs, kept, id_col).unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
