"""Every secret against every text: which texts hold which secrets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Secrets up to this number and this many bytes in all travel to the tasks as one automaton.
MAX_SECRETS, MAX_BYTES = 10_000, 4 << 20
#: Longer lists are met by hashes: of the least hashed GRAM bytes in each stretch of SPAN bytes.
GRAM, SPAN = 8, 24


@lru_cache(2)
def _automaton(secrets: tuple[tuple[int, str], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    by_text: dict[str, list] = {}
    for key, s in secrets:
        by_text.setdefault(s, []).append(key)
    for s, keys in by_text.items():
        a.add_word(s, keys)
    a.make_automaton()
    return a


def minimizers(raw: bytes) -> list[int]:
    """The hashes that stand for the stretches of SPAN bytes: equal stretches have one in common."""
    n = len(raw) - GRAM + 1
    wide = SPAN - GRAM + 1
    if n < wide:
        return []
    h = np.zeros(n, np.uint64)
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for k in range(GRAM):
        h = (h ^ data[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    low = h[: n - wide + 1].copy()
    for k in range(1, wide):
        np.minimum(low, h[k : k + n - wide + 1], out=low)
    return np.unique(low).view(np.int64).tolist()


def leak_pairs(docs: DataFrame, secrets: DataFrame, key: str, text: str, secret_key: str, secret: str) -> DataFrame:
    """(key, secret_key) where the text holds the secret. A short list of secrets (MAX_SECRETS, MAX_BYTES) goes
    to the tasks as an Aho-Corasick automaton; otherwise texts and secrets meet in an equi-join on hashes of
    their parts, and the secret is then looked for. Null and empty secrets match nothing."""
    kinds = dict(docs.dtypes) | {f"s:{c}": k for c, k in secrets.dtypes}
    secrets = secrets.where(F.length(secret) > 0).select(secret_key, F.col(secret).alias("secret"))
    size = secrets.agg(F.count("*"), F.sum(F.octet_length("secret")), F.min(F.octet_length("secret"))).first()
    schema = f"`{key}` {kinds[key]}, `{secret_key}` {kinds[f's:{secret_key}']}"
    if size[0] <= MAX_SECRETS and (size[1] or 0) <= MAX_BYTES:
        listed = tuple(sorted(map(tuple, secrets.collect()), key=str))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _automaton(listed)
            for b in batches:
                ids, found = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    hits = {k for _, keys in a.iter(t.as_py() or "") for k in keys} if listed else set()
                    ids += [i] * len(hits)
                    found += sorted(hits)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(found, pa.int64())], [key, secret_key])

        return docs.select(key, text).mapInArrow(run, f"`{key}` {kinds[key]}, `{secret_key}` long").select(key, F.col(secret_key).cast(kinds[f"s:{secret_key}"]).alias(secret_key))
    if size[2] < SPAN:
        raise ValueError(f"a long list of secrets needs at least {SPAN} bytes in each")

    def hashed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, h) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for h in minimizers((t.as_py() or "").encode()[: SPAN if first else None])]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], b.column(0).type), pa.array([h for _, h in rows], pa.int64())], ["k", "h"])

        return run

    one = docs.select(key, text).mapInArrow(hashed(False), f"k {kinds[key]}, h long").withColumnRenamed("k", key)
    two = secrets.mapInArrow(hashed(True), f"k {kinds[f's:{secret_key}']}, h long").withColumnRenamed("k", secret_key)
    met = one.join(two, "h").select(key, secret_key).distinct()
    return met.join(docs.select(key, text), key).join(secrets, secret_key).where(F.contains(text, "secret")).select(key, secret_key).distinct()
