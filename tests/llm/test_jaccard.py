"""The near-copy stage against brute force over all pairs."""

import numpy as np

import corpus_pipeline as p
from papyra.llm import jaccard
from papyra.llm.common import connected_components


def shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def close(a, b):
    return 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)


def least(ids, linked):
    root = dict(zip(ids, ids))
    while True:
        new = {i: min([root[i], *(root[j] for j in linked[i])]) for i in ids}
        if new == root:
            return root
        root = new


def graph(sets):
    return {i: [j for j in sets if j != i and close(sets[i], sets[j])] for i in sets}


def noisy(copies, words, seed):
    """Copies of one text with some words changed: similarities all around 0.8."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 5000, words)
    for _ in range(copies):
        new = base.copy()
        new[rng.integers(0, words, rng.integers(0, words // 12))] = rng.integers(5000, 10**6)
        yield " ".join(f"w{x}" for x in new)


def test_stage_leaves_no_near_copies(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: shingles(r.text) for r in dict(p.STAGES)["simhash_near_dedup"](spark, docs, sf).collect()}
    assert not any(graph(got).values())
    first = {r.doc_id: shingles(r.text) for r in p.near_duplicates(spark, docs, sf).collect()}
    root = least(list(first), graph(first))
    assert sorted(got) == sorted(i for i in first if root[i] == i)


def test_links_against_brute_force(spark):
    texts = [None, "", "one two", "One  two", *(t for g in range(6) for t in noisy(60, 150, g)), *(t for g in range(40) for t in noisy(2, 120, 100 + g))]
    sets = dict(enumerate(map(shingles, texts)))
    want = least(list(sets), graph(sets))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[5]), (7, texts[7])], "doc_id long, text string")
    got = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([None, *(i for i in sets if want[i] == i), *([7] if want[7] == 7 else [])], key=str)
    assert not jaccard.keep_one(docs.limit(0)).count()
    prints = docs.where("doc_id is not null").mapInArrow(jaccard._prints(5), "id long, sig long, n long, keys array<long>")
    entries = prints.groupBy("sig", "n", "keys").agg({"id": "min"}).withColumnRenamed("min(id)", "rep")
    roots = dict(map(tuple, connected_components(jaccard.links(docs, entries, "doc_id", "text", 5, tokens=3000)).collect()))  # by way of chunks
    reps = [r.rep for r in entries.collect()]
    assert {i: roots.get(i, i) for i in reps} == {i: want[i] for i in reps}
