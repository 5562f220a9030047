"""A training corpus from documents: language ID, SimHash near-dedup, suffix-array dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it again for the next. Extra columns, whatever their names, go along up to
mixing; repeated rows count as rows; empty tables stay empty; texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bpe, jaccard, langid, mixing, simhash, suffix_dedup
from papyra.llm.common import drop, join_by_key, keep_ids, save


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ... and which is which: so no column of the input, whatever its
    name, meets a name of an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {name: f"c{i}" for i, name in reversed(list(enumerate(docs.columns)))}


def renamed(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter) go. An empty table stays one."""
    own, at = numbered(docs)
    names = at["doc_id"], at["text"]
    model = langid.fit(own.where(~langid.held_out(names[0])), *names, at["lang"])
    rest = tuple(c for c in own.columns if c != names[0])
    return renamed(langid.predict(own, model, *names, keep=rest).where("lang_pred <> 'und'"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: 5-word shingles, up to 6 of 64 bits apart. Rows without an id stay."""
    own, at = numbered(docs)
    return renamed(simhash.keep_one(own, at["doc_id"], at["text"]), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash first, which finds few of the pairs between 0.8 and 0.9; then no two documents stay whose
    sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Ids decide which stays (the least);
    rows that share an id are one document, and rows without an id stay."""
    own, at = numbered(docs)
    name, text = at["doc_id"], at["text"]
    first = simhash.kept_ids(own, name, text)
    kept = jaccard.kept_ids(own, name, text, among=first)
    drop(first)
    return renamed(keep_ids(own, kept, name).unionByName(own.where(F.col(name).isNull())), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, words: bool = False) -> DataFrame:
    """Bytes in 400-byte strings that occur elsewhere too go; characters cut in half go whole. A null text
    stays null; texts that lose nothing stay as they are; a text may lose all and stay, empty. words: so do
    runs of 50 words that occur elsewhere, however few bytes these have."""
    own, at = numbered(docs)
    name, text, n_chars = at["doc_id"], at["text"], at["n_chars"]
    rest = tuple(c for c in own.columns if c not in (name, text, n_chars))
    out = suffix_dedup.remove_repeats(own, name, text, carry=rest, as_text=True, words=words).withColumnRenamed("kept", text)
    return renamed(out.withColumn(n_chars, F.length(text).cast(dict(own.dtypes)[n_chars])), docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, docs, sf_dir, words=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (whole copies; documents without a word go). Equal rows
    are rounded together and each copy is one of them; null ids and sources are values like others."""
    own, at = numbered(docs)
    id_, text, source = at["doc_id"], at["text"], at["source"]
    own = own.withColumn("row", F.xxhash64(*[c for c, kind in own.dtypes if "map<" not in kind]))
    got = mixing.groups(own, id_, text, source, carry=("row",))
    key = ["row", "mark"]
    got = save(got.select(F.col("carry.row").alias("row"), F.xxhash64("id", "source", "size", "t").alias("mark"), "n", (F.col("n") * F.col("base") + F.col("more")).alias("copies")), "mixture")
    own = own.withColumn("mark", F.xxhash64(id_, source, mixing.n_words(text), F.xxhash64(text)))
    again = lambda rows: rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*own.columns)
    out = again(own.join(got.where("n = 1 and copies > 0").drop("n"), key))
    many = got.where("n > 1")
    if many.limit(1).count():
        many = save(many, "mixture-equal")
        met = join_by_key(own, many, key, "n").where("copies > 0")
        one = met.groupBy(*key, "copies").agg(F.first(F.struct(*[c for c in own.columns if c not in key])).alias("one"))
        out = out.unionByName(again(one.select(*key, "copies", "one.*")))
    return renamed(out, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: the tokens, checked by decoding them. A null
    text has no tokens."""
    own, at = numbered(docs)
    return bpe.encoded(own, public_tokenizers.path("byte_bpe_50k.json"), at["doc_id"], at["text"], outputs=("ids",)).withColumnRenamed(at["doc_id"], "doc_id")


STAGES = [
    ("language_id", language), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", shared_passages),
    ("mixing", mixture), ("bpe", tokens),
]

#: Mixing draws and tokens are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
