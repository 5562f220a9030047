"""Language ID in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the whole lower-cased text (square roots, unit length). Squared
hinge SVMs are fitted on the driver from a bounded sample: about SAMPLE rows, shared evenly by the
languages and drawn by a hash of the id; their features, not their texts, come to the driver. A
language whose family is not listed forms a family of its own.

Nulls: rows with a null id, text or lang are not learned from. A null text, or one without a letter,
is `und` with score 0; so is everything where no language could be learned, as from an empty table. Ties
go to the language first by name. Rows are judged one by one: repeats and extra columns change nothing, and
very long texts are counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

DIM = 2048
SAMPLE = 6000
CHUNK = 1 << 20
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk pl cs sk bg sr hr sl",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> np.ndarray:
    """Counts by hash bucket; long texts go through in chunks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        b = raw[at : at + CHUNK + 2].astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            counts += np.bincount((code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIM.bit_length() + 1), minlength=DIM)
    return counts


def vector(text: str) -> np.ndarray:
    v = np.sqrt(trigrams(text)).astype(np.float32)
    return v / max(1e-9, float(np.linalg.norm(v)))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a squared-hinge linear SVM (y: -1 or 1), classes weighted alike, by
    accelerated gradient steps. x must have a last column of ones."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue of the loss's curvature
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (1e-3 + 2 * float(v @ (x.T @ (weight * (x @ v)))))
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (1e-3 * z - 2 * (x.T @ (weight * slack * y)))
        z = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


class Model:
    """langs: learned languages by name; family_w: one row per family; pair_w: one per language pair."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        lang = np.array(langs)
        self.langs = sorted(set(langs))
        fam = np.array([FAMILY.get(v, v) for v in langs])
        self.families = sorted(set(fam))
        self.members = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in self.families}
        self.family_w = np.stack([fit_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        self.pair_w = {}
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1 :]:
                    pick = (lang == a) | (lang == b)
                    self.pair_w[a, b] = fit_svm(x[pick], np.where(lang[pick] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.family_w is None:
            chosen, sure = np.zeros(len(x), int), np.full(len(x), 9.0)
        else:
            m = x @ self.family_w.T
            chosen = m.argmax(1)
            top2 = -np.sort(-m, axis=1)[:, :2]
            sure = (top2[:, 0] - top2[:, 1]) / 2
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f, name in enumerate(self.families):
            rows, members = np.flatnonzero(chosen == f), self.members[name]
            votes = np.zeros((len(rows), len(members)))
            margin = np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = x[rows] @ self.pair_w[a, members[j]]
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margin[:, i] += m
                    margin[:, j] -= m
            best = (votes + 1e-6 * margin).argmax(1)
            own = margin[np.arange(len(rows)), best] / max(1, len(members) - 1) if len(members) > 1 else np.full(len(rows), 9.0)
            for r, b, o in zip(rows.tolist(), best.tolist(), own.tolist()):
                out[r] = members[b], float(1 / (1 + np.exp(-3 * np.clip(min(o, sure[r]), -8, 8))))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """docs: the rows that may be learned from. The sample is shared evenly by the languages."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    each = sample / len(counts)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    # by id and text, so that rows which share an id are drawn one by one
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kind = dict(docs.dtypes)[lang_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [vector(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["lang", "v", "draw"])

    small_batches(docs.sparkSession)
    picked = usable.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col), draw.alias("draw"))
    # equal rows share a draw, and one of them is enough to learn from; what is left is about `sample` rows, so
    # the limit, a bound on what the driver takes, cuts nothing
    got = picked.mapInArrow(run, f"lang {kind}, v binary, draw double").dropDuplicates(["lang", "draw"]).limit(2 * sample).toPandas()
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["v"].map(bytes)), np.float32).reshape(len(got), DIM)
    order = np.lexsort((x @ np.arange(DIM, dtype=np.float32), got["lang"].to_numpy()))  # the same order in each run
    return Model(x[order], got["lang"].iloc[order].tolist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score and the columns in keep, which can't have these names themselves."""
    types = dict(docs.dtypes)
    cols = [id_col, *keep]
    if clash := {c.lower() for c in keep} & {id_col.lower(), "lang_pred", "score"}:
        raise ValueError(f"the result has columns of these names itself: {sorted(clash)}")
    schema = ", ".join([f"`{c}` {types[c]}" for c in cols] + ["lang_pred string", "score double"])

    place = cols.index(text_col) if text_col in cols else len(cols)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t.as_py() for t in b.column(place)]
                ok = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
                out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
                if ok:
                    for i, p in zip(ok, model.predict(np.stack([vector(texts[i]) for i in ok]))):
                        out[i] = p
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: len(cols)], pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*cols, "lang_pred", "score"]
                )

    small_batches(docs.sparkSession)
    return docs.select(*cols, *([] if place < len(cols) else [F.col(text_col)])).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 3 = 1; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score: learned from the rows not held out, applied to all."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
