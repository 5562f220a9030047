"""Toxicity by a weighted finite-state grammar of clauses.

A clause's words become symbols (insult, threat, target, negation, vow, report, other). Three transducers
mark what reaches over later words: negation over the next few, reported speech to the clause's end, a vow
("will", "going to") over the next few. Composed with each of them in turn come two weighted automata, one
that picks an insult and one that picks a threat. They are nondeterministic: a path picks one head, and
either a target stood within a few words before it, or the path owes one within a few words after it and
dies if none comes; an insult may also go without, a threat may not. A path's weight is the product of its
arcs' (the head's own weight, and a factor for each mark); a clause has the best path's weight and half of
the others'. A document's clause weights go into a logistic score.

Weights are learned. A word is listed as an insult if the neighbours it has in toxic documents are many
and hardly any are in others (neighbours, not documents, are counted, so that copies of one document
do not make its words insults). A mark's factor is the log-odds of toxicity with it over those without,
drawn to a prior where few documents show it. The sample is bounded: SAMPLE labelled rows, in order of a
hash of the id. A few seed words per class and language stand for what the sample does not show.

Nulls: a null text scores like an empty one (the share of label 1 among texts without a match); null
ids or labels are not learned from; if labels of an id differ, 1 wins. Rows are scored one by one:
repeats and extra columns change nothing, and long texts are read clause by clause. Without labelled rows,
as with empty tables, the seed weights alone are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches

SAMPLE = 20_000
LEXICON = 500
SEEDS = {
    "insult": "idiot idiots moron morons imbecile stupid scum trash worthless pathetic disgusting loser losers clown idiota imbécil estúpido basura escoria dumm dummkopf abschaum widerlich trottel imbécile crétin ordure pathétique dégoûtant",
    "threat": "kill hurt destroy die attack punish töten umbringen vernichten tuer détruire crever matar destruir morir",
    "target": "you your yourself he him she her they them this that these those people who du dich ihr sie diese tu vous ils elles ces vosotros ustedes ellos estos esa ese",
    "negation": "not no never isn't aren't wasn't don't doesn't nobody without nicht kein keine nie ne pas jamais sans nunca jamás sin",
    "vow": "will gonna shall must should werde werden wird sollte vais va doit voy vas debe",
    "report": "said says say claimed called quoted wrote according reported sagte schrieb laut nannte dit écrit selon dijo escribió según llamó",
}
CLAUSE = re.compile(r"[.!?;:|\n]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
PRIOR = 2.0


WINDOW = 6
#: Prior factors of the marks on a head; learned ones are drawn to these.
FACTOR = {"negated": 0.4, "reported": 0.6, "targeted": 1.25, "vowed": 1.2, "bare": 1.0}
HEADS = ("insult", "threat")


class Transducer:
    """Weighted and nondeterministic: arcs(state, symbol) gives (state, output symbol, weight) for each arc.
    A symbol is (class, marks). final(state): whether a path may end there."""

    def __init__(self, start, arcs, final=lambda state: True):
        self.start, self.arcs, self.final = start, arcs, final


def marker(cls: str, mark: str, reach: int | None) -> Transducer:
    """Puts a mark on heads within reach words after a word of class cls; None: to the end."""

    def arcs(state: int, symbol: tuple) -> list[tuple]:
        kind, marks = symbol
        if kind == cls:
            return [(reach or 1, symbol, 1.0)]
        out = (kind, marks | {mark}) if state and kind in HEADS else symbol
        return [(state if reach is None else max(0, state - 1), out, 1.0)]

    return Transducer(0, arcs)


def picker(head: str, factor: dict[str, float]) -> Transducer:
    """Picks one head. States: (words since a target, or 0; what the path has done: 0 picked nothing yet,
    1 picked, -k: picked and owes a target within k words)."""

    def arcs(state: tuple, symbol: tuple) -> list[tuple]:
        since, did = state
        kind, marks = symbol
        if kind == "target":
            return [((WINDOW, 1 if did < 0 else did), symbol, 1.0)]
        if did == -1:
            return []
        after = (max(0, since - 1), did + 1 if did < 0 else did)
        out = [(after, symbol, 1.0)]
        if kind == head and did == 0:
            weight = math.prod(factor[m] for m in marks)
            if since:
                out.append(((after[0], 1), symbol, weight * factor["targeted"]))
            else:
                out.append(((0, -WINDOW), symbol, weight * factor["targeted"]))
                if head == "insult":
                    out.append(((0, 1), symbol, weight * factor["bare"]))
        return out

    return Transducer((0, 0), arcs, lambda state: state[1] == 1)


def compose(*parts: Transducer) -> Transducer:
    """One machine whose states are tuples and whose weights are products; arcs are made as they are met and kept."""
    table: dict = {}

    def arcs(state: tuple, symbol: tuple) -> list[tuple]:
        if (hit := table.get((state, symbol))) is None:
            hit = [((), symbol, 1.0)]
            for k, part in enumerate(parts):
                hit = [((*now, s), out, w * v) for now, x, w in hit for s, out, v in part.arcs(state[k], x)]
            table[state, symbol] = hit
        return hit

    return Transducer(tuple(p.start for p in parts), arcs, lambda state: all(p.final(s) for p, s in zip(parts, state)))


def best_and_sum(machine: Transducer, symbols: list[tuple], weight: list[float]) -> tuple[float, float]:
    """The weight of the best path and of all paths. weight: that of each word as a head, put on the arc
    that picks it (the only arcs that end an open choice). A head that can be read with and without a
    target counts once, in the better way: both arcs end in one place only if a target follows."""
    now = {machine.start: {-1: 1.0}}  # state: {place picked: weight}
    for i, symbol in enumerate(symbols):
        new: dict = {}
        for state, by in now.items():
            for to, _, w in machine.arcs(state, symbol):
                picked = state[-1][1] == 0 and to[-1][1] != 0
                kept = new.setdefault(to, {})
                for place, v in by.items():
                    at, value = (i, v * w * weight[i]) if picked else (place, v * w)
                    kept[at] = max(kept.get(at, 0.0), value)
        now = new
    ends: dict[int, float] = {}
    for state, by in now.items():
        if machine.final(state):
            for place, v in by.items():
                ends[place] = max(ends.get(place, 0.0), v)
    return max(ends.values(), default=0.0), sum(ends.values())


class Grammar:
    def __init__(self, weights: dict[str, float], factor: dict[str, float] | None = None):
        self.factor = FACTOR | (factor or {})
        self.marks = (marker("negation", "negated", 3), marker("report", "reported", None), marker("vow", "vowed", WINDOW))
        self.machines = {head: compose(*self.marks, picker(head, self.factor)) for head in HEADS}
        self.cls = {w: c for c in ("target", "vow", "report", "negation", "threat", "insult") for w in SEEDS[c].split()}
        self.weight = dict.fromkeys(SEEDS["insult"].split(), PRIOR) | dict.fromkeys(SEEDS["threat"].split(), PRIOR) | weights
        self.cls |= {w: "insult" for w in weights if self.cls.get(w) != "threat"}
        heads = sorted((w for w, c in self.cls.items() if c in HEADS), key=len, reverse=True)
        self.heads = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, heads)) + r")(?![^\W_])")

    def symbols(self, words: list[str]) -> list[tuple]:
        return [(self.cls.get(w, "other"), frozenset()) for w in words]

    def clause(self, words: list[str]) -> float:
        symbols, weight = self.symbols(words), [self.weight.get(w, 0.0) for w in words]
        best = total = 0.0
        for head in HEADS:
            if any(kind == head for kind, _ in symbols):
                top, all_ = best_and_sum(self.machines[head], symbols, weight)
                best, total = max(best, top), total + all_
        return best + 0.5 * (total - best)

    def clauses(self, text: str) -> list[list[str]]:
        low = text.lower()
        return [TOKEN.findall(c) for c in CLAUSE.split(low) if self.heads.search(c)] if self.heads.search(low) else []

    def kinds(self, text: str) -> set[str]:
        """Which marks, alone or together, the heads of a text bear; "" is a head without any."""
        out = set()
        for words in self.clauses(text):
            symbols = self.symbols(words)
            for head in HEADS:
                machine = compose(*self.marks)
                state = machine.start
                for i, symbol in enumerate(symbols):
                    ((state, (kind, marks), _),) = machine.arcs(state, symbol)
                    if kind == head:
                        near = any(k == "target" for k, _ in symbols[max(0, i - WINDOW) : i + WINDOW + 1])
                        out.add(",".join(sorted(marks | {"targeted"} if near else marks)))
        return out

    def features(self, text: str) -> list[float]:
        scores = [s for words in self.clauses(text) if (s := self.clause(words))]
        if not scores:
            return [0.0, 0.0, 0.0, 0.0]
        total = sum(scores)
        return [math.log1p(total), max(scores), math.sqrt(100 * total / (10 + len(text.split()))), 1.0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton steps; x has a last column of ones, which is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(shrink)
        w += np.linalg.solve(h, x.T @ (y - p) - shrink * w)
    return w


def _features(docs: DataFrame, grammar: Grammar, columns: list[str]) -> DataFrame:
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", f array<double>"
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [grammar.features(t.as_py() or "") for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, pa.list_(pa.float64()))], [*columns, "f"])

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with a hash of its neighbours, once a document."""
    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            words = TOKEN.findall((text.as_py() or "").lower())
            seen = {(w, xxhash.xxh3_64_intdigest(f"{p} {n}") >> 1) for p, w, n in zip(["", *words[:-1]], words, [*words[1:], ""]) if len(w) > 2}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64()), pa.array([y] * len(seen), pa.int64())], ["w", "c", "y"])


def learned_factors(counts: dict[tuple[str, int], int], n: dict[int, int], strength: float = 20.0) -> dict[str, float]:
    """counts: documents by (marks, label). A mark's factor: log-odds of label 1 for heads with it over heads
    without it, each from the counts of all combinations, drawn to the prior by `strength` documents."""
    out = {}
    for mark, prior in FACTOR.items():
        if mark == "bare":
            continue
        odds, seen = [], []
        for with_ in (True, False):
            one, zero = (sum(c for (kind, y), c in counts.items() if y == label and (mark in kind.split(",")) == with_) for label in (1, 0))
            odds.append(math.log((one + 0.5) / (n.get(1, 0) + 1)) - math.log((zero + 0.5) / (n.get(0, 0) + 1)))
            seen.append(one + zero)
        ratio = min(2.0, max(0.1, odds[0] / odds[1])) if odds[1] > 0.5 else prior
        few = min(seen)
        out[mark] = (few * ratio + strength * prior) / (few + strength)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[Grammar, np.ndarray]:
    """docs and labels (toxic) by id_col: only rows that may be learned from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").cast("long").alias("y"))
    # at most `sample` rows of two numbers: small enough for every executor
    known = F.broadcast(known.orderBy(F.xxhash64(id_col), id_col).limit(sample))
    rows = save(docs.join(known, id_col).select(F.col("text"), "y"), "toxic")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    weights: dict[str, float] = {}
    if n.get(1) and n.get(0):
        pairs = rows.mapInArrow(_contexts, "w string, c long, y long").groupBy("w", "c").agg(F.max("y").alias("one"), F.min("y").alias("zero"))
        words = pairs.groupBy("w").agg(F.sum("one").alias("one"), F.sum(1 - F.col("zero")).alias("zero"))
        odds = F.log((F.col("one") + 0.5) / (n[1] + 1)) - F.log((F.col("zero") + 0.5) / (n[0] + 1))
        top = words.where(F.col("one") >= max(8, 0.02 * n[1])).withColumn("odds", odds).where("odds >= 3").orderBy(F.desc("odds"), "w").limit(LEXICON)
        weights = {r["w"]: min(6.0, r["odds"]) / 3 * PRIOR for r in top.collect()}
    grammar = Grammar(weights)
    if not weights:
        return grammar, np.array([0.5, 0.5, 0.3, 1.0, -3.0])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, y) for text, y in zip(b.column(0), b.column(1).to_pylist()) for k in grammar.kinds(text.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], ["k", "y"])

    # one row for each combination of marks
    counts = {(r["k"], r["y"]): r["count"] for r in rows.mapInArrow(kinds, "k string, y long").groupBy("k", "y").count().collect()}
    grammar = Grammar(weights, learned_factors(counts, n))
    got = _features(rows, grammar, ["y"]).toPandas()
    x = np.hstack([np.array(got["f"].tolist()), np.ones((len(got), 1))])
    return grammar, logistic(x, got["y"].to_numpy().astype(float))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    grammar, w = train(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col)
    z = sum((F.col("f")[i] * F.lit(float(w[i])) for i in range(len(w) - 1)), F.lit(float(w[-1])))
    out = _features(docs, grammar, [id_col]).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
