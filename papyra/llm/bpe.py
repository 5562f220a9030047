"""Byte-level BPE with a pair occurrence index, and its inverse.

Texts are cut into pieces by the vocabulary's pattern; distinct pieces are encoded once, all
together: their symbols lie in one array, an index maps each mergeable pair to all its positions, and
the ranks that occur are applied in ascending order, each to all its positions at once, which updates
the lists of the neighbouring pairs. A merge only makes pairs of higher rank (its symbol did not exist
before), so this order gives each piece what merging it alone would give; where a rank makes a lower
one, that one is queued again and applied next. Encoded pieces are kept in a cache of bounded size.

Nulls: a null text is encoded as empty. Empty texts have no ids. Text equal to an added token (such as
<|endoftext|>) becomes that token, as the tokenizers library does with special tokens left on. Rows are
independent: repeated rows, null ids, ties and extra columns change nothing. A very long text is a block by
itself and is taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import small_batches, trimmed

#: The public pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What \s matches in the pattern.
WHITE = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
#: Bytes of distinct units after which a worker's cache is emptied; with what belongs to them, they take about 15 times this.
CACHE_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins for the 256 bytes, as such vocabularies write them."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, ids = byte_alphabet(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        table = [b""] * self.size
        self.of_byte = np.zeros(256, np.int32)
        for token, i in ids.items():
            table[i] = bytes(back[c] for c in token)
            if len(token) == 1:
                self.of_byte[back[token]] = i
        for token, i in self.added.items():
            table[i] = token.encode()
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        self.made = made.astype(np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.token_len = np.array([len(t) for t in table], np.int32)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len))).astype(np.int32)
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        k = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], -1)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class PairIndex:
    """Positions by rank, over all pieces at once."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[bytes]):
        self.v = vocabulary
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.sym = vocabulary.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(self.sym)
        self.piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        first = np.cumsum(lengths) - lengths
        self.prev[first[lengths > 0]] = -1
        self.next[(first + lengths - 1)[lengths > 0]] = n
        self.lists: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        self.enter(np.flatnonzero(self.next < n))

    def enter(self, at: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        r = self.v.rank(self.sym[at], self.sym[self.next[at]])
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, group in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.queue, rank)
            self.lists[rank].append(group)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, piece of each) after all merges."""
        n, sym, nxt, prv = len(self.sym), self.sym, self.next, self.prev
        while self.queue:
            rank = heapq.heappop(self.queue)
            groups = self.lists.pop(rank)
            at = groups[0] if len(groups) == 1 else distinct(np.concatenate(groups))
            # entries go stale when a neighbour was merged; only pairs still in place count
            at = at[(sym[at] >= 0) & (nxt[at] < n)]
            if not len(at):
                continue
            at = np.sort(at[self.v.rank(sym[at], sym[nxt[at]]) == rank])
            if not len(at):
                continue
            chained = nxt[at[:-1]] == at[1:]
            if chained.any():  # like symbols in a row: every other pair, from the left
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), place, 0))
                at = at[(place - head) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.v.made[rank], -1
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            self.enter(distinct(np.concatenate((before[before >= 0], at[inner]))))
        keep = sym >= 0
        return sym[keep], self.piece[keep]


class Numbered(dict):
    """Gives each new key the next number and lists it, after a prefix, as a new unit."""

    def __init__(self, units: list[str], prefix: str):
        self.units, self.prefix = units, prefix

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.units)
        self.units.append(self.prefix + key)
        return n


class Codec:
    """Encodes and decodes batches. One per Python worker and vocabulary; see codec().

    Texts are numbered in units of whole pieces: a lone space between two other characters always
    begins a piece, so texts without wider white space are split there, which is much faster than the
    pattern; others are cut by the pattern. Only new units are cut and encoded, in learn()."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.units: list[str] = []
        self.n_bytes = 0
        self.bare, self.spaced = Numbered(self.units, ""), Numbered(self.units, " ")
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self) -> None:
        """Encode the units that were numbered since the last time."""
        new = self.units[len(self.start) :]
        if not new:
            return
        number: dict[str, int] = {}
        self.n_bytes += sum(map(len, new))
        of_unit = [[number.setdefault(p, len(number)) for p in ([u] if u in self.v.added else self.v.cut.findall(u))] for u in new]
        plain = list(number)
        special = {number[u]: i for u, i in self.v.added.items() if u in number}
        sym, piece = PairIndex(self.v, [b"" if i in special else p.encode() for i, p in enumerate(plain)]).run()
        counts = np.bincount(piece, minlength=len(plain))
        at = np.concatenate((np.cumsum(counts) - counts, np.arange(len(special)) + len(sym))).astype(np.int64)
        sym = np.concatenate((sym, np.array(list(special.values()), np.int32)))
        for k, i in enumerate(special):
            at[i], counts[i] = at[len(plain) + k], 1
        pieces = np.array([p for ps in of_unit for p in ps], np.int64)
        ends = np.concatenate(([0], np.cumsum(counts[pieces])))[np.concatenate(([0], np.cumsum([len(ps) for ps in of_unit])))]
        flat = sym[gather(at[pieces], counts[pieces])].astype(np.int32)
        self.start = np.concatenate((self.start, len(self.flat) + ends[:-1]))
        self.length = np.concatenate((self.length, np.diff(ends).astype(np.int32)))
        self.flat = np.concatenate((self.flat, flat))

    def wide(self, text: str) -> bool:
        """Whether a space stands at an end or beside other white space."""
        return text[:1] == " " or text[-1:] == " " or any(c in text and (" " + c in text or c + " " in text) for c in WHITE)

    def number(self, text: str) -> np.ndarray:
        """The text as numbers of units; encode() wants learn() after this."""
        if self.v.split is not None and any(t in text for t in self.v.added):
            cut = [p for part in self.v.split.split(text) for p in ([part] if part in self.v.added else self.v.cut.findall(part))]
        elif self.wide(text):
            cut = self.v.cut.findall(text)
        else:
            first, *rest = text.split(" ")
            out = np.fromiter(map(self.spaced.__getitem__, rest), np.int32, len(rest))
            return np.concatenate((np.array([self.bare[first]], np.int32), out)) if first else out
        return np.fromiter(map(self.bare.__getitem__, cut), np.int32, len(cut))

    def encode(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[gather(self.start[numbers], self.length[numbers])]

    def encode_text(self, text: str) -> np.ndarray:
        numbers = self.number(text)
        self.learn()
        return self.encode(numbers)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, with what is no UTF-8 replaced as Unicode recommends."""
        raw = self.v.token_bytes[gather(self.v.token_at[ids], self.v.token_len[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows in groups of about BLOCK_BYTES of text, whatever the size of Arrow's batches."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + (n or 0) > BLOCK_BYTES:
                yield [*held, batch.slice(start, i - start)]
                held, start, size = [], i, 0
            size += n or 0
        held.append(batch.slice(start))
    yield held


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and what outputs names: ids, decoded (text).
    vocabulary: a file that every executor has at this path."""
    kind = dict(docs.dtypes)[id_col]
    extra = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {o} {extra[o][0]}" for o in outputs)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for block in blocks(batches):
            if c.n_bytes > CACHE_BYTES:
                c.reset()
            numbers = [[c.number(t.as_py() or "") for t in part.column(1)] for part in block]
            c.learn()
            for part, rows in zip(block, numbers):
                out: dict[str, list] = {"n": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for row in rows:
                    ids = c.encode(row)
                    text = c.decode(ids)
                    out["n"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                    for o in outputs:
                        out[o].append(ids if o == "ids" else text.decode())
                columns = [part.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                columns += [pa.array(out[o], extra[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, [*names, *outputs])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decoded(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of an array of ids; null arrays decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, text string")
