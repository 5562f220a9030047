"""Changing files: an overlay of objects, full and incremental saves, object streams, and page operations."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from .cos import Name, Ref, Stream, write
from .document import Document, append_revision, write_file

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


def references(v) -> Iterator[Ref]:
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            yield x
        elif isinstance(x, Stream):
            todo.append(x.dict)
        elif isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def mapped(v, f: Callable):
    """v with f applied to its references."""
    if isinstance(v, Ref):
        return f(v)
    if isinstance(v, Stream):
        return Stream(mapped(v.dict, f), v.raw)
    if isinstance(v, dict):
        return {k: mapped(x, f) for k, x in v.items()}
    return [mapped(x, f) for x in v] if isinstance(v, list) else v


class Overlay:
    """A document with changed, new and removed objects laid over it; the document itself stays as it is."""

    def __init__(self, doc: Document):
        self.doc, self.changed, self.gone = doc, {}, set()
        self.next = max([0, *doc.entries]) + 1

    def get(self, v):
        v = Ref(v, 0) if isinstance(v, int) and not isinstance(v, bool) else v
        for _ in range(64):
            if not isinstance(v, Ref):
                return v
            v = None if v.num in self.gone else self.changed[v.num] if v.num in self.changed else self.doc.get(v)
        return None

    def field(self, d, key: str):
        d = self.get(d) if isinstance(d, Ref) else d
        v = d.get(key) if isinstance(d, dict) else None
        return self.get(v) if isinstance(v, Ref) else v

    def set(self, num: int, v) -> None:
        self.gone.discard(num)
        self.changed[num] = v

    def add(self, v) -> Ref:
        self.changed[self.next] = v
        self.next += 1
        return Ref(self.next - 1, 0)

    def remove(self, num: int) -> None:
        self.changed.pop(num, None)
        self.gone.add(num)

    def root(self) -> Ref:
        return self.doc.trailer["Root"]

    def reachable(self) -> dict[int, object]:
        """Objects that the trailer leads to."""
        out: dict[int, object] = {}
        todo = [r for k, v in self.doc.trailer.items() if k in ("Root", "Info") for r in references(v)]
        while todo:
            r = todo.pop()
            if r.num not in out and (v := self.get(r)) is not None:
                out[r.num] = v
                todo += references(v)
        return out

    def save_full(self) -> bytes:
        """A new file of what is reachable, numbered anew in order."""
        kept = self.reachable()
        number = {n: i + 1 for i, n in enumerate(sorted(kept))}
        renumber = lambda r: Ref(number[r.num], 0) if r.num in number else None
        info = self.doc.trailer.get("Info")
        return write_file({number[n]: mapped(v, renumber) for n, v in kept.items()}, number[self.root().num], number.get(info.num) if isinstance(info, Ref) else None)

    def save_incremental(self) -> bytes:
        """The bytes as they are and the changed objects behind them; removed ones become null."""
        return append_revision(self.doc.data, self.changed | dict.fromkeys(self.gone & set(self.doc.entries)), self.doc)


def object_stream(objects: dict[int, object]) -> Stream:
    """Objects (no streams among them) packed as one /ObjStm."""
    bodies = {n: write(v) for n, v in objects.items()}
    head, at = [], 0
    for n, b in bodies.items():
        head.append(b"%d %d" % (n, at))
        at += len(b) + 1
    first = b" ".join(head) + b"\n"
    return Stream({"Type": Name("ObjStm"), "N": len(bodies), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + b"\n".join(bodies.values())))


def packed_file(objects: dict[int, object], root: int) -> bytes:
    """A file whose plain objects lie in one object stream under a cross-reference stream."""
    plain = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    home, xref = max(objects) + 1, max(objects) + 2
    out, where = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {0: (0, 0, 65535)}
    for n, v in [*((n, v) for n, v in objects.items() if n not in plain), (home, object_stream(plain))]:
        where[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + write(v) + b"\nendobj\n"
    where |= {n: (2, home, i) for i, n in enumerate(plain)}
    where[xref] = (1, len(out), 0)
    rows = b"".join(k.to_bytes(1) + a.to_bytes(4) + b.to_bytes(2) for k, a, b in (where.get(n, (0, 0, 0)) for n in range(xref + 1)))
    table = Stream({"Type": Name("XRef"), "Size": xref + 1, "W": [1, 4, 2], "Root": Ref(root, 0), "Filter": Name("FlateDecode")}, zlib.compress(rows))
    at = len(out)
    return bytes(out) + b"%d 0 obj\n" % xref + write(table) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at


def build(parts: list[tuple[Document, list[int]]], info: dict | None = None) -> bytes:
    """A file of pages (indices) of documents, in this order; equal streams are kept once, by SHA-256."""
    objects: dict[int, object] = {1: None, 2: None}
    by_hash: dict[bytes, Ref] = {}
    kids = []

    def take(doc: Document, v, new: dict[int, Ref]):
        if isinstance(v, Ref):
            if v.num not in new:
                got = doc.get(v)
                if got is None or isinstance(got, dict) and got.get("Type") in ("Pages", "Catalog"):
                    return None
                if isinstance(got, Stream):
                    key = hashlib.sha256(write(got)).digest()
                    if key in by_hash and not any(True for _ in references(got.dict)):
                        new[v.num] = by_hash[key]
                        return by_hash[key]
                    by_hash.setdefault(key, Ref(len(objects) + 1, 0))
                objects[len(objects) + 1] = None
                new[v.num] = Ref(len(objects), 0)
                todo.append((new[v.num].num, got))
            return new[v.num]
        if isinstance(v, Stream):
            return Stream(take(doc, v.dict, new), v.raw)
        if isinstance(v, dict):
            return {k: take(doc, x, new) for k, x in v.items() if k != "Parent"}
        return [take(doc, x, new) for x in v] if isinstance(v, list) else v

    for doc, indices in parts:
        pages, new = doc.pages(), {}
        todo: list[tuple[int, object]] = []
        for i in indices:
            page = {k: v for k, v in pages[i].items() if k not in ("#num", "Parent")}
            own = len(objects) + 1
            objects[own] = None
            if pages[i]["#num"] is not None:
                new.setdefault(pages[i]["#num"], Ref(own, 0))
            objects[own] = take(doc, page, new) | {"Type": Name("Page"), "Parent": Ref(2, 0)}
            kids.append(Ref(own, 0))
            while todo:
                n, v = todo.pop()
                objects[n] = take(doc, v, new)
    objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    if info:
        objects[len(objects) + 1] = info
    return write_file(objects, 1, len(objects) if info else None)


def merge(docs: list[Document]) -> bytes:
    return build([(d, list(range(len(d.pages())))) for d in docs])


def extract(doc: Document, indices: list[int]) -> bytes:
    n = len(doc.pages())
    return build([(doc, [i for i in indices if 0 <= i < n])])


def delete(doc: Document, indices: list[int]) -> bytes:
    """The other pages; a document keeps at least one page."""
    gone = set(indices)
    kept = [i for i in range(len(doc.pages())) if i not in gone]
    if not kept:
        raise ValueError("no page would be left")
    return build([(doc, kept)])


def split_every(doc: Document, n: int) -> list[bytes]:
    count = len(doc.pages())
    return [build([(doc, list(range(i, min(i + n, count))))]) for i in range(0, count, max(1, n))]


def insert(doc: Document, other: Document, at: int) -> bytes:
    """All pages of other before page `at`."""
    n = len(doc.pages())
    at = min(max(0, at), n)
    return build([(doc, list(range(at))), (other, list(range(len(other.pages())))), (doc, list(range(at, n)))])


def blank(width: float, height: float) -> Document:
    return Document(write_file({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, width, height]}}, 1))


def replace(doc: Document, at: int, other: Document) -> bytes:
    n = len(doc.pages())
    return build([(doc, list(range(at))), (other, [0]), (doc, list(range(at + 1, n)))])


def reorder(doc: Document, order: list[int]) -> bytes:
    return build([(doc, order)])


def _page(over: Overlay, index: int) -> tuple[int, dict]:
    page = over.doc.pages()[index]
    return page["#num"], dict(over.get(page["#num"]))


def rotate(doc: Document, index: int, by: int) -> bytes:
    over = Overlay(doc)
    num, own = _page(over, index)
    over.set(num, own | {"Rotate": (doc.boxes(doc.pages()[index])[2] + by) % 360})
    return over.save_incremental()


def crop(doc: Document, index: int, box: list[float]) -> bytes:
    """A crop box, cut to the media box; one without area is refused."""
    over = Overlay(doc)
    media = doc.boxes(doc.pages()[index])[0]
    box = [max(min(box[0], box[2]), media[0]), max(min(box[1], box[3]), media[1]), min(max(box[0], box[2]), media[2]), min(max(box[1], box[3]), media[3])]
    if box[2] <= box[0] or box[3] <= box[1]:
        raise ValueError("an empty box")
    num, own = _page(over, index)
    over.set(num, own | {"CropBox": box})
    return over.save_incremental()


def set_labels(doc: Document, ranges: list[tuple[int, str | None, str, int]]) -> bytes:
    """Page labels as a number tree of (start, style, prefix, first)."""
    over = Overlay(doc)
    nums: list = []
    for start, style, prefix, first in sorted(ranges):
        nums += [start, {k: v for k, v in (("S", style and Name(style)), ("P", prefix.encode("latin-1", "replace")), ("St", first)) if v}]
    over.set(over.root().num, dict(over.get(over.root())) | {"PageLabels": {"Nums": nums}})
    return over.save_incremental()


def apply_patches(data: bytes, patches: list[tuple[int, int, bytes]]) -> bytes:
    """Byte ranges replaced; refused out of bounds or where one covers bytes of another. Insertions at a
    boundary are allowed."""
    out, at = [], 0
    for start, end, body in sorted(patches, key=lambda p: p[:2]):
        if not 0 <= start <= end <= len(data):
            raise ValueError("a patch lies outside the bytes")
        if start < at:
            raise ValueError("patches overlap")
        out += [data[at:start], body]
        at = end
    return b"".join([*out, data[at:]])


def optimized(doc: Document) -> tuple[bytes, dict[str, int]]:
    """Streams without a filter compressed, equal streams once, unreachable objects left out; with a report."""
    over = Overlay(doc)
    same: dict[bytes, int] = {}
    swap: dict[int, int] = {}
    compressed = 0
    for n, v in sorted(over.reachable().items()):
        if isinstance(v, Stream):
            if not v.dict.get("Filter") and len(small := zlib.compress(v.raw, 9)) < len(v.raw):
                v = Stream({k: x for k, x in v.dict.items() if k not in ("DecodeParms", "Length")} | {"Filter": Name("FlateDecode")}, small)
                over.set(n, v)
                compressed += 1
            key = hashlib.sha256(write(v)).digest()
            if same.setdefault(key, n) != n:
                swap[n] = same[key]
    if swap:
        for n, v in over.reachable().items():
            over.set(n, mapped(v, lambda r: Ref(swap.get(r.num, r.num), r.gen)))
    data = over.save_full()
    return data, {"before": len(doc.data), "after": len(data), "compressed": compressed, "deduplicated": len(swap), "objects": len(over.reachable())}
