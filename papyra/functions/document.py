"""One PDF file: cross-references or repair, objects, pages, content operations and text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from .cos import Name, Op, Reader, Ref, Stream, write
from .crypto import Handler
from .filters import decode
from .fonts import to_unicode  # noqa: F401

_OBJ = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")
_HEADING = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj|\(|%[^\r\n]*|(?<!end)stream\r?\n")
#: A subsection's heading and an entry of a cross-reference table, as they are nearly always written.
_RANGE = re.compile(rb"[\0\t\n\f\r ]*+(\d{1,10})[\0\t\n\f\r ]++(\d{1,10})(?=[\0\t\n\f\r ])(?![\0\t\n\f\r ]++R(?![^\0\t\n\f\r ()<>\[\]{}/%]))")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*+(\d{1,10})[\0\t\n\f\r ]++(\d{1,10})[\0\t\n\f\r ]++([nf])(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_STARTXREF = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)")
_VERSION = re.compile(rb"%PDF-(\d\.\d)")
MAX_SECTIONS = 1024
SLACK = 4096


class Document:
    """recovery is Clean, Repaired (bad offsets replaced), Rebuilt (no usable table) or Failed."""

    def __init__(self, data: bytes, password: bytes = b""):
        self.password, self.handler = password, None
        self.data, self.notes, self.entries, self.trailer = data, [], {}, {}
        self.cache: dict[int, object] = {}
        self.packed: dict[int, dict[int, object]] = {}
        self.fonts_by_object: dict[int, object] = {}
        self.revisions: list[dict[int, tuple]] = []
        self.leaves: list[dict] | None = None
        m = _VERSION.search(data[:1024])
        self.version = m[1].decode() if m else None
        self.recovery = "Clean"
        self.read_chain()
        if not self.trailer.get("Root"):
            self.rebuild()
        elif wrong := [n for n, e in self.entries.items() if e[0] == "f" and not self.at_object(n, e[1])]:
            self.repair(wrong)
        if self.recovery != "Failed" and not self.pages():
            kept = self.recovery
            self.rebuild()
            self.recovery = self.recovery if self.pages() or self.recovery == "Failed" else kept

    # cross-references

    def read_chain(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        m = _STARTXREF.match(self.data, at) if at >= 0 else None
        todo, seen = ([int(m[1])] if m else []), set()
        while todo and len(seen) < MAX_SECTIONS:
            at = todo.pop(0)
            if at in seen or at >= len(self.data):
                self.notes.append(f"cross-reference section at {at} is repeated or outside the file")
                continue
            seen.add(at)
            section = self.read_section(at)
            if section is None:
                self.notes.append(f"no cross-reference section at {at}")
                continue
            entries, trailer = section
            self.revisions.append(entries)
            for n, e in entries.items():
                self.entries.setdefault(n, e)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), (int, float))]
        self.entries = {n: e for n, e in self.entries.items() if e[0] != "free"}

    def read_section(self, at: int) -> tuple[dict, dict] | None:
        r = Reader(self.data, at)
        try:
            first = r.value()
            if isinstance(first, Op) and first == "xref":
                return self.read_table(r)
            if isinstance(first, int):
                s = self.object_at(at)
                if isinstance(s, Stream) and s.dict.get("Type") == "XRef":
                    return self.read_stream(s), s.dict
        except (EOFError, ValueError, TypeError):
            pass
        return None

    def read_table(self, r: Reader) -> tuple[dict, dict]:
        out: dict[int, tuple] = {}
        while True:
            if m := _RANGE.match(self.data, r.at):
                first, n = int(m[1]), int(m[2])
                r.at = m.end()
            else:
                first, n = r.value(), None
            if isinstance(first, Op):
                trailer = r.value() if first == "trailer" else {}
                return out, trailer if isinstance(trailer, dict) else {}
            for n in range(first, first + (r.value() if n is None else n)):
                if m := _ENTRY.match(self.data, r.at):
                    offset, gen, kind = int(m[1]), int(m[2]), m[3].decode()
                    r.at = m.end()
                else:
                    offset, gen, kind = r.value(), r.value(), r.value()
                    if not isinstance(kind, Op):
                        return out, {}
                out.setdefault(n, ("f", offset, gen) if kind == "n" else ("free", 0, gen))

    def read_stream(self, s: Stream) -> dict:
        body, _, _ = self.decoded(s)
        w = [int(x) for x in s.dict.get("W", [])]
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        out, at = {}, 0
        for a, n in zip(index[::2], index[1::2]):
            for num in range(a, a + n):
                if at + sum(w) > len(body) or len(w) < 3:
                    return out
                cut = [body[at + sum(w[:i]) : at + sum(w[: i + 1])] for i in range(3)]
                at += sum(w)
                kind = int.from_bytes(cut[0]) if w[0] else 1
                x, y = int.from_bytes(cut[1]), int.from_bytes(cut[2])
                out[num] = {1: ("f", x, y), 2: ("s", x, y)}.get(kind, ("free", 0, y))
        return out

    def at_object(self, num: int, at: int) -> int | None:
        """Where object num begins, at the offset or a little after it."""
        m = _OBJ.search(self.data, at, at + SLACK) if 0 <= at < len(self.data) else None
        return m.start() if m and int(m[1]) == num else None

    def scan(self) -> dict[int, tuple]:
        """Objects by their headings; strings, comments and the bodies of streams are passed over."""
        out, data, at = {}, self.data, 0
        while m := _HEADING.search(data, at):
            at = m.end()
            if m[1]:
                out[int(m[1])] = ("f", m.start(1), int(m[2]))
            elif m[0] == b"(":
                r = Reader(data, m.start())
                r.string()
                # a string that never ends hides nothing
                at = r.at if r.at < len(data) else m.end()
            elif m[0].startswith(b"stream"):
                end = data.find(b"endstream", at)
                at = end + 9 if end >= 0 else at
        return out

    def repair(self, wrong: list[int]) -> None:
        found = self.scan()
        self.recovery = "Repaired"
        self.notes.append(f"{len(wrong)} of {len(self.entries)} offsets are wrong")
        for n in wrong:
            self.entries.pop(n)
        self.entries |= found
        self.leaves = None

    def rebuild(self) -> None:
        self.cache.clear()
        self.packed.clear()
        self.entries = self.scan()
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Reader(self.data, m.end()).value()
            except EOFError:
                continue
            self.trailer |= t if isinstance(t, dict) else {}
        for n in list(self.entries):
            v = self.get(n)
            if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm":
                self.entries |= {k: ("s", n, i) for i, k in enumerate(self.unpack(n)) if k not in self.entries}
        roots = [n for n in self.entries if isinstance(v := self.get(n), dict) and v.get("Type") == "Catalog"]
        if roots and not isinstance(self.get(self.trailer.get("Root")), dict):
            self.trailer["Root"] = Ref(roots[-1], 0)
        self.recovery = "Rebuilt" if self.entries and self.trailer.get("Root") else "Failed"
        self.notes.append("objects were found by scanning")
        self.leaves = None

    # objects

    def object_at(self, at: int):
        r = Reader(self.data, at)
        m = _OBJ.match(self.data, at)
        if not m:
            return None
        r.at = m.end()
        try:
            v = r.value()
        except EOFError:
            return None
        if isinstance(v, dict):
            r.blank()
            if self.data.startswith(b"stream", r.at):
                start = r.at + 6
                start += 2 if self.data.startswith(b"\r\n", start) else self.data[start : start + 1] in (b"\n", b"\r")
                return Stream(v, self.data[start : self.stream_end(start, v)])
        return None if isinstance(v, Op) else v

    def stream_end(self, start: int, d: dict) -> int:
        n = d.get("Length")
        n = self.get(n) if isinstance(n, Ref) else n
        if isinstance(n, int) and n >= 0 and re.compile(rb"[\0\t\n\f\r ]{0,4}endstream").match(self.data, start + n):
            return start + n
        end = self.data.find(b"endstream", start)
        end = self.data.find(b"endobj", start) if end < 0 else end
        end = len(self.data) if end < 0 else end
        return end - (2 if self.data.startswith(b"\r\n", end - 2) else self.data[end - 1 : end] in (b"\n", b"\r"))

    def unpack(self, num: int) -> dict[int, object]:
        if num not in self.packed:
            self.packed[num] = {}
            s = self.get(num)
            if isinstance(s, Stream):
                body, _, _ = self.decoded(s)
                r, first = Reader(body), int(s.dict.get("First", 0))
                try:
                    where = [(r.value(), r.value()) for _ in range(int(s.dict.get("N", 0)))]
                    self.packed[num] = {n: Reader(body, first + o).value() for n, o in where}
                except (EOFError, TypeError):
                    self.notes.append(f"object stream {num} is damaged")
        return self.packed[num]

    def get(self, v, hops: int = 64):
        """What a reference (or an object's number) leads to; other values as they are."""
        if isinstance(v, int) and not isinstance(v, bool):
            v = Ref(v, 0)
        while isinstance(v, Ref) and hops:
            hops -= 1
            if v.num not in self.cache:
                self.cache[v.num] = None  # a cycle reads as null
                e = self.entries.get(v.num)
                if e and e[0] == "f":
                    at = self.at_object(v.num, e[1])
                    self.cache[v.num] = None if at is None else self.opened(v.num, at)
                elif e:
                    self.cache[v.num] = self.unpack(e[1]).get(v.num)
            v = self.cache[v.num]
        return None if isinstance(v, Ref) else v

    def opened(self, num: int, at: int):
        """The object at a place, decrypted where the file is encrypted and the password fits."""
        v, sealed = self.object_at(at), self.trailer.get("Encrypt")
        if sealed is None or sealed == Ref(num, 0):
            return v
        if self.handler is None:
            d = self.get(sealed) if isinstance(sealed, Ref) else sealed
            ids = self.trailer.get("ID")
            first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
            self.handler = Handler(d if isinstance(d, dict) else {}, first, self.password)
            if not self.handler.valid:
                self.notes.append("encrypted, and the password does not fit")
        m = _OBJ.match(self.data, at)
        return self.handler.turned(v, num, int(m[0].split()[1])) if self.handler.valid and m else v

    def field(self, d, key: str):
        d = self.get(d) if isinstance(d, Ref) else d
        v = d.get(key) if isinstance(d, dict) else None
        return self.get(v) if isinstance(v, Ref) else v

    def decoded(self, s: Stream) -> tuple[bytes, bool, list[str]]:
        listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        filters = [self.get(x) if isinstance(x, Ref) else x for x in listed(self.field(s.dict, "Filter"))]
        parms = [self.get(x) if isinstance(x, Ref) else x for x in listed(self.field(s.dict, "DecodeParms"))]
        return decode(s.raw, filters, parms)

    # pages

    def pages(self) -> list[dict]:
        """Leaves of the page tree with inherited attributes; cycles are cut."""
        if self.leaves is None:
            self.leaves = self.page_leaves()
        return [dict(p) for p in self.leaves]

    def page_leaves(self) -> list[dict]:
        root = self.field(self.get(self.trailer.get("Root")), "Pages")
        out: list[dict] = []
        seen: set[int] = set()
        todo = [(None, root, {})]
        while todo:
            ref, node, above = todo.pop()
            if not isinstance(node, dict) or ref is not None and ref in seen:
                continue
            seen.add(ref)
            own = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.field(node, "Kids")
            if self.field(node, "Type") == "Page" or kids is None:
                out.append(node | own | {"#num": ref})
            elif isinstance(kids, list):
                todo += [(k.num if isinstance(k, Ref) else None, self.get(k) if isinstance(k, Ref) else k, own) for k in reversed(kids)]
        return out

    def rect(self, v) -> list[float] | None:
        v = self.get(v) if isinstance(v, Ref) else v
        v = [self.get(x) if isinstance(x, Ref) else x for x in v] if isinstance(v, list) else []
        if len(v) < 4 or not all(isinstance(x, (int, float)) for x in v[:4]):
            return None
        return [float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3]))]

    def boxes(self, page: dict) -> tuple[list[float], list[float], int]:
        """Media box (Letter by default), the crop box inside it, and rotation as a right angle."""
        media = self.rect(page.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        crop = self.rect(page.get("CropBox")) or media
        crop = [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]
        if crop[2] <= crop[0] or crop[3] <= crop[1]:
            crop = media
        turn = self.field(page, "Rotate")
        return media, crop, (int(turn) + 45) // 90 * 90 % 360 if isinstance(turn, (int, float)) else 0

    def content(self, page: dict) -> bytes:
        parts = self.field(page, "Contents")
        parts = parts if isinstance(parts, list) else [parts]
        streams = [self.get(p) if isinstance(p, Ref) else p for p in parts]
        return b"\n".join(self.decoded(s)[0] for s in streams if isinstance(s, Stream))

    def fonts(self, page: dict) -> dict:
        table = self.field(self.field(page, "Resources"), "Font")
        return {k: self.get(v) if isinstance(v, Ref) else v for k, v in table.items()} if isinstance(table, dict) else {}


def operations(content: bytes) -> Iterator[tuple[str, list, int, int]]:
    """(operator, operands, start, end) of a content stream; operands left over come under ''."""
    r, operands, start = Reader(content, refs=False), [], None
    while True:
        if start is None:
            r.blank()
            start = r.at
        try:
            v = r.value()
        except EOFError:
            break
        if not isinstance(v, Op):
            operands.append(v)
            continue
        if v == "BI":
            back, d = r.at, {}
            try:
                while isinstance(k := r.value(), Name):
                    d[str(k)] = r.value()
                if k == "ID":
                    end = re.compile(rb"[\0\t\n\f\r ]EI(?![^\0\t\n\f\r ()<>\[\]{}/%])").search(content, r.at)
                    body = content[r.at + 1 : end.start() if end else len(content)]
                    r.at = end.end() if end else len(content)
                    yield "BI", [d, body], start, r.at
                    operands, start = [], None
                    continue
                r.at = back
            except EOFError:
                r.at = back
        yield str(v), operands, start, r.at
        operands, start = [], None
    if operands:
        yield "", operands, start, len(content)


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
            a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def runs(doc: Document, page: dict) -> Iterator[tuple[str, float, float, float, float, float]]:
    """(text, start x, start y, end x, end y, size) of each shown string, in page space."""
    from .interp import text_marks

    for m in text_marks(doc, page):
        yield m.text, *m.line, m.size


def write_file(objects: dict[int, object], root: int, info: int | None = None, extra: dict | None = None) -> bytes:
    """A whole file with a classic cross-reference table."""
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for n in sorted(objects):
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + write(objects[n]) + b"\nendobj\n"
    return bytes(out) + _table(len(out), offsets, max(objects) + 1, {"Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {}) | (extra or {}), True)


def append_revision(data: bytes, changed: dict[int, object], old: Document | None = None) -> bytes:
    """An incremental save: data as it is, then changed objects; without changes the same bytes. old: the
    document of data, where it was read before."""
    if not changed:
        return data
    old = old or Document(data)
    at = re.findall(rb"startxref\s+(\d+)", data)
    out, offsets = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for n in sorted(changed):
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + write(changed[n]) + b"\nendobj\n"
    keep = {k: old.trailer[k] for k in ("Root", "Info", "ID") if k in old.trailer}
    size = max([*old.entries, *changed]) + 1
    return bytes(out) + _table(len(out), offsets, size, keep | {"Prev": int(at[-1])}, False)


def _table(at: int, offsets: dict[int, int], size: int, trailer: dict, free: bool) -> bytes:
    lines = [b"xref\n"]
    if free:
        lines.append(b"0 1\n0000000000 65535 f \n")
    lines += [b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(offsets.items())]
    return b"".join(lines) + b"trailer\n" + write(trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % at


def text_file(lines: list[str], per_page: int = 40, title: str = "", compress: bool = True, seal=None) -> bytes:
    """A PDF of text lines in Helvetica, one Tj a line. seal: objects to encrypted ones and trailer entries."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}, 4: {"Title": title.encode("latin-1", "replace")}}
    kids = []
    for p in range(0, max(1, len(lines)), per_page):
        body = b"BT /F1 10 Tf 12 TL 50 780 Td\n" + b"".join(write(x.encode("cp1252", "replace")) + b" Tj T*\n" for x in lines[p : p + per_page]) + b"ET"
        n = 5 + 2 * len(kids)
        objects[n] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(n + 1, 0)}
        objects[n + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)) if compress else Stream({}, body)
        kids.append(Ref(n, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    objects, extra = seal(objects) if seal else (objects, {})
    return write_file(objects, 1, 4, extra)
