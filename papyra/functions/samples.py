"""Small files for tests and queries, each with what one operator is about."""

from __future__ import annotations

from functools import lru_cache

from .cos import Name, Ref, Stream
from .document import Document, text_file, write_file
from .forms import create_text_field, pdf_text
from .organize import Overlay


def page_file(content: bytes, resources: dict | None = None, extra: dict[int, object] | None = None, page: dict | None = None) -> bytes:
    """One page with this content; objects from 10 on are free for resources."""
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 612, 792]}}
    objects[3] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": resources or {}} | (page or {})
    return write_file(objects | {4: Stream({}, content)} | (extra or {}), 1)


def font(base: str = "Helvetica", differences: list | None = None) -> dict:
    enc = Name("WinAnsiEncoding") if differences is None else {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": differences}
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": enc}


def literal(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def drawing(title: str, inner: str, n: int) -> bytes:
    """A title, n squares, and a form whose font has A and B exchanged."""
    squares = b" ".join(b"%d 600 5 5 re f" % (20 * i + 20) for i in range(n))
    body = b"q 1 0 0 rg " + squares + b" Q BT /F1 10 Tf 50 700 Td " + literal(title) + b" Tj ET /Fm0 Do"
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 300, 50], "Matrix": [1, 0, 0, 1, 50, 500], "Resources": {"Font": {"F1": Ref(12, 0)}}}, b"BT /F1 10 Tf 5 5 Td " + literal(inner) + b" Tj ET")
    return page_file(body, {"Font": {"F1": Ref(11, 0)}, "XObject": {"Fm0": Ref(10, 0)}}, {10: form, 11: font("Courier"), 12: font("Courier", [65, Name("B"), Name("A")])})


def columns(left: list[str], right: list[str]) -> bytes:
    """Two columns whose lines are drawn by turns."""
    parts = []
    for i in range(max(len(left), len(right))):
        for x, lines in ((50, left), (350, right)):
            if i < len(lines):
                parts.append(b"1 0 0 1 %d %d Tm " % (x, 700 - 12 * i) + literal(lines[i]) + b" Tj")
    return page_file(b"BT /F1 10 Tf " + b" ".join(parts) + b" ET", {"Font": {"F1": font("Courier")}})


def kerned(words: list[str]) -> bytes:
    """Words in one TJ, parted by gaps only."""
    return page_file(b"BT /F1 10 Tf 50 700 Td [" + b" -300 ".join(map(literal, words)) + b"] TJ ET", {"Font": {"F1": font("Courier")}})


def annotated(flags: list[int], parents: list[int | None] | None = None) -> bytes:
    """A note for each number of flags; parents: the place of the note that it replies to."""
    extra = {10 + i: {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [10 * i, 0, 10 * i + 5, 5], "F": f, "Contents": b"note %d" % i} for i, f in enumerate(flags)}
    for i, p in enumerate(parents or []):
        if p is not None:
            extra[10 + i]["IRT"] = Ref(10 + p, 0)
    return page_file(b"", {}, extra, {"Annots": [Ref(n, 0) for n in extra]})


def nested_pages(turns: list[int | None]) -> bytes:
    """One page under a chain of nodes, each with its /Rotate or none; the last is the page's."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    for i, turn in enumerate(turns):
        leaf = i == len(turns) - 1
        objects[2 + i] = ({"Type": Name("Page")} if leaf else {"Type": Name("Pages"), "Kids": [Ref(3 + i, 0)], "Count": 1}) | ({"Parent": Ref(1 + i, 0)} if i else {}) | ({"Rotate": turn} if turn is not None else {})
    return write_file(objects, 1)


@lru_cache(8)
def text_document(*lines: str) -> Document:
    """A file of text lines, read once; overlays leave it as it is."""
    return Document(text_file(list(lines)))


def nested_fields(names: list[str], value: str) -> bytes:
    """A form whose one field's name has these parts."""
    over, kid = Overlay(text_document("")), None
    for i, n in enumerate(reversed(names)):
        d = {"T": pdf_text(n)} | ({"Kids": [kid]} if kid else {"V": pdf_text(value)}) | ({"FT": Name("Tx")} if i == len(names) - 1 else {})
        kid = over.add(d)
    over.set(1, dict(over.get(1)) | {"AcroForm": {"Fields": [kid]}})
    return over.save_full()


def form(values: dict[str, str], max_len: dict[str, int] | None = None, scripts: dict[str, dict[str, str]] | None = None) -> bytes:
    """Text fields one below the other, with MaxLen and scripts (F: format, V: range, C: calculation)."""
    over = Overlay(text_document(""))
    for i, (name, value) in enumerate(values.items()):
        ref = create_text_field(over, 0, name, [50, 700 - 20 * i, 250, 715 - 20 * i], value)
        d = dict(over.get(ref))
        if name in (max_len or {}):
            d["MaxLen"] = max_len[name]
        if name in (scripts or {}):
            d["AA"] = {k: {"S": Name("JavaScript"), "JS": pdf_text(s)} for k, s in scripts[name].items()}
        over.set(ref.num, d)
    return over.save_full()


def bookmarked(title: str, missing: bool) -> bytes:
    """Two pages and a bookmark to the second, or to a page that is not in the file."""
    over = Overlay(Document(text_file(["one", "two"], 1)))
    pages = over.doc.pages()
    item = over.add({"Title": pdf_text(title), "Dest": [Ref(9999, 0) if missing else Ref(pages[1]["#num"], 0), Name("Fit")]})
    over.set(1, dict(over.get(1)) | {"Outlines": over.add({"Type": Name("Outlines"), "First": item, "Last": item})})
    return over.save_incremental()
