"""Text laid out, and edits of a page as a session: paragraphs, headers, retyping, undo and redo."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from .cos import Name, Ref, Stream, number
from .document import Document
from .fonts import standard_width
from .interp import Interpreter, Mark
from .organize import Overlay, apply_patches
from .samples import literal


class Placed(NamedTuple):
    text: str
    x: float
    y: float
    word_space: float
    width: float


def text_width(text: str, font: str, size: float, spacing: float = 0.0, scale: float = 100.0) -> float:
    return sum((standard_width(font, c) or 500) / 1000 * size + spacing for c in text) * scale / 100


def paragraph(text: str, font: str, size: float, leading: float, x0: float, top: float, width: float, height: float | None = None,
              align: str = "Left", spacing: float = 0.0, scale: float = 100.0) -> tuple[list[Placed], bool]:
    """(lines, whether all fit): words fill lines from the left; a word wider than a line has one of its own.
    Justified lines spread what is left over their spaces, but the last of a paragraph."""
    w = lambda s: text_width(s, font, size, spacing, scale)
    lines: list[tuple[str, bool]] = []
    for part in text.split("\n"):
        now = ""
        for word in part.split():
            if now and w(f"{now} {word}") > width:
                lines.append((now, False))
                now = word
            else:
                now = f"{now} {word}" if now else word
        lines.append((now, True))
    out, y = [], top - size
    for line, last in lines:
        if height is not None and y < top - height:
            return out, False
        own, gaps = w(line), line.count(" ")
        extra = (width - own) / gaps if align == "Justify" and gaps and not last else 0.0
        x = x0 + {"Center": (width - own) / 2, "Right": width - own}.get(align, 0.0)
        out.append(Placed(line, x, y, extra, own + extra * gaps))
        y -= leading
    return out, True


def shown_lines(lines: list[Placed], font: str, size: float) -> bytes:
    """The lines as content of their own."""
    body = [b"q BT /%s %s Tf" % (font.encode(), number(size).encode())]
    for p in lines:
        body.append(b"%s Tw 1 0 0 1 %s %s Tm %s Tj" % (*(number(v).encode() for v in (p.word_space, p.x, p.y)), literal(p.text)))
    return b"\n".join([*body, b"ET Q"])


def add_artifact(over: Overlay, page: int, text: str, x: float, y: float, size: float, subtype: str = "Header", angle: tuple = (1.0, 0.0), gray: float = 0.0, opacity: float = 1.0) -> None:
    """A header, footer or watermark: text behind the page's own content, marked as an artifact."""
    leaf = over.doc.pages()[page]
    own = dict(over.get(leaf["#num"]))
    resources = dict(over.field(leaf, "Resources") or {})
    fonts, states = dict(over.field(resources, "Font") or {}), dict(over.field(resources, "ExtGState") or {})
    fonts["ArtF"] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    states["ArtG"] = {"ca": opacity, "CA": opacity}
    c, s = angle
    turn = " ".join(map(number, (c, s, -s, c, x, y)))
    body = f"/Artifact <</Type /Pagination /Subtype /{subtype}>> BDC q /ArtG gs {number(gray)} g BT /ArtF {number(size)} Tf {turn} Tm ".encode() + literal(text) + b" Tj ET Q EMC"
    old = own.get("Contents")
    old = old if isinstance(old, list) else [old] if old is not None else []
    own["Contents"] = [over.add(Stream({}, b"q")), *old, over.add(Stream({}, b"Q\n" + body))]
    own["Resources"] = resources | {"Font": fonts, "ExtGState": states}
    over.set(leaf["#num"], own)


def retyped(doc: Document, page: dict, content: bytes, mark: Mark, text: str) -> list[tuple[int, int, bytes]]:
    """The patch that shows another text with the mark's own font; refused where the font lacks a character.
    Kerns within a TJ stay only where the length is the same."""
    reader = Interpreter(doc, page)
    font = next((f for f in reader.fonts.values() if f.name == mark.name), None)
    codes = font.encode(text) if font else None
    if codes is None:
        raise ValueError("the font has no code for a character")
    body = content[mark.start : mark.end]
    strings = list(re.finditer(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>", body))
    if not strings:
        raise ValueError("no string to retype")
    shown = b"<" + codes.hex().upper().encode() + b">"
    last = strings[-1].end()
    start = body.rfind(b"[", 0, strings[0].start())
    if start >= 0 and len(text) != len(mark.text):
        end = body.index(b"]", last)
        return [(mark.start + start, mark.start + end + 1, b"[" + shown + b"]")]
    if start >= 0:
        step, at, patches = 2 if font.wide else 1, 0, []
        for m in strings:
            n = len(m[0]) - 2 if m[0][:1] == b"(" else len(re.sub(rb"\s", b"", m[0][1:-1])) // 2
            n = n // step * step
            patches.append((mark.start + m.start(), mark.start + m.end(), b"<" + codes[at : at + n].hex().upper().encode() + b">"))
            at += n
        return patches
    return [(mark.start + strings[0].start(), mark.start + last, shown)]


class Session:
    """Edits of one page's content with undo and redo; saving appends a revision."""

    def __init__(self, doc: Document, page: int):
        self.doc, self.page = doc, page
        self.history, self.at = [doc.content(doc.pages()[page])], 0

    @property
    def content(self) -> bytes:
        return self.history[self.at]

    def apply(self, patches: list[tuple[int, int, bytes]]) -> bytes:
        """Patches of the present content; what was undone before is forgotten."""
        new = apply_patches(self.content, patches)
        self.history[self.at + 1 :] = [new]
        self.at += 1
        return new

    def undo(self) -> bool:
        self.at, moved = max(0, self.at - 1), self.at > 0
        return moved

    def redo(self) -> bool:
        moved = self.at + 1 < len(self.history)
        self.at += moved
        return moved

    def save(self) -> bytes:
        if self.content == self.history[0]:
            return self.doc.data
        over, leaf = Overlay(self.doc), self.doc.pages()[self.page]
        over.set(leaf["#num"], dict(over.get(leaf["#num"])) | {"Contents": over.add(Stream({}, self.content))})
        return over.save_incremental()


def reordered(content: bytes, mark: Mark, to_front: bool) -> list[tuple[int, int, bytes]]:
    """The patches that draw a mark after all others, or before them."""
    body = content[mark.start : mark.end]
    at = len(content) if to_front else 0
    return [(mark.start, mark.end, b" "), (at, at, b"\nq " + body + b" Q\n")]


def subset_tag(subset: bytes) -> str:
    """Six capitals from the bytes of a subset."""
    n = int.from_bytes(hashlib.sha256(subset).digest()[:8])
    return "".join(chr(65 + n // 26**i % 26) for i in range(6))


def free_name(prefix: str, taken) -> str:
    n = 0
    while f"{prefix}{n}" in taken:
        n += 1
    return f"{prefix}{n}"


def without_insertions(after: bytes, inserted: list[bytes]) -> bytes | None:
    """The bytes before insertions were made, each taken out once in order; None where one is missing."""
    at, out = 0, []
    for x in inserted:
        i = after.find(x, at)
        if i < 0:
            return None
        out.append(after[at:i])
        at = i + len(x)
    return b"".join([*out, after[at:]])


def shared_forms(doc: Document) -> dict[int, list[int]]:
    """Form XObjects (object numbers) to the pages that draw them."""
    out: dict[int, list[int]] = {}
    for i, page in enumerate(doc.pages()):
        table = doc.field(doc.field(page, "Resources"), "XObject")
        for name in set(Interpreter(doc, page).names):
            ref = table.get(name) if isinstance(table, dict) else None
            if isinstance(ref, Ref):
                out.setdefault(ref.num, []).append(i)
    return out


def banner(doc: Document) -> str | None:
    """What a user is told about how a file was opened."""
    return {"Repaired": "This file was damaged; places of its objects were corrected.", "Rebuilt": "This file was damaged; its objects were found by searching.", "Failed": "This file can't be read."}.get(doc.recovery)
