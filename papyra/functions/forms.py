"""Forms and annotations: number formats, calculations, filling, XFDF, adding, deleting and flattening."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import NamedTuple
from xml.sax.saxutils import escape, quoteattr

from .cos import Name, Ref, Stream, number, write
from .document import Document
from .organize import Overlay
from .structure import FIELD_DEPTH, calculation, text_of, value_range

#: Flags of annotations and fields (bits of the specification).
HIDDEN, PRINT, NO_VIEW, READ_ONLY = 2, 4, 32, 1
_NUMBER_FORMAT = re.compile(r"AFNumber_Format\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*\"((?:[^\"\\]|\\.)*)\"\s*,\s*(true|false)\s*\)")
SUBTYPES = ("Text", "Link", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Ink")


def pdf_text(s: str) -> bytes:
    return s.encode("latin-1") if all(ord(c) < 256 for c in s) else b"\xfe\xff" + s.encode("utf-16-be", "replace")


def number_of(text: str | None) -> float:
    """The digits, dots and minus signs of a text as a number; 0 where they are none."""
    try:
        return float(re.sub(r"[^0-9.\-]", "", text or ""))
    except ValueError:
        return 0.0


class NumberFormat(NamedTuple):
    decimals: int
    separator: int  # 0 and 2: thousands are parted by commas
    currency: str
    before: bool

    def text(self, value: float) -> str:
        body = f"{abs(value):,.{self.decimals}f}" if self.separator in (0, 2) else f"{abs(value):.{self.decimals}f}"
        body = self.currency + body if self.before else body + self.currency
        return "-" + body if value < 0 and re.search("[1-9]", body) else body


def number_format(script: str) -> NumberFormat | None:
    m = _NUMBER_FORMAT.search(script)
    return m and NumberFormat(int(m[1]), int(m[2]), re.sub(r"\\(.)", r"\1", m[5]), m[6] == "true")


def calculate(kind: str, values: list[float]) -> float:
    """SUM, PRD, AVG, MIN or MAX; 0 of nothing."""
    if not values:
        return 0.0
    if kind == "PRD":
        out = 1.0
        for v in values:
            out *= v
        return out
    return {"SUM": sum, "AVG": lambda v: sum(v) / len(v), "MIN": min, "MAX": max}[kind](values)


class Field(NamedTuple):
    num: int
    name: str
    kind: str | None
    flags: int
    value: object
    max_len: int | None
    scripts: dict[str, str]


def form_fields(over: Overlay) -> list[Field]:
    """Terminal fields that are objects of their own, with what they inherit and their scripts (F, K, V)."""
    out: list[Field] = []

    def walk(ref, prefix: str, above: dict, depth: int) -> None:
        d = over.get(ref)
        if not isinstance(d, dict) or depth > FIELD_DEPTH or not isinstance(ref, Ref):
            return
        full = ".".join(x for x in (prefix, text_of(over.field(d, "T"))) if x)
        own = above | {k: over.field(d, k) for k in ("FT", "Ff", "V", "MaxLen") if k in d}
        kids = over.field(d, "Kids")
        kids = [k for k in kids if isinstance(x := over.get(k), dict) and "T" in x] if isinstance(kids, list) else []
        for k in kids:
            walk(k, full, own, depth + 1)
        if not kids:
            actions, scripts = over.field(d, "AA"), {}
            for key in ("F", "K", "V", "C"):
                js = over.field(over.field(actions, key), "JS")
                js = over.doc.decoded(js)[0] if isinstance(js, Stream) else js
                if isinstance(js, bytes):
                    scripts[key] = text_of(js) or ""
            flags, most = own.get("Ff"), own.get("MaxLen")
            out.append(Field(ref.num, full, own.get("FT"), flags if isinstance(flags, int) else 0, own.get("V"), most if isinstance(most, int) else None, scripts))

    fields = over.field(over.field(over.root(), "AcroForm"), "Fields")
    for ref in fields if isinstance(fields, list) else []:
        walk(ref, "", {}, 0)
    return out


def shown(value) -> str:
    return text_of(value) or "" if isinstance(value, bytes) else str(value) if isinstance(value, Name) else ""


def _write_value(over: Overlay, field: Field, value: str) -> None:
    d = dict(over.get(field.num))
    d["V"] = Name(value) if field.kind == "Btn" else pdf_text(value)
    box = over.doc.rect(d.get("Rect"))
    if field.kind == "Btn":
        d["AS"] = Name(value)
    elif box:
        d["AP"] = {"N": over.add(text_appearance(value, box))}
    over.set(field.num, d)


def text_appearance(text: str, box: list[float], size: float = 10.0) -> Stream:
    w, h = box[2] - box[0], box[3] - box[1]
    body = b"/Tx BMC q BT /Helv %s Tf 0 g 2 %s Td %s Tj ET Q EMC" % (number(size).encode(), number(max(2.0, (h - size) / 2)).encode(), write(text.encode("cp1252", "replace")))
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    return Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, w, h], "Resources": {"Font": {"Helv": font}}}, body)


def fill(over: Overlay, name: str, value: str) -> str:
    """The value written to a field: cut to MaxLen; refused where the field is read only or a range check
    fails. Calculated fields follow."""
    field = next((f for f in form_fields(over) if f.name == name), None)
    if field is None:
        raise KeyError(name)
    if field.flags & READ_ONLY:
        raise ValueError("the field is read only")
    limits = value_range(field.scripts.get("V", ""))
    if limits and not ((limits[0] is None or number_of(value) >= limits[0]) and (limits[1] is None or number_of(value) <= limits[1])):
        raise ValueError("the value is out of range")
    value = value[: field.max_len] if field.max_len is not None else value
    _write_value(over, field, value)
    recalculate(over)
    return value


def recalculate(over: Overlay) -> None:
    fields = form_fields(over)
    values = {f.name: shown(f.value) for f in fields}
    for f in fields:
        if found := calculation(f.scripts.get("C", "")):
            kind, names = found
            result = calculate(kind, [number_of(values[n]) for n in names if values.get(n)])
            style = number_format(f.scripts.get("F", ""))
            values[f.name] = style.text(result) if style else number(result)
            if values[f.name] != shown(f.value):
                _write_value(over, f, values[f.name])


def reset(over: Overlay) -> None:
    """Every field to its default value, or none."""
    for f in form_fields(over):
        d = dict(over.get(f.num))
        default = d.get("DV")
        d.pop("V", None)
        d.pop("AP", None)
        over.set(f.num, d | ({"V": default} if default is not None else {}))


def create_text_field(over: Overlay, page: int, name: str, box: list[float], value: str = "") -> Ref:
    leaf = over.doc.pages()[page]
    ref = over.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Tx"), "T": pdf_text(name), "V": pdf_text(value), "Rect": box, "F": PRINT, "P": Ref(leaf["#num"], 0), "AP": {"N": over.add(text_appearance(value, box))}})
    _attach(over, leaf["#num"], ref)
    root = dict(over.get(over.root()))
    form = dict(over.field(root, "AcroForm") or {})
    form["Fields"] = [*(over.field(form, "Fields") or []), ref]
    over.set(over.root().num, root | {"AcroForm": form})
    return ref


def _attach(over: Overlay, page: int, ref: Ref) -> None:
    own = dict(over.get(page))
    listed = over.field(own, "Annots")
    over.set(page, own | {"Annots": [*(listed if isinstance(listed, list) else []), ref]})


# annotations


def normalised_quad(q: list[float]) -> list[float]:
    """Four points as top left, top right, bottom left, bottom right."""
    points = sorted(zip(q[::2], q[1::2]), key=lambda p: -p[1])
    top, low = sorted(points[:2]), sorted(points[2:])
    return [c for p in (*top, *low) for c in p]


def appearance(kind: str, box: list[float], colour: list[float], quads: list[float], opacity: float) -> Stream:
    """A form XObject over the box: highlights multiply, underlines and strike-outs are lines of one point."""
    c = " ".join(map(number, colour))
    quads = quads or [box[0], box[3], box[2], box[3], box[0], box[1], box[2], box[1]]
    lines = [f"{c} RG {c} rg /GS0 gs 1 w"]
    for i in range(0, len(quads) - 7, 8):
        tl, tr, bl, br = (quads[i + 2 * k : i + 2 * k + 2] for k in range(4))
        n = lambda *v: " ".join(map(number, v))
        if kind == "Highlight":
            lines.append(f"{n(*tl)} m {n(*tr)} l {n(*br)} l {n(*bl)} l h f")
        elif kind == "Underline":
            lines.append(f"{n(*bl)} m {n(*br)} l S")
        elif kind == "StrikeOut":
            lines.append(f"{n((tl[0] + bl[0]) / 2, (tl[1] + bl[1]) / 2)} m {n((tr[0] + br[0]) / 2, (tr[1] + br[1]) / 2)} l S")
        elif kind == "Squiggly":
            x, up, path = bl[0], False, [f"{n(*bl)} m"]
            while x < br[0]:
                x, up = min(x + 3, br[0]), not up
                path.append(f"{n(x, bl[1] + (1.5 if up else 0))} l")
            lines.append(" ".join(path) + " S")
        elif kind == "Circle":
            x0, y0, x1, y1 = box
            mx, my, kx, ky = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2 * 0.5522848, (y1 - y0) / 2 * 0.5522848
            lines.append(f"{n(x1, my)} m {n(x1, my + ky, mx + kx, y1, mx, y1)} c {n(mx - kx, y1, x0, my + ky, x0, my)} c {n(x0, my - ky, mx - kx, y0, mx, y0)} c {n(mx + kx, y0, x1, my - ky, x1, my)} c S")
        else:
            lines.append(f"{n(box[0], box[1], box[2] - box[0], box[3] - box[1])} re S")
    state = {"ca": opacity, "CA": opacity} | ({"BM": Name("Multiply")} if kind == "Highlight" else {})
    return Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": list(box), "Resources": {"ExtGState": {"GS0": state}}}, "\n".join(lines).encode())


def add_annotation(over: Overlay, page: int, kind: str, box: list[float], contents: str = "", author: str = "", colour: tuple = (1.0, 1.0, 0.0), quads: list[float] | None = None, opacity: float = 1.0) -> Ref:
    if kind not in SUBTYPES:
        raise ValueError(f"no annotation of kind {kind}")
    quads = [x for i in range(0, len(quads or []) - 7, 8) for x in normalised_quad(quads[i : i + 8])]
    d = {"Type": Name("Annot"), "Subtype": Name(kind), "Rect": list(box), "F": PRINT, "C": list(colour), "Contents": pdf_text(contents), "AP": {"N": over.add(appearance(kind, box, list(colour), quads, opacity))}}
    d |= ({"T": pdf_text(author)} if author else {}) | ({"QuadPoints": quads} if quads else {}) | ({"CA": opacity} if opacity < 1 else {})
    ref = over.add(d)
    _attach(over, over.doc.pages()[page]["#num"], ref)
    return ref


def delete_annotation(over: Overlay, page: int, place: int) -> None:
    """One annotation, with its popup and the replies to it."""
    num = over.doc.pages()[page]["#num"]
    own = dict(over.get(num))
    listed = list(over.field(own, "Annots") or [])
    gone = {listed[place]} if isinstance(listed[place], Ref) else set()
    while True:
        more = {r for r in listed if isinstance(r, Ref) and r not in gone and isinstance(d := over.get(r), dict) and (d.get("IRT") in gone or d.get("Parent") in gone)}
        if not more:
            break
        gone |= more
    for r in gone:
        over.remove(r.num)
    over.set(num, own | {"Annots": [r for i, r in enumerate(listed) if i != place and r not in gone]})


def flatten(over: Overlay, page: int, printing: bool = False) -> int:
    """Appearances drawn into the page, their annotations taken off; hidden ones go, popups too. How many."""
    leaf = over.doc.pages()[page]
    own = dict(over.get(leaf["#num"]))
    resources = dict(over.field(leaf, "Resources") or {})
    objects = dict(over.field(resources, "XObject") or {})
    body, n = [], 0
    for ref in over.field(own, "Annots") or []:
        d = over.get(ref)
        look = over.field(over.field(d, "AP"), "N")
        if isinstance(look, dict):
            look = over.field(look, str(d.get("AS", "Off")))
        flags = d.get("F", 0) if isinstance(d, dict) else 0
        if not isinstance(look, Stream) or d.get("Subtype") == "Popup" or flags & (HIDDEN | NO_VIEW) or printing and not flags & PRINT:
            continue
        name = next(f"Flat{i}" for i in range(len(objects), len(objects) + 10_000) if f"Flat{i}" not in objects)
        rect, form = over.doc.rect(d.get("Rect")), over.doc.rect(look.dict.get("BBox")) or [0, 0, 1, 1]
        if not rect:
            continue
        sx, sy = ((rect[2] - rect[0]) / (form[2] - form[0]) if form[2] > form[0] else 1.0), ((rect[3] - rect[1]) / (form[3] - form[1]) if form[3] > form[1] else 1.0)
        objects[name] = over.add(look)
        body.append(f"q {number(sx)} 0 0 {number(sy)} {number(rect[0] - sx * form[0])} {number(rect[1] - sy * form[1])} cm /{name} Do Q")
        n += 1
    old = own.get("Contents")
    old = old if isinstance(old, list) else [old] if old is not None else []
    own["Contents"] = [over.add(Stream({}, b"q")), *old, over.add(Stream({}, ("Q\n" + "\n".join(body)).encode()))]
    own["Resources"] = resources | {"XObject": objects}
    own.pop("Annots", None)
    over.set(leaf["#num"], own)
    return n


# XFDF


def annotations_xfdf(doc: Document) -> str:
    """The markup annotations of a file as XFDF; links, widgets and popups are no markup."""
    out = []
    for page, leaf in enumerate(doc.pages()):
        for a in doc.field(leaf, "Annots") or []:
            d = doc.get(a) if isinstance(a, Ref) else a
            kind = doc.field(d, "Subtype")
            if kind in (None, "Link", "Widget", "Popup"):
                continue
            rect = doc.rect(doc.field(d, "Rect")) or [0.0] * 4
            flags, colour = doc.field(d, "F"), doc.field(d, "C")
            attrs = {"page": str(page), "rect": ",".join(map(number, rect)), "title": text_of(doc.field(d, "T")), "flags": "print" if isinstance(flags, int) and flags & PRINT else None}
            attrs["color"] = "#" + "".join(f"{round(255 * c):02X}" for c in colour) if isinstance(colour, list) and len(colour) == 3 else None
            quads = doc.field(d, "QuadPoints")
            attrs["coords"] = ",".join(map(number, quads)) if isinstance(quads, list) else None
            text = text_of(doc.field(d, "Contents")) or ""
            out.append(f"<{kind.lower()} " + " ".join(f"{k}={quoteattr(v)}" for k, v in attrs.items() if v is not None) + f"><contents>{escape(text)}</contents></{kind.lower()}>")
    return '<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>' + "".join(out) + "</annots></xfdf>"


def import_xfdf(over: Overlay, xfdf: str) -> tuple[int, int]:
    """Field values and annotations of an XFDF text; how many of each. What names no page or field is passed over."""
    root = ET.fromstring(xfdf)  # noqa: S314 - entities are not expanded by this parser's defaults
    local = lambda e: e.tag.rpartition("}")[2]
    kinds = {k.lower(): k for k in SUBTYPES}
    n_fields = n_annots = 0
    pages = len(over.doc.pages())

    def values(e, prefix: str):
        for f in e:
            if local(f) == "field":
                full = ".".join(x for x in (prefix, f.get("name")) if x)
                for v in f:
                    if local(v) == "value":
                        yield full, v.text or ""
                yield from values(f, full)

    for part in root:
        if local(part) == "fields":
            for name, value in values(part, ""):
                try:
                    fill(over, name, value)
                    n_fields += 1
                except (KeyError, ValueError):
                    continue
        elif local(part) == "annots":
            for a in part:
                box = [float(x) for x in (a.get("rect") or "").split(",") if x]
                page = int(a.get("page") or -1)
                if local(a) in kinds and len(box) == 4 and 0 <= page < pages:
                    colour = tuple(int(a.get("color")[i : i + 2], 16) / 255 for i in (1, 3, 5)) if a.get("color") else (1.0, 1.0, 0.0)
                    text = next((c.text or "" for c in a if local(c) == "contents"), "")
                    quads = [float(x) for x in (a.get("coords") or "").split(",") if x]
                    add_annotation(over, page, kinds[local(a)], box, text, a.get("title") or "", colour, quads or None)
                    n_annots += 1
    return n_fields, n_annots
