"""What a catalog leads to: outlines, name trees, attachments, layers, form fields, annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .cos import Name, Ref, Stream
from .document import Document, write_file

#: Levels of a tree that are followed, and of a form's fields.
DEPTH, FIELD_DEPTH = 64, 16


def text_of(v) -> str | None:
    """A text string: UTF-16 by byte order mark, else a character a byte; empty is null."""
    if not isinstance(v, bytes) or not v:
        return None
    for mark, codec in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if v.startswith(mark):
            return v[2:].decode(codec, "replace")
    return v.decode("latin-1")


def catalog(doc: Document) -> dict:
    root = doc.get(doc.trailer.get("Root")) if "Root" in doc.trailer else None
    return root if isinstance(root, dict) else {}


def resolved(doc: Document, v) -> list:
    """The entries of an array, each led to its value; none where it is no array."""
    v = doc.get(v) if isinstance(v, Ref) else v
    return [doc.get(x) if isinstance(x, Ref) else x for x in v] if isinstance(v, list) else []


def page_numbers(doc: Document) -> dict[int, int]:
    return {p["#num"]: i for i, p in enumerate(doc.pages())}


def named_destinations(doc: Document) -> dict[str, object]:
    root = catalog(doc)
    old = doc.field(root, "Dests")
    found = dict(old) if isinstance(old, dict) else {}
    for key, v in name_tree(doc, doc.field(doc.field(root, "Names"), "Dests")):
        found[key.decode("latin-1")] = v
    return {str(k): doc.get(v) if isinstance(v, Ref) else v for k, v in found.items()}


def target_page(dest, named: dict[str, object], numbers: dict[int, int]) -> int | None:
    """The page of an explicit or named destination: the first where its page is not in the file, null where
    it is no destination."""
    for _ in range(4):
        if isinstance(dest, bytes):
            dest = named.get(dest.decode("latin-1"))
        elif isinstance(dest, Name):
            dest = named.get(str(dest))
        elif isinstance(dest, dict):
            dest = dest.get("D")
    if not isinstance(dest, list) or not dest:
        return None
    return numbers.get(dest[0].num, 0) if isinstance(dest[0], Ref) else dest[0] if isinstance(dest[0], int) else 0


def outlines(doc: Document) -> Iterator[tuple[list[int], int, str | None, int | None]]:
    """(path, depth, title, page) in reading order. An item seen before ends its chain."""
    named, numbers, seen = named_destinations(doc), page_numbers(doc), set()
    # the next item of each open level: a stack, since files nest as deep as they like
    stack = [(doc.field(catalog(doc), "Outlines") or {}, [])]
    stack = [(top.get("First"), [0]) for top, _ in stack if isinstance(top, dict)]
    while stack:
        ref, path = stack.pop()
        item = doc.get(ref) if isinstance(ref, Ref) and ref.num not in seen else None
        if not isinstance(item, dict):
            continue
        seen.add(ref.num)
        action = doc.field(item, "A")
        dest = doc.field(item, "Dest")
        if dest is None and isinstance(action, dict) and action.get("S") == "GoTo":
            dest = doc.field(action, "D")
        yield path, len(path) - 1, text_of(doc.field(item, "Title")), target_page(dest, named, numbers)
        stack.append((item.get("Next"), [*path[:-1], path[-1] + 1]))
        if len(path) < DEPTH:
            stack.append((item.get("First"), [*path, 0]))


def name_tree(doc: Document, node, depth: int = 0) -> Iterator[tuple[bytes, object]]:
    """(key, value) of a name tree's leaves, in order; values as they stand."""
    if not isinstance(node, dict) or depth > DEPTH:
        return
    flat = doc.field(node, "Names")
    if isinstance(flat, list):
        for k, v in zip(flat[::2], flat[1::2]):
            k = doc.get(k) if isinstance(k, Ref) else k
            if isinstance(k, bytes):
                yield k, v
    for kid in resolved(doc, node.get("Kids")):
        yield from name_tree(doc, kid, depth + 1)


def attachments(doc: Document) -> Iterator[tuple[str, str | None, str | None, bytes | None]]:
    """(key, file name, description, bytes); the name is the first of UF, F, DOS, Mac, Unix."""
    for key, v in name_tree(doc, doc.field(doc.field(catalog(doc), "Names"), "EmbeddedFiles")):
        spec = doc.get(v) if isinstance(v, Ref) else v
        names = (text_of(doc.field(spec, k)) for k in ("UF", "F", "DOS", "Mac", "Unix"))
        held = doc.field(spec, "EF")
        body = doc.field(held, "UF") or doc.field(held, "F")
        yield key.decode("latin-1"), next(filter(None, names), None), text_of(doc.field(spec, "Desc")), doc.decoded(body)[0] if isinstance(body, Stream) else None


def layers(doc: Document) -> Iterator[tuple[int, str | None, bool, bool]]:
    """(object, name, visible at first, locked) of the optional content groups."""
    props = doc.field(catalog(doc), "OCProperties")
    listed = doc.field(props, "OCGs")
    config = doc.field(props, "D")
    nums = lambda key: {r.num for r in doc.field(config, key) or [] if isinstance(r, Ref)}
    on, off, locked = nums("ON"), nums("OFF"), nums("Locked")
    base_off = doc.field(config, "BaseState") == "OFF"
    for r in listed if isinstance(listed, list) else []:
        if isinstance(r, Ref):
            yield r.num, text_of(doc.field(doc.get(r), "Name")), r.num in on if base_off else r.num not in off, r.num in locked


def fields(doc: Document) -> Iterator[tuple[str, str | None, int, str | None, bool]]:
    """(full name, type, flags, value, read only) of the form's terminal fields; type, flags and value
    come down from parents. Names are joined by dots; a kid without a name of its own is a widget."""

    def walk(d, prefix: str, kind, flags, value, depth: int):
        if not isinstance(d, dict) or depth > FIELD_DEPTH:
            return
        part = text_of(doc.field(d, "T"))
        full = ".".join(x for x in (prefix, part) if x)
        kind, flags = doc.field(d, "FT") or kind, doc.field(d, "Ff") if isinstance(doc.field(d, "Ff"), int) else flags
        value = doc.field(d, "V") if "V" in d else value
        kids = [k for k in resolved(doc, d.get("Kids")) if isinstance(k, dict) and "T" in k]
        for k in kids:
            yield from walk(k, full, kind, flags, value, depth + 1)
        if not kids:
            shown = text_of(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None
            yield full, str(kind) if kind else None, flags, shown, bool(flags & 1)

    for top in resolved(doc, doc.field(doc.field(catalog(doc), "AcroForm"), "Fields")):
        yield from walk(top, "", None, 0, None, 0)


def annotations(doc: Document) -> Iterator[tuple[int, int, str | None, list[float] | None, int, str | None, str | None]]:
    """(page, place on it, subtype, box, flags, contents, author)."""
    for page, p in enumerate(doc.pages()):
        for i, a in enumerate(resolved(doc, p.get("Annots"))):
            if isinstance(a, dict):
                flags = doc.field(a, "F")
                yield page, i, str(doc.field(a, "Subtype") or "") or None, doc.rect(doc.field(a, "Rect")), flags if isinstance(flags, int) else 0, text_of(doc.field(a, "Contents")), text_of(doc.field(a, "T"))


def label_ranges(doc: Document) -> Iterator[tuple[int, str | None, str | None, int]]:
    """(start, style, prefix, first) of the page labels' number tree, in order."""

    def walk(node, depth: int):
        if not isinstance(node, dict) or depth > DEPTH:
            return
        nums = resolved(doc, node.get("Nums"))
        for start, d in zip(nums[::2], nums[1::2]):
            if isinstance(start, int) and isinstance(d, dict):
                style, first = doc.field(d, "S"), doc.field(d, "St")
                yield start, str(style) if isinstance(style, Name) else None, text_of(doc.field(d, "P")), first if isinstance(first, int) else 1
        for kid in resolved(doc, node.get("Kids")):
            yield from walk(kid, depth + 1)

    yield from walk(doc.field(catalog(doc), "PageLabels"), 0)


def has_xfa(doc: Document) -> bool:
    return doc.field(doc.field(catalog(doc), "AcroForm"), "XFA") is not None


def signed(doc: Document) -> bool:
    """A signature field with a value, or a dictionary with ByteRange and Contents, anywhere."""

    def is_signature(v) -> bool:
        d = v.dict if isinstance(v, Stream) else v
        return isinstance(d, dict) and ((d.get("FT") == "Sig" and "V" in d) or ("ByteRange" in d and "Contents" in d))

    return any(is_signature(doc.get(n)) for n in list(doc.entries))


# AcroForm's scripts of the standard calculations, validations and formats
_CALCULATE = re.compile(r"AFSimple_Calculate\(\s*\"(SUM|PRD|AVG|MIN|MAX)\"\s*,\s*(?:new Array\s*\((.*?)\)|\[(.*?)\]|\"(.*?)\")\s*\)", re.S)
_RANGE = re.compile(r"AFRange_Validate\(\s*(true|false)\s*,\s*([^,]+),\s*(true|false)\s*,\s*([^,)]+)\)")


def calculation(script: str) -> tuple[str, list[str]] | None:
    """(SUM, PRD, AVG, MIN or MAX, field names)."""
    m = _CALCULATE.search(script)
    if not m:
        return None
    return m[1], [x.strip().strip("\"'") for x in next(g for g in m.groups()[1:] if g is not None).split(",") if x.strip()]


def value_range(script: str) -> tuple[float | None, float | None] | None:
    """(least, most) that a range check allows; null where that side is open."""
    m = _RANGE.search(script)
    try:
        return m and (float(m[2]) if m[1] == "true" else None, float(m[4]) if m[3] == "true" else None)
    except ValueError:
        return None


def structured_file(title: str, sections: list[tuple[str, list[str]]], values: dict[str, str], note: str, attached: dict[str, bytes]) -> bytes:
    """A PDF with a page for each section, an outline of two levels, a form of one group, a text note on
    the first page, attachments and one layer for each section, of which the first is hidden."""
    s = lambda x: x.encode("latin-1") if all(ord(c) < 256 for c in x) else b"\xfe\xff" + x.encode("utf-16-be")
    objects: dict[int, object] = {}

    def add(v) -> Ref:
        objects[len(objects) + 1] = v
        return Ref(len(objects), 0)

    root, pages, info = add({}), add({}), add({"Title": s(title)})
    leaves = [add({"Type": Name("Page"), "Parent": pages}) for _ in sections]
    objects[pages.num] = {"Type": Name("Pages"), "Kids": leaves, "Count": len(leaves), "MediaBox": [0, 0, 612, 792]}
    if leaves:
        objects[leaves[0].num]["Annots"] = [add({"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [10, 10, 30, 30], "F": 4, "Contents": s(note)})]

    def chain(items: list[Ref]) -> dict:
        for a, b in zip(items, items[1:]):
            objects[a.num]["Next"], objects[b.num]["Prev"] = b, a
        return {"First": items[0], "Last": items[-1]} if items else {}

    tops = []
    for leaf, (name, parts) in zip(leaves, sections):
        dest = [leaf, Name("Fit")]
        kids = [add({"Title": s(x), "A": {"S": Name("GoTo"), "D": dest}}) for x in parts]
        tops.append(add({"Title": s(name), "Dest": dest} | chain(kids)))
    kids = [add({"T": s(k), "V": s(v)}) for k, v in values.items()]
    form = {"Fields": [add({"T": b"form", "FT": Name("Tx"), "Ff": 1, "Kids": kids})]}
    specs = [x for k, v in sorted(attached.items()) for x in (s(k), add({"Type": Name("Filespec"), "F": s(k), "EF": {"F": add(Stream({}, v))}}))]
    groups = [add({"Type": Name("OCG"), "Name": s(name)}) for name, _ in sections]
    objects[root.num] = {
        "Type": Name("Catalog"), "Pages": pages, "Outlines": add({"Type": Name("Outlines")} | chain(tops)), "AcroForm": form,
        "Names": {"EmbeddedFiles": {"Names": specs}}, "OCProperties": {"OCGs": groups, "D": {"OFF": groups[:1]}},
    }
    return write_file(objects, root.num, info.num)
