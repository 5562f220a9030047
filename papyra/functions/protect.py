"""Redaction, scrubbing, sanitising, leak scans and signature ranges of files."""

from __future__ import annotations

import hashlib
import re

from .cos import Name, Ref, Stream, write
from .document import Document, write_file
from .interp import EVERYWHERE, Interpreter, Mark
from .organize import Overlay, apply_patches

# fixed values: the bits of /P that permit something
RIGHTS = {"print": 4, "modify": 8, "extract": 16, "annotate": 32, "fill forms": 256, "accessibility": 512, "assemble": 1024, "print in high quality": 2048}


def permissions(p: int) -> dict[str, bool]:
    return {name: bool(p & bit) for name, bit in RIGHTS.items()}


def denied(p: int) -> str:
    return ", ".join(name for name, bit in RIGHTS.items() if not p & bit)


def scrub_bytes(data: bytes, tokens: list[bytes]) -> bytes:
    """Every occurrence of each token taken out, one token after another."""
    for t in tokens:
        if t:
            data = data.replace(t, b"")
    return data


def _forms(token: str) -> list[bytes]:
    """A token as files may hold it: in Latin-1, UTF-16 either way, and hex of each."""
    plain = [token.encode(c) for c in ("utf-8", "utf-16-be", "utf-16-le") if token]
    return plain + [h for b in plain for h in (b.hex().encode(), b.hex().upper().encode())]


def leaks(doc: Document, tokens: list[str]) -> list[str]:
    """The tokens found in the bytes of the file, in a decoded stream or in a string of any object."""
    hay = [doc.data]
    for n in doc.entries:
        v = doc.get(n)
        hay.append(doc.decoded(v)[0] if isinstance(v, Stream) else b"")
        hay += strings(v)
    return [t for t in tokens if any(f in h for f in _forms(t) for h in hay)]


def strings(v) -> list[bytes]:
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if isinstance(x, bytes):
            out.append(x)
        elif isinstance(x, Stream):
            todo.append(x.dict)
        elif isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return out


def scrubbed(v, tokens: list[str], doc: Document):
    """An object without the tokens in its strings and stream bodies; streams that change lose their filters."""
    forms = [f for t in tokens for f in _forms(t)]
    if isinstance(v, bytes):
        return scrub_bytes(v, forms)
    if isinstance(v, Stream):
        d = {k: scrubbed(x, tokens, doc) for k, x in v.dict.items()}
        body, encoded, _ = doc.decoded(v)
        clean = scrub_bytes(body, forms)
        return Stream(d, v.raw) if encoded or clean == body else Stream({k: x for k, x in d.items() if k not in ("Filter", "DecodeParms", "Length")}, clean)
    if isinstance(v, dict):
        return {k: scrubbed(x, tokens, doc) for k, x in v.items()}
    return [scrubbed(x, tokens, doc) for x in v] if isinstance(v, list) else v


def scrub(doc: Document, tokens: list[str]) -> bytes:
    """The whole file written anew without the tokens; older revisions go with their bytes."""
    over = Overlay(doc)
    for n, v in over.reachable().items():
        over.set(n, scrubbed(v, tokens, doc))
    return over.save_full()


def redacted(doc: Document, page: int, boxes: list[list[float]]) -> tuple[bytes, int]:
    """The file written anew with what is drawn under the boxes taken out: the operations of text, images and
    inline images that touch one are deleted, black boxes drawn in their place, and annotations there go.
    Text inside forms is redacted by leaving out the form's drawing. Returns also how many marks went."""
    leaf = doc.pages()[page]
    over = Overlay(doc)
    touched = lambda b: any(b[0] < x[2] and x[0] < b[2] and b[1] < x[3] and x[1] < b[3] for x in boxes)
    content = doc.content(leaf)
    gone = {(m.start, m.end) for m in Interpreter(doc, leaf).marks if m.kind in ("text", "image", "inline") and touched(m.box)}
    cover = "\n".join(f"q 0 g {b[0]} {b[1]} {b[2] - b[0]} {b[3] - b[1]} re f Q" for b in boxes)
    clean = apply_patches(content, [(s, e, b" ") for s, e in gone])
    own = dict(over.get(leaf["#num"]))
    own["Contents"] = over.add(Stream({}, b"q\n" + clean + b"\nQ\n" + cover.encode()))
    listed = over.field(own, "Annots")
    if isinstance(listed, list):
        own["Annots"] = [a for a in listed if not touched(doc.rect(doc.field(a, "Rect")) or EVERYWHERE)]
    over.set(leaf["#num"], own)
    return over.save_full(), len(gone)


def sanitized(doc: Document) -> tuple[bytes, list[str]]:
    """The file written anew without scripts, open actions, attachments, metadata, thumbnails, form data of
    other programs and hidden layers' lists; and what was taken."""
    over, found = Overlay(doc), []
    root = dict(over.get(over.root()))
    names = dict(over.field(root, "Names") or {})
    for part in ("JavaScript", "EmbeddedFiles"):
        if names.pop(part, None) is not None:
            found.append(part)
    root["Names"] = names
    for key in ("OpenAction", "AA", "Metadata", "PieceInfo", "Collection"):
        if root.pop(key, None) is not None:
            found.append(key)
    over.set(over.root().num, {k: v for k, v in root.items() if v != {}})
    for n, v in list(over.reachable().items()):
        d = v.dict if isinstance(v, Stream) else v
        if isinstance(d, dict):
            bad = [k for k in ("AA", "Metadata", "PieceInfo", "Thumb", "JS") if k in d] + (["A"] if isinstance(a := over.get(d.get("A")), dict) and a.get("S") in ("JavaScript", "Launch") else [])
            if bad:
                found += bad
                d = {k: x for k, x in d.items() if k not in bad}
                over.set(n, Stream(d, v.raw) if isinstance(v, Stream) else d)
    if "Info" in doc.trailer:
        found.append("Info")
        doc.trailer = {k: v for k, v in doc.trailer.items() if k != "Info"}
    return over.save_full(), sorted(set(found))


# signatures: the digest over the byte range; certificates are not judged


def sign(objects: dict[int, object], root: int, page: int, name: str, room: int = 64) -> bytes:
    """A file with a signature field whose Contents hold the SHA-256 of the bytes in ByteRange."""
    objects = dict(objects)
    n = max(objects) + 1
    objects[n] = {"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.x509.rsa_sha1"), "Name": name.encode("latin-1", "replace"), "ByteRange": [0, 1111111111, 2222222222, 3333333333], "Contents": b"\1" * room}
    objects[n + 1] = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Sig"), "T": b"Signature", "V": Ref(n, 0), "Rect": [0, 0, 0, 0], "P": Ref(page, 0)}
    objects[root] = objects[root] | {"AcroForm": {"Fields": [Ref(n + 1, 0)], "SigFlags": 3}}
    data = write_file(objects, root)
    at = data.index(b"/Contents (" + b"\1" * room) + 10
    end = at + room + 2
    ranges = b"[0 %010d %010d %010d]" % (at, end, len(data) - end)
    data = data.replace(b"[0 1111111111 2222222222 3333333333]", ranges, 1)
    digest = hashlib.sha256(data[:at] + data[end:]).hexdigest().encode()
    return data[:at] + b"(" + digest.ljust(room, b"0") + b")" + data[end:]


def verified(doc: Document) -> list[tuple[str, bool, bool]]:
    """(name, whether the digest fits, whether bytes follow the signed range) of the signatures."""
    out = []
    for n in sorted(doc.entries):
        d = doc.get(n)
        r = doc.field(d, "ByteRange") if isinstance(d, dict) else None
        if isinstance(r, list) and len(r) == 4 and all(isinstance(x, int) and x >= 0 for x in r):
            signed = doc.data[r[0] : r[0] + r[1]] + doc.data[r[2] : r[2] + r[3]]
            held = d.get("Contents")
            name = d.get("Name")
            out.append((name.decode("latin-1") if isinstance(name, bytes) else "", isinstance(held, bytes) and held[:64] == hashlib.sha256(signed).hexdigest().encode(), r[2] + r[3] < len(doc.data)))
    return out


# edits of page content as byte patches


def _safe(content: bytes, at: int, body: bytes) -> bytes:
    """body with spaces where it would touch a regular byte."""
    regular = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]")
    before = b" " if at and regular.match(content[at - 1 : at]) and regular.match(body) else b""
    after = b" " if regular.match(content[at : at + 1]) and regular.match(body[-1:]) else b""
    return before + body + after


def moved(content: bytes, mark: Mark, m: tuple) -> list[tuple[int, int, bytes]]:
    """The patches that draw a mark under a matrix: q ... cm before it, Q behind."""
    matrix = b"q %s cm" % b" ".join(write(float(x)) for x in m)
    return [(mark.start, mark.start, _safe(content, mark.start, matrix) + b" "), (mark.end, mark.end, b" " + _safe(content, mark.end, b"Q"))]


def deleted(content: bytes, mark: Mark) -> list[tuple[int, int, bytes]]:
    return [(mark.start, mark.end, b" ")]


def recoloured(content: bytes, mark: Mark, rgb: tuple) -> list[tuple[int, int, bytes]]:
    state = b"q %s rg %s RG" % ((b" ".join(write(float(c)) for c in rgb),) * 2)
    return [(mark.start, mark.start, _safe(content, mark.start, state) + b" "), (mark.end, mark.end, b" " + _safe(content, mark.end, b"Q"))]


def edited(doc: Document, page: int, patches: list[tuple[int, int, bytes]]) -> bytes:
    """An incremental save in which the page has the patched content."""
    over, leaf = Overlay(doc), doc.pages()[page]
    own = dict(over.get(leaf["#num"]))
    own["Contents"] = over.add(Stream({}, apply_patches(doc.content(leaf), patches)))
    over.set(leaf["#num"], own)
    return over.save_incremental()
