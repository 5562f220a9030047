"""TrueType programs: tables, character maps, widths, outlines, subsets, and embedding as a CID font."""

from __future__ import annotations

import struct
import zlib

from .cos import Name, Ref, Stream
from .raster import Point

MAX_DEPTH = 8


class TrueType:
    """A font program. Damaged tables read as empty; glyphs that can't be read have no outline."""

    def __init__(self, data: bytes):
        self.data, self.tables = data, {}
        n = struct.unpack(">H", data[4:6])[0] if len(data) > 12 else 0
        for i in range(n):
            tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * i : 28 + 16 * i].ljust(16, b"\0"))
            self.tables[tag.decode("latin-1")] = data[at : at + size]
        head, maxp, hhea = (self.tables.get(t, b"").ljust(64, b"\0") for t in ("head", "maxp", "hhea"))
        self.units = struct.unpack(">H", head[18:20])[0] or 1000
        self.long = struct.unpack(">h", head[50:52])[0] == 1
        self.n_glyphs = struct.unpack(">H", maxp[4:6])[0]
        self.n_widths = struct.unpack(">H", hhea[34:36])[0]
        loca = self.tables.get("loca", b"")
        step = 4 if self.long else 2
        self.places = [x * (1 if self.long else 2) for x in struct.unpack(f">{len(loca) // step}{'I' if self.long else 'H'}", loca[: len(loca) // step * step])]
        self.map = self.character_map()

    def character_map(self) -> dict[int, int]:
        cmap, out = self.tables.get("cmap", b""), {}
        n = struct.unpack(">H", cmap[2:4])[0] if len(cmap) >= 4 else 0
        found = sorted(struct.unpack(">HHI", cmap[4 + 8 * i : 12 + 8 * i].ljust(8, b"\0")) for i in range(n))
        for _, _, at in found:
            kind = struct.unpack(">H", cmap[at : at + 2].ljust(2, b"\0"))[0]
            if kind == 4:
                count = struct.unpack(">H", cmap[at + 6 : at + 8])[0] // 2
                words = lambda k, sign="H", at=at, count=count: struct.unpack(f">{count}{sign}", cmap[at + k : at + k + 2 * count])
                ends, starts = words(14), words(16 + 2 * count)
                deltas, offsets = words(16 + 4 * count), words(16 + 6 * count)
                for i, (a, b) in enumerate(zip(starts, ends)):
                    for c in range(a, b + 1) if b != 0xFFFF or a != 0xFFFF else []:
                        where = at + 16 + 6 * count + 2 * i + offsets[i] + 2 * (c - a)
                        g = struct.unpack(">H", cmap[where : where + 2].ljust(2, b"\0"))[0] if offsets[i] else c
                        if g := (g + deltas[i]) & 0xFFFF if g or not offsets[i] else 0:
                            out[c] = g
            elif kind == 12:
                for i in range(struct.unpack(">I", cmap[at + 12 : at + 16])[0]):
                    a, b, g = struct.unpack(">III", cmap[at + 16 + 12 * i : at + 28 + 12 * i])
                    out |= {c: g + c - a for c in range(a, min(b, a + 0xFFFF) + 1)}
        return out

    def width(self, glyph: int) -> float:
        """In thousandths of the size."""
        at = 4 * min(glyph, max(0, self.n_widths - 1))
        raw = self.tables.get("hmtx", b"")[at : at + 2]
        return struct.unpack(">H", raw)[0] * 1000 / self.units if len(raw) == 2 else 0.0

    def glyph(self, n: int) -> bytes:
        if not 0 <= n < len(self.places) - 1:
            return b""
        return self.tables.get("glyf", b"")[self.places[n] : self.places[n + 1]]

    def parts(self, n: int) -> list[tuple[int, tuple]]:
        """(glyph, matrix) of a composite glyph's components."""
        raw, out, at = self.glyph(n), [], 10
        if len(raw) < 10 or struct.unpack(">h", raw[:2])[0] >= 0:
            return out
        while at + 4 <= len(raw):
            flags, part = struct.unpack(">HH", raw[at : at + 4])
            at += 4
            dx, dy = struct.unpack(">hh" if flags & 1 else ">bb", raw[at : at + (4 if flags & 1 else 2)])
            at += 4 if flags & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            k = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack(f">{k}h", raw[at : at + 2 * k])]
            at += 2 * k
            a, b, c, d = (v[0], 0.0, 0.0, v[0]) if k == 1 else (v[0], 0.0, 0.0, v[1]) if k == 2 else tuple(v) if k == 4 else (a, b, c, d)
            out.append((part, (a, b, c, d, float(dx), float(dy))))
            if not flags & 32:
                break
        return out

    def outline(self, n: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """Contours of (x, y, on the curve), in font units."""
        raw = self.glyph(n)
        if len(raw) < 10 or depth > MAX_DEPTH:
            return []
        contours = struct.unpack(">h", raw[:2])[0]
        if contours < 0:
            return [[(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5], on) for x, y, on in c] for part, m in self.parts(n) for c in self.outline(part, depth + 1)]
        try:
            ends = struct.unpack(f">{contours}H", raw[10 : 10 + 2 * contours])
            at = 12 + 2 * contours + struct.unpack(">H", raw[10 + 2 * contours : 12 + 2 * contours])[0]
            total, flags = (ends[-1] + 1 if ends else 0), []
            while len(flags) < total:
                f = raw[at]
                at += 1
                again = raw[at] if f & 8 else 0
                at += bool(f & 8)
                flags += [f] * (again + 1)
            axes = []
            for short, same in ((2, 16), (4, 32)):
                v, out = 0, []
                for f in flags[:total]:
                    if f & short:
                        v += raw[at] if f & same else -raw[at]
                        at += 1
                    elif not f & same:
                        v += struct.unpack(">h", raw[at : at + 2])[0]
                        at += 2
                    out.append(v)
                axes.append(out)
        except (struct.error, IndexError):
            return []
        points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags)]
        return [points[a:b] for a, b in zip((0, *(e + 1 for e in ends)), (e + 1 for e in ends))]

    def polygons(self, n: int, size: float, steps: int = 6) -> list[list[Point]]:
        """Contours as polygons at a size; quadratic arcs in steps."""
        k, out = size / self.units, []
        for c in self.outline(n):
            full: list[tuple[float, float, bool]] = []
            for p, q in zip(c, [*c[1:], c[0]]):
                full.append(p)
                if not p[2] and not q[2]:
                    full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
            first = next((i for i, p in enumerate(full) if p[2]), None)
            if first is None:
                continue
            full = full[first:] + full[: first + 1]
            poly, i = [(full[0][0] * k, full[0][1] * k)], 1
            while i < len(full):
                a = full[i - 1]
                if full[i][2]:
                    poly.append((full[i][0] * k, full[i][1] * k))
                    i += 1
                    continue
                b, e = full[i], full[min(i + 1, len(full) - 1)]
                for t in (j / steps for j in range(1, steps + 1)):
                    poly.append(tuple(k * ((1 - t) ** 2 * a[x] + 2 * t * (1 - t) * b[x] + t * t * e[x]) for x in (0, 1)))
                i += 2
            out.append(poly)
        return out


def built(tables: dict[str, bytes]) -> bytes:
    """A font file of tables."""
    n = len(tables)
    out, at, body = struct.pack(">IHHHH", 0x10000, n, 16 * (1 << n.bit_length() - 1), n.bit_length() - 1, 16 * n - 16 * (1 << n.bit_length() - 1)), 12 + 16 * n, b""
    for tag, raw in sorted(tables.items()):
        padded = raw + bytes(-len(raw) % 4)
        check = sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF
        out += struct.pack(">4sIII", tag.encode(), check, at + len(body), len(raw))
        body += padded
    return out + body


def subset(font: TrueType, text: str) -> bytes:
    """The font with the outlines of these characters, and of what they are composed of, alone; glyph numbers stay."""
    keep, todo = {0}, [font.map[ord(c)] for c in text if ord(c) in font.map]
    while todo:
        g = todo.pop()
        if g not in keep:
            keep.add(g)
            todo += [p for p, _ in font.parts(g)]
    glyf, places = b"", [0]
    for n in range(font.n_glyphs):
        raw = font.glyph(n) if n in keep else b""
        glyf += raw + bytes(-len(raw) % 4)
        places.append(len(glyf))
    head = font.tables["head"]
    wanted = {t: font.tables[t] for t in ("cvt ", "fpgm", "prep", "hhea", "hmtx", "maxp", "cmap") if t in font.tables}
    return built(wanted | {"head": head[:50] + struct.pack(">h", 1) + head[52:], "glyf": glyf, "loca": struct.pack(f">{len(places)}I", *places)})


def embedded(font: TrueType, text: str, name: str, add) -> Ref:
    """The five objects of a composite font with a subset for this text; add(object) gives a reference."""
    from .layout import subset_tag

    data = subset(font, text)
    name = f"{subset_tag(data)}+{name}"
    glyphs = sorted({(font.map[ord(c)], c) for c in text if ord(c) in font.map})
    file = add(Stream({"Filter": Name("FlateDecode"), "Length1": len(data)}, zlib.compress(data)))
    descriptor = add({"Type": Name("FontDescriptor"), "FontName": Name(name), "Flags": 4, "FontBBox": [0, -200, 1000, 900], "ItalicAngle": 0, "Ascent": 900, "Descent": -200, "CapHeight": 700, "StemV": 80, "FontFile2": file})
    widths = [x for g, _ in glyphs for x in (g, [font.width(g)])]
    kid = add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(name), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": descriptor, "DW": 1000, "W": widths, "CIDToGIDMap": Name("Identity")})
    lines = "\n".join(f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in glyphs)
    cmap = add(Stream({}, f"1 begincodespacerange <0000> <FFFF> endcodespacerange\n{len(glyphs)} beginbfchar\n{lines}\nendbfchar".encode()))
    return add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(name), "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": cmap})


def cid_to_gid(doc, d: dict):
    """What maps a composite font's CIDs to glyphs: the identity, or a stream of two bytes each."""
    m = doc.field(d, "CIDToGIDMap")
    if not isinstance(m, Stream):
        return lambda cid: cid
    raw = doc.decoded(m)[0]
    return lambda cid: int.from_bytes(raw[2 * cid : 2 * cid + 2])


def boxes_font(widths: dict[str, int], height: int = 700) -> bytes:
    """A small font whose glyphs are boxes, one for each character; the last is composed of the first."""
    glyphs, chars = [b""], sorted(widths)
    for i, c in enumerate(chars):
        w = widths[c]
        if i and i == len(chars) - 1:
            glyphs.append(struct.pack(">hhhhh", -1, 0, 0, w, height) + struct.pack(">HHhh", 3, 1, 50, 10))
            continue
        xs, ys = (0, w, 0, -w), (0, 0, height, 0)
        glyphs.append(struct.pack(">hhhhh", 1, 0, 0, w, height) + struct.pack(">HH", 3, 0) + b"\1\1\1\1" + struct.pack(">4h4h", *xs, *ys))
    places, glyf = [0], b""
    for g in glyphs:
        glyf += g + bytes(-len(g) % 4)
        places.append(len(glyf))
    n = len(chars)
    segments = [(ord(c), ord(c), (i + 1 - ord(c)) & 0xFFFF) for i, c in enumerate(chars)] + [(0xFFFF, 0xFFFF, 1)]
    k = len(segments)
    words = lambda v: struct.pack(f">{len(v)}H", *v)
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * k, 0, 2 * k, 0, 0, 0) + words([s[1] for s in segments]) + b"\0\0" + words([s[0] for s in segments]) + words([s[2] for s in segments]) + words([0] * k)
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    struct.pack_into(">h", head, 50, 1)
    hhea = bytearray(36)
    struct.pack_into(">H", hhea, 34, n + 1)
    return built({"head": bytes(head), "hhea": bytes(hhea), "maxp": struct.pack(">IH", 0x10000, n + 1), "loca": struct.pack(f">{len(places)}I", *places), "glyf": glyf,
                  "hmtx": struct.pack(">Hh", 500, 0) + b"".join(struct.pack(">Hh", widths[c], 0) for c in chars), "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub})
