"""Pixels from geometry: curves, strokes, dashes, coverage, shadings, blending, and pages drawn from these.
Glyphs are drawn from embedded TrueType programs; other text appears as boxes of its runs where asked for."""

from __future__ import annotations

import math

import numpy as np

from .cos import Stream
from .document import Document, times
from .images import MAX_PIXELS, MAX_SIDE, decoded_image
from .interp import Interpreter, apply, rgb
from .pdf_function import Function

Point = tuple[float, float]
SUB = 4  # sample rows and columns of a pixel


def flatten_curve(p0: Point, p1: Point, p2: Point, p3: Point, tolerance: float = 0.1) -> list[Point]:
    """Points of a cubic after p0, close enough that chords err by less than the tolerance."""
    bend = max(math.hypot(a[0] - 2 * b[0] + c[0], a[1] - 2 * b[1] + c[1]) for a, b, c in ((p0, p1, p2), (p1, p2, p3)))
    n = min(256, max(1, math.ceil(math.sqrt(0.75 * bend / tolerance))))
    out = []
    for i in range(1, n + 1):
        t = i / n
        w = ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
        out.append(tuple(sum(k * p[axis] for k, p in zip(w, (p0, p1, p2, p3))) for axis in (0, 1)))
    return out


def dashed(line: list[Point], pattern: list[float], phase: float = 0.0) -> list[list[Point]]:
    """The parts of a line that its dashes leave; a pattern without length changes nothing."""
    if not pattern or sum(pattern) <= 0 or min(pattern) < 0:
        return [line]
    pattern = pattern * 2 if len(pattern) % 2 else pattern
    phase %= sum(pattern)
    k = 0
    while phase >= pattern[k]:
        phase -= pattern[k]
        k = (k + 1) % len(pattern)
    left, out = pattern[k] - phase, []
    now = [line[0]] if k % 2 == 0 else []
    for a, b in zip(line, line[1:]):
        length, at = math.hypot(b[0] - a[0], b[1] - a[1]), 0.0
        while length - at > left:
            at += left
            p = (a[0] + (b[0] - a[0]) * at / length, a[1] + (b[1] - a[1]) * at / length)
            if k % 2 == 0:
                out.append([*now, p])
            k = (k + 1) % len(pattern)
            now, left = [p] if k % 2 == 0 else [], pattern[k] or 1e-9
        left -= length - at
        if k % 2 == 0:
            now.append(b)
    return [x for x in [*out, now] if len(x) > 1]


def stroked(line: list[Point], width: float, cap: int = 0, join: int = 0, miter: float = 10.0) -> list[list[Point]]:
    """Polygons that cover a stroke: a quad for each segment, joins and caps (0 butt or miter, 1 round, 2 square or bevel)."""
    r, out = width / 2, []
    if r <= 0:
        return out
    circle = lambda p: [(p[0] + r * math.cos(k * math.pi / 8), p[1] + r * math.sin(k * math.pi / 8)) for k in range(16)]
    parts = [(a, b) for a, b in zip(line, line[1:]) if a != b]
    if not parts:
        return [circle(line[0])] if line and cap == 1 else out
    closed = line[0] == line[-1] and len(parts) > 2
    for i, (a, b) in enumerate(parts):
        n = math.hypot(b[0] - a[0], b[1] - a[1])
        u, v = (b[0] - a[0]) / n * r, (b[1] - a[1]) / n * r
        if cap == 2 and not closed:
            a = (a[0] - u, a[1] - v) if i == 0 else a
            b = (b[0] + u, b[1] + v) if i == len(parts) - 1 else b
        out.append([(a[0] - v, a[1] + u), (b[0] - v, b[1] + u), (b[0] + v, b[1] - u), (a[0] + v, a[1] - u)])
    for (a, b), (c, d) in zip(parts, parts[1:] + (parts[:1] if closed else [])):
        if join == 1:
            out.append(circle(b))
            continue
        one, two = math.atan2(b[1] - a[1], b[0] - a[0]), math.atan2(d[1] - c[1], d[0] - c[0])
        turn = (two - one + math.pi) % (2 * math.pi) - math.pi
        side = -1 if turn > 0 else 1
        p, q = ((b[0] - side * r * math.sin(t), b[1] + side * r * math.cos(t)) for t in (one, two))
        half = math.cos(turn / 2)
        tip = [(b[0] + (p[0] + q[0] - 2 * b[0]) / (2 * half * half), b[1] + (p[1] + q[1] - 2 * b[1]) / (2 * half * half))] if join == 0 and half > 1e-6 and 1 / half <= miter else []
        out.append([b, p, *tip, q])
    if cap == 1 and not closed:
        out += [circle(parts[0][0]), circle(parts[-1][1])]
    return out


def coverage(polygons: list[list[Point]], width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """How much of each pixel the polygons cover, 0 to 1, by SUB x SUB samples; rows go down, y too."""
    acc = np.zeros((height * SUB, width * SUB + 1), np.int32)
    for poly in polygons:
        for (x0, y0), (x1, y1) in zip(poly, [*poly[1:], poly[0]]):
            if y0 == y1:
                continue
            sign = 1 if y1 > y0 else -1
            if y1 < y0:
                x0, y0, x1, y1 = x1, y1, x0, y0
            first, last = max(0, math.ceil(y0 * SUB - 0.5)), min(height * SUB - 1, math.ceil(y1 * SUB - 0.5) - 1)
            if last < first:
                continue
            rows = np.arange(first, last + 1)
            x = x0 + ((rows + 0.5) / SUB - y0) * (x1 - x0) / (y1 - y0)
            np.add.at(acc, (rows, np.clip(np.ceil(x * SUB - 0.5), 0, width * SUB).astype(int)), sign)
    wind = np.cumsum(acc[:, :-1], axis=1)
    inside = wind % 2 != 0 if even_odd else wind != 0
    return inside.reshape(height, SUB, width, SUB).mean(axis=(1, 3))


def blended(mode: str, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A blend function over arrays of colours (the last axis has three)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if mode in ("Hue", "Saturation", "Color", "Luminosity"):
            return _hsl(mode, b, s)
        root = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
        hard = lambda low, high: np.where(high <= 0.5, low * 2 * high, low + (2 * high - 1) - low * (2 * high - 1))
        return {
            "Multiply": lambda: b * s, "Screen": lambda: b + s - b * s, "Darken": lambda: np.minimum(b, s), "Lighten": lambda: np.maximum(b, s),
            "Difference": lambda: np.abs(b - s), "Exclusion": lambda: b + s - 2 * b * s, "HardLight": lambda: hard(b, s), "Overlay": lambda: hard(s, b),
            "ColorDodge": lambda: np.where(b == 0, 0.0, np.where(s >= 1, 1.0, np.minimum(1, b / np.maximum(1 - s, 1e-12)))),
            "ColorBurn": lambda: np.where(b >= 1, 1.0, np.where(s <= 0, 0.0, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-12)))),
            "SoftLight": lambda: np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (root - b)),
        }.get(mode, lambda: s)()


def _hsl(mode: str, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    light = lambda c: (c @ np.array([0.3, 0.59, 0.11]))[..., None]
    amount = lambda c: c.max(-1, keepdims=True) - c.min(-1, keepdims=True)

    def saturated(c: np.ndarray, to: np.ndarray) -> np.ndarray:
        own = amount(c)
        return np.where(own > 0, (c - c.min(-1, keepdims=True)) * to / np.where(own > 0, own, 1), 0.0)

    def lit(c: np.ndarray, to: np.ndarray) -> np.ndarray:
        c = c + to - light(c)
        at, low, high = light(c), c.min(-1, keepdims=True), c.max(-1, keepdims=True)
        c = np.where(low < 0, at + (c - at) * at / np.where(low < 0, at - low, 1), c)
        return np.where(high > 1, at + (c - at) * (1 - at) / np.where(high > 1, high - at, 1), c)

    return {"Hue": lambda: lit(saturated(s, amount(b)), light(b)), "Saturation": lambda: lit(saturated(b, amount(s)), light(b)), "Color": lambda: lit(s, light(b)), "Luminosity": lambda: lit(b, light(s))}[mode]()


def over(canvas: np.ndarray, colour: np.ndarray, alpha: np.ndarray, mode: str = "Normal") -> None:
    """A colour with an alpha a pixel, laid over a canvas of straight RGBA in place."""
    ab, b = canvas[:, :, 3:], canvas[:, :, :3]
    a = alpha[:, :, None]
    s = np.broadcast_to(colour, b.shape)
    out = a + ab - a * ab
    mixed = a * (1 - ab) * s + a * ab * blended(mode, b, s) + (1 - a) * ab * b
    canvas[:, :, :3] = np.where(out > 0, mixed / np.where(out > 0, out, 1), 0.0)
    canvas[:, :, 3:] = out


def shading(doc: Document, d: dict, inverse: tuple, width: int, height: int, resources: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """(colours, where) of an axial or radial shading for each pixel; None for other kinds."""
    kind, coords = doc.field(d, "ShadingType"), doc.field(d, "Coords")
    if kind not in (2, 3) or not isinstance(coords, list):
        return None
    domain = doc.field(d, "Domain") or [0.0, 1.0]
    extend = doc.field(d, "Extend") or [False, False]
    y, x = np.mgrid[0:height, 0:width] + 0.5
    px, py = inverse[0] * x + inverse[2] * y + inverse[4], inverse[1] * x + inverse[3] * y + inverse[5]
    if kind == 2:
        x0, y0, x1, y1 = map(float, coords[:4])
        span = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / span if span else np.zeros_like(px)
        fits = np.ones_like(t, bool)
    else:
        x0, y0, r0, x1, y1, r1 = map(float, coords[:6])
        dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
        a = dx * dx + dy * dy - dr * dr
        b = (px - x0) * dx + (py - y0) * dy + r0 * dr
        c = (px - x0) ** 2 + (py - y0) ** 2 - r0 * r0
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(b * b - a * c, 0))
            t = (b + np.sign(a) * root) / a if a else c / (2 * b)
            other = (b - np.sign(a) * root) / a if a else t
        usable = lambda v: np.isfinite(v) & (r0 + v * dr >= 0) & ((v >= 0) | bool(extend[0])) & ((v <= 1) | bool(extend[1]))
        t = np.where(usable(t), t, other)
        fits = usable(t) & (b * b - a * c >= 0)
    fits &= ((t >= 0) | bool(extend[0])) & ((t <= 1) | bool(extend[1]))
    f, space = Function(doc, d["Function"]), d.get("ColorSpace")
    steps = [rgb(doc, space, f([domain[0] + i / 255 * (domain[1] - domain[0])]), resources) or (0.0, 0.0, 0.0) for i in range(256)]
    at = np.clip(np.nan_to_num(t), 0, 1) * 255
    return np.array(steps)[np.round(at).astype(int)], fits


def placed(box: list[float], turn: int, scale: float) -> tuple[tuple, int, int]:
    """The matrix from a page's box to pixels (from the upper left), and their number each way."""
    w, h = (box[2] - box[0]) * scale, (box[3] - box[1]) * scale
    m = times((1, 0, 0, 1, -box[0], -box[1]), (scale, 0, 0, -scale, 0, h))
    for _ in range(turn // 90 % 4):
        m, w, h = times(m, (0, 1, -1, 0, h, 0)), h, w
    return m, math.ceil(w), math.ceil(h)


def inverse(m: tuple) -> tuple:
    det = m[0] * m[3] - m[1] * m[2]
    return (m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)


class Painter(Interpreter):
    """The interpreter with a canvas: paths, images, and axial and radial shadings are painted."""

    def __init__(self, doc: Document, page: dict, scale: float = 1.0, boxes_for_text: bool = False):
        _, crop, turn = doc.boxes(page)
        self.view, self.w, self.h = placed(crop, turn, min(scale, 16.0))
        if max(self.w, self.h) > MAX_SIDE or self.w * self.h > MAX_PIXELS:
            raise ValueError("the picture would be too large")
        self.canvas = np.ones((self.h, self.w, 4))
        self.lines: list[list[Point]] = []
        self.boxes_for_text, self.programs = boxes_for_text, {}
        super().__init__(doc, page)

    def add(self, *points) -> None:
        start = self.at
        super().add(*points)
        if self.op in ("m", "re") or not self.lines:
            self.lines.append(list(points))
        elif self.op in ("c", "v", "y"):
            self.lines[-1] += flatten_curve(start, *points, 0.1 / max(1e-6, abs(self.state.ctm[0]) + abs(self.state.ctm[1])))
        else:
            self.lines[-1] += points

    def close(self, _=None) -> None:
        if self.lines:
            self.lines[-1].append(self.lines[-1][0])

    def paint(self, stroke: bool, shown: bool = True) -> None:
        m = times(self.state.ctm, self.view)
        if shown and self.lines:
            s = self.state
            if self.op in ("s", "b", "b*"):
                self.close()
            if self.op in ("f", "F", "f*", "B", "B*", "b", "b*"):
                self.lay([[apply(m, *p) for p in x] for x in self.lines if len(x) > 2], s.colours["fill"], s.alpha["fill"], self.op.endswith("*"))
            if stroke:
                parts = [d for x in self.lines for d in dashed(x, [float(v) for v in s.dash[0]], s.dash[1])]
                polys = [[apply(m, *p) for p in poly] for x in parts for poly in stroked(x, s.width, s.cap, s.join, s.miter)]
                self.lay([p if _area(p) > 0 else p[::-1] for p in polys], s.colours["stroke"], s.alpha["stroke"], False)
        self.lines = []
        super().paint(stroke, shown)

    def program(self, font):
        """The font's TrueType program and its codes' glyphs; None where it has none."""
        from .truetype import TrueType, cid_to_gid

        if id(font) not in self.programs:
            kids = self.doc.field(font.dict, "DescendantFonts")
            d = self.doc.get(kids[0]) if font.wide and isinstance(kids, list) and kids else font.dict
            file = self.doc.field(self.doc.field(d, "FontDescriptor"), "FontFile2")
            found = TrueType(self.doc.decoded(file)[0]) if isinstance(file, Stream) else None
            glyph = cid_to_gid(self.doc, d) if font.wide else (lambda code: found.map.get(ord(font.text(code)[:1] or "\0"), 0))
            self.programs[id(font)] = found and (found, glyph)
        return self.programs[id(font)]

    def show(self, parts: list) -> None:
        s, font = self.state, self.state.font or self.fallback
        known = self.program(font)
        if known and s.render in (0, 2, 4, 6):
            x, th = 0.0, s.tz / 100
            m = times(times(self.tm, s.ctm), self.view)
            polygons = []
            for p in parts:
                if isinstance(p, bytes):
                    for code in font.codes(p):
                        polygons += [[apply(m, x + px * th, s.rise + py) for px, py in poly] for poly in known[0].polygons(known[1](code), s.size)]
                        x += (font.width(code) / 1000 * s.size + s.tc + (s.tw if code == 32 and not font.wide else 0)) * th
                elif isinstance(p, (int, float)):
                    x -= p / 1000 * s.size * th
            self.lay(polygons, s.colours["fill"], s.alpha["fill"], False)
        super().show(parts)

    def clip_mask(self) -> np.ndarray:
        x0, y0, x1, y1 = self.state.clip
        corners = [apply(self.view, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
        far = 1e7
        return coverage([[(max(-far, min(far, x)), max(-far, min(far, y))) for x, y in corners]], self.w, self.h)

    def lay(self, polygons: list[list[Point]], colour, alpha: float, even_odd: bool) -> None:
        if colour is not None and polygons:
            over(self.canvas, np.array(colour), coverage(polygons, self.w, self.h, even_odd) * self.clip_mask() * alpha, self.state.blend)

    def mark(self, kind: str, box: tuple, **more) -> None:
        super().mark(kind, box, **more)
        if kind == "text" and self.boxes_for_text:
            x0, y0, x1, y1 = box
            self.lay([[apply(self.view, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]], self.state.colours["fill"], self.state.alpha["fill"], False)
        elif kind == "image":
            self.picture(more["name"])
        elif kind == "shading":
            d = self.doc.field(self.doc.field(self.resources, "Shading"), more["name"])
            found = shading(self.doc, d.dict if isinstance(d, Stream) else d or {}, inverse(times(self.state.ctm, self.view)), self.w, self.h, self.resources)
            if found is None:
                self.notes.append("a shading of a kind that is not drawn")
            else:
                over(self.canvas, found[0], found[1] * self.clip_mask() * self.state.alpha["fill"], self.state.blend)

    def picture(self, name: str) -> None:
        x = self.doc.field(self.doc.field(self.resources, "XObject"), name)
        pixels = decoded_image(self.doc, x, self.resources) if isinstance(x, Stream) else None
        if pixels is None:
            self.notes.append(f"image {name} can't be drawn")
            return
        x_dict, (h, w) = x.dict, pixels.shape[:2]
        m = inverse(times(self.state.ctm, self.view))
        y, x = np.mgrid[0 : self.h, 0 : self.w] + 0.5
        u, v = m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]
        inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        col, row = np.clip((u * w).astype(int), 0, w - 1), np.clip(((1 - v) * h).astype(int), 0, h - 1)
        got = pixels[row, col] / 255.0
        stencil = self.doc.field(x_dict, "ImageMask") is True
        colour = np.array(self.state.colours["fill"] or (0, 0, 0)) if stencil else got[:, :, :3]
        over(self.canvas, colour, got[:, :, 3] * inside * self.clip_mask() * self.state.alpha["fill"], self.state.blend)


def _area(p: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]]))


def render(doc: Document, page: dict, scale: float = 1.0, boxes_for_text: bool = False) -> np.ndarray:
    """RGBA pixels of a page on white."""
    p = Painter(doc, page, scale, boxes_for_text)
    return np.floor(p.canvas * 255 + 0.5).astype(np.uint8)

