"""The page interpreter: content operations to marks (text, paths, images, shadings, forms) with bounds,
colours, clips and marked content."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from .cos import Name, Ref, Stream
from .document import Document, operations, times
from .fonts import Font
from .pdf_function import Function

MAX_STATES, MAX_FORMS, MAX_CLIPS = 64, 12, 32
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
EVERYWHERE = (-1e9, -1e9, 1e9, 1e9)
#: A glyph's box above and below its baseline, as parts of the size.
ABOVE, BELOW = 0.75, 0.25
# fixed values: the abbreviations of inline images
SHORT_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
SHORT_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
SHORT_FILTERS = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
# fixed values: every operator of a content stream with its number of operands (-1: any)
ARITY = {
    "w": 1, "J": 1, "j": 1, "M": 1, "d": 2, "ri": 1, "i": 1, "gs": 1, "q": 0, "Q": 0, "cm": 6, "CS": 1, "cs": 1, "SC": -1, "sc": -1, "SCN": -1, "scn": -1,
    "m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "h": 0, "re": 4, "S": 0, "s": 0, "f": 0, "F": 0, "f*": 0, "B": 0, "B*": 0, "b": 0, "b*": 0, "n": 0, "W": 0, "W*": 0,
    "BT": 0, "ET": 0, "Tc": 1, "Tw": 1, "Tz": 1, "TL": 1, "Tf": 2, "Tr": 1, "Ts": 1, "Td": 2, "TD": 2, "Tm": 6, "T*": 0, "Tj": 1, "TJ": 1, "'": 1, '"': 3,
    "d0": 2, "d1": 6, "gx": 0, "G": 1, "g": 1, "RG": 3, "rg": 3, "K": 4, "k": 4, "sh": 1, "Do": 1, "BI": 1, "ID": 0, "EI": 0, "MP": 1, "DP": 2, "BMC": 1, "BDC": 2,
    "EMC": 0, "BX": 0, "EX": 0, "OC": 1,
}


class Mark(NamedTuple):
    kind: str  # text, path, image, inline, shading, form
    box: tuple[float, float, float, float]
    start: int
    end: int
    form: str | None = None  # the name of the outermost form it comes from
    mcid: int | None = None
    artifact: bool = False
    fill: tuple | None = None
    stroke: tuple | None = None
    clip: tuple[float, float, float, float] = EVERYWHERE
    text: str = ""
    line: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # start and end of the baseline
    size: float = 0.0
    name: str = ""  # of the font or XObject


class State:
    def __init__(self):
        self.ctm, self.clip, self.n_clips = UNIT, EVERYWHERE, 0
        self.width, self.cap, self.join, self.miter, self.dash, self.intent = 1.0, 0, 0, 10.0, ([], 0.0), ""
        self.spaces = {"fill": Name("DeviceGray"), "stroke": Name("DeviceGray")}
        self.colours = {"fill": (0.0, 0.0, 0.0), "stroke": (0.0, 0.0, 0.0)}
        self.alpha = {"fill": 1.0, "stroke": 1.0}
        self.blend = "Normal"
        self.font, self.font_name, self.size = None, "", 1.0
        self.tc = self.tw = self.tl = self.rise = 0.0
        self.tz, self.render = 100.0, 0

    def copied(self) -> State:
        new = copy.copy(self)
        new.spaces, new.colours, new.alpha = dict(self.spaces), dict(self.colours), dict(self.alpha)
        return new


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def bounds(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def box_under(m: tuple, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    return bounds([apply(m, x, y) for x in (x0, x1) for y in (y0, y1)])


def crossing(a: tuple, b: tuple) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (x0, y0, max(x0, x1), max(y0, y1))


def rgb(doc: Document, space, values: list[float], resources: dict, depth: int = 0) -> tuple[float, float, float] | None:
    """A colour in [0, 1] each; None for patterns and what can't be read."""
    space = doc.get(space) if isinstance(space, Ref) else space
    if depth > 3:
        return None
    if isinstance(space, Name):
        named = doc.field(doc.field(resources, "ColorSpace"), str(space))
        if named is not None and space not in ("DeviceGray", "DeviceRGB", "DeviceCMYK"):
            return rgb(doc, named, values, resources, depth + 1)
        space = [space]
    if not isinstance(space, list) or not space:
        return None
    kind, args = space[0], [doc.get(x) if isinstance(x, Ref) else x for x in space[1:]]
    v = [min(1.0, max(0.0, float(x))) for x in values]
    if kind in ("DeviceGray", "CalGray", "G") and v:
        return (v[0],) * 3
    if kind in ("DeviceRGB", "CalRGB", "RGB") and len(v) >= 3:
        return tuple(v[:3])
    if kind in ("DeviceCMYK", "CMYK") and len(v) >= 4:
        return tuple((1 - c) * (1 - v[3]) for c in v[:3])
    if kind == "ICCBased" and args and isinstance(args[0], Stream):
        n = doc.field(args[0].dict, "N")
        other = doc.field(args[0].dict, "Alternate") or {1: Name("DeviceGray"), 3: Name("DeviceRGB"), 4: Name("DeviceCMYK")}.get(n)
        return rgb(doc, other, values, resources, depth + 1)
    if kind in ("Indexed", "I") and len(args) >= 3 and values:
        table = doc.decoded(args[2])[0] if isinstance(args[2], Stream) else args[2]
        n = components(doc, args[0], resources)
        at = int(min(max(values[0], 0), args[1] if isinstance(args[1], int) else 255)) * n
        return rgb(doc, args[0], [x / 255 for x in table[at : at + n]], resources, depth + 1) if isinstance(table, bytes) else None
    if kind in ("Separation", "DeviceN") and len(args) >= 3:
        return rgb(doc, args[1], Function(doc, args[2])(v), resources, depth + 1)
    if kind == "Lab" and len(values) >= 3:
        white = doc.field(args[0], "WhitePoint") if args else None
        return lab_rgb(values[:3], [float(x) for x in white] if isinstance(white, list) else [0.9505, 1.0, 1.089])
    return None


def components(doc: Document, space, resources: dict) -> int:
    space = doc.get(space) if isinstance(space, Ref) else space
    if isinstance(space, Name):
        named = doc.field(doc.field(resources, "ColorSpace"), str(space))
        space = named if isinstance(named, list) else [space]
    kind = space[0] if isinstance(space, list) and space else ""
    if kind == "ICCBased":
        s = doc.get(space[1]) if isinstance(space[1], Ref) else space[1]
        n = doc.field(s.dict, "N") if isinstance(s, Stream) else 3
        return n if isinstance(n, int) else 3
    if kind == "DeviceN":
        names = doc.get(space[1]) if isinstance(space[1], Ref) else space[1]
        return len(names) if isinstance(names, list) else 1
    return {"DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4}.get(kind, 1)


def lab_rgb(lab: list[float], white: list[float]) -> tuple[float, float, float]:
    m = (lab[0] + 16) / 116
    g = lambda t: t**3 if t >= 6 / 29 else 108 / 841 * (t - 4 / 29)
    return xyz_rgb(*(w * g(t) for w, t in zip(white, (m + lab[1] / 500, m, m - lab[2] / 200))))


def xyz_rgb(x: float, y: float, z: float) -> tuple[float, float, float]:
    """CIE XYZ to sRGB with its companding."""
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    lin = [a * x + b * y + c * z for a, b, c in rows]
    return tuple(min(1.0, max(0.0, 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055)) for v in lin)


def expanded(d: dict) -> dict:
    """An inline image's dictionary with its abbreviations spelled out."""
    word = lambda v, table: Name(table.get(v, v)) if isinstance(v, Name) else [word(x, table) for x in v] if isinstance(v, list) else v
    out = {SHORT_KEYS.get(k, k): v for k, v in d.items()}
    for key, table in (("ColorSpace", SHORT_SPACES), ("Filter", SHORT_FILTERS)):
        if key in out:
            out[key] = word(out[key], table)
    return out


def with_gaps(glyphs: list[str], gaps: list[float], size: float) -> str:
    """Glyphs with spaces where the gap to the next is over a tenth of the size, letter spacing apart."""
    base = min(gaps) if gaps and max(gaps) - min(gaps) <= 0.04 * size and min(gaps) > 0.08 * size else 0.0
    out = [glyphs[0]] if glyphs else []
    for g, gap in zip(glyphs[1:], gaps):
        if gap - base > 0.10 * size and not out[-1][-1:].isspace() and not g[:1].isspace() and out[-1] and g:
            out.append(" ")
        out.append(g)
    return "".join(out)


class Interpreter:
    def __init__(self, doc: Document, page: dict):
        self.doc, self.page = doc, page
        self.marks: list[Mark] = []
        self.notes: list[str] = []
        self.unknown: list[str] = []
        self.names: list[str] = []  # XObjects, in the order in which they are drawn
        self.content: list[tuple[str, int | None]] = []
        self.fonts: dict[int, Font] = doc.fonts_by_object
        self.state, self.stack = State(), []
        self.path: list[tuple[float, float]] = []
        self.at = (0.0, 0.0)
        self.pending = False
        self.tm = self.line = UNIT
        resources = doc.field(page, "Resources")
        self.run(doc.content(page), resources if isinstance(resources, dict) else {}, 0, None)

    def run(self, content: bytes, resources: dict, depth: int, form: str | None) -> None:
        outer = getattr(self, "resources", None), getattr(self, "depth", 0), getattr(self, "form", None)
        self.resources, self.depth, self.form = resources, depth, form
        floor, marked = len(self.stack), len(self.content)
        for op, args, start, end in operations(content):
            self.span, self.op = (start, end), op
            handler = HANDLERS.get(op)
            if handler:
                need = ARITY.get(op, -1)
                if need > 0 and len(args) < need:
                    self.notes.append(f"{op} has too few operands")
                    continue
                try:
                    handler(self, args[-need:] if need > 0 else args)
                except (TypeError, ValueError, IndexError, AttributeError, OverflowError):
                    self.notes.append(f"{op} can't be read")
            elif op and op not in ARITY:
                self.unknown.append(op)
        del self.content[marked:]
        while len(self.stack) > floor:
            self.state = self.stack.pop()
        self.resources, self.depth, self.form = outer

    def mark(self, kind: str, box: tuple, **more) -> None:
        s = self.state
        mcid = next((m for _, m in reversed(self.content) if m is not None), None)
        artifact = any(t == "Artifact" for t, _ in self.content)
        self.marks.append(Mark(kind, crossing(box, s.clip), *self.span, self.form, mcid, artifact, s.colours["fill"], s.colours["stroke"], s.clip, **more))

    # state

    def push(self, _) -> None:
        if len(self.stack) < MAX_STATES:
            self.stack.append(self.state)
            self.state = self.state.copied()

    def pop(self, _) -> None:
        if self.stack:
            self.state = self.stack.pop()

    def concat(self, a) -> None:
        self.state.ctm = times(tuple(float(x) for x in a), self.state.ctm)

    def ext_state(self, a) -> None:
        d = self.doc.field(self.doc.field(self.resources, "ExtGState"), str(a[0]))
        s, get = self.state, lambda k: self.doc.field(d, k)
        for key, name in (("LW", "width"), ("LC", "cap"), ("LJ", "join"), ("ML", "miter")):
            if isinstance(v := get(key), (int, float)):
                setattr(s, name, v)
        for key, side in (("ca", "fill"), ("CA", "stroke")):
            if isinstance(v := get(key), (int, float)):
                s.alpha[side] = float(v)
        mode = get("BM")
        mode = mode[0] if isinstance(mode, list) and mode else mode
        s.blend = str(mode) if isinstance(mode, Name) else s.blend
        if isinstance(font := get("Font"), list) and len(font) == 2:
            s.font, s.size = self.font_of(font[0]), float(font[1])

    def space(self, side: str, a) -> None:
        self.state.spaces[side] = a[0]
        n = components(self.doc, a[0], self.resources)
        self.state.colours[side] = rgb(self.doc, a[0], [0.0] * (n - 1) + [1.0 if a[0] == "DeviceCMYK" else 0.0], self.resources)

    def colour(self, side: str, a, space=None) -> None:
        if space:
            self.state.spaces[side] = Name(space)
        self.state.colours[side] = rgb(self.doc, self.state.spaces[side], [float(x) for x in a if isinstance(x, (int, float))], self.resources)

    # paths

    def add(self, *points) -> None:
        self.path += [apply(self.state.ctm, x, y) for x, y in points]
        self.at = points[-1]

    def rectangle(self, a) -> None:
        x, y, w, h = a
        self.add((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))

    def paint(self, stroke: bool, shown: bool = True) -> None:
        if self.path:
            box = bounds(self.path)
            if shown:
                m = self.state.ctm
                grow = self.state.width / 2 * math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) if stroke else 0.0
                self.mark("path", (box[0] - grow, box[1] - grow, box[2] + grow, box[3] + grow))
            if self.pending and self.state.n_clips < MAX_CLIPS:
                self.state.clip, self.state.n_clips = crossing(self.state.clip, box), self.state.n_clips + 1
        self.path, self.pending = [], False

    def clip(self, _) -> None:
        self.pending = True

    def close(self, _) -> None:
        """Bounds don't change; painters override this."""

    # text

    @cached_property
    def fallback(self) -> Font:
        return Font(self.doc, {})

    def font_of(self, v) -> Font:
        key = v.num if isinstance(v, Ref) else -id(v)
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, self.doc.get(v) if isinstance(v, Ref) else v)
        return self.fonts[key]

    def set_font(self, a) -> None:
        table = self.doc.field(self.resources, "Font")
        v = table.get(a[0]) if isinstance(table, dict) else None
        self.state.font = self.font_of(v) if v is not None else self.fallback
        self.state.font_name, self.state.size = str(a[0]), float(a[1])

    def begin_text(self, _) -> None:
        self.tm = self.line = UNIT

    def move(self, a, lead: bool = False) -> None:
        if lead:
            self.state.tl = -a[1]
        self.tm = self.line = times((1, 0, 0, 1, float(a[0]), float(a[1])), self.line)

    def matrix(self, a) -> None:
        self.tm = self.line = tuple(float(x) for x in a)

    def show(self, parts: list) -> None:
        s, font = self.state, self.state.font or self.fallback
        size, th = s.size, s.tz / 100
        tm = self.tm
        m = times(tm, s.ctm)
        at = apply(m, 0, s.rise)
        pieces, x, loose = [], 0.0, s.tc > 0.08 * abs(size)
        glyphs: list[str] = []
        gaps: list[float] = []
        wide = loose or any(isinstance(p, (int, float)) and -p > 80 for p in parts)
        for p in parts:
            if isinstance(p, bytes):
                text, width = font.shown(p)
                n = len(p) // 2 if font.wide else len(p)
                x += (width / 1000 * size + n * s.tc + (0 if font.wide or not s.tw else s.tw * p.count(b" "))) * th
                if wide:
                    new = [font.text(c) for c in font.codes(p)]
                    gaps += [s.tc] * (len(new) - (not glyphs)) if len(gaps) == max(0, len(glyphs) - 1) else [s.tc] * (len(new) - 1)
                    glyphs += new
                else:
                    pieces.append(text)
            elif isinstance(p, (int, float)) and not isinstance(p, bool):
                x -= p / 1000 * size * th
                if wide and glyphs:
                    if len(gaps) == len(glyphs) - 1:
                        gaps.append(s.tc)
                    gaps[-1] -= p / 1000 * size
        self.tm = times((1, 0, 0, 1, x, 0), tm)
        end = apply(m, x, s.rise)
        text = with_gaps(glyphs, gaps[: max(0, len(glyphs) - 1)], abs(size)) if wide else "".join(pieces)
        scale = max(1.0, math.sqrt(abs(m[0] * m[3] - m[1] * m[2])))
        box = box_under(m, 0, s.rise - BELOW * size, x, s.rise + ABOVE * size)
        if s.render != 7:
            self.mark("text", box, text=text, line=(*at, *end), size=max(1.0, size * scale), name=font.name)

    def next_line(self, _=None) -> None:
        self.move((0.0, -self.state.tl))

    def quoted(self, a) -> None:
        self.state.tw, self.state.tc = float(a[0]), float(a[1])
        self.next_line()
        self.show([a[2]])

    # objects

    def draw(self, a) -> None:
        name = str(a[0])
        self.names.append(name)
        x = self.doc.field(self.doc.field(self.resources, "XObject"), name)
        if x is None and self.depth:  # a form without the name looks on its page
            x = self.doc.field(self.doc.field(self.doc.field(self.page, "Resources"), "XObject"), name)
        if not isinstance(x, Stream):
            self.notes.append(f"no XObject {name}")
        elif x.dict.get("Subtype") == "Image":
            self.mark("image", box_under(self.state.ctm, 0, 0, 1, 1), name=name)
        elif x.dict.get("Subtype") == "Form":
            if self.depth >= MAX_FORMS:
                self.notes.append("forms are nested too deep")
                return
            self.push(None)
            outer = self.tm, self.line, self.path, self.span
            m, box = self.doc.field(x.dict, "Matrix"), self.doc.rect(self.doc.field(x.dict, "BBox"))
            if isinstance(m, list) and len(m) == 6:
                self.concat(m)
            if box:
                self.state.clip = crossing(self.state.clip, box_under(self.state.ctm, *box))
                self.mark("form", box_under(self.state.ctm, *box), name=name)
            self.path = []
            own = self.doc.field(x.dict, "Resources")
            self.run(self.doc.decoded(x)[0], own if isinstance(own, dict) else self.resources, self.depth + 1, self.form or name)
            self.tm, self.line, self.path, self.span = outer
            self.pop(None)

    def marked(self, a, props: bool) -> None:
        mcid = None
        if props:
            d = a[1]
            if isinstance(d, Name):
                d = self.doc.field(self.doc.field(self.resources, "Properties"), str(d))
            mcid = self.doc.field(d, "MCID")
        self.content.append((str(a[0]), mcid if isinstance(mcid, int) else None))

    def unmarked(self, _) -> None:
        if self.content:
            self.content.pop()


def _set(name: str, kind: Callable = float) -> Callable:
    return lambda self, a: setattr(self.state, name, kind(a[0]))


def _curve(first: bool, last: bool) -> Callable:
    def run(self: Interpreter, a: list) -> None:
        points = list(zip(a[::2], a[1::2]))
        self.add(*([self.at] if first else []), *points, *([points[-1]] if last else []))

    return run


def _painter(stroke: bool) -> Callable:
    return lambda self, a: self.paint(stroke)


HANDLERS: dict[str, Callable] = {
    "q": Interpreter.push, "Q": Interpreter.pop, "cm": Interpreter.concat, "gs": Interpreter.ext_state, "w": _set("width"), "J": _set("cap", int), "j": _set("join", int),
    "M": _set("miter"), "ri": _set("intent", str), "d": lambda self, a: setattr(self.state, "dash", (a[0], float(a[1]))),
    "CS": lambda self, a: self.space("stroke", a), "cs": lambda self, a: self.space("fill", a),
    **{op: lambda self, a: self.colour("stroke", a) for op in ("SC", "SCN")}, **{op: lambda self, a: self.colour("fill", a) for op in ("sc", "scn")},
    "G": lambda self, a: self.colour("stroke", a, "DeviceGray"), "g": lambda self, a: self.colour("fill", a, "DeviceGray"),
    "RG": lambda self, a: self.colour("stroke", a, "DeviceRGB"), "rg": lambda self, a: self.colour("fill", a, "DeviceRGB"),
    "K": lambda self, a: self.colour("stroke", a, "DeviceCMYK"), "k": lambda self, a: self.colour("fill", a, "DeviceCMYK"),
    "m": lambda self, a: self.add(tuple(a)), "l": lambda self, a: self.add(tuple(a)), "c": _curve(False, False), "v": _curve(True, False), "y": _curve(False, True),
    "h": lambda self, a: self.close(a), "re": lambda self, a: self.rectangle(a), **{op: _painter(True) for op in ("S", "s", "B", "B*", "b", "b*")}, **{op: _painter(False) for op in ("f", "F", "f*")},
    "n": lambda self, a: self.paint(False, False), "W": Interpreter.clip, "W*": Interpreter.clip,
    "BT": Interpreter.begin_text, "Tc": _set("tc"), "Tw": _set("tw"), "Tz": _set("tz"), "TL": _set("tl"), "Ts": _set("rise"), "Tr": _set("render", int),
    "Tf": Interpreter.set_font, "Td": Interpreter.move, "TD": lambda self, a: self.move(a, True), "Tm": Interpreter.matrix, "T*": Interpreter.next_line,
    "Tj": lambda self, a: self.show(a), "TJ": lambda self, a: self.show(a[0] if isinstance(a[0], list) else a), '"': Interpreter.quoted,
    "'": lambda self, a: (self.next_line(), self.show(a)), "Do": Interpreter.draw,
    "BI": lambda self, a: self.mark("inline", box_under(self.state.ctm, 0, 0, 1, 1)), "sh": lambda self, a: self.mark("shading", self.state.clip, name=str(a[0])),
    "BMC": lambda self, a: self.marked(a, False), "BDC": lambda self, a: self.marked(a, True), "EMC": Interpreter.unmarked,
}


def text_marks(doc: Document, page: dict) -> list[Mark]:
    """The text of a page in drawing order; artifacts only where there is nothing else."""
    marks = [m for m in Interpreter(doc, page).marks if m.kind == "text"]
    own = [m for m in marks if not m.artifact]
    return own or marks
