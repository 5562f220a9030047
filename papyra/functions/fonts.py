"""Fonts: glyph names, encodings with differences, character maps and widths."""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

from .cos import Name, Op, Reader, Ref, Stream

# fixed values: glyph names of ASCII's signs, in order of their codes
ASCII_NAMES = {
    32: "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash",
    48: "zero one two three four five six seven eight nine colon semicolon less equal greater question at",
    91: "bracketleft backslash bracketright asciicircum underscore grave",
    123: "braceleft bar braceright asciitilde",
}
# fixed values: glyph names that follow no rule
OTHER_NAMES = {
    "exclamdown": 0xA1, "cent": 0xA2, "sterling": 0xA3, "currency": 0xA4, "yen": 0xA5, "brokenbar": 0xA6, "section": 0xA7, "dieresis": 0xA8,
    "copyright": 0xA9, "ordfeminine": 0xAA, "guillemotleft": 0xAB, "logicalnot": 0xAC, "registered": 0xAE, "macron": 0xAF, "degree": 0xB0,
    "plusminus": 0xB1, "twosuperior": 0xB2, "threesuperior": 0xB3, "acute": 0xB4, "mu": 0xB5, "paragraph": 0xB6, "periodcentered": 0xB7,
    "cedilla": 0xB8, "onesuperior": 0xB9, "ordmasculine": 0xBA, "guillemotright": 0xBB, "onequarter": 0xBC, "onehalf": 0xBD,
    "threequarters": 0xBE, "questiondown": 0xBF, "AE": 0xC6, "Eth": 0xD0, "multiply": 0xD7, "Thorn": 0xDE, "germandbls": 0xDF, "ae": 0xE6,
    "eth": 0xF0, "divide": 0xF7, "thorn": 0xFE, "dotlessi": 0x131, "OE": 0x152, "oe": 0x153, "florin": 0x192, "circumflex": 0x2C6,
    "caron": 0x2C7, "breve": 0x2D8, "dotaccent": 0x2D9, "ring": 0x2DA, "ogonek": 0x2DB, "tilde": 0x2DC, "hungarumlaut": 0x2DD,
    "endash": 0x2013, "emdash": 0x2014, "quoteleft": 0x2018, "quoteright": 0x2019, "quotesinglbase": 0x201A, "quotedblleft": 0x201C,
    "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020, "daggerdbl": 0x2021, "bullet": 0x2022, "ellipsis": 0x2026,
    "perthousand": 0x2030, "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "fraction": 0x2044, "Euro": 0x20AC, "trademark": 0x2122,
    "minus": 0x2212, "ff": 0xFB00, "fi": 0xFB01, "fl": 0xFB02, "ffi": 0xFB03, "ffl": 0xFB04, "nbspace": 0xA0, "sfthyphen": 0xAD,
}
MARKS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "BREVE": "breve", "OGONEK": "ogonek", "MACRON": "macron", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut", "STROKE": "slash"}
# fixed values: the upper half of StandardEncoding and the special codes of PDFDocEncoding, from the code given
STANDARD = {
    0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl",
    0xB1: "endash dagger daggerdbl periodcentered", 0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand",
    0xBF: "questiondown", 0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis", 0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash",
    0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls",
}
PDF_DOC = {
    0x18: "breve caron circumflex dotaccent hungarumlaut ogonek ring tilde",
    0x80: "bullet dagger daggerdbl ellipsis emdash endash florin fraction guilsinglleft guilsinglright minus perthousand quotedblbase quotedblleft quotedblright quoteleft quoteright quotesinglbase trademark fi fl Lslash OE Scaron Ydieresis Zcaron dotlessi lslash oe scaron zcaron",
    0xA0: "Euro",
}
# fixed values: widths of Helvetica's and Times-Roman's glyphs for the codes 32 to 126; Courier has 600 for all
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
TIMES = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
FAMILIES = {"Arial": "Helvetica", "CourierNew": "Courier", "TimesNewRoman": "Times"}
STYLES = ("bold", "italic", "oblique", "roman", "regular")
MAX_MAP = 65_536


@lru_cache(1)
def glyph_codes() -> dict[str, int]:
    """Glyph name to code point: signs by table, letters by rule from their Unicode names."""
    out = {n: first + i for first, names in ASCII_NAMES.items() for i, n in enumerate(names.split())} | OTHER_NAMES
    out |= {chr(c): c for c in (*range(65, 91), *range(97, 123))}
    for c in range(0xC0, 0x250):
        m = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER (\w) WITH ([A-Z ]+)", unicodedata.name(chr(c), ""))
        if m and m[3] in MARKS:
            out.setdefault((m[2] if m[1] == "CAPITAL" else m[2].lower()) + MARKS[m[3]], c)
    for c in range(0x391, 0x3CA):
        if m := re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER (\w+)", unicodedata.name(chr(c), "")):
            plain = m[2].lower().replace("lamda", "lambda")
            out.setdefault(plain.capitalize() if m[1] == "CAPITAL" else plain, c)
    return out


def glyph_text(name: str) -> str | None:
    """The text of a glyph name: by the list, by uniXXXX or uXXXXX, without a suffix, or joined by underscores."""
    if (code := glyph_codes().get(name)) is not None:
        return chr(code)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = re.findall("....", m[1]) if m[1] else [m[2]]
        return "".join(chr(x) for c in codes if (x := int(c, 16)) < 0x110000)
    base = name.partition(".")[0]
    parts = base.split("_")
    if base and (base != name or len(parts) > 1):
        got = [glyph_text(p) for p in parts]
        return "".join(got) if all(got) else None
    return None


@lru_cache(8)
def base_encoding(name: str) -> tuple[str, ...]:
    """Text by code; empty where a code has none."""
    ascii_ = ["" if c < 32 or c > 126 else chr(c) for c in range(256)]
    if name == "WinAnsiEncoding":
        return tuple(bytes([c]).decode("cp1252", "ignore") or "•" if c > 31 else bytes([c]).decode() for c in range(256))
    if name == "MacRomanEncoding":
        return tuple(bytes([c]).decode("mac_roman") for c in range(256))
    special = PDF_DOC if name == "PDFDocEncoding" else STANDARD
    if name == "PDFDocEncoding":
        ascii_[9:14], ascii_[0xA1:] = "\t\n\x0b\x0c\r", [chr(c) for c in range(0xA1, 256)]
    else:
        ascii_[0x27], ascii_[0x60] = "’", "‘"
    for first, names in special.items():
        for i, n in enumerate(names.split()):
            ascii_[first + i] = glyph_text(n) or ""
    return tuple(ascii_)


@lru_cache(1024)
def split_name(name: str) -> tuple[str, list[str]] | None:
    """(family, style words) of a font's name, None for styles that are not known."""
    name = re.sub(r"^[A-Z]{6}\+", "", name)
    family, _, rest = re.sub(r"[-,]", "-", name, count=1).partition("-")
    family = re.sub(r"(PSMT|MT|PS)$", "", family)
    rest = re.sub(r"(PSMT|MT|PS)$", "", rest)
    words = re.findall("|".join(STYLES), rest.lower())
    return (FAMILIES.get(family, family), words) if "".join(words) == rest.lower().replace("-", "").replace(",", "") else None


def standard_width(font: str, text: str) -> int | None:
    """The width of a character in one of the standard faces, where it is known."""
    found = split_name(font)
    if not found or len(text) != 1:
        return None
    family = found[0]
    if family == "Courier":
        return 600
    table = {"Helvetica": HELVETICA, "Times": TIMES}.get(family)
    plain = unicodedata.normalize("NFD", text)[0] if text > "~" else text
    plain = {"’": "'", "‘": "`"}.get(plain, plain)
    return table[ord(plain) - 32] if table and not {"bold", "italic"} & set(found[1]) and " " <= plain <= "~" else None


@lru_cache(256)
def standard_widths(font: str, table: tuple[str, ...]) -> tuple[float, ...]:
    """By code; 500 where the face's width is not known."""
    return tuple(500.0 if (w := standard_width(font, s)) is None else float(w) for s in table)


@lru_cache(256)
def changed_encoding(base: str | None, changes: tuple[tuple[int, str], ...]) -> tuple[str, ...]:
    """The text by code of a base encoding (None: Latin-1 as it stands) with glyph names for some codes."""
    table = list(base_encoding(base)) if base else [chr(c) for c in range(256)]
    for code, name in changes:
        table[code] = "" if name in ("", ".notdef") else glyph_text(name) or ""
    return tuple(table)


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    stack: list = []
    r = Reader(cmap, refs=False)
    try:
        while len(out) < MAX_MAP:
            v = r.value()
            if not isinstance(v, Op):
                stack.append(v)
                continue
            if v == "endbfchar":
                out |= {int.from_bytes(a): text(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif v == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                    for i in range(int.from_bytes(a), min(int.from_bytes(b), int.from_bytes(a) + 65_535) + 1):
                        k = i - int.from_bytes(a)
                        if isinstance(c, list):
                            if k < len(c):
                                out[i] = text(c[k])
                        else:
                            out[i] = text(c[:-2] + (int.from_bytes(c[-2:]) + k & 0xFFFF).to_bytes(2))
            stack = []
    except (EOFError, TypeError):
        pass
    return out


class Font:
    """Codes to text and widths. A code without text counts as unmapped; it decodes to nothing."""

    def __init__(self, doc, d):
        d = d if isinstance(d, dict) else {}
        self.doc, self.dict = doc, d
        self.name = str(doc.field(d, "BaseFont") or "")
        self.kind = str(d.get("Subtype") or "")
        self.wide = self.kind == "Type0"
        cmap, enc = doc.field(d, "ToUnicode"), doc.field(d, "Encoding")
        self.map = to_unicode(doc.decoded(cmap)[0]) if isinstance(cmap, Stream) else {}
        self.table: tuple[str, ...] = ("",) * 256
        if not self.wide:
            self.table = self.encoding(doc, enc)
            if self.map:
                self.table = tuple(self.map.get(code, s) for code, s in enumerate(self.table))
        self.widths = self.simple_widths(doc, d) if not self.wide else []
        self.cid_widths, self.default = self.cid(doc, d) if self.wide else ({}, 500.0)

    @cached_property
    def back(self) -> dict[str, int | None]:
        """Text to its code."""
        out: dict[str, int | None] = {}
        for code, s in [*enumerate(self.table), *self.map.items()]:
            if s:
                out[s] = None if s in out and out[s] != code else code  # ambiguous ones are refused
        return out

    def encoding(self, doc, enc) -> tuple[str, ...]:
        changes = None
        if isinstance(enc, list):
            enc = {"Differences": enc}
        if isinstance(enc, dict):
            enc, changes = doc.field(enc, "BaseEncoding"), doc.field(enc, "Differences")
        known = isinstance(enc, str) and enc in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding")
        # a font that names no encoding: Latin-1 as it stands, but Standard below differences
        base = str(enc) if known else "StandardEncoding" if changes else None
        at, found = 0, []
        for x in changes if isinstance(changes, list) else []:
            x = doc.get(x) if isinstance(x, Ref) else x
            if isinstance(x, int):
                at = x
            elif isinstance(x, Name):
                if 0 <= at < 256:
                    found.append((at, str(x)))
                at += 1
        return changed_encoding(base, tuple(found))

    def simple_widths(self, doc, d: dict) -> list[float] | tuple[float, ...]:
        first, listed = doc.field(d, "FirstChar"), doc.field(d, "Widths")
        first = first if isinstance(first, int) else 0
        missing = doc.field(doc.field(d, "FontDescriptor"), "MissingWidth")
        missing = float(missing) if isinstance(missing, (int, float)) else None
        if listed is None and missing is None:
            return standard_widths(self.name, self.table)
        out = []
        for code in range(256):
            w = listed[code - first] if isinstance(listed, list) and 0 <= code - first < len(listed) else None
            w = doc.get(w) if isinstance(w, Ref) else w
            if not isinstance(w, (int, float)):
                w = missing
            out.append(500.0 if w is None else float(w))
        return out

    def cid(self, doc, d: dict) -> tuple[dict[int, float], float]:
        """/W's lists and ranges in the order of the file, the first that names a code; /DW, or 1000."""
        kids = doc.field(d, "DescendantFonts")
        kid = doc.get(kids[0]) if isinstance(kids, list) and kids else None
        default = doc.field(kid, "DW")
        w, out, i = doc.field(kid, "W"), {}, 0
        w = [doc.get(x) if isinstance(x, Ref) else x for x in w] if isinstance(w, list) else []
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                for k, x in enumerate(w[i + 1]):
                    if isinstance(x, (int, float)):
                        out.setdefault(w[i] + k, float(x))
                i += 2
            elif i + 2 < len(w):
                for code in range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65_535) + 1):
                    out.setdefault(code, float(w[i + 2]))
                i += 3
            else:
                break
        return out, float(default) if isinstance(default, (int, float)) else 1000.0

    def codes(self, s: bytes) -> list[int]:
        return [int.from_bytes(s[i : i + 2]) for i in range(0, len(s), 2)] if self.wide else list(s)

    def text(self, code: int) -> str:
        return self.map.get(code, "") if self.wide else self.table[code] if code < 256 else ""

    def width(self, code: int) -> float:
        return self.cid_widths.get(code, self.default) if self.wide else self.widths[code] if code < 256 else 500.0

    def shown(self, s: bytes) -> tuple[str, float]:
        """The text and the summed widths of a string."""
        if self.wide:
            codes = self.codes(s)
            return "".join(map(self.text, codes)), sum(map(self.width, codes))
        return "".join(map(self.table.__getitem__, s)), sum(map(self.widths.__getitem__, s))

    def encode(self, text: str) -> bytes | None:
        """The codes of a text; None where a character has none or several."""
        codes = [self.back.get(c) for c in text]
        if any(c is None for c in codes):
            return None
        return b"".join(c.to_bytes(2 if self.wide else 1) for c in codes)
