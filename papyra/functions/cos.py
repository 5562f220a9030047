"""The PDF object syntax: bytes to Python values and back.

Values: None, bool, int, float, bytes (strings), Name, list, dict (by key, in order), Ref, Stream, and
Op for a bare word. Malformed input never raises: what cannot be read is skipped.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

MAX_DEPTH = 300
WHITE = b"\0\t\n\f\r "
_BLANK = rb"[\0\t\n\f\r ]*+(?:%[^\r\n]*+[\0\t\n\f\r ]*+)*+"
_SKIP = re.compile(_BLANK)
_NUMBER = rb"([+-]*(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_REF = rb"(\d++)[\0\t\n\f\r ]++(\d++)[\0\t\n\f\r ]++R(?![^\0\t\n\f\r ()<>\[\]{}/%])"
#: One value's first token, and which group found it.
_TOKEN = re.compile(_BLANK + rb"(?:" + _REF + rb"|/([^\0\t\n\f\r ()<>\[\]{}/%]*+)|" + _NUMBER + rb"|([^\0\t\n\f\r ()<>\[\]{}/%]++)|(<<|>>|.))", re.S)
REF, NAME, NUMBER, WORD = 2, 3, 4, 5
_TOKEN_NO_REF = re.compile(_TOKEN.pattern.replace(_REF, rb"(?!)()()"), re.S)
_PLAIN = re.compile(rb"[^()\\]*")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_SPECIAL = re.compile(rb"[\\()\r]")
WORDS = {b"true": True, b"false": False, b"null": None}
ESCAPES = {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\f"}


class Name(str):
    __slots__ = ()


class Op(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    raw: bytes


@lru_cache(4096)
def short_name(raw: bytes) -> Name:
    return long_name(raw)


def long_name(raw: bytes) -> Name:
    raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw
    return Name(raw.decode("latin-1"))


def name(raw: bytes) -> Name:
    return short_name(raw) if len(raw) < 64 else long_name(raw)


def number_of(raw: bytes) -> int | float:
    if len(raw) < 19 and raw.isdigit():
        return int(raw)
    text = raw.decode()
    sign = -1 if text.startswith("-") else 1
    text = text.lstrip("+-")
    real = float(text)
    return sign * int(text) if text.isdigit() and real < 2**63 else sign * real if math.isfinite(real) else 0


class Reader:
    """Reads one value after another from data, from position at."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at = data, at
        self.token = (_TOKEN if refs else _TOKEN_NO_REF).match

    def blank(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def string(self) -> bytes:
        data, depth, out = self.data, 1, []
        self.at += 1
        while self.at < len(data):
            m = _PLAIN.match(data, self.at)
            out.append(m[0])
            self.at = m.end()
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            elif c == b"\\":
                n = data[self.at : self.at + 1]
                if octal := _OCTAL.match(data, self.at):
                    out.append(bytes([int(octal[0], 8) & 255]))
                    self.at = octal.end()
                    continue
                self.at += 1
                if n in (b"\r", b"\n"):
                    self.at += data[self.at - 1 : self.at + 1] == b"\r\n"
                elif n:
                    out.append(ESCAPES.get(n[0], n))
                continue
            out.append(c)
        return b"".join(out)

    def hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def value(self, depth: int = 0):
        """The next value; EOFError at the end; closing brackets come as Op."""
        while True:
            m = self.token(self.data, self.at)
            if m is None:
                self.blank()
                raise EOFError
            self.at, kind = m.end(), m.lastindex
            if kind == NAME:
                return name(m[NAME])
            if kind == NUMBER:
                return number_of(m[NUMBER])
            if kind == REF:
                return Ref(int(m[1]), int(m[2]))
            if kind == WORD:
                word = m[WORD]
                return WORDS[word] if word in WORDS else Op(word.decode("latin-1"))
            c = m[m.lastindex]
            if c == b"(":
                self.at -= 1
                return self.string()
            if c == b"<<":
                return self.dictionary(depth)
            if c == b"<":
                self.at -= 1
                return self.hex()
            if c == b"[":
                return self.array(depth)
            if c in (b")", b">"):
                continue
            return Op(c.decode())

    def array(self, depth: int) -> list:
        out: list = []
        try:
            while True:
                v = self.value(depth + 1)
                if type(v) is Op:
                    if v == "]":
                        break
                    if v == ">>":
                        continue
                if depth < MAX_DEPTH:
                    out.append(v)
        except EOFError:
            pass
        return out

    def dictionary(self, depth: int) -> dict:
        out: dict = {}
        try:
            while True:
                m = self.token(self.data, self.at)
                if m and m.lastindex == NAME:
                    self.at, k = m.end(), name(m[NAME])
                else:
                    k = self.value(depth + 1)
                if type(k) is not Name:
                    if type(k) is Op and k == ">>":
                        break
                    continue
                v = self.value(depth + 1)
                if type(v) is Op:
                    if v == ">>":
                        break
                    continue
                if depth < MAX_DEPTH:
                    out[str(k)] = v
        except EOFError:
            pass
        return out


def number(x: float) -> str:
    """At most six decimals, no exponent, no minus zero."""
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


@lru_cache(4096)
def written_name(v: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in v.encode("latin-1", "replace"))


def write(v) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, Name):
        return written_name(v)
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return number(v).encode()
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, (bytes, bytearray)):
        return b"(" + _SPECIAL.sub(lambda m: {b"\r": b"\\r"}.get(m[0], b"\\" + m[0]), bytes(v)) + b")"
    if isinstance(v, Stream):
        return write(v.dict | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    if isinstance(v, dict):
        return b"<<" + b"".join([b" " + written_name(k) + b" " + write(x) for k, x in v.items()]) + b" >>"
    return b"[" + b" ".join(map(write, v)) + b"]"
