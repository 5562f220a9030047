"""PDF functions: sampled (0), exponential (2), stitching (3) and calculator (4)."""

from __future__ import annotations

import math
from itertools import product

from .cos import Op, Reader, Ref, Stream

MAX_STACK = 512
MAX_STEPS = 100_000


def clamp(v: float, lo: float, hi: float) -> float:
    return min(max(v, lo), hi)


def pairs(v) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in zip(v[::2], v[1::2])] if isinstance(v, list) else []


def linear(x: float, a: float, b: float, c: float, d: float) -> float:
    return c if a == b else c + (x - a) * (d - c) / (b - a)


def _atan(a: float, b: float) -> float:
    return math.degrees(math.atan2(a, b)) % 360


def _bitshift(a: int, n: int) -> int:
    v = (a << n if n >= 0 else (a & 0xFFFFFFFF) >> -n) & 0xFFFFFFFF
    return v - (1 << 32) if v >= 1 << 31 else v


def _power(a: float, b: float) -> float:
    try:
        v = math.pow(a, b)
    except (ValueError, OverflowError):
        return 0.0
    return v


def _logic(on_bool, on_int):
    return lambda a, b: on_bool(a, b) if isinstance(a, bool) and isinstance(b, bool) else on_int(int(a), int(b))


TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0,
    "idiv": lambda a, b: math.trunc(int(a) / int(b)) if int(b) else 0, "mod": lambda a, b: int(math.fmod(int(a), int(b))) if int(b) else 0,
    "exp": _power, "atan": _atan, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "bitshift": lambda a, b: _bitshift(int(a), int(b)),
    "and": _logic(lambda a, b: a and b, lambda a, b: a & b), "or": _logic(lambda a, b: a or b, lambda a, b: a | b),
    "xor": _logic(lambda a, b: a != b, lambda a, b: a ^ b),
}
ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc,
    "sqrt": lambda a: math.sqrt(a) if a > 0 else 0.0, "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": math.trunc, "cvr": float,
    "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}


def program(source: bytes) -> list:
    """The words of a calculator program; blocks as lists."""
    r, out = Reader(source, refs=False), []
    stack = [out]
    try:
        while True:
            v = r.value()
            if isinstance(v, Op) and v == "{":
                stack.append([])
            elif isinstance(v, Op) and v == "}":
                done = stack.pop()
                if not stack:
                    return done
                stack[-1].append(done)
            else:
                stack[-1].append(v)
    except EOFError:
        pass
    return out[0] if out and isinstance(out[0], list) else []


def calculate(words: list, inputs: list[float]) -> list:
    """The stack after a program; what can't be done ends it with the stack as it is."""
    stack, steps = list(inputs), 0
    todo = [iter(words)]
    while todo:
        w = next(todo[-1], None)
        if w is None:
            todo.pop()
            continue
        steps += 1
        if steps > MAX_STEPS or len(stack) > MAX_STACK:
            break
        try:
            if not isinstance(w, Op):
                stack.append(w)
            elif w in TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(TWO[w](a, b))
            elif w in ONE:
                stack.append(ONE[w](stack.pop()))
            elif w == "pop":
                stack.pop()
            elif w == "dup":
                stack.append(stack[-1])
            elif w == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif w == "copy":
                n = int(stack.pop())
                stack += stack[len(stack) - n :] if 0 < n <= len(stack) else []
            elif w == "index":
                stack.append(stack[-1 - abs(int(stack.pop()))])
            elif w == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if 0 < n <= len(stack):
                    top = stack[-n:]
                    stack[-n:] = top[-(j % n) :] + top[: -(j % n)] if j % n else top
            elif w == "if":
                block, test = stack.pop(), stack.pop()
                if test:
                    todo.append(iter(block))
            elif w == "ifelse":
                other, block, test = stack.pop(), stack.pop(), stack.pop()
                todo.append(iter(block if test else other))
            else:
                break
        except (IndexError, TypeError, ValueError, OverflowError):
            break
    return stack


class Function:
    """call(inputs) gives the outputs; an array of functions gives one output each."""

    def __init__(self, doc, obj):
        obj = doc.get(obj) if isinstance(obj, Ref) else obj
        self.parts = [Function(doc, x) for x in obj] if isinstance(obj, list) else None
        if self.parts is not None:
            return
        d = obj.dict if isinstance(obj, Stream) else obj if isinstance(obj, dict) else {}
        get = lambda k: doc.field(d, k)
        self.kind, self.domain, self.range = get("FunctionType"), pairs(get("Domain")), pairs(get("Range"))
        if self.kind == 0:
            self.size = [max(1, int(x)) for x in get("Size") or []]
            self.bits = int(get("BitsPerSample") or 8)
            self.encode = pairs(get("Encode")) or [(0.0, n - 1.0) for n in self.size]
            self.decode = pairs(get("Decode")) or self.range
            self.samples = doc.decoded(obj)[0] if isinstance(obj, Stream) else b""
        elif self.kind == 2:
            self.c0, self.c1, self.n = get("C0") or [0.0], get("C1") or [1.0], float(get("N") or 1)
        elif self.kind == 3:
            self.functions = [Function(doc, f) for f in get("Functions") or []]
            self.bounds, self.encode = [float(b) for b in get("Bounds") or []], pairs(get("Encode"))
        elif self.kind == 4:
            self.words = program(doc.decoded(obj)[0] if isinstance(obj, Stream) else b"")

    def sample(self, at: tuple[int, ...], k: int) -> int:
        i = 0
        for x, n in zip(reversed(at), reversed(self.size)):
            i = i * n + x
        bit = (i * len(self.range) + k) * self.bits
        raw = int.from_bytes(self.samples[bit // 8 : (bit + self.bits + 7) // 8].ljust((bit % 8 + self.bits + 7) // 8, b"\0"))
        return raw >> (-(bit + self.bits)) % 8 & (1 << self.bits) - 1

    def __call__(self, inputs: list[float]) -> list[float]:
        if self.parts is not None:
            return [f(inputs)[0] for f in self.parts]
        xs = [clamp(x, *d) for x, d in zip(inputs, self.domain)] if self.domain else list(inputs)
        out: list = []
        if self.kind == 0 and len(xs) >= len(self.size) and self.size:
            at = [clamp(linear(x, *d, *e), 0, n - 1) for x, d, e, n in zip(xs, self.domain, self.encode, self.size)]
            low = [min(int(a), max(0, n - 2)) for a, n in zip(at, self.size)]
            for k in range(len(self.range)):
                v = 0.0
                for corner in product((0, 1), repeat=len(at)):
                    weight = math.prod(a - lo if c else 1 - (a - lo) for a, lo, c in zip(at, low, corner))
                    if weight:
                        v += weight * self.sample(tuple(min(lo + c, n - 1) for lo, c, n in zip(low, corner, self.size)), k)
                out.append(linear(v, 0, (1 << self.bits) - 1, *self.decode[k]))
        elif self.kind == 2 and xs:
            out = [a + _power(xs[0], self.n) * (b - a) for a, b in zip(self.c0, self.c1)]
        elif self.kind == 3 and xs and self.functions:
            k = next((i for i, b in enumerate(self.bounds) if b > xs[0]), len(self.functions) - 1)
            k = min(k, len(self.functions) - 1)
            edges = [self.domain[0][0], *self.bounds, self.domain[0][1]]
            code = self.encode[k] if k < len(self.encode) else (0.0, 1.0)
            out = self.functions[k]([linear(xs[0], edges[k], edges[k + 1], *code)])
        elif self.kind == 4:
            n = len(self.range)
            out = [float(v) if isinstance(v, (int, float)) else 0.0 for v in calculate(self.words, xs)[-n:]] if n else []
            out = [0.0] * (n - len(out)) + out
        return [clamp(float(v), *r) for v, r in zip(out, self.range)] if self.range else [float(v) for v in out]
