"""Images: samples to pixels, CCITT, PNG, files of images, and comparing two pictures."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from .cos import Name, Ref, Stream
from .document import Document, write_file
from .interp import components, rgb

MAX_PIXELS, MAX_SIDE = 64 << 20, 16_384
TOLERANCE = 24


def samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """(height, width, n) raw samples; rows begin on whole bytes, what is missing is 0."""
    row = -(-width * n * bits // 8)
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        return raw[:, : width * n].reshape(height, width, n).astype(np.int64)
    if bits == 16:
        return raw[:, : 2 * width * n].reshape(height, width, n, 2).astype(np.int64) @ np.array([256, 1])
    flat = np.unpackbits(raw, axis=1).reshape(height, -1)[:, : width * n * bits].reshape(height, width, n, bits)
    return flat.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1))


def decoded_image(doc: Document, image: Stream, resources: dict) -> np.ndarray | None:
    """RGBA pixels of an image, with /Decode, stencil and soft mask; None for what can't be read."""
    get = lambda k: doc.field(image.dict, k)
    w, h, stencil = get("Width"), get("Height"), get("ImageMask") is True
    if not isinstance(w, int) or not isinstance(h, int) or w <= 0 or h <= 0 or w * h > MAX_PIXELS:
        return None
    body, encoded, _ = doc.decoded(image)
    bits = 1 if stencil else get("BitsPerComponent")
    if encoded:
        names = get("Filter")
        names = names if isinstance(names, list) else [names]
        parms = get("DecodeParms")
        parms = parms[-1] if isinstance(parms, list) and parms else parms
        if names[-1] not in ("CCITTFaxDecode", "CCF"):
            return None
        body, bits = np.packbits(ccitt(body, parms if isinstance(parms, dict) else {}, h, w), axis=1).tobytes(), 1
    space = Name("DeviceGray") if stencil else get("ColorSpace")
    n = components(doc, space, resources)
    bits = bits if bits in (1, 2, 4, 8, 16) else 8
    raw = samples(body, w, h, n, bits)
    top = (1 << bits) - 1
    decode = get("Decode")
    out = np.zeros((h, w, 4), np.uint8)
    if stencil:
        shown = raw[:, :, 0] == (1 if isinstance(decode, list) and decode[:1] == [1] else 0)
        out[:, :, 3] = np.where(shown, 255, 0)
        return out
    kind = doc.get(space[0]) if isinstance(space, list) and space and isinstance(space[0], Ref) else space[0] if isinstance(space, list) and space else space
    indexed = kind in ("Indexed", "I")
    lo_hi = [(float(a), float(b)) for a, b in zip(decode[::2], decode[1::2])] if isinstance(decode, list) and len(decode) >= 2 * n else [(0.0, float(top))] if indexed else [(0.0, 100.0), (-100.0, 100.0), (-100.0, 100.0)] if kind == "Lab" else [(0.0, 1.0)] * n
    v = np.stack([lo + raw[:, :, k] * (hi - lo) / top for k, (lo, hi) in enumerate(lo_hi)], axis=2)
    if kind in ("DeviceGray", "CalGray"):
        colours = np.repeat(v, 3, axis=2)
    elif kind in ("DeviceRGB", "CalRGB"):
        colours = v
    elif kind == "DeviceCMYK":
        colours = (1 - v[:, :, :3]) * (1 - v[:, :, 3:4])
    else:  # by distinct values, which are few next to the pixels
        flat = v.reshape(-1, n)
        distinct, back = np.unique(flat, axis=0, return_inverse=True)
        colours = np.array([rgb(doc, space, list(x), resources) or (0.0, 0.0, 0.0) for x in distinct])[back.ravel()].reshape(h, w, 3)
    out[:, :, :3] = np.floor(np.clip(colours, 0, 1) * 255 + 0.5)
    out[:, :, 3] = 255
    mask = get("SMask")
    if isinstance(mask, Stream) and (alpha := decoded_image(doc, mask, resources)) is not None:
        rows, cols = np.arange(h) * alpha.shape[0] // h, np.arange(w) * alpha.shape[1] // w
        out[:, :, 3] = alpha[rows][:, cols, 0]
    return out


def page_images(doc: Document, page: dict):
    """(name, pixels) of the images among a page's XObjects."""
    resources = doc.field(page, "Resources")
    table = doc.field(resources, "XObject")
    for name, v in sorted(table.items()) if isinstance(table, dict) else []:
        v = doc.get(v) if isinstance(v, Ref) else v
        if isinstance(v, Stream) and v.dict.get("Subtype") == "Image":
            yield name, decoded_image(doc, v, resources)


# CCITT: the run codes by rule from their lengths is not possible, so they are listed
# fixed values: terminating codes of white and black runs 0 to 63, and make-up codes of 64 to 1728, as bit strings
WHITE_RUNS = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
BLACK_RUNS = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
WHITE_MAKE_UP = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK_MAKE_UP = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
LONG_MAKE_UP = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# fixed values: the modes of two-dimensional rows; V with its offset
MODES = {"0001": "P", "001": "H", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def _runs(terminating: str, make_up: str) -> dict[str, int]:
    table = {code: n for n, code in enumerate(terminating.split())}
    table |= {code: 64 * (n + 1) for n, code in enumerate(make_up.split())}
    return table | {code: 1792 + 64 * n for n, code in enumerate(LONG_MAKE_UP.split())}


RUNS = (_runs(WHITE_RUNS, WHITE_MAKE_UP), _runs(BLACK_RUNS, BLACK_MAKE_UP))


class _Bits:
    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def code(self, table: dict, most: int = 13):
        for n in range(1, most + 1):
            word = self.bits[self.at : self.at + n]
            if len(word) < n:
                return None
            if word in table:
                self.at += n
                return table[word]
        return None

    def run(self, colour: int) -> int | None:
        total = 0
        while (n := self.code(RUNS[colour])) is not None:
            total += n
            if n < 64:
                return total
        return None

    def skip_eol(self) -> bool:
        end = self.bits.find("1", self.at)
        if end >= 0 and end - self.at >= 11:
            self.at = end + 1
            return True
        return False


def ccitt(data: bytes, parms: dict, rows: int = 0, columns: int = 0) -> np.ndarray:
    """Rows of samples (1 is black if BlackIs1, else 0 is): Group 3 in one and two dimensions, and Group 4.
    A damaged row ends the image where there is no line end to go on from."""
    k, columns = int(parms.get("K", 0)), int(parms.get("Columns", columns or 1728))
    rows = int(parms.get("Rows", 0)) or rows
    b, out, before = _Bits(data), [], [columns]
    while b.at < len(b.bits) and (not rows or len(out) < rows):
        if parms.get("EncodedByteAlign") is True:
            b.at += -b.at % 8
        start = b.at
        ended = b.skip_eol() if k >= 0 else False
        if k < 0 and b.bits.startswith("000000000001", b.at):
            break
        two = k < 0
        if k > 0:
            two = b.bits[b.at : b.at + 1] == "0"
            b.at += 1
        edges = _row_2d(b, before, columns) if two else _row_1d(b, columns)
        if edges is None:
            if k >= 0 and not ended and (at := b.bits.find("00000000000", max(start, b.at))) >= 0 and at > start:
                b.at = at
                continue
            break
        row = np.zeros(columns, np.uint8)
        for s, e in zip(edges[::2], [*edges[1::2], columns]):
            row[s:e] = 1
        out.append(row)
        before = [*edges, columns]
    got = np.array(out, np.uint8).reshape(-1, columns)
    if rows > len(got):
        got = np.vstack([got, np.zeros((rows - len(got), columns), np.uint8)])
    return got if parms.get("BlackIs1") is True else 1 - got


def _row_1d(b: _Bits, columns: int) -> list[int] | None:
    """The places where the colour changes; the first is where black begins."""
    at, colour, edges = 0, 0, []
    while at < columns:
        n = b.run(colour)
        if n is None:
            return None
        at += n
        edges.append(min(at, columns))
        colour ^= 1
    return [e for e in edges if e < columns] if edges and edges[-1] >= columns else edges


def _row_2d(b: _Bits, before: list[int], columns: int) -> list[int] | None:
    a0, colour, edges = -1, 0, []
    while a0 < columns:
        mode = b.code(MODES, 7)
        if mode is None:
            return None
        # b1: the first change on the row above right of a0 and of the other colour
        above = [x for i, x in enumerate(before) if x > a0 and (i % 2 == colour or x >= columns)]
        b1 = above[0] if above else columns
        later = [x for x in before if x > b1]
        b2 = later[0] if later else columns
        if mode == "P":
            a0 = b2
        elif mode == "H":
            one, two = b.run(colour), b.run(colour ^ 1)
            if one is None or two is None:
                return None
            a0 = max(a0, 0)
            edges += [min(a0 + one, columns), min(a0 + one + two, columns)]
            a0 += one + two
        else:
            a0 = b1 + mode
            if a0 < (edges[-1] if edges else 0):
                return None
            edges.append(min(a0, columns))
            colour ^= 1
    while edges and edges[-1] >= columns:
        edges.pop()
    return edges


def png(pixels: np.ndarray) -> bytes:
    """RGBA or RGB pixels as a PNG file."""
    h, w, n = pixels.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * n)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit RGB or RGBA PNG files as png() writes them (filter 0 to 4)."""
    from .filters import predict

    at, body, w, h, n = 8, b"", 0, 0, 4
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", data[at + 8 : at + 18])
            n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(predict(zlib.decompress(body), {"Predictor": 15, "Colors": n, "Columns": w})[0], np.uint8).reshape(h, w, n)


def pdf_of_images(pictures: list[np.ndarray]) -> bytes:
    """A page for each picture, in its own size; transparency goes to a soft mask."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {}}
    kids = []

    def add(v) -> Ref:
        objects[len(objects) + 1] = v
        return Ref(len(objects), 0)

    for p in pictures:
        h, w, n = p.shape
        base = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
        d = base | {"ColorSpace": Name("DeviceRGB")}
        if n == 4 and (p[:, :, 3] < 255).any():
            d["SMask"] = add(Stream(base | {"ColorSpace": Name("DeviceGray")}, zlib.compress(np.ascontiguousarray(p[:, :, 3], np.uint8).tobytes())))
        image = add(Stream(d, zlib.compress(np.ascontiguousarray(p[:, :, :3], np.uint8).tobytes())))
        content = add(Stream({}, b"q %d 0 0 %d 0 0 cm /Im0 Do Q" % (w, h)))
        kids.append(add({"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, w, h], "Contents": content, "Resources": {"XObject": {"Im0": image}}}))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return write_file(objects, 1)


# comparing


def gaussian(taps: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(taps) - taps // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _blur(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Both ways, without the border."""
    n = len(k)
    a = sum(k[i] * a[i : a.shape[0] - n + 1 + i] for i in range(n))
    return sum(k[i] * a[:, i : a.shape[1] - n + 1 + i] for i in range(n))


def compared(a: np.ndarray, b: np.ndarray, tolerance: int = TOLERANCE) -> dict[str, float] | None:
    """Mean and root mean square of differences, the worst, the share of pixels over the tolerance, PSNR and
    SSIM (mean of three channels); None for pictures of unlike or impossible size."""
    if a.shape != b.shape or not a.size or a.shape[0] * a.shape[1] > MAX_PIXELS:
        return None
    x, y = a[:, :, :3].astype(float), b[:, :, :3].astype(float)
    d = np.abs(x - y)
    mse = float((d**2).mean())
    k, scores = gaussian(), []
    if min(a.shape[:2]) >= len(k):
        for c in range(3):
            p, q = x[:, :, c], y[:, :, c]
            mp, mq = _blur(p, k), _blur(q, k)
            vp, vq, cov = _blur(p * p, k) - mp * mp, _blur(q * q, k) - mq * mq, _blur(p * q, k) - mp * mq
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            scores.append(float(((2 * mp * mq + c1) * (2 * cov + c2) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))).mean()))
    return {
        "mean": float(d.mean()), "rms": math.sqrt(mse), "worst": float(d.max()), "over": float((d.max(axis=2) > tolerance).mean()),
        "psnr": 10 * math.log10(255**2 / mse) if mse else math.inf, "ssim": sum(scores) / 3 if scores else 1.0 if not mse else 0.0,
    }


def heatmap(a: np.ndarray, b: np.ndarray, tolerance: int = TOLERANCE) -> np.ndarray:
    """Gray where alike, red where a pixel differs by more than the tolerance, by how much."""
    d = np.abs(a[:, :, :3].astype(int) - b[:, :, :3].astype(int)).max(axis=2)
    gray = (a[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722]) / 2 + 127).astype(np.uint8)
    out = np.stack([gray, gray, gray, np.full_like(gray, 255)], axis=2)
    out[d > tolerance] = np.stack([np.full_like(d, 255), 255 - d, 255 - d, np.full_like(d, 255)], axis=2)[d > tolerance]
    return out
