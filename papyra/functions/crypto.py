"""RC4, AES-CBC and the standard security handler (revisions 2 to 6), from the published algorithms."""

from __future__ import annotations

import hashlib
import os
import unicodedata

import numpy as np

from .cos import Name, Ref, Stream

# fixed value: what fills up passwords
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def prepared(password: str) -> str:
    """A password for revisions 5 and 6: other spaces become spaces, what is invisible goes, then NFKC."""
    kept = "".join(" " if unicodedata.category(c) == "Zs" else c for c in password if c not in "\u00ad\u1806\u200b\u2060\ufeff" and not "\ufe00" <= c <= "\ufe0f")
    return unicodedata.normalize("NFKC", kept)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
    return out


def _substitution() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    inverse = {0: 0} | {a: b for a in range(1, 256) for b in range(1, 256) if _times(a, b) == 1}
    for a, b in inverse.items():
        turned = b
        for k in range(1, 5):
            turned ^= ((b << k) | (b >> (8 - k))) & 255
        out[a] = turned ^ 0x63
    return out


SUB = _substitution()
UNSUB = np.argsort(SUB).astype(np.uint8)
TIMES = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (1, 2, 3, 9, 11, 13, 14)}
#: Where each byte of a block comes from when rows are shifted; blocks are filled column by column.
SHIFT = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])
UNSHIFT = np.argsort(SHIFT)


def _mix(state: np.ndarray, row: tuple[int, ...]) -> np.ndarray:
    columns = state.reshape(-1, 4, 4)
    return np.stack([np.bitwise_xor.reduce([TIMES[row[(j - i) % 4]][columns[:, :, j]] for j in range(4)]) for i in range(4)], axis=2).reshape(-1, 16)


class Aes:
    """A key's schedule. decrypt takes blocks as rows of 16 bytes; a chain can only be encrypted block by
    block, which goes faster by words of four bytes."""

    def __init__(self, key: bytes):
        n, step = len(key) // 4, 1
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        while len(words) < 4 * (n + 7):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [int(SUB[x]) for x in w[1:] + w[:1]]
                w[0] ^= step
                step = _times(step, 2)
            elif n > 6 and len(words) % n == 4:
                w = [int(SUB[x]) for x in w]
            words.append([a ^ b for a, b in zip(w, words[-n])])
        self.keys = np.array(words, np.uint8).reshape(-1, 16)

    def decrypt(self, state: np.ndarray) -> np.ndarray:
        state = UNSUB[(state ^ self.keys[-1])[:, UNSHIFT]]
        for k in self.keys[-2:0:-1]:
            state = UNSUB[_mix(state ^ k, (14, 11, 13, 9))[:, UNSHIFT]]
        return state ^ self.keys[0]


def _rows(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, 16)


#: Substitution and mixing of one byte as a column's word, by the byte's row.
WORDS = [[int.from_bytes(bytes(int(TIMES[(2, 1, 1, 3)[(r - i) % 4]][x]) for r in range(4))) for x in SUB] for i in range(4)]
LAST = SUB.tolist()


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    keys = Aes(key).keys.reshape(-1, 4).copy().view(">u4").reshape(-1, 4).tolist()
    t0, t1, t2, t3 = WORDS
    first, middle, final = keys[0], keys[1:-1], keys[-1]
    text = np.frombuffer(data, ">u4").reshape(-1, 4).tolist()
    last, out = np.frombuffer(iv, ">u4").tolist(), []
    for block in text:
        a, b, c, d = (x ^ y ^ z for x, y, z in zip(block, last, first))
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        w = (a, b, c, d)
        last = [(LAST[w[i] >> 24] << 24 | LAST[w[(i + 1) % 4] >> 16 & 255] << 16 | LAST[w[(i + 2) % 4] >> 8 & 255] << 8 | LAST[w[(i + 3) % 4] & 255]) ^ final[i] for i in range(4)]
        out += last
    return np.array(out, ">u4").tobytes()


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, all at once; a part of a block at the end is left out."""
    data = data[: len(data) // 16 * 16]
    if not data:
        return b""
    return (Aes(key).decrypt(_rows(data)) ^ _rows((iv + data)[: len(data)])).tobytes()


def aes_open(key: bytes, data: bytes) -> bytes:
    """The start vector, then blocks with a padded end; padding that makes no sense stays."""
    out = cbc_decrypt(key, data[:16], data[16:]) if len(data) >= 32 else b""
    n = out[-1] if out else 0
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else out


def aes_seal(key: bytes, data: bytes) -> bytes:
    iv, n = os.urandom(16), 16 - len(data) % 16
    return iv + cbc_encrypt(key, iv, data + bytes([n]) * n)


def _strong_hash(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    turn, last = 0, 255
    while revision >= 6 and (turn < 64 or last > turn - 32):
        e = cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        turn, last = turn + 1, e[-1]
    return k[:32]


def _rounds(key: bytes, data: bytes, turns) -> bytes:
    for i in turns:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


class Handler:
    """The file's key, where the password is its user's or its owner's; else valid is False. Reads and
    writes the strings and stream bytes of single objects."""

    def __init__(self, d: dict, file_id: bytes, password: bytes = b""):
        number = lambda k, other: d[k] if isinstance(d.get(k), int) else other
        self.v, self.r = number("V", 0), number("R", 0)
        self.size = 5 if self.r < 3 else number("Length", 128 if self.v >= 4 else 40) // 8
        self.size = self.size if 5 <= self.size <= 16 else 16
        self.d, self.file_id = d, file_id
        self.o, self.u = (bytes(d.get(k) or b"") for k in "OU")
        filters = d.get("CF") if isinstance(d.get("CF"), dict) else {}
        method = lambda k: str((filters.get(d.get(k, "Identity")) or {}).get("CFM", "None")) if self.v >= 4 else "V2"
        self.of_stream, self.of_string = method("StmF"), method("StrF")
        self.key = self.open(password)
        self.valid = self.key is not None

    def open(self, password: bytes) -> bytes | None:
        if self.r >= 5:
            user, password = self.u[:48], password[:127]
            for value, extra, sealed in ((self.u, b"", "UE"), (self.o, user, "OE")):
                if _strong_hash(password, value[32:40], extra, self.r) == value[:32]:
                    return cbc_decrypt(_strong_hash(password, value[40:48], extra, self.r), bytes(16), bytes(self.d.get(sealed) or b""))
            return None
        for pad in ((password + PAD)[:32], self.of_owner(password)):
            key = self.file_key(pad)
            n = 16 if self.r >= 3 else 32
            if self.user_entry(key)[:n] == self.u[:n]:
                return key
        return None

    def owner_key(self, password: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k).digest()
        return k[: self.size]

    def of_owner(self, password: bytes) -> bytes:
        """The padded user password that an owner's password opens."""
        return _rounds(self.owner_key(password), self.o[:32], range(19, -1, -1) if self.r >= 3 else (0,))

    def file_key(self, padded: bytes) -> bytes:
        permissions = (self.d.get("P") if isinstance(self.d.get("P"), int) else 0) & 0xFFFFFFFF
        clear = b"\xff" * 4 if self.r >= 4 and self.d.get("EncryptMetadata") is False else b""
        k = hashlib.md5(padded + self.o[:32] + permissions.to_bytes(4, "little") + self.file_id + clear).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k[: self.size]).digest()
        return k[: self.size]

    def user_entry(self, key: bytes) -> bytes:
        if self.r < 3:
            return rc4(key, PAD)
        return _rounds(key, hashlib.md5(PAD + self.file_id).digest(), range(20)) + bytes(16)

    def of_object(self, num: int, gen: int, method: str) -> bytes:
        if method == "AESV3":
            return self.key
        salt = b"sAlT" if method == "AESV2" else b""
        return hashlib.md5(self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + salt).digest()[: min(len(self.key) + 5, 16)]

    def turned(self, v, num: int, gen: int, seal: bool = False):
        """An object with its strings and stream bytes decrypted, or encrypted."""

        def one(data: bytes, method: str) -> bytes:
            if method not in ("V2", "AESV2", "AESV3"):
                return data
            key = self.of_object(num, gen, method)
            return rc4(key, data) if method == "V2" else aes_seal(key, data) if seal else aes_open(key, data)

        def walk(x):
            if isinstance(x, bytes):
                return one(x, self.of_string)
            if isinstance(x, dict):
                return {k: walk(y) for k, y in x.items()}
            return [walk(y) for y in x] if isinstance(x, list) and not isinstance(x, Ref) else x

        if isinstance(v, Stream):
            return v if v.dict.get("Type") == "XRef" else Stream(walk(v.dict), one(v.raw, self.of_stream))
        return walk(v)


def sealed(objects: dict[int, object], aes: bool = False, user: bytes = b"", owner: bytes = b"", permissions: int = -4) -> tuple[dict[int, object], dict]:
    """Objects encrypted with 128 bits (RC4, or AES), and what the trailer needs."""
    file_id = hashlib.md5(repr(sorted(objects)).encode()).digest()
    d: dict = {"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 128, "P": permissions, "O": b"", "U": b""}
    if aes:
        d |= {"V": 4, "R": 4, "CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    h = Handler(d, file_id)
    h.o = d["O"] = _rounds(h.owner_key(owner or user), (user + PAD)[:32], range(20))
    h.key = h.file_key((user + PAD)[:32])
    d["U"] = h.user_entry(h.key)
    return {n: h.turned(v, n, 0, True) for n, v in objects.items()}, {"Encrypt": d, "ID": [file_id, file_id]}
