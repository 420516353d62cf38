"""The standard security handler of PDF files: RC4, AES-128 and AES-256 (ISO 32000-2, 7.6).

Decryption runs over whole arrays of blocks; encryption, which only the digest of revision 6
needs, runs block after block.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache

import numpy as np

# Fixed value: what passwords are padded with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
BLOCKS = 1 << 16


class Locked(Exception):
    """The file cannot be opened; the text says why."""


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for at, byte in enumerate(data):
        i = (i + 1) & 255
        x = box[i]
        j = (j + x) & 255
        y = box[j]
        box[i], box[j] = y, x
        out[at] = byte ^ box[(x + y) & 255]
    return bytes(out)


@cache
def _field() -> tuple[list[int], list[int]]:
    """Powers of 3 in the field of AES, and their logarithms."""
    powers, logs, x = [], [0] * 256, 1
    for i in range(255):
        powers.append(x)
        logs[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    return powers, logs


def _product(a: int, b: int) -> int:
    powers, logs = _field()
    return powers[(logs[a] + logs[b]) % 255] if a and b else 0


@cache
def _boxes() -> tuple[list[int], list[int]]:
    powers, logs = _field()
    box = []
    for x in range(256):
        y = powers[-logs[x] % 255] if x else 0
        turned = (y << shift | y >> (8 - shift) for shift in range(1, 5))
        box.append((y ^ 0x63 ^ next(turned) ^ next(turned) ^ next(turned) ^ next(turned)) & 255)
    return box, [box.index(x) for x in range(256)]


def _round_keys(key: bytes) -> list[bytes]:
    """The words of the key schedule."""
    box, n, turn = _boxes()[0], len(key) // 4, 1
    words = [key[i : i + 4] for i in range(0, len(key), 4)]
    for i in range(n, 4 * (n + 7)):
        word = words[-1]
        if i % n == 0:
            word = bytes(box[b] for b in word[1:] + word[:1])
            word = bytes([word[0] ^ turn]) + word[1:]
            turn = _product(turn, 2)
        elif n > 6 and i % n == 4:
            word = bytes(box[b] for b in word)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], word)))
    return words


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks of ``data``; a broken last block and the padding are left to the caller."""
    data = data[: len(data) // 16 * 16]
    keys = np.frombuffer(b"".join(_round_keys(key)), np.uint8).reshape(-1, 16)
    back = np.array(_boxes()[1], np.uint8)
    by = {k: np.array([_product(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
    shifted = [4 * ((column - row) % 4) + row for column in range(4) for row in range(4)]
    out, before = [], np.frombuffer(iv, np.uint8)
    for at in range(0, len(data), 16 * BLOCKS):
        blocks = np.frombuffer(data[at : at + 16 * BLOCKS], np.uint8).reshape(-1, 16)
        state = blocks ^ keys[-1]
        for r in range(len(keys) - 2, -1, -1):
            state = back[state[:, shifted]] ^ keys[r]
            if r:
                c = state.reshape(-1, 4, 4)
                mixed = by[14][c] ^ np.roll(by[11][c], -1, 2) ^ np.roll(by[13][c], -2, 2) ^ np.roll(by[9][c], -3, 2)
                state = mixed.reshape(-1, 16)
        out.append((state ^ np.vstack([before[None], blocks[:-1]])).tobytes())
        before = blocks[-1]
    return b"".join(out)


@cache
def _forward() -> tuple[list[int], ...]:
    """Substitution and mixing of one column in one look-up, a table for each row."""
    box = _boxes()[0]
    first = [_product(s, 2) << 24 | s << 16 | s << 8 | _product(s, 3) for s in box]
    return tuple([(x >> 8 * row | x << (32 - 8 * row)) & 0xFFFFFFFF for x in first] for row in range(4))


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    (t, u, v, w), box = _forward(), _boxes()[0]
    keys = [int.from_bytes(x, "big") for x in _round_keys(key)]
    words = struct.unpack(f">{len(data) // 4}I", data)
    a, b, c, d = struct.unpack(">4I", iv)
    out = []
    for at in range(0, len(words), 4):
        a, b, c, d = (x ^ words[at + i] ^ keys[i] for i, x in enumerate((a, b, c, d)))
        for k in range(4, len(keys) - 4, 4):
            a, b, c, d = (
                t[a >> 24] ^ u[b >> 16 & 255] ^ v[c >> 8 & 255] ^ w[d & 255] ^ keys[k],
                t[b >> 24] ^ u[c >> 16 & 255] ^ v[d >> 8 & 255] ^ w[a & 255] ^ keys[k + 1],
                t[c >> 24] ^ u[d >> 16 & 255] ^ v[a >> 8 & 255] ^ w[b & 255] ^ keys[k + 2],
                t[d >> 24] ^ u[a >> 16 & 255] ^ v[b >> 8 & 255] ^ w[c & 255] ^ keys[k + 3],
            )
        rows = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
        a, b, c, d = (
            (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ keys[len(keys) - 4 + i]
            for i, (p, q, r, s) in enumerate(rows)
        )
        out.append(struct.pack(">4I", a, b, c, d))
    return b"".join(out)


def hardened(password: bytes, salt: bytes, owner: bytes = b"") -> bytes:
    """The digest of revision 6."""
    k, i, last = hashlib.sha256(password + salt + owner).digest(), 0, 0
    while i < 64 or last > i - 32:
        made = aes_cbc_encrypt(k[:16], k[16:32], (password + k + owner) * 64)
        way = ("sha256", "sha384", "sha512")[sum(made[:16]) % 3]
        k, i, last = hashlib.new(way, made).digest(), i + 1, made[-1]
    return k[:32]


class Handler:
    """Opens strings and streams of one file with a user's or owner's password."""

    def __init__(self, spec: dict, file_id: bytes, password: str = ""):
        if spec.get("Filter") != "Standard":
            raise Locked(f"unknown security handler {spec.get('Filter')}")
        self.version, self.revision = spec.get("V", 0), spec.get("R", 0)
        if self.version not in (1, 2, 4, 5):
            raise Locked(f"unknown encryption version {self.version}")
        self.spec, self.file_id = spec, file_id
        length = spec.get("Length", 40)
        length = length if isinstance(length, int) and 40 <= length <= 128 else 40
        self.bytes = 5 if self.revision == 2 else 16 if self.version == 4 else length // 8
        self.owner, self.user = spec.get("O", b""), spec.get("U", b"")
        numbers = isinstance(self.revision, int) and isinstance(spec.get("P", 0), int)
        if not isinstance(self.owner, bytes) or not isinstance(self.user, bytes) or not numbers:
            raise Locked("broken encryption dictionary")
        key = self._modern(password.encode()[:127]) if self.version == 5 else self._classic(password.encode("latin-1", "replace"))
        if key is None:
            raise Locked("a password is needed" if not password else "wrong password")
        self.key = key
        self.strings, self.streams = self.method(spec.get("StrF")), self.method(spec.get("StmF"))

    def method(self, name) -> str:
        """rc4, aes or nothing, of a named crypt filter."""
        if self.version < 4:
            return "rc4"
        if name in (None, "Identity"):
            return ""
        filters = self.spec.get("CF")
        known = filters.get(str(name)) if isinstance(filters, dict) else None
        way = known.get("CFM", "None") if isinstance(known, dict) else "None"
        return {"V2": "rc4", "AESV2": "aes", "AESV3": "aes"}.get(str(way), "")

    def _classic(self, password: bytes) -> bytes | None:
        for candidate in (password, self._of_owner(password)):
            key = self._file_key(candidate)
            if self.revision == 2:
                if rc4(key, PAD) == self.user[:32]:
                    return key
                continue
            mark = hashlib.md5(PAD + self.file_id).digest()
            for i in range(20):
                mark = rc4(bytes(b ^ i for b in key), mark)
            if mark == self.user[:16]:
                return key
        return None

    def _file_key(self, password: bytes) -> bytes:
        permitted = struct.pack("<I", self.spec.get("P", 0) & 0xFFFFFFFF)
        seed = (password + PAD)[:32] + self.owner[:32] + permitted + self.file_id
        if self.revision >= 4 and self.spec.get("EncryptMetadata") == "false":
            seed += b"\xff\xff\xff\xff"
        key = hashlib.md5(seed).digest()[: self.bytes]
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()[: self.bytes]
        return key

    def _of_owner(self, password: bytes) -> bytes:
        """The user's password, as the owner's opens it."""
        key = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()
        key, held = key[: self.bytes], self.owner[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            held = rc4(bytes(b ^ i for b in key), held)
        return held

    def _modern(self, password: bytes) -> bytes | None:
        def digest(salt: bytes, owner: bytes = b"") -> bytes:
            plain = hashlib.sha256(password + salt + owner).digest()
            return plain if self.revision == 5 else hardened(password, salt, owner)

        for held, sealed, more in ((self.user, "UE", b""), (self.owner, "OE", self.user[:48])):
            if digest(held[32:40], more) == held[:32]:
                body = self.spec.get(sealed, b"")
                if not isinstance(body, bytes) or len(body) < 32:
                    raise Locked("broken encryption dictionary")
                return aes_cbc_decrypt(digest(held[40:48], more), bytes(16), body[:32])
        return None

    def open(self, data: bytes, number: int, generation: int, way: str) -> bytes:
        """What is sealed in object (number, generation)."""
        if not way:
            return data
        key = self.key
        if self.version < 5:
            salt = struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if way == "aes" else b"")
            key = hashlib.md5(key + salt).digest()[: min(16, len(key) + 5)]
        if way == "rc4":
            return rc4(key, data)
        out = aes_cbc_decrypt(key, data[:16], data[16:]) if len(data) >= 32 else b""
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out
