"""Ciphers, signatures and keys that Spark lacks, after their RFCs, as small helpers of column functions.

AES-256-GCM is built in (F.aes_encrypt). These run in Python: meant for audit records by the thousand a second and task, not for bulk data.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ed25519 (RFC 8032): fixed values of the curve.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _recover_x(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _I % _P
    if (x * x - square) % _P or (not x and odd):
        return None
    return x if x & 1 == odd else _P - x


_BY = 4 * pow(5, -1, _P) % _P
_BASE = (_recover_x(_BY, 0), _BY, 1, _recover_x(_BY, 0) * _BY % _P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, p):
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, p)
        p = _add(p, p)
        k >>= 1
    return out


def _pack(p) -> bytes:
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _recover_x(y, odd) if y < _P else None
    return None if x is None else (x, y, 1, x * y % _P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def ed25519_public(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def ed25519_sign(seed: bytes, data: bytes) -> bytes:
    a, prefix = _secret(seed)
    public = _pack(_times(a, _BASE))
    r = _number(prefix, data)
    point = _pack(_times(r, _BASE))
    return point + ((r + _number(point, public, data) * a) % _L).to_bytes(32, "little")


def ed25519_verify(public: bytes, data: bytes, signature: bytes) -> bool:
    if len(signature) != 64:
        return False
    key, point, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or point is None or s >= _L:
        return False
    left, right = _times(s, _BASE), _add(point, _times(_number(signature[:32], public, data), key))
    return not (left[0] * right[2] - right[0] * left[2]) % _P and not (left[1] * right[2] - right[1] * left[2]) % _P


_PKCS8, _SPKI = bytes.fromhex("302e020100300506032b657004220420"), bytes.fromhex("302a300506032b6570032100")


def _pem(kind: str, der: bytes) -> str:
    return f"-----BEGIN {kind}-----\n{base64.b64encode(der).decode()}\n-----END {kind}-----\n"


def ed25519_pem(seed: bytes) -> tuple[str, str]:
    """Private and public key as PEM."""
    return _pem("PRIVATE KEY", _PKCS8 + seed), _pem("PUBLIC KEY", _SPKI + ed25519_public(seed))


def load_ed25519(pem: str) -> bytes:
    """The seed or the public key of a PEM text."""
    der = base64.b64decode("".join(x for x in pem.splitlines() if not x.startswith("-----")))
    for head in (_PKCS8, _SPKI):
        if der.startswith(head) and len(der) == len(head) + 32:
            return der[len(head) :]
    raise ValueError("no Ed25519 key")


# RSA-PSS with SHA-256 and a salt as long as the digest (RFC 8017). Keys are numbers: modulus, exponent.
def _mask(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha256(seed + struct.pack(">I", k)).digest() for k in range(-(-n // 32)))[:n]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def rsa_pss_sign(modulus: int, private: int, data: bytes, salt: bytes | None = None) -> bytes:
    bits = modulus.bit_length() - 1
    size = -(-bits // 8)
    salt = os.urandom(32) if salt is None else salt
    h = hashlib.sha256(bytes(8) + hashlib.sha256(data).digest() + salt).digest()
    block = bytes(size - len(salt) - 34) + b"\1" + salt
    masked = bytearray(_xor(block, _mask(h, len(block))))
    masked[0] &= 0xFF >> (8 * size - bits)
    return pow(int.from_bytes(bytes(masked) + h + b"\xbc", "big"), private, modulus).to_bytes(-(-modulus.bit_length() // 8), "big")


def rsa_pss_verify(modulus: int, public: int, data: bytes, signature: bytes, salt: int = 32) -> bool:
    bits = modulus.bit_length() - 1
    size = -(-bits // 8)
    value = pow(int.from_bytes(signature, "big"), public, modulus)
    if value.bit_length() > 8 * size:
        return False
    em = value.to_bytes(size, "big")
    masked, h = em[: size - 33], em[size - 33 : -1]
    if em[-1] != 0xBC or masked[0] & ~(0xFF >> (8 * size - bits)) & 0xFF:
        return False
    block = bytearray(_xor(masked, _mask(h, len(masked))))
    block[0] &= 0xFF >> (8 * size - bits)
    if any(block[: -salt - 1]) or block[-salt - 1] != 1:
        return False
    return hmac.compare_digest(h, hashlib.sha256(bytes(8) + hashlib.sha256(data).digest() + bytes(block[-salt:])).digest())


# ChaCha20-Poly1305 (RFC 8439): nonce, ciphertext, tag.
def _quarter(x: list[int], a: int, b: int, c: int, d: int) -> None:
    for i, j, k, r in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        x[i] = x[i] + x[j] & 0xFFFFFFFF
        v = x[k] ^ x[i]
        x[k] = (v << r | v >> 32 - r) & 0xFFFFFFFF


def _block(key: bytes, count: int, nonce: bytes) -> bytes:
    start = [*struct.unpack("<4I", b"expand 32-byte k"), *struct.unpack("<8I", key), count, *struct.unpack("<3I", nonce)]
    x = list(start)
    for _ in range(10):
        for at in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            _quarter(x, *at)
    return struct.pack("<16I", *(a + b & 0xFFFFFFFF for a, b in zip(x, start, strict=True)))


def _stream(key: bytes, nonce: bytes, data: bytes) -> bytes:
    return _xor(data, b"".join(_block(key, k + 1, nonce) for k in range(-(-len(data) // 64)))[: len(data)])


def _tag(key: bytes, nonce: bytes, sealed: bytes) -> bytes:
    one = _block(key, 0, nonce)
    r, s, total = int.from_bytes(one[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(one[16:32], "little"), 0
    text = sealed + bytes(-len(sealed) % 16) + struct.pack("<QQ", 0, len(sealed))
    for k in range(0, len(text), 16):
        total = (total + int.from_bytes(text[k : k + 16] + b"\1", "little")) * r % (2**130 - 5)
    return (total + s & (1 << 128) - 1).to_bytes(16, "little")


def chacha20_seal(key: bytes, data: bytes, nonce: bytes | None = None) -> bytes:
    nonce = os.urandom(12) if nonce is None else nonce
    sealed = _stream(key, nonce, data)
    return nonce + sealed + _tag(key, nonce, sealed)


def chacha20_open(key: bytes, sealed: bytes) -> bytes | None:
    """The data, or None if it isn't authentic."""
    nonce, body, tag = sealed[:12], sealed[12:-16], sealed[-16:]
    return _stream(key, nonce, body) if len(sealed) >= 28 and hmac.compare_digest(_tag(key, nonce, body), tag) else None


# keys
def new_key() -> bytes:
    return os.urandom(32)


def derive_key(password: str, salt: bytes) -> bytes:
    """A key from a password by scrypt (N 32768, r 8, p 1)."""
    if len(salt) < 16:
        raise ValueError("the salt must have 16 bytes or more")
    return hashlib.scrypt(password.encode(), salt=salt, n=32768, r=8, p=1, maxmem=64 << 20, dklen=32)


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


# columns
def by_row(of: Callable[..., object], kind: str, *columns: Column) -> Column:
    """of called on the columns' bytes row by row, in Arrow batches; null where a column is."""

    def each(*series: pd.Series) -> pd.Series:
        rows = zip(*series, strict=True)
        return pd.Series([None if any(x is None for x in row) else of(*(bytes(x) for x in row)) for row in rows], dtype=object)

    return F.pandas_udf(each, kind)(*columns)
