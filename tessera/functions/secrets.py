"""Share codes and the keys made from them (driver side); payloads are sealed by Spark's AES-GCM."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

PRODUCT = "tessera"
CODE = re.compile(rf"^{PRODUCT}[a-z]+[0-9a-f]{{10}}$")
_WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron", "inlet", "junco", "kelp", "larch", "maple", "north", "otter", "pearl")


def share_code() -> str:
    return PRODUCT + "".join(secrets.choice(_WORDS) for _ in range(3)) + secrets.token_hex(5)


def is_share_code(code: Column) -> Column:
    return code.rlike(CODE.pattern)


def hkdf(secret: str, salt: str, info: str, size: int = 32) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    key, out, block = hmac.digest(salt.encode(), secret.encode(), hashlib.sha256), b"", b""
    while len(out) < size:
        block = hmac.digest(key, block + info.encode() + bytes([len(out) // 32 + 1]), hashlib.sha256)
        out += block
    return out[:size]


def topic(code: str) -> bytes:
    """For finding the peer; says nothing about the key."""
    return hkdf(code, f"{PRODUCT}-topic", "topic")


def key(code: str) -> bytes:
    return hkdf(code, f"{PRODUCT}-key", "encryption")


def sealed(payload: Column, code: str) -> Column:
    """iv (12 bytes), ciphertext, tag (16 bytes)."""
    return F.aes_encrypt(payload, F.lit(key(code)), F.lit("GCM"))


def opened(payload: Column, code: str) -> Column:
    return F.aes_decrypt(payload, F.lit(key(code)), F.lit("GCM"))
