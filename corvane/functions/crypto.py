"""Encryption: PBKDF2 keys on the driver, AES-GCM per row in the JVM, and the backup container."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 310_000
# Fixed value: the first bytes of the container.
MAGIC = b"DSSBACK1"


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS, 32)


def encrypt(c: Column, key: bytes) -> Column:
    """Base64 of nonce, ciphertext and tag."""
    return F.base64(F.aes_encrypt(c, F.unhex(F.lit(key.hex())), F.lit("GCM")))


def decrypt(c: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string")


def _gcm(spark, key: bytes, iv: bytes, data: bytes, aad: bytes, seal: bool) -> bytes:
    """AES-256-GCM through the JVM's own provider, so no Python package is needed."""
    jvm = spark._jvm
    cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(1 if seal else 2, jvm.javax.crypto.spec.SecretKeySpec(key, "AES"), jvm.javax.crypto.spec.GCMParameterSpec(128, iv))
    cipher.updateAAD(aad)
    return bytes(cipher.doFinal(data))


def write_backup(spark, payload: dict, passphrase: str) -> bytes:
    """Magic, u32 header length, JSON header, then the encrypted gzip of the payload; the header is authenticated."""
    if len(passphrase) < 12:
        raise ValueError("use a passphrase of at least 12 characters")
    salt, iv = os.urandom(16), os.urandom(12)
    head = json.dumps({"version": 1, "iterations": ITERATIONS, "createdAt": payload.get("createdAt"), "salt": base64.b64encode(salt).decode(), "iv": base64.b64encode(iv).decode()}).encode()
    body = gzip.compress(json.dumps(payload, ensure_ascii=False).encode())
    return MAGIC + struct.pack(">I", len(head)) + head + _gcm(spark, derive_key(passphrase, salt), iv, body, head, True)


def read_backup(spark, blob: bytes, passphrase: str, max_payload: int = 128 * 1024 * 1024) -> dict:
    """Payload of a container; raises ValueError for a foreign, damaged, oversized or differently dated one."""
    if blob[:8] != MAGIC:
        raise ValueError("not a backup")
    n = struct.unpack(">I", blob[8:12])[0]
    head = blob[12 : 12 + n]
    h = json.loads(head)
    try:
        body = _gcm(spark, derive_key(passphrase, base64.b64decode(h["salt"])), base64.b64decode(h["iv"]), blob[12 + n :], head, False)
    except Exception as e:
        raise ValueError("wrong passphrase or damaged backup") from e
    import io

    raw = gzip.GzipFile(fileobj=io.BytesIO(body)).read(max_payload + 1)
    if len(raw) > max_payload:
        raise ValueError("backup too large")
    out = json.loads(raw)
    if out.get("createdAt") != h["createdAt"]:
        raise ValueError("header and payload differ")
    return out
