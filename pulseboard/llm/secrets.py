"""Secret scan with structural confirmation.

Three base patterns find assignments, access ids and hex strings. Beyond them, base64 and hex candidates
are decoded and reported only if their structure holds: DER private keys whose nested lengths fill their
parents exactly, OpenSSH key files whose length-prefixed fields fill the blob, PEM blocks around either,
and signed tokens whose header and payload are JSON objects and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, out_batch, pieces

# The base patterns with the least length of what they must hold.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: shorter ones hold no match
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "key", "token")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]+")
SSH_MAGIC = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06
DEPTH = 8  # of nested DER values and of text within base64


def unbase64(text: str) -> bytes | None:
    """Decoded bytes of base64 in either alphabet, padded or not; None if it isn't base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_values(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, nested lengths checked; else None."""
    out = []
    while start < end:
        if end - start < 2 or depth > DEPTH:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at:at + k], "big"), at + k
        if at + n > end:
            return None
        if tag & 0x20 and der_values(data, at, at + n, depth + 1) is None:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in DER: PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8."""
    top = der_values(data, 0, len(data)) if data[:1] == bytes([SEQUENCE]) else None
    if not top or len(top) != 1:
        return False
    parts = der_values(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in parts]
    if tags[:9] == [INTEGER] * 9 or (len(tags) == 6 and tags == [INTEGER] * 6):  # RSA; DSA
        return True
    if tags[:2] == [INTEGER, OCTETS]:  # elliptic curve
        return data[parts[0][1]:parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] >= 16
    named = None
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        named = parts[1]
    elif tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        named = parts[0]
    inner = der_values(data, named[1], named[2]) if named else None
    return bool(inner) and inner[0][0] == OBJECT_ID


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file: its length-prefixed fields fill it exactly."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and at == len(data)


def is_key(data: bytes | None, depth: int = 0) -> bool:
    """Decoded bytes that are a private key, or base64 text or PEM of one (as config stores nest them)."""
    if not data or depth > DEPTH:
        return False
    if is_der_key(data) or is_ssh_key(data):
        return True
    if len(data) >= 40 and data.isascii():
        text = data.decode("ascii").strip()
        if m := PEM.fullmatch(text):
            return is_key(pem_body(m[2]), depth + 1)
        if BASE64.fullmatch(text):
            return is_key(unbase64(text), depth + 1)
    return False


def pem_body(body: str) -> bytes | None:
    return unbase64(re.sub(r"\\[nr]|\s", "", body))


def is_token(text: str) -> bool:
    """A signed token: JSON header that names an algorithm other than none, JSON payload, a signature."""
    head, payload, sign = (unbase64(x) for x in text.split("."))
    try:
        head, payload = json.loads(head or b"0"), json.loads(payload or b"0")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(payload, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and bool(sign)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every secret in ``text``, by start, then kind, then end."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    blocks = []
    if "-----BEGIN" in text:
        blocks = [(m.start(), m.end()) for m in PEM.finditer(text) if is_key(pem_body(m[2]))]
        found += [(a, b, 3) for a, b in blocks]
    inside = lambda m: any(a <= m.start() and m.end() <= b for a, b in blocks)
    found += [(m.start(), m.end(), 4) for m in BASE64.finditer(text) if not inside(m) and is_key(unbase64(m[0]))]
    found += [(m.start(), m.end(), 4) for m in LONG_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    if "." in text:
        found += [(m.start(), m.end(), 5) for m in TOKEN.finditer(text) if is_token(m[0])]
    return sorted(set(found), key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans
    kind:start:end, by start, then kind), spans (all spans, likewise) and n_structural (spans confirmed by
    their structure). Places are code points, ends exclusive.

    Null or empty text: no spans. Overlapping spans of different kinds are all reported. Each row is
    scanned by itself, so repeated rows give repeated results and an empty table an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            spans = [scan(t or "") for t in column(b, "text")]
            base = [[s for s in x if s[2] < 3] for x in spans]
            count = [[sum(s[2] == k for s in x) for x in base] for k in range(3)]
            yield out_batch(
                doc_id=pa.array(column(b, "doc_id"), pa.int64()), n_assign=count[0], n_access=count[1], n_hex=count[2],
                base_sha256=[hashlib.sha256(joined(x).encode()).hexdigest() for x in base], spans=[joined(x) for x in spans],
                n_structural=[len(x) - len(y) for x, y in zip(spans, base, strict=True)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_structural bigint")
