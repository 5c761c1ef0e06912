"""Secrets in raw records: patterns, and keys and signed tokens confirmed by their inner structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_texts

# The base patterns, and the least length of what counts of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of [0-9a-f]+ of 32 and more
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem_key", "der_key", "ssh_key", "signed_token")

# A body ends at the next five dashes, so a text of many openings is scanned once.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[A-Za-z0-9+/=\s,:.-])*)-----END \1-----")
_BLANK_LINE = re.compile(r"\r?\n\r?\n")
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{23,}={0,2}")
_SSH64 = re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_SSH_MAGIC = b"openssh-key-v1\x00"


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    plain = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER elements; None unless their lengths fill the data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """A private key in PKCS#1, SEC1, DSA, PKCS#8 or encrypted PKCS#8 form, with all lengths consistent."""
    top = der_items(data) if data and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    items = der_items(top[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    oid_first = lambda body: bool(x := der_items(body)) and x[0][0] == 0x06
    if tags[0] == 0x02:
        version = int.from_bytes(items[0][1], "big") if len(items[0][1]) == 1 else -1
        if version in (0, 1) and tags in ([2] * 9, [2] * 6):
            return len(items[1][1]) >= 16
        if version in (0, 1) and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            return oid_first(items[1][1]) and all(t in (0xA0, 0xA1, 0x80, 0x81) for t in tags[3:])
        return version == 1 and len(tags) >= 2 and tags[1] == 0x04 and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [0x30, 0x04] and oid_first(items[0][1]) and len(items[1][1]) >= 16


def is_ssh_key(data: bytes | None) -> bool:
    """The container of an OpenSSH private key: magic, then strings whose lengths fill it exactly."""
    if not data or not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    if any(string() is None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(string() is not None for _ in range(keys + 1)) and at == len(data)


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """A signed token's header is a JSON object that names its algorithm; its claims are a JSON object."""
    try:
        header, claims = (json.loads(decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(decode64(signature) or b"") >= 16


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of what is found, by start and kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            *head, body = _BLANK_LINE.split(m[2])
            data = decode64(body)
            if is_der_key(data) or is_ssh_key(data) or ("DEK-Info:" in "\n".join(head) and data and len(data) % 8 == 0):
                found.append(("pem_key", m.start(), m.end()))
    pem = [(s, e) for kind, s, e in found if kind == "pem_key"]
    bare = lambda m: not any(s <= m.start() < e for s, e in pem)
    found += [("der_key", m.start(), m.end()) for m in _DER64.finditer(text) if bare(m) and is_der_key(decode64(m[0]))]
    found += [("der_key", m.start(), m.end()) for m in _HEX_ANY.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    if "b3BlbnNzaC1rZXktdjEA" in text:
        found += [("ssh_key", m.start(), m.end()) for m in _SSH64.finditer(text) if bare(m) and is_ssh_key(decode64(m[0]))]
    if "eyJ" in text:
        found += [("signed_token", m.start(), m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every found stretch replaced by ``[kind]``; overlapping ones by the first one's."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_records(events: DataFrame, id_col: str = "event_id", text_col: str = "raw") -> DataFrame:
    """Secrets in the raw record of every event, and the record without them.

    Base kinds are pattern matches; the others are candidates that were decoded (base64, hex, PEM) and
    whose structure was parsed: key encodings with nested lengths that fill the data exactly, and signed
    tokens whose header names an algorithm. Returns ``event_id``, ``findings`` (array of kind, start,
    stop, in order) and ``redacted``; one row for each input row, repeated rows included. A null or
    empty record has no findings and is '' redacted. Whole records are scanned, whatever their length.
    Other columns are not read. There is no shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def one():
        def apply(texts: list[str]) -> list[pa.Array]:
            found = [find_secrets(t) for t in texts]
            rows = [[{"kind": k, "start": s, "stop": e} for k, s, e in f] for f in found]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            return [pa.array(rows, kind), pa.array(clean, pa.string())]

        return apply

    columns = ["findings array<struct<kind:string,start:long,stop:long>>", "redacted string"]
    return map_texts(events, id_col, text_col, one, columns).withColumnRenamed("id", id_col)


def listed(findings: Column) -> Column:
    """``kind:start:stop`` of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")


def base_only(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["kind"].isin(*BASE_KINDS))


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
