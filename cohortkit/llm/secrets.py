"""Secrets in texts: patterns, and runs that decode to something with the structure of a key.

Three patterns report what looks like a secret (an assignment, an access key, a long hex
run).  Beside them every long base64 or hex run is decoded, and reported only if its
structure holds: a signed token whose header and payload are JSON objects, the header naming
an algorithm; a DER key whose nested lengths all fit and whose elements are those of a
private key; an OpenSSH key whose length-prefixed fields fit; a PEM block around either, or
one that its label or headers call encrypted.  A run wrapped over lines is joined first; a hex
run is tried from its first and its second digit.

A null is an empty text; texts without secrets give no spans and the digest of the empty
string.  Spans count code points, the end exclusive.  Rows are only mapped, so repeated
rows, ties, extra columns and empty tables need no rule.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
# Runs of 24 or more: shorter runs fail whole, so asking for 24 finds the same runs.
HEX = re.compile(r"[0-9a-f]{24,}")

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE_KINDS = KINDS[:3]

# Base64url of "{", with or without blanks before it, starts like this.  From every place, as
# words and dots before a token may look like its segments.
_JWT = re.compile(
    r"(?<![A-Za-z0-9_-])(?=((?:e[0-3w-z]|[ICD])[A-Za-z0-9_-]++\.(?:e[0-3w-z]|[ICD])[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++))"
)
# The body may hold headers, and hyphens in them; it ends at the next five hyphens.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:(?!-----).)*+)-----END \1-----", re.DOTALL)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:\s*\S+")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}+={0,2}")
# Full lines and a last one; the last may be text that follows.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{40,}+[ \t]*\r?\n[ \t]*)++(?:[A-Za-z0-9+/]++={0,2})?")
_HEX_ANY = re.compile(r"[0-9a-f]{64,}+|[0-9A-F]{64,}+")
_SSH_MAGIC = b"openssh-key-v1\0"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns: leftmost matches of each, failing ones dropped."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [
            (*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST
        ]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _unbase64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        padded = text + "=" * (-len(text) % 4)
        return base64.b64decode(padded, altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(segment: str) -> dict | None:
    raw = _unbase64(segment, url=True)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    """Three segments; header and payload are JSON objects, the header names an algorithm."""
    header, payload, signature = text.split(".")
    head = _json(header)
    return (
        head is not None and isinstance(head.get("alg"), str) and _json(payload) is not None
        and (_unbase64(signature, url=True) is not None or head["alg"] == "none")
    )


def der_elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements end to end, or None if a length does not fit."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(raw):
                return None
            size = int.from_bytes(raw[at : at + wide], "big")
            at += wide
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


# Object identifiers of key algorithms.
_RSA, _EC, _DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
#: Curves whose private key is a string of so many bytes.
_CURVES = {b"\x2b\x65\x6e": 32, b"\x2b\x65\x6f": 56, b"\x2b\x65\x70": 32, b"\x2b\x65\x71": 57}


def _is_inner_key(algorithm: bytes, raw: bytes) -> bool:
    """Whether the string of a PKCS 8 key holds a key of its algorithm."""
    elements = der_elements(raw)
    if not elements or len(elements) != 1:
        return False
    tag, value = elements[0]
    if algorithm in (_RSA, _EC):
        tags = [t for t, _ in der_elements(value) or []]
        return tag == 0x30 and (len(tags) == 9) == (algorithm == _RSA) and is_der_key(raw)
    if algorithm == _DSA:
        return tag == 0x02 and len(value) >= 16
    if algorithm in _CURVES:
        return tag == 0x04 and len(value) == _CURVES[algorithm]
    return tag in (0x02, 0x04, 0x30) and len(value) >= 16


def is_der_key(raw: bytes) -> bool:
    """One SEQUENCE that fills ``raw`` and holds what a private key holds."""
    outer = der_elements(raw) if raw[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_elements(outer[0][1])
    if not inner or inner[0][0] != 0x02 or len(inner) < 2:
        return False
    tags = [tag for tag, _ in inner]
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # DSA; RSA: version and eight numbers
        return all(value for _, value in inner)
    if tags[1] == 0x04 and inner[0][1] == b"\x01":  # elliptic curve: version 1, the number
        return len(inner[1][1]) >= 16 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:  # PKCS 8: algorithm, key
        algorithm = der_elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and _is_inner_key(algorithm[0][1], inner[2][1])
    return False


def is_ssh_key(raw: bytes) -> bool:
    """The magic, three strings and a count, then that many keys and one private part."""
    if not raw.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        at += 4 + size
        return raw[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(field() is not None for _ in range(keys + 1))


def _key_kind(raw: bytes | None) -> str | None:
    if raw:
        return "der" if is_der_key(raw) else "ssh" if is_ssh_key(raw) else None
    return None


def tokens(text: str) -> list[Span]:
    """Spans of signed tokens, leftmost first; none overlap."""
    found: list[Span] = []
    for m in _JWT.finditer(text):
        if not (found and m.start() < found[-1][1]) and is_signed_token(m[1]):
            found.append((*m.span(1), "jwt"))
    return found


def _pem_body(text: str) -> str:
    """The base64 of a block: what follows its headers, without blanks."""
    if ":" in text:
        parts = _BLANK_LINE.split(text.strip(), maxsplit=1)
        if len(parts) == 2 and ":" in parts[0]:
            text = parts[1]
        else:
            lines = " ".join(line for line in text.splitlines() if ":" not in line)
            text = lines if lines.strip() else _HEADER.sub(" ", text)  # a block may be one line
    return "".join(text.split())


def confirmed_spans(text: str) -> list[Span]:
    """Spans of runs that decode to a signed token or a key."""
    found: list[Span] = []
    if "." in text:
        found += tokens(text)
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            raw = _unbase64(_pem_body(m[2]))
            encrypted = "ENCRYPTED" in m[1] or "ENCRYPTED" in m[2]
            if raw and (_key_kind(raw) or encrypted):
                found.append((*m.span(), "pem"))
    for m in _BASE64.finditer(text):
        # The first bytes of a sequence or of the magic, in base64.
        if m[0][0] == "M" or m[0].startswith("b3BlbnNzaC"):
            kind = _key_kind(_unbase64(m[0]))
            if kind:
                found.append((*m.span(), kind))
    for m in _WRAPPED.finditer(text):
        if m[0][0] == "M" or m[0].startswith("b3BlbnNzaC"):
            full = m[0][: m[0].rindex("\n")].rstrip()
            for run in (m[0].rstrip(), full):
                kind = _key_kind(_unbase64("".join(run.split())))
                if kind and "\n" in run:
                    found.append((m.start(), m.start() + len(run), kind))
                    break
    for m in _HEX_ANY.finditer(text):
        for skip in (0, 1):
            run = m[0][skip:]
            run = run[: len(run) // 2 * 2]
            if run.startswith("30") or run[:8].lower() == "6f70656e":
                kind = _key_kind(bytes.fromhex(run))
                if kind:
                    found.append((m.start() + skip, m.start() + skip + len(run), kind))
                    break
    return found


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as in KINDS, joined by commas."""
    ordered = sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def _report(text: str) -> tuple:
    base = base_spans(text)
    kinds = [kind for _, _, kind in base]
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return (*map(kinds.count, BASE_KINDS), digest, listed(base + confirmed_spans(text)))


_COLUMNS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scan(text: Column) -> Column:
    """A struct of counts of base spans, their digest, and all spans of ``text``."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def work(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([_report(t) for t in part], columns=_COLUMNS)

    return work(F.coalesce(text.cast("string"), F.lit("")))
