"""Secret scans with structural confirmation.

Base kinds are patterns alone: an assignment to a name such as password or token, an
access key id, a long run of hex digits. Structural kinds are reported only where a
candidate decodes and its inside holds together: a signed token whose first two parts
are JSON objects (white space in front allowed) and whose header names an algorithm, a
DER key whose nested lengths fill the data exactly, an SSH key whose length-prefixed
fields do, a PEM block that holds one of the two or, behind headers that name a cipher
and its start value, whole blocks of that cipher. Candidates may be base64 (either
alphabet, also wrapped in lines, with or without armour; once more around a PEM block) or hex.

Spans are (kind, start, end) in code points of the whole text, end exclusive.

Defined cases: null text counts as empty and has no span; a repeated secret is
reported at each place; spans of different kinds may overlap and all stay; equal rows
are scanned each; other columns are ignored; an empty table gives an empty result.
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

from .common import giving_back, small_batches

#: Kinds in the order in which spans with equal starts stand.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
_BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}")
# a header that begins with { or with white space, at every place where a part can begin
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([CDIe][A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+[^\s][^\n]*\n)*)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Z0-9]+(?:-[A-Z0-9]+)*,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})[ \t]*\r?\n")
_KEY64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|AAAA|b3Bl|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{30,}={0,2}")
_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?=[ \t\r]*(?:\n|\Z))")
#: Lines that a wrapped key without armour goes on for at most; a longer one is no key.
_LINES = 400
_HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:30|0000|6f70)(?:[0-9a-f]{2}|[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
_MAGIC = b"openssh-key-v1\0"


def _decode64(s: str) -> bytes:
    s = re.sub(r"\s", "", s).rstrip("=").translate({45: 43, 95: 47})
    return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)


def _fields(data: bytes, depth: int = 0) -> int | None:
    """Number of DER values that fill data exactly, constructed ones checked inside; None if they don't."""
    at = count = 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            size = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + size > len(data) or tag == 0:
            return None
        if tag & 0x20 and (depth > 8 or _fields(data[at : at + size], depth + 1) is None):
            return None
        at += size
        count += 1
    return count


def is_der_key(data: bytes) -> bool:
    """One DER sequence of two or more values, with an integer, an object id or a bit string among the keys' shapes."""
    if len(data) < 24 or data[0] != 0x30 or _fields(data) != 1:
        return False
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    inside = data[head:]
    return (_fields(inside, 1) or 0) >= 2 and inside[0] in (0x02, 0x30)


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(_MAGIC):
        data = data[len(_MAGIC) :]
        at = 0
        for _ in range(3):  # cipher, key derivation and its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data)
    at, names = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        names.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(names) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", names[0]) is not None


def is_jwt(token: str) -> bool:
    head, body, _ = token.split(".", 2)
    try:
        head, body = json.loads(_decode64(head)), json.loads(_decode64(body))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def is_pem(headers: str, body: str) -> bool:
    """Whether a PEM block holds a key, or behind the headers of an encrypted one whole blocks of its cipher."""
    try:
        data = _decode64(body)
    except (ValueError, binascii.Error):
        return False
    sealed = _CIPHER.search(headers)
    if sealed and "ENCRYPTED" in headers:
        return len(data) >= 16 and len(data) % (len(sealed[1]) // 2) == 0
    return is_der_key(data) or is_ssh_key(data)


def _kind(data: bytes) -> str | None:
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if data.startswith(b"-----BEGIN "):
        found = _PEM.search(data.decode("latin-1"))
        return "pem" if found and is_pem(found[2], found[3]) else None
    return None


def _wrapped(text: str, m: re.Match) -> Iterator[int]:
    """Ends of a base64 candidate: of its first line, or behind further lines that hold nothing else, the longest first."""
    ends, at = [m.end()], m.end()
    while text[at - 1] != "=" and len(ends) < _LINES and (line := _LINE.match(text, at)):
        at = line.end()
        ends.append(at)
    return reversed(ends)


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    if "." in text:
        for m in _TOKEN.finditer(text):
            if is_jwt(m[1]):
                yield "jwt", m.start(), m.end(1)
        if "eyJ" in text:
            for m in _JWT.finditer(text):
                if is_jwt(m[0]):
                    yield "jwt", m.start(), m.end()
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if is_pem(m[2], m[3]):
                yield "pem", m.start(), m.end()
    if "AAAA" in text or "b3Bl" in text or "M" in text or "LS0t" in text:
        for m in _KEY64.finditer(text):
            for end in _wrapped(text, m):
                try:
                    kind = _kind(_decode64(text[m.start() : end]))
                except (ValueError, binascii.Error):
                    continue
                if kind:
                    yield kind, m.start(), end
                    break
    for m in _HEXKEY.finditer(text):
        if kind := _kind(bytes.fromhex(m[0])):
            yield kind, m.start(), m.end()


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed, then end."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found += _confirmed(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with every span (overlapping ones as one) replaced by mark."""
    out, at, end = [], 0, -1
    for _, a, b in found:
        if a >= end:
            out.append(text[at:a])
            out.append(mark)
        end = max(end, b)
        at = end
    out.append(text[at:])
    return "".join(out)


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [spans(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in found if s[0] in _BASE] for found in every]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in _BASE]
        digest = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest), pa.array([_joined(f) for f in every], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(giving_back(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced by a mark; texts without spans stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, f) if t and (f := spans(t)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(giving_back(run), docs.schema)
