"""Secret scan with structural confirmation.

Pattern matches are candidates; runs of base64 or hex, PEM blocks and signed-token headers are reported as further
kinds only if they decode to what they claim: a token header must be JSON with ``alg``, a key must be DER whose nested
lengths add up.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from groundmetrics.llm.common import documents, map_batches

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three plain patterns (code points, end exclusive), each kind leftmost and non-overlapping."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def der_ok(data: bytes, depth: int = 0) -> bool:
    """True if ``data`` is a sequence of DER elements whose lengths nest exactly, an outer SEQUENCE at the top."""
    at, seen = 0, 0
    if depth > 8 or not data or depth == 0 and data[0] != 0x30:
        return False
    while at < len(data):
        if len(data) - at < 2:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or len(data) - at < n:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size > len(data) - at or tag & 0x20 and size and not der_ok(data[at : at + size], depth + 1):
            return False
        at, seen = at + size, seen + 1
    return seen == 1 if depth == 0 else seen > 0


def _decoded(text: str, url: bool = False) -> bytes | None:
    try:
        raw = text.rstrip("=")
        raw += "=" * (-len(raw) % 4)
        return base64.b64decode(raw.replace("-", "+").replace("_", "/") if url else raw, validate=True)
    except (binascii.Error, ValueError):
        return None


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded content has the structure of a signed token or an encoded key."""
    out: list[tuple[str, int, int]] = []
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            try:
                head = json.loads(_decoded(m[1], True) or b"")
            except ValueError:  # covers bad UTF-8, bad JSON
                continue
            except RecursionError:
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and _decoded(m[2], True) is not None:
                out.append(("jwt", m.start(), m.end()))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            raw = _decoded(re.sub(r"\s+", "", m[2]))
            if raw and (der_ok(raw) or raw.startswith(b"openssh-key-v1\0")):
                out.append(("pem", m.start(), m.end()))
    if "MI" in text or "MC" in text or "MD" in text or "ME" in text or "MF" in text or "MG" in text or "MH" in text:  # 0x30 and a length
        for m in BASE64.finditer(text):
            if m[0][0] == "M" and (raw := _decoded(m[0])) and len(raw) >= 30 and der_ok(raw):
                out.append(("der", m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and len(m[0]) >= 60 and der_ok(bytes.fromhex(m[0])):
            out.append(("der", m.start(), m.end()))
    return out


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), ordered by start and kind."""
    base = base_spans(text)
    return base, sorted({*base, *structural_spans(text)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row with counts, the digest of the base spans and all spans.

    Null or empty texts have no spans (digest of the empty string); null ids and repeated rows pass through.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text in b.column("text").to_pylist():
                base, spans = find_secrets(text)
                kinds = [s[0] for s in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return map_batches(documents(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); ``n_chars``, if there, is counted anew.

    All rows and columns stay; null texts stay null.
    """

    def clean(text):
        if text is None:
            return None
        parts, at = [], 0
        for _, s, e in find_secrets(text)[1]:
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    names = docs.columns

    def run(batches):
        for b in batches:
            i = names.index("text")
            texts = [clean(t) for t in b.column(i).to_pylist()]
            arrays = list(b.columns)
            arrays[i] = pa.array(texts, b.schema.field(i).type)
            if "n_chars" in names:
                j = names.index("n_chars")
                old = b.column("n_chars").to_pylist()
                arrays[j] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return map_batches(docs, run, docs.schema)
