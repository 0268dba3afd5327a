"""Secret scans: patterns propose candidates, and structure confirms them before they are reported.

Base kinds (assign, access, hex) are reported as the patterns find them. Encoded candidates are decoded first:
``jwt`` needs a signed-token header (base64url JSON object with a string ``alg``) and an object as payload;
``key`` needs base64 or hex that decodes to a private key encoding: an ASN.1 sequence whose nested lengths add up
exactly, at every depth, and whose fields are those of a PKCS#1, PKCS#8 or SEC1 key, or an OpenSSH key whose
length-prefixed fields fill it exactly, down to its public keys and (where it isn't encrypted) its check numbers.

Tokens are looked for in the runs between characters that no token has, headers at every place of a run's part that can
start one: a part is decoded once for each of its four alignments, and objects are read in the decoded text.

All work is within one document; nothing is shuffled. Null and empty texts have no spans; repeated rows are
scanned alike; long texts are scanned whole; other columns are passed by.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches, texts

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
Span = tuple[int, int, str]

# The kinds in their listed order, and the patterns.
KINDS = ("assign", "access", "hex", "jwt", "key")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]{10,}")
OBJECT_START = "eyJ"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{64,}")
LONG_WORD = re.compile(r"[A-Za-z0-9+/_=-]{40}")


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that fill ``data`` exactly, or None if some length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length = int.from_bytes(data[at : at + size], "big")
            at += size
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_nested(data: bytes) -> bool:
    """Whether ``data`` is DER items whose constructed ones are so, too, at every depth."""
    open_parts = [data]
    while open_parts:
        items = der_items(open_parts.pop())
        if items is None:
            return False
        open_parts += [content for tag, content in items if tag & 0x20]
    return True


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out.append(data[at + 4 : end])
        at = end
    return out


def is_openssh_key(data: bytes) -> bool:
    """What follows the magic: cipher, key derivation and its options, a count, as many public keys, and one private part."""
    at, head = 0, []
    for _ in range(3):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        head.append(data[at + 4 : end])
        at = end
    count = int.from_bytes(data[at : at + 4], "big")
    rest = ssh_fields(data[at + 4 :]) if at + 4 <= len(data) else None
    if not rest or not 1 <= count == len(rest) - 1 or not all(re.fullmatch(rb"[a-z0-9@.-]+", name) for name in head[:2]):
        return False
    public = [ssh_fields(key) for key in rest[:-1]]
    if not all(fields and len(fields) > 1 and re.fullmatch(rb"[a-z0-9@.-]+", fields[0]) for fields in public):
        return False
    private = rest[-1]
    return len(private) >= 8 and (head[0] != b"none" or (private[:4] == private[4:8] and private[12:].startswith(public[0][0])))


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or OpenSSH private key encodings, by structure."""
    if data.startswith(b"openssh-key-v1\0"):
        return is_openssh_key(data[15:])
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or not is_nested(data):
        return False
    fields = der_items(outer[0][1])
    if not fields:
        return False
    tags = [tag for tag, _ in fields]
    if tags[0] == 0x02 and len(fields[0][1]) == 1:
        pkcs1 = len(tags) >= 9 and all(t == 0x02 and content for t, content in fields[:9])
        pkcs8 = len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and (der_items(fields[1][1]) or [(0, b"")])[0][0] == 0x06
        # A plain key of PKCS#8 is an encoding inside the octets.
        pkcs8 = pkcs8 and len(der_items(fields[2][1]) or ()) == 1
        sec1 = len(tags) >= 2 and tags[1] == 0x04 and len(fields[1][1]) in (24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])
        return pkcs1 or pkcs8 or sec1
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: an algorithm and the ciphertext
        algorithm = der_items(fields[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm) == 2 and len(fields[1][1]) >= 8
    return False


def decode64(text: str) -> bytes | None:
    """Base64 or base64url with or without padding."""
    body = text.translate(str.maketrans("-_", "+/")).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    """The JSON object that a part of a token encodes."""
    try:
        value = json.loads(decode64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


#: What is read of an object before all of it is.
GLANCE = 512


def _may_be_object(text: str, place: int) -> bool:
    """Whether the first characters at a place may begin an object: an error well inside them is one of the whole, and costs no look at the rest."""
    head = text[place : place + GLANCE]
    try:
        json.JSONDecoder().raw_decode(head)
    except json.JSONDecodeError as error:
        return len(head) == GLANCE and (error.pos > GLANCE - 16 or error.msg.startswith("Unterminated string"))
    except RecursionError:
        return False
    return True


def header_start(part: str) -> int | None:
    """The first place from which the rest of a part encodes an object that names its algorithm."""
    first, read = None, json.JSONDecoder().raw_decode
    for shift in range(4):
        data = decode64(part[shift:]) if len(part) > shift else None
        if not data:
            continue
        # One character for each byte: the bytes beyond ASCII only stand in strings, and what is found is read again as it is.
        text, at = data.decode("latin-1"), part.find(OBJECT_START)
        last = len(text.rstrip(" \t\n\r"))
        while at >= 0 and (first is None or at < first):
            place = (at - shift) // 4 * 3
            if at % 4 == shift and _may_be_object(text, place):
                try:
                    value, end = read(text, place)
                    if end >= last and isinstance(value, dict) and isinstance(value.get("alg"), str) and isinstance(json.loads(data[place:]), dict):
                        first = at
                        break
                except (ValueError, RecursionError):
                    pass
            at = part.find(OBJECT_START, at + 1)
    return first


def signed_tokens(text: str) -> list[Span]:
    """Tokens of three parts: a header object that names its algorithm, a payload object, and a signature that may be empty."""
    out: list[Span] = []
    for run in TOKEN_RUN.finditer(text):
        parts = run[0].split(".")
        starts = [run.start()]
        for part in parts:
            starts.append(starts[-1] + len(part) + 1)
        k = 0
        while k + 2 < len(parts):
            at = header_start(parts[k]) if OBJECT_START in parts[k] and _object(parts[k + 1]) is not None else None
            if at is not None:
                out.append((starts[k] + at, starts[k + 2] + len(parts[k + 2]), "jwt"))
                k += 2
            k += 1
    return out


def is_signed_token(token: str) -> bool:
    return (0, len(token), "jwt") in signed_tokens(token)


def base_spans(text: str) -> list[Span]:
    """The assign, access and hex spans."""
    out: list[Span] = []
    if ASSIGN_HINT.search(text.lower()):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    """Encoded secrets whose structure checks out."""
    out: list[Span] = []
    if "eyJ" in text:
        out += signed_tokens(text)
    taken: list[Span] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            data = decode64(re.sub(r"\\[nr]|[\s\\]", "", m[2]))
            if data and is_private_key(data):
                taken.append((m.start(), m.end(), "key"))
    if LONG_WORD.search(text):
        for pattern, decode in ((HEX_KEY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None), (BASE64, decode64)):
            before, k = sorted(taken), 0
            for m in pattern.finditer(text):
                while k < len(before) and before[k][1] <= m.start():
                    k += 1
                if k == len(before) or before[k][0] >= m.end():
                    data = decode(m[0])
                    if data and is_private_key(data):
                        taken.append((m.start(), m.end(), "key"))
    return out + taken


def ordered(found: list[Span]) -> list[Span]:
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered(found))


def redact(text: str, found: list[Span]) -> str:
    """The text with each maximal covered run replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    for a, b, kind in ordered(found):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, a digest of the base spans, and all spans in code points (end exclusive)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts(batch):
                base, more = base_spans(text), confirmed_spans(text)
                kinds = [s[2] for s in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")
            return columns(doc_id=batch.column("doc_id"), **{k: [r[i] for r in rows] for i, k in enumerate(names)})

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All documents and columns, with every reported span replaced and ``length_col`` (if there) set anew where text changed."""
    schema = docs.schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(text_col).to_pylist()
            new = [t and redact(t, base_spans(t) + confirmed_spans(t)) for t in old]
            at = batch.schema.get_field_index(text_col)
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length_col and (at := out.schema.get_field_index(length_col)) >= 0:
                lengths = [len(b) if a != b else n for a, b, n in zip(old, new, batch.column(length_col).to_pylist(), strict=True)]
                out = out.set_column(at, out.schema.field(at), pa.array(lengths, out.schema.field(at).type))
            return out

        return step

    return map_batches(docs, make, schema)
