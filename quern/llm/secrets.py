"""Secrets in texts, reported only after their structure is confirmed.

Texts with a long run of token characters or a PEM block are looked at whole. In every run of base64, base64url or
hex characters (lines of such characters that follow each other are one run, too) each place where a key's encoding can
begin is tried: a DER sequence states its length, so what follows is decoded to that length and parsed by nested tags
and lengths that must fill their parents exactly; an OpenSSH key is parsed by its length-prefixed fields. Signed tokens are
parsed by their JSON header, payload and the signature length the header's algorithm asks for,
provider tokens by their checksum or embedded account number. A value that is assigned to a
credential's name is reported if it decodes to as many bytes as keys have and these look random.
Decoded text is scanned again, ``DEPTH`` layers deep.

Defined results
- rows (id, kind, start, end, digest): byte places in the text (of the outermost layer) and the first 16 hex digits of the secret's SHA-256, never the secret;
- null and empty texts have no rows; long texts are scanned whole; a null id is reported with its null;
- rows that repeat an id are scanned one by one; the same secret at two places gives two rows;
- a place is reported once, as what is tried first: PEM block, signed token, access key, provider token, key encoding, encoded text, assigned value;
- public keys, certificates, plain hashes and identifiers without a credential's name are not secrets;
- an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import importable
from .textbuf import buffers, slices

SHORTEST, DEPTH = 20, 3
RUN = np.zeros(256, dtype=bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-":
    RUN[_c] = True

_PEM = re.compile(rb"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----([^-]*)-----END \1-----")
_DOTTED = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
_BRACE = re.compile(rb"e[w-z0-9_-]")
_AWS = re.compile(rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
_GITHUB = re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NAMED = re.compile(rb"(?:token|secret|passwd|password|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credential)s?[\"']?\s*(?:=>|:=|=|:)\s*[\"']?", re.I)
_WRAPPED = re.compile(rb"(?:[A-Za-z0-9+/]{20,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
_STD, _URL, _DIGITS = re.compile(rb"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(rb"[A-Za-z0-9_-]{20,}={0,2}"), re.compile(rb"[0-9a-fA-F]{20,}")
#: Where an encoded DER sequence can begin: tag 0x30 and the first byte of its length.
_DER64, _DERHEX = re.compile(rb"(?=M[A-I])"), re.compile(rb"(?=30[0-8])")
_SSH64, _SSHHEX = b"b3BlbnNzaC1rZXktdjEA", b"openssh-key-v1\0".hex().encode()
_HEX, _B64 = re.compile(rb"[0-9a-fA-F]+\Z"), re.compile(rb"[A-Za-z0-9+/_-]+={0,2}\Z")
KEY_BYTES = {16, 20, 24, 28, 30, 32, 40, 48, 64}
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def unbase64(s: bytes) -> bytes | None:
    """Strict base64 of either alphabet, padding optional but right where it stands; unused bits must be 0."""
    if not _B64.match(s) or (b"+" in s or b"/" in s) and (b"-" in s or b"_" in s):
        return None
    body = s.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(body) % 4 == 1 or len(s) > len(body) and len(s) % 4:
        return None
    try:
        out = base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None
    return out if base64.b64encode(out).rstrip(b"=") == body else None


def der(b: bytes, depth: int = 0) -> list | None:
    """[(tag, content or children)] of bytes that DER elements fill exactly; None for others."""
    out, at = [], 0
    while at < len(b):
        if at + 2 > len(b) or depth > 16:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(b):
                return None
            n = int.from_bytes(b[at : at + k], "big")
            if n < 0x80 or b[at] == 0:
                return None
            at += k
        if at + n > len(b):
            return None
        body = b[at : at + n]
        if tag & 0x20:
            body = der(body, depth + 1)
            if body is None:
                return None
        out.append((tag, body))
        at += n
    return out


def private_der(b: bytes) -> str | None:
    """Kind of private key whose DER encoding ``b`` is."""
    if len(b) < 24 or b[0] != 0x30 or (t := der(b)) is None or len(t) != 1:
        return None
    seq = t[0][1]
    tags = [x for x, _ in seq]
    if len(seq) >= 9 and set(tags[:9]) == {2} and seq[0][1] in (b"\0", b"\1") and len(seq[1][1]) >= 32:
        return "rsa_private_key"
    if len(seq) == 6 and set(tags) == {2} and seq[0][1] == b"\0":
        return "dsa_private_key"
    if len(seq) >= 2 and tags[:2] == [2, 4] and seq[0][1] == b"\1" and len(seq[1][1]) in (20, 24, 28, 32, 48, 66):
        return "ec_private_key"
    if len(seq) >= 3 and tags[:3] == [2, 0x30, 4] and seq[0][1] in (b"\0", b"\1") and seq[1][1] and seq[1][1][0][0] == 6:
        return "pkcs8_private_key"
    if len(seq) == 2 and tags == [0x30, 4] and seq[0][1] and seq[0][1][0][0] == 6 and len(seq[1][1]) % 8 == 0:
        return "encrypted_private_key"
    return None


def openssh(b: bytes) -> int | None:
    """Length of the openssh-key-v1 that ``b`` begins with: cipher, kdf, options, number of keys, public keys, private part, each within its stated length."""
    if not b.startswith(b"openssh-key-v1\0"):
        return None
    at, fields = 15, []

    def take(at: int) -> tuple[bytes, int] | None:
        n = int.from_bytes(b[at : at + 4], "big")
        return (b[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(b) and at + 4 <= len(b) else None

    for _ in range(3):
        if (x := take(at)) is None:
            return None
        fields.append(x[0])
        at = x[1]
    keys = int.from_bytes(b[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not fields[0].isascii():
        return None
    for _ in range(keys + 1):
        if (x := take(at)) is None:
            return None
        last, at = x
    return at if len(last) >= 16 else None


def _object(s: bytes) -> dict | None:
    b = unbase64(s)
    if b is None or b[:1] != b"{":
        return None
    try:
        out = json.loads(b)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def signed_tokens(raw: bytes) -> list[tuple[int, int]]:
    """Spans of header.payload.signature, the signature of the length that the header's algorithm gives."""
    out = []
    for m in _DOTTED.finditer(raw):
        parts, at = m[0].split(b"."), m.start()
        for head, body, sign in zip(parts, parts[1:], parts[2:]):
            if (payload := _object(body)) is not None:
                for h in _BRACE.finditer(head):
                    alg = (_object(head[h.start() :]) or {}).get("alg")
                    if not isinstance(alg, str):
                        continue
                    sizes = [_SIGNATURE[alg]] if alg in _SIGNATURE else [512, 384, 256, 128] if alg[:2] in ("RS", "PS") else []
                    fits = [n for b in sizes if (n := -(-b * 4 // 3)) <= len(sign) and unbase64(sign[:n]) is not None]
                    if fits and payload is not None:
                        n = len(sign) if len(sign) in fits else fits[0]
                        out.append((at + h.start(), at + len(head) + 1 + len(body) + 1 + n))
                        break
            at += len(head) + 1
    return out


def aws(key: bytes) -> bool:
    """The account number in the id: 40 of its bits, of 12 digits at most and not 0."""
    x = base64.b32decode(key[:16])
    return 0 < (int.from_bytes(x[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12


def github(body: bytes, check: bytes) -> bool:
    n, want = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        want = _BASE62[r] + want
    return want.rjust(6, "0") == check.decode()


def random_bytes(b: bytes) -> bool:
    """Whether bytes look like a key: as many distinct values as chance gives, no text, no steady steps."""
    if len(set(b)) < 0.75 * 256 * -math.expm1(-len(b) / 256):
        return False
    if all(32 <= c < 127 or c in (9, 10, 13) for c in b):
        return False
    return len({(y - x) & 255 for x, y in zip(b, b[1:])}) > len(b) // 3


def _keyed(value: bytes) -> bool:
    if _HEX.match(value) and len(value) % 2 == 0:
        b = bytes.fromhex(value.decode())
        return len(b) in KEY_BYTES and random_bytes(b)
    b = unbase64(value)
    return b is not None and len(b) >= 15 and random_bytes(b) and bool(re.search(rb"[0-9]", value)) and bool(re.search(rb"[A-Z]", value)) and bool(re.search(rb"[a-z]", value))


def _length(head: bytes) -> int | None:
    """Bytes of the DER sequence whose first bytes these are."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    k = head[1] & 0x7F
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 3 and len(head) >= 2 + k else None


def keys64(body: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the private keys encoded in a run of base64 characters."""
    out, done = [], 0
    for m in _DER64.finditer(body):
        p = m.start()
        head = body[p : p + 8].replace(b"-", b"+").replace(b"_", b"/")
        n = _length(base64.b64decode(head)) if len(head) == 8 and p >= done and b"=" not in head else None
        if n is None or n < 24 or p + -(-n * 4 // 3) > len(body):
            continue
        end = p + -(-n * 4 // 3)
        b = unbase64(body[p:end])
        if b is not None and (kind := private_der(b)):
            while end < len(body) and body[end : end + 1] == b"=" and (end - p) % 4:
                end += 1
            out.append((kind, p, end))
            done = end
    p = body.find(_SSH64)
    while p >= 0:
        rest = body[p:].split(b"=")[0].replace(b"-", b"+").replace(b"_", b"/")
        n = openssh(base64.b64decode(rest + b"=" * (-len(rest) % 4) if len(rest) % 4 != 1 else rest[:-1]))
        if n is not None:
            out.append(("openssh_private_key", p, p + -(-n * 4 // 3)))
        p = body.find(_SSH64, p + 1)
    return out


def keys16(body: bytes) -> list[tuple[str, int, int]]:
    """The same in a run of hex digits."""
    out, done = [], 0
    for m in _DERHEX.finditer(body):
        p = m.start()
        head = body[p : p + 10]
        n = _length(bytes.fromhex(head.decode())) if p >= done and len(head) == 10 else None
        if n is not None and n >= 24 and p + 2 * n <= len(body) and (kind := private_der(bytes.fromhex(body[p : p + 2 * n].decode()))):
            out.append((kind, p, p + 2 * n))
            done = p + 2 * n
    low = body.lower()
    p = low.find(_SSHHEX)
    while p >= 0:
        n = openssh(bytes.fromhex(body[p : len(body) - (len(body) - p) % 2].decode()))
        if n is not None:
            out.append(("openssh_private_key", p, p + 2 * n))
        p = low.find(_SSHHEX, p + 1)
    return out


def _bodies(raw: bytes):
    """(run, places of its bytes or None where they follow each other, start, hex or not) of all runs of base64 and hex characters, wrapped ones joined."""
    for m in _WRAPPED.finditer(raw):
        at = np.frombuffer(m[0], np.uint8)
        at = np.flatnonzero((at != 10) & (at != 13) & (at != 32) & (at != 9))
        body = np.frombuffer(m[0], np.uint8)[at].tobytes()
        yield body, at + m.start(), 0, False
        if _HEX.match(body):
            yield body, at + m.start(), 0, True
    for pattern, digits in ((_STD, False), (_URL, False), (_DIGITS, True)):
        for m in pattern.finditer(raw):
            yield m[0], None, m.start(), digits


def _printable(b: bytes) -> bool:
    return all(32 <= c < 127 or c in (9, 10, 13) for c in b)


def pem_blocks(raw: bytes) -> list[tuple[str, int, int]]:
    out = []
    for m in _PEM.finditer(raw):
        lines = m[2].replace(b"\\n", b"\n").split()
        body = b"".join(x for x in lines if b":" not in x and not x.startswith(b"DEK"))
        b = unbase64(body)
        kind = b is not None and (private_der(b) or ("openssh_private_key" if openssh(b) == len(b) else None))
        if kind:
            out.append((kind, *m.span()))
    return out


def _runs(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = RUN[data]
    d = np.diff(inside)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if cuts is not None and len(starts):
        # a run that goes over the edge of two texts is cut there
        c = cuts[(cuts > 0) & (cuts < len(data))]
        c = np.unique(c[RUN[data[c]] & RUN[data[c - 1]]]) if len(c) else c
        starts, ends = np.sort(np.concatenate([starts, c])), np.sort(np.concatenate([ends, c]))
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def scan(raw: bytes, depth: int = 0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in the bytes of one text."""
    found: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if not any(a < end and start < b for _, a, b in found):
            found.append((kind, start, end))

    if b"-----BEGIN " in raw:
        found += pem_blocks(raw)
    for span in signed_tokens(raw):
        add("signed_token", *span)
    for m in _AWS.finditer(raw):
        if aws(m[1]):
            add("access_key_id", *m.span())
    for m in _GITHUB.finditer(raw):
        if github(m[1], m[2]):
            add("provider_token", *m.span())
    bodies = list(_bodies(raw))
    place = lambda where, start, a, b: (start + a, start + b) if where is None else (int(where[a]), int(where[b - 1]) + 1)
    for body, where, start, digits in bodies:
        for kind, a, b in keys16(body) if digits else keys64(body):
            add(kind, *place(where, start, a, b))
    if depth < DEPTH:
        for body, where, start, digits in bodies:
            b = bytes.fromhex(body.decode()) if digits and len(body) % 2 == 0 else None if digits else unbase64(body)
            if b is not None and len(b) >= SHORTEST and _printable(b):
                for kind in sorted({k for k, *_ in scan(b, depth + 1)}):
                    add(kind, *place(where, start, 0, len(body)))
    for m in _NAMED.finditer(raw):
        for pattern in (_DIGITS, _STD, _URL):
            v = pattern.match(raw, m.end())
            if v and _keyed(v[0]):
                add("keyed_value", *v.span())
                break
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of confirmed secrets. See the module for defined results."""
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                starts, _ = _runs(data, offsets)
                hit = np.unique(np.searchsorted(offsets, starts, "right") - 1)
                raw = data.tobytes()
                # PEM blocks may have lines shorter than a run
                if b"-----BEGIN " in raw:
                    at = np.array([m.start() for m in re.finditer(b"-----BEGIN ", raw)])
                    hit = np.union1d(hit, np.searchsorted(offsets, at, "right") - 1)
                rows, which = [], []
                for d in hit.tolist():
                    text = raw[offsets[d] : offsets[d + 1]]
                    for k, s, e in scan(text):
                        which.append(d)
                        rows.append((k, s, e, hashlib.sha256(text[s:e]).hexdigest()[:16]))
                if rows:
                    a, b, c, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(which)), pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], names=[id_col, "kind", "start", "end", "digest"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").mapInArrow(run, f"`{id_col}` {kind}, kind string, start bigint, end bigint, digest string")
