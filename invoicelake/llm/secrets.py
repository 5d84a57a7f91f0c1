"""Secret scans: plain patterns, and encoded candidates that are reported only if their decoded structure holds."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invoicelake.llm.common import with_columns_by

# The plain patterns.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order that breaks ties of the start; the first three are plain patterns.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "encoded")
BASE_KINDS = KINDS[:3]

_HINTS = ("passw", "secret", "token", "api")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
# the shortest assign, token=abcdef, has 12 bytes
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{24,}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# UTF-8 without control characters, as long as the shortest assign, and the start of a private key in DER
_READABLE = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}"
)
_DER_START = re.compile(rb"(?s)(?=\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83.{3}|\x84.{4})\x02\x01)")
# Object identifiers of key types in DER (RSA, EC, Ed25519, X25519).
_KEY_TYPES = tuple(map(bytes.fromhex, ("06092a864886f70d010101", "06072a8648ce3d0201", "06032b6570", "06032b656e")))
_SSH_MAGIC = b"openssh-key-v1\0"


def _unpack(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the DER elements that fill data[start:end] exactly, or None."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size >= 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def is_private_der(data: bytes) -> bool:
    """A private key in PKCS#1, SEC1 or PKCS#8: one SEQUENCE whose nested lengths fit to the last byte."""
    whole = _elements(data, 0, len(data))
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = _elements(data, whole[0][1], whole[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags[1] == 0x04:
        return 16 <= parts[1][2] - parts[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[1] == 0x30 and len(parts) >= 3 and tags[2] == 0x04:
        return data[parts[1][1] : parts[1][2]].startswith(_KEY_TYPES)
    return False


def _ssh_length(data: bytes, start: int = 0) -> int | None:
    """Bytes of the OpenSSH private key that starts there: its magic, then length-prefixed strings that all fit."""
    if not data.startswith(_SSH_MAGIC, start):
        return None
    at = start + len(_SSH_MAGIC)
    for part in range(3):  # cipher, key derivation, its options
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at + 4 > len(data) or (part < 2 and size == 0):
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at - start if at <= len(data) else None


def is_private_ssh(data: bytes) -> bool:
    """An OpenSSH private key and nothing behind it."""
    return _ssh_length(data) == len(data)


def is_signed_token(header: str, payload: str) -> bool:
    """The first part is a JSON object with an algorithm, the second a JSON object."""
    try:
        head, body = (json.loads(_unpack(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 over lines of one length, of 16 or more, with and without a shorter last one: start, end, joined text."""
    for m in _WRAPPED.finditer(text):
        lines = list(_LINE.finditer(text, *m.span()))
        k = 0
        while k < len(lines):
            width, first = len(lines[k][0]), k
            while k < len(lines) and len(lines[k][0]) == width:
                k += 1
            if width < 16:
                continue
            tail = k < len(lines) and len(lines[k][0]) < width
            for end in (k + 1, k) if tail else (k,):
                if end - first > 1:
                    yield lines[first].start(), lines[end - 1].end(), "".join(x[0] for x in lines[first:end])


def _kind_of(data: bytes | None, glued: bool = True) -> str | None:
    """What decoded bytes are: a key, or text that holds a secret itself (plain or confirmed), or neither."""
    if not data:
        return None
    if is_private_der(data) or is_private_ssh(data):
        return "key"
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    readable = "".join(inner.split()).isprintable()
    if readable and (next(_base(inner), None) or next(_confirmed(inner, glued), None)):
        return "encoded"
    return None


def _key_parts(data: bytes, step: int) -> Iterator[tuple[int, int]]:
    """Keys within decoded bytes, from places that a character begins (multiples of `step`): start and end."""
    for m in _DER_START.finditer(data):
        start = m.start()
        size, head = data[start + 1], 2
        if size >= 128:
            head += size & 127
            size = int.from_bytes(data[start + 2 : start + head], "big")
        end = start + head + size
        if start % step == 0 and end <= len(data) and is_private_der(data[start:end]):
            yield start, end
    start = data.find(_SSH_MAGIC)
    while start >= 0:
        if start % step == 0 and (size := _ssh_length(data, start)):
            yield start, start + size
        start = data.find(_SSH_MAGIC, start + 1)


def _parts(run: str, chars: int, step: int, unpack: Callable[[str], bytes | None]) -> Iterator[tuple[str, int, int]]:
    """Secrets that are only a part of a run, as other characters of its alphabet are glued to them.

    `chars` characters are `step` bytes. The run is decoded from each of its first `chars` places on, which reads what
    begins anywhere; a span has the whole characters of a key, or of the readable stretch that holds a secret.
    """
    size = len(run.rstrip("="))
    for shift in range(chars):
        data = unpack(run[shift : size - ((size - shift) % chars == 1)])
        if not data:
            continue
        found = [("key", *part) for part in _key_parts(data, step)]
        for m in _READABLE.finditer(data):
            inner = m[0].decode("utf-8", "replace")
            if next(_base(inner), None) or next(_confirmed(inner, glued=False), None):
                found.append(("encoded", *m.span()))
        for kind, start, end in found:
            end = shift + (end + step - 1) // step * chars
            yield kind, shift + start // step * chars, end if end < size else len(run)


def _header_start(segment: str) -> int | None:
    """Where in a part of a signed token the JSON object starts that ends with it."""
    for shift in range(4):
        text = (_unpack(segment[shift:]) or b"").decode("latin-1")
        at = text.find('{"')
        while at >= 0:
            try:
                if at % 3 == 0 and json.JSONDecoder().raw_decode(text, at)[1] == len(text):
                    return shift + at // 3 * 4
            except (ValueError, RecursionError):
                pass
            at = text.find('{"', at + 1)
    return None


def _confirmed(text: str, glued: bool = True) -> Iterator[tuple[str, int, int]]:
    """Candidates whose decoded bytes have the structure of a secret; with `glued`, parts of candidates too."""
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in _ARMOUR.finditer(text):
            data = _unpack("".join(m[2].split()))
            if data is not None and (is_private_der(data) or is_private_ssh(data)):
                armoured.append(m.span())
                yield "pem", *m.span()
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            if "eyJ" in m[1] and (start := _header_start(m[1])) is not None and is_signed_token(m[1][start:], m[2]):
                yield "jwt", m.start() + start, m.end(3)
    for start, end, body in _wrapped(text):
        if not any(a <= start < b for a, b in armoured) and (kind := _kind_of(_unpack(body), glued)):
            armoured.append((start, end))
            yield kind, start, end
    alphabets = ((_BASE64, 4, 3, _unpack), (_HEX_ANY, 2, 1, lambda x: bytes.fromhex(x[: len(x) // 2 * 2])))
    for pattern, chars, step, unpack in alphabets:
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in armoured):
                continue
            if kind := _kind_of(unpack(m[0]), glued):
                yield kind, *m.span()
            elif glued:
                for kind, start, end in _parts(m[0], chars, step, unpack):
                    yield kind, m.start() + start, m.start() + end


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end in code points) of a whole text, by start, then kind."""
    if not text:
        return []
    found = set(_base(text)) | set(_confirmed(text))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    ),
    True,
)
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """`docs` with the secrets of each whole text as spans (kind, start, end), an empty list for null or empty texts.

    A column named `into` is replaced, other columns and repeated rows pass unchanged. Row by row: no shuffle.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts.to_pylist()]
        return [pa.array(rows, _SPANS_ARROW)]

    return with_columns_by(docs, text, [T.StructField(into, _SPANS)], compute)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every secret replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; texts without a secret stay as they are.
    """

    def masked(value: str | None) -> str | None:
        spans = find_secrets(value)
        if not spans:
            return value
        merged: list[list] = []
        for kind, start, end in spans:
            if merged and start < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], end)
            else:
                merged.append([kind, start, end])
        parts, at = [], 0
        for kind, start, end in merged:
            parts += [value[at:start], f"[{kind}]"]
            at = end
        return "".join([*parts, value[at:]])

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([masked(t) for t in texts.to_pylist()], pa.string())]

    order = docs.columns
    return with_columns_by(docs, text, [T.StructField(text, T.StringType())], compute).select(*order)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))
