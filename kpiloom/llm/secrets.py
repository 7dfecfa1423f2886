"""Secret scans with structural confirmation.

Three base patterns mark spans by their form. Beyond them, candidates are confirmed by structure
before they are reported: wherever base64 or hex could start a key encoding, line breaks left out, as
much as its header declares is decoded, and reported only if the bytes are a key encoding (a DER
sequence whose nested lengths add up and whose members are those of a private key, or an OpenSSH key
with its length-prefixed strings); a dotted token is reported only if its header decodes to JSON that
names a signing algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's patterns, lengths and order of kinds; the method's kinds follow.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "signed_token", "pem_key", "base64_key", "hex_key")

#: The first segment starts as "{" or white space before it does in base64.
_DOTTED = re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])((?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])[A-Za-z0-9_-]++)"
                    r"(?=\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]++))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9]+(?: [A-Z0-9]+)*)-----([A-Za-z0-9+/=\s\\]++)-----END \1-----")
#: Line breaks with the blanks after them, real or escaped as in JSON and source text, and the backslash of an
#: escaped slash: what may stand inside a key. Other backslashes set the group.
_BREAK = re.compile(r"[\r\n\x0b\x0c\\](?:(?<!\\)[ \t]*+|\\*+(?:(?:[\r\n\x0b\x0cnr]|u000[aAdD])[ \t]*+|(?=/)|()))")
_PEM_SPACE = re.compile(r"\s++|(?<!\\)\\++(?:[nrt]|u000[9aAdD]|(?=[/\s]))")
_LEAST_RUN, _LEAST_HEX = 40, 64  # letters of a key outside PEM
#: A sequence tag with a length, or the OpenSSH magic.
_BASE64_START = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{%d})|b3BlbnNzaC1rZXktdjEA(?=[A-Za-z0-9+/_-]{%d})" % (_LEAST_RUN - 2, _LEAST_RUN - 20))
_HEX_START = re.compile(r"30(?=[0-9A-Fa-f]{%d})|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100(?=[0-9A-Fa-f]{%d})" % (_LEAST_HEX - 2, _LEAST_HEX - 30))
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]*+")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]*+")
_OPENSSH = b"openssh-key-v1\x00"

#: Object identifiers of password-based encryption: PKCS #5 and PKCS #12.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

#: Members of a key's sequences: nine integers and the other primes of PKCS #1 are the most.
_MOST_MEMBERS = 10

Span = tuple[str, int, int]


class Encoded:
    """The bytes that text[start:stop] encodes, decoded where they are looked at: a check of nested lengths reads a few
    bytes for each member, however long the candidate is. ``letters`` letters stand for ``size`` bytes."""

    def __init__(self, text: str, start: int, stop: int, letters: int, size: int, decode):
        self.text, self.start, self.letters, self.size, self.decode = text, start, letters, size, decode
        self.length = (stop - start) * size // letters

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at:at + 1][0]
        first, last, _ = at.indices(self.length)
        if last <= first:
            return b""
        group, groups = first // self.size, -(-last // self.size)
        data = self.decode(self.text[self.start + group * self.letters:self.start + groups * self.letters]) or b""
        return data[first - group * self.size:last - group * self.size]

    def startswith(self, head: bytes) -> bool:
        return self[:len(head)] == head


def der_items(data: bytes | Encoded, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end of content) of the definite-length DER values that fill data[start:end] exactly; None also for
    more members than a key has."""
    items = []
    while start < end:
        if start + 2 > end or len(items) == _MOST_MEMBERS:
            return None
        head = data[start:start + 6]
        tag, size, at = head[0], head[1], start + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end or head[2] == 0:
                return None
            size, at = int.from_bytes(head[2:2 + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def _openssh_end(data: bytes | Encoded) -> int | None:
    """Where an OpenSSH key ends: three strings, a count, so many public keys and the private part. None if
    data is not one as far as its public keys; its own end if it breaks off later."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)
    for _ in range(3):  # cipher, key derivation and its options are length-prefixed strings
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    if at + 4 > len(data) or not (n := int.from_bytes(data[at:at + 4], "big")):
        return None
    at += 4
    for _ in range(n + 1):
        if at + 4 > len(data):
            return len(data)
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return min(at, len(data))


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that starts with ``head`` (10 bytes or more), if its first member is an integer or
    a sequence, as in every key."""
    if head[:1] != b"\x30" or len(head) < 2:
        return None
    size, at = head[1], 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width >= len(head):
            return None
        size, at = int.from_bytes(head[at:at + width], "big"), at + width
    return at + size if at < len(head) and head[at] in (0x02, 0x30) else None


def is_private_key(data: bytes | Encoded) -> bool:
    """PKCS #1 (nine integers), DSA (version 0 and five integers), SEC 1 (version 1 and an octet string),
    PKCS #8 (version, algorithm identifier, octet string), encrypted PKCS #8 (password-based encryption,
    octet string) or OpenSSH."""
    if data.startswith(_OPENSSH):
        return _openssh_end(data) is not None
    if data[:1] != b"\x30":
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    items = der_items(data, *outer[0][1:])
    if not items:
        return False
    tags, version = [t for t, _, _ in items], data[items[0][1]:items[0][2]]
    if tags == [0x30, 0x04]:
        algorithm = der_items(data, *items[0][1:])
        return (bool(algorithm) and algorithm[0][0] == 0x06 and items[1][2] > items[1][1]
                and data[algorithm[0][1]:algorithm[0][2]].startswith(_ENCRYPTION))
    if tags[0] != 0x02:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6 and version == b"\x00":
        return True
    if tags[:2] == [0x02, 0x04] and version == b"\x01":
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\x00", b"\x01"):
        algorithm = der_items(data, *items[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def _decode64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_signed_header(segment: str) -> bool:
    raw = _decode64(segment)
    try:
        header = json.loads(raw.decode()) if raw else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def without_breaks(text: str) -> tuple[str, list[int], list[int]]:
    """The text without line breaks, and where its parts start, in it and in the text."""
    if not any(c in text for c in "\n\r\x0b\x0c\\"):
        return text, [0], [0]
    parts, starts, froms, at, n = [], [], [], 0, 0
    for m in _BREAK.finditer(text):
        if m.lastindex:
            continue
        start, end = m.span()
        if text[end - 1] != "\\":
            while start > at and text[start - 1] in " \t":  # blanks before a line break
                start -= 1
        if start > at:
            parts.append(text[at:start])
            starts.append(n)
            froms.append(at)
            n += start - at
        at = end
    return "".join([*parts, text[at:]]), [*starts, n], [*froms, at]


def _keys(clean: str, starting: re.Pattern, run: re.Pattern, letters: int, size: int, decode) -> Iterator[tuple[int, int]]:
    """Spans of key encodings, where ``letters`` letters stand for ``size`` bytes. Every run of letters is walked once,
    and a start in it only looks at the lengths that it declares."""
    at = ended = 0
    while m := starting.search(clean, at):
        start, at, n = m.start(), m.end(), None
        if start >= ended:
            ended = run.match(clean, start).end()
        if m.end() - start > 2:  # the OpenSSH magic: the key ends with its private part, or with its run
            end = ended - ((ended - start) % 4 == 1 if letters == 4 else (ended - start) % 2)
            stop = _openssh_end(Encoded(clean, start, end, letters, size, decode))
            n = stop and -(-stop * letters // size)
        elif total := der_size(decode(clean[start:start + 16]) or b""):
            n = -(-total * letters // size)
            fits = n >= (_LEAST_RUN if letters == 4 else _LEAST_HEX) and start + n <= ended
            n = n if fits and is_private_key(Encoded(clean, start, start + n, letters, size, decode)) else None
        if n:
            at = start + n
            yield start, at


def _from_hex(run: str) -> bytes:
    return bytes.fromhex(run)


def confirmed_spans(text: str) -> list[Span]:
    """The spans that the method adds."""
    found: list[Span] = []
    if _DOTTED.search(text):
        at = 0
        for m in _TOKEN.finditer(text):
            if m.start() >= at and _is_signed_header(m[1]):
                at = m.end(2)
                found.append(("signed_token", m.start(), at))
    blocks: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _decode64(_PEM_SPACE.sub("", m[2]))
            if data and is_private_key(data):
                blocks.append(m.span())
    found += [("pem_key", *x) for x in blocks]
    clean, starts, froms = without_breaks(text)

    def place(i: int) -> int:
        part = bisect.bisect_right(starts, i) - 1
        return froms[part] + i - starts[part]

    for a, b in _keys(clean, _BASE64_START, _BASE64_RUN, 4, 3, _decode64):
        b += len(clean[b:b + 2]) - len(clean[b:b + 2].lstrip("="))
        start, end = place(a), place(b - 1) + 1
        block = bisect.bisect_right(blocks, (start, len(text))) - 1
        if block < 0 or end > blocks[block][1]:  # else it is the body of one
            found.append(("base64_key", start, end))
    for a, b in _keys(clean, _HEX_START, _HEX_RUN, 2, 1, _from_hex):
        found.append(("hex_key", place(a), place(b - 1) + 1))
    return found


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in pc.fill_null(batch.column("text"), "").to_pylist():
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(base + confirmed_spans(text))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]),
             *(pa.array(c, pa.string()) for c in columns[3:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_assign, n_access,
    n_hex, base_sha256, spans. Null text is empty and has no spans; a null doc_id and repeated rows are
    kept; an empty table gives no rows. No shuffle; a task holds one batch of texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; null texts stay null. ``n_chars``, if there
    and not null, is that of the new text."""
    at = docs.columns.index("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else redacted(t, base_spans(t) + confirmed_spans(t), mark)
                     for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(texts, docs.schema)
    return _with_length(out, docs)


def _with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    n: Column = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", n).select(docs.columns)
