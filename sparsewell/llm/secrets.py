"""Secret scans with structural confirmation.

Three pattern kinds (assign, access, hex) are reported as they match.  Further
kinds are reported only if the candidate's structure holds up:

* ``pem``    an armoured private-key block whose body decodes to a DER sequence with
  consistent nested lengths, or to an OpenSSH container with consistent field lengths,
  or whose two legacy headers say that it is encrypted; its line ends and slashes may
  be escaped by backslashes;
* ``jwt``    three base64url segments whose first is a JSON object with an ``alg``
  string, whose second is a JSON object and whose third, the signature, is not empty;
* ``der``    a bare base64 or hex run that decodes to a private key in DER form
  (PKCS#1, PKCS#8 or SEC1 layout) with nested lengths that use up the run;
* ``sshkey`` a bare base64 run that decodes to an OpenSSH private-key container.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded_batches

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24

#: Order of kinds for spans that start at one place.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "sshkey")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # runs are maximal, so the least length can be asked for at once
_ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\-]*")
_ESCAPED_END = re.compile(r"\\+[nr]")  # line ends of JSON and env files
_ESCAPED_SLASH = re.compile(r"\\+/")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++))")  # from every segment on
_B64 = re.compile(r"(?:(?<![A-Za-z0-9+/])(?!(?<=\\)[nr])|(?<=\\[nr]))[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])")
_HEXRUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=_-])MI[A-Za-z0-9+/]{38,}(?=\r?\n[ \t]*[A-Za-z0-9+/])")
_LINE = re.compile(r"([A-Za-z0-9+/]+)(?:\r?\n[ \t]*(?=[A-Za-z0-9+/=]))?")
_B64URL = re.compile(r"(?<![A-Za-z0-9_+/-])M[A-Za-z0-9_-]{39,}={0,2}(?![A-Za-z0-9_+/=-])")
_COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])30(?::(?:\r?\n[ \t]*)?[0-9A-Fa-f]{2}){31,}(?![0-9A-Fa-f:])")

#: First bytes of an OpenSSH private-key container (fixed value).
_OPENSSH_MAGIC = b"openssh-key-v1\x00"


class Span(NamedTuple):
    start: int
    order: int
    end: int

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _decode64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER element at ``at``; None unless it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, length, body = data[at], data[at + 1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        length = int.from_bytes(data[body : body + n], "big")
        body += n
        if length < 0x80:
            return None  # DER asks for the short form
    return (tag, body, body + length) if body + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _tlv(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_private_key(data: bytes) -> bool:
    """Whether ``data`` is exactly one private key: PKCS#1, PKCS#8 (also encrypted) or SEC1."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # encrypted: algorithm, octets
        inner = _elements(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02:
        return False
    if tags[1:] and all(t == 0x02 for t in tags) and len(tags) in (6, 9):  # DSA has 6 integers, RSA 9
        return True
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        inner = _elements(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    return len(tags) >= 2 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_openssh_private_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH container whose nested lengths use it up."""
    if not data.startswith(_OPENSSH_MAGIC):
        return False
    at = len(_OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys + 1)) and at == len(data)


def _json_object(segment: str) -> dict | None:
    raw = _decode64(segment, url=True)
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(candidate: str) -> bool:
    """Whether there is a signature, the header names an algorithm and the payload is a JSON object."""
    head, body, signature = candidate.split(".")
    if not signature:
        return False
    header = _json_object(head)
    return header is not None and isinstance(header.get("alg"), str) and _json_object(body) is not None


def _armoured(text: str) -> Iterator[Span]:
    """Key blocks: a header and the next armour line, if that is its trailer."""
    begin = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin and begin[2] == m[2] and _BODY.fullmatch(text, begin.end(), m.start()):
            lines = _ESCAPED_SLASH.sub("/", _ESCAPED_END.sub("\n", text[begin.end() : m.start()])).splitlines()
            head = [x.partition(":") for x in lines if ":" in x]
            # an encrypted body has no structure of its own
            legacy = any(k == "Proc-Type" and v.endswith("ENCRYPTED") for k, _, v in head) and any(k == "DEK-Info" and v.strip() for k, _, v in head)
            data = _decode64("".join("".join(x for x in lines if ":" not in x).split()))
            if data and (len(data) >= 32 if legacy else is_der_private_key(data) or is_openssh_private_key(data)):
                yield Span(begin.start(), 3, m.end())
        begin = None


def _tokens(text: str) -> Iterator[Span]:
    end = 0
    for m in _JWT.finditer(text):
        if m.start() >= end and is_signed_token(m[1]):
            end = m.end(1)
            yield Span(m.start(), 4, end)


def _bare_keys(text: str, armoured: list[Span]) -> Iterator[Span]:
    starts = [a.start for a in armoured]
    for m in _B64.finditer(text):
        run = m[0]
        block = bisect_right(starts, m.start()) - 1
        if block >= 0 and m.start() < armoured[block].end:
            continue  # the block is reported as a whole
        if run[0] == "M":  # 0x30 as the first byte
            data = _decode64(run)
            if data is not None and is_der_private_key(data):
                yield Span(m.start(), 5, m.end())
        elif run.startswith("b3BlbnNzaC1rZXktdjE"):
            data = _decode64(run)
            if data is not None and is_openssh_private_key(data):
                yield Span(m.start(), 6, m.end())
    for m in _HEXRUN.finditer(text):
        if m[0].startswith("30") and is_der_private_key(bytes.fromhex(m[0])):
            yield Span(m.start(), 5, m.end())


def _spread_keys(text: str) -> Iterator[Span]:
    """Keys in base64 over several lines, whose outer length says where they end, in base64url, and in hex with colons."""
    end = 0
    for m in _WRAPPED.finditer(text):
        head = _tlv(_decode64(m[0][:8]), 0, 1 << 20) if m.start() >= end else None
        if head is None or head[0] != 0x30:
            continue
        wanted, run, at = -(-head[2] * 8 // 6), [], m.start()
        while wanted > 0 and (line := _LINE.match(text, at)):
            run.append(line[1])
            wanted, at = wanted - len(line[1]), line.end()
        pad = -sum(map(len, run)) % 4
        stop = at if text[at : at + pad] == "=" * pad and pad < 3 else -1
        if wanted == 0 and stop >= 0:
            data = _decode64("".join(run))
            stop = stop + pad if pad else at - len(line[0]) + len(line[1])
            if data is not None and is_der_private_key(data):
                end = stop
                yield Span(m.start(), 5, end)
    for m in _B64URL.finditer(text):
        if "-" in m[0] or "_" in m[0]:
            data = _decode64(m[0], url=True)
            if data is not None and is_der_private_key(data):
                yield Span(m.start(), 5, m.end())
    if "30:" in text:
        for m in _COLON_HEX.finditer(text):
            if is_der_private_key(bytes.fromhex("".join(m[0].replace(":", " ").split()))):
                yield Span(m.start(), 5, m.end())


def _runs_of(chars: str, dot: bool = False) -> bytes:
    """Table that maps ``chars`` to x and all other bytes but, if asked for, the dot to a space."""
    return bytes(ord("x") if chr(b) in chars and b < 128 else ord(".") if dot and b == ord(".") else ord(" ") for b in range(256))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX_RUNS, _B64_RUNS, _TOKEN_RUNS = _runs_of("0123456789abcdef"), _runs_of(_ALNUM + "+/"), _runs_of(_ALNUM + "_-", dot=True)
_ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
#: Characters of the shortest header with an ``alg`` string: ``{"alg":""}``.
_HEADER_LEAST = 14


def find_secrets(text: str) -> list[Span]:
    """All spans of a text in code points, by start, then kind in the order of KINDS.

    Most texts have no run of characters that is long enough for a kind, and no
    word of an assignment; that is seen on the bytes before any pattern is tried.
    """
    spans = []
    low, data = text.lower(), text.encode()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if b"x" * HEX_LEAST in data.translate(_HEX_RUNS):
        spans += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    armoured = list(_armoured(text)) if "-----BEGIN " in text else []
    spans += armoured
    runs = data.translate(_TOKEN_RUNS)
    if b"x" * _HEADER_LEAST + b"." in runs:
        spans += _tokens(text)
    bare = b"x" * 40 in data.translate(_B64_RUNS)
    if bare:
        spans += _bare_keys(text, armoured)
    if bare or b"x" * 40 in runs or "30:" in text:
        blocks = [(a.start, a.end) for a in armoured]
        spans += [k for k in _spread_keys(text) if not any(a <= k.start < b for a, b in blocks)]
    spans.sort()
    return spans


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for s in spans:
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = s.end
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex (long),
    base_sha256 (of the base spans as ``kind:start:end``, comma-joined) and
    spans (all spans, joined likewise).  Null and empty texts hold no spans; a
    null id stays null; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            shas, joined = [], []
            for text in b.column(1).to_pylist():
                spans = find_secrets(text) if text else []
                for k in range(3):
                    counts[k].append(sum(s.order == k for s in spans))
                shas.append(hashlib.sha256(",".join(str(s) for s in spans if s.order < 3).encode()).hexdigest())
                joined.append(",".join(map(str, spans)))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``documents`` with secrets masked and n_chars brought up to date.

    Every row stays; null texts stay null (n_chars as it was); other columns
    than those of ``documents`` are dropped.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars = b.column(1).to_pylist(), b.column(4).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := find_secrets(text)):
                    texts[i] = redact(text, spans)
                    chars[i] = len(texts[i])
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array(chars, pa.int64())], names=list(DOCUMENT_COLUMNS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
