"""Secret scans with structural confirmation.

Patterns find candidates; what looks like base64 or hexadecimal is decoded and
parsed before it is reported as more than a pattern:

* ``der_key``: a DER private key or key pair (PKCS#1, PKCS#8, SEC 1) whose nested
  lengths add up to the byte, with an integer version and key parts inside;
* ``ssh_key``: an OpenSSH private key (its magic and length-prefixed fields) or a
  public key whose length-prefixed fields fill the blob and start with its type;
* ``jwt``: three base64url parts of which the first decodes to a JSON object with
  ``alg`` and the second to a JSON object (a signed-token header);
* ``sealed_key``: an encrypted private key: PKCS#8 (algorithm with parameters and
  an octet string), or a PEM body whose headers name its cipher and IV.

A PEM body is joined over its lines before it is decoded, be they real or
written as the escapes \\n and \\r. All scans take time in proportion to the
text: markers are paired with their next one, and the dotted parts of a run are
each decoded twice at most. Base spans are found
by the kinds' patterns, leftmost and non-overlapping, and all stay. Positions
are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import only, tune

#: The base kinds in order, with patterns and least lengths (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "jwt", "sealed_key")

_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Where a token's header may begin inside a part, and its first characters.
_HEAD = re.compile(r"(?:^|(?<=[_-]))eyJ")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_LINE_END = re.compile(r"\r\n|\n|\r|\\r\\n|\\n|\\r")
_CIPHER = re.compile(r"[A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,16}")
#: Names that open a public key blob (fixed values).
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_SSH_MAGIC = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text of either alphabet, padding optional."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill ``data``, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
            if n < 0x80 or (width > 1 and n < 1 << 8 * (width - 1)):
                return None  # DER wants the shortest form
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = elements(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1:
        return False
    version, second = inner[0][1][0], inner[1]
    if version == 0 and second[0] == 0x30 and len(inner) >= 3 and inner[2][0] == 0x04:  # PKCS#8
        algorithm = elements(second[1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if version == 1 and second[0] == 0x04 and 16 <= len(second[1]) <= 80:  # SEC 1
        return all(tag in (0xA0, 0xA1) for tag, _ in inner[2:])
    if version in (0, 1) and len(inner) >= 6:  # PKCS#1, DSA
        return all(tag == 0x02 and body for tag, body in inner[:6]) and len(second[1]) >= 32
    return False


def fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill ``data``, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(_SSH_MAGIC):
        at = len(_SSH_MAGIC)
        for _ in range(3):  # cipher, key derivation, its options
            n = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + n > len(data):
                return False
            at += 4 + n
        count = int.from_bytes(data[at : at + 4], "big")
        rest = fields(data[at + 4 :])
        return 1 <= count <= 16 and rest is not None and len(rest) == count + 1
    found = fields(data)
    return bool(found) and len(found) >= 2 and found[0] in _SSH_TYPES


def is_sealed(data: bytes) -> bool:
    """Encrypted PKCS#8: an algorithm with its parameters, and an octet string."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = elements(outer[0][1])
    if not inner or [tag for tag, _ in inner] != [0x30, 0x04] or len(inner[1][1]) < 16 or len(inner[1][1]) % 8:
        return False
    algorithm = elements(inner[0][1])
    return bool(algorithm) and [tag for tag, _ in algorithm] == [0x06, 0x30] and bool(elements(algorithm[1][1]))


def key_kind(data: bytes) -> int | None:
    """The kind that decoded bytes are, if any."""
    if data[:1] == b"\x30":
        return 3 if is_der_key(data) else 6 if is_sealed(data) else None
    return 4 if is_ssh_key(data) else None


def pem_kind(body: str) -> int | None:
    """The kind of what stands between two PEM markers."""
    lines = [x.strip() for x in _LINE_END.split(body)]
    heads = dict(x.split(": ", 1) for x in lines if ": " in x)
    data = decoded(re.sub(r"\s+", "", "".join(x for x in lines if ": " not in x))) or b""
    if "DEK-Info" in heads:
        sealed = heads.get("Proc-Type") == "4,ENCRYPTED" and _CIPHER.fullmatch(heads["DEK-Info"])
        return 6 if sealed and len(data) >= 16 and len(data) % 8 == 0 else None
    return key_kind(data)


def is_object(text: str, *, signed: bool) -> bool:
    """Whether a base64url text is a JSON object, with ``alg`` if ``signed``."""
    try:
        value = json.loads(decoded(text) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(value, dict) and (not signed or isinstance(value.get("alg"), str))


def tokens(run: str) -> Iterator[tuple[int, int]]:
    """The spans of signed tokens in a run of base64url characters and dots."""
    parts, at, after = run.split("."), 0, 0
    for k, part in enumerate(parts[:-2]):
        if at >= after and parts[k + 1]:
            for m in _HEAD.finditer(part):
                # a header is plain text: what begins otherwise is not decoded in full
                start = decoded(part[m.start() : m.start() + 64]) or b""
                if start.isascii() and start.decode().isprintable() and is_object(part[m.start() :], signed=True):
                    if is_object(parts[k + 1], signed=False):
                        after = at + len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                        yield at + m.start(), after
                    break
        at += len(part) + 1


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    keys = set()
    for m in _HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            keys.add((m.start(), kind, m.end()))
    if "-----BEGIN" in text:
        marks = list(_PEM.finditer(text))
        for m, end in zip(marks, marks[1:], strict=False):
            if (m[1], end[1]) == ("BEGIN", "END") and m[2] == end[2] and (kind := pem_kind(text[m.end() : end.start()])):
                keys.add((m.start(), kind, end.end()))
    for m in _BASE64.finditer(text):
        if (data := decoded(m[0])) and (kind := key_kind(data)):
            keys.add((m.start(), kind, m.end()))
    if "eyJ" in text:
        for m in _DOTTED.finditer(text):
            if "eyJ" in m[0]:
                keys.update((m.start() + a, 5, m.start() + b) for a, b in tokens(m[0]))
    return sorted([*out, *keys])


def _written_as(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [scan(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "found"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [scan(t) for t in b.column("text").to_pylist()]
        base = [[x for x in s if x[1] < 3] for s in found]
        cols = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
        sha = pa.array([hashlib.sha256(_written_as(s).encode()).hexdigest() for s in base], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, sha, pa.array([_written_as(s) for s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def clean(text: str | None) -> str | None:
        spans = scan(text)
        if not spans:
            return text
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    for b in batches:
        k = b.schema.get_field_index("text")
        yield b.set_column(k, b.schema.field(k), pa.array([clean(t) for t in b.column("text").to_pylist()], b.schema.field(k).type))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end)."""
    tune(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with every span in ``text`` replaced by
    its kind in brackets (overlapping spans by the first), n_chars counted anew
    where there is such a column."""
    tune(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return docs.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
