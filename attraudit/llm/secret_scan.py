"""Operator 8, secret scans with structural confirmation.

Base kinds are found by pattern alone: ``assign`` (a name like password or token, and its value), ``access``
(access key ids) and ``hex`` (long hexadecimal runs). Further kinds are reported only if their structure is
confirmed: candidates in base64 or hexadecimal are decoded and parsed.

* ``jwt``: the first part is a JSON object with an ``alg``, the second a JSON object.
* ``der``: base64 of an ASN.1 key (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA) whose nested lengths fit exactly; it may be
  wrapped into lines of equal length.
* ``hexkey``: the same in hexadecimal.
* ``ssh``: base64 of a length-prefixed key blob whose lengths fit exactly, wrapped or not.
* ``pem``: a private key block whose body is one of the above, or, if its headers say that it is encrypted, whole cipher blocks.

Keys inside a reported private key block aren't reported by themselves.

Spans are in code points, the end exclusive, ordered by start, then by kind as listed. Null texts count as
empty. Each text is scanned as a whole; repeated rows, empty tables and other columns change nothing.
"""
from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.llm.common import text_or_empty

KINDS = ["assign", "access", "hex", "jwt", "der", "hexkey", "ssh", "pem"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of 20 and more of AKIA[A-Z0-9]+
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
ANY_HEX = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{60,76}(?:\r?\n[A-Za-z0-9+/]{60,76})*\r?\n[A-Za-z0-9+/]{1,76}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+?)-----END \1-----")
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16,32})\s")
LONG = 20  # no run without white space that is shorter is an access key, a hexadecimal run or a key


def _unbase64(s: str) -> bytes | None:
    bare = s.rstrip("=")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _object(part: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_token(s: str) -> bool:
    head, body, _ = s.split(".")
    first = _object(head)
    return first is not None and isinstance(first.get("alg"), str) and _object(body) is not None


def _parts(b: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill the bytes exactly; None if lengths don't fit."""
    out, i = [], 0
    while i < len(b):
        if i + 2 > len(b):
            return None
        tag, n, i = b[i], b[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(b):
                return None
            n, i = int.from_bytes(b[i:i + k], "big"), i + k
        if i + n > len(b):
            return None
        out.append((tag, b[i:i + n]))
        i += n
    return out


def asn1_key(b: bytes | None) -> bool:
    """Whether the bytes are one ASN.1 sequence laid out as a private or public key."""
    if not b or b[0] != 0x30:
        return False
    outer = _parts(b)
    inner = _parts(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:3] == [2, 0x30, 4] or tags in ([0x30, 3], [0x30, 4]):  # PKCS#8, a public key with its algorithm, or PKCS#8 encrypted
        named = _parts(inner[1 if tags[0] == 2 else 0][1])
        return bool(named) and named[0][0] == 6
    if tags[:2] == [2, 4] and inner[0][1] == b"\x01":  # SEC 1
        return len(inner[1][1]) >= 16
    return len(tags) in (2, 6, 9) and set(tags) == {2} and any(len(v) >= 32 for _, v in inner)  # PKCS#1, or DSA with six numbers


def ssh_key(b: bytes | None) -> bool:
    """Whether the bytes are length-prefixed strings that begin with a key type and fill them exactly."""
    if not b:
        return False
    if b.startswith(b"openssh-key-v1\0"):
        return len(b) > 60
    n, i, seen = 0, 0, []
    while i + 4 <= len(b):
        n = int.from_bytes(b[i:i + 4], "big")
        if i + 4 + n > len(b):
            return False
        seen.append(b[i + 4:i + 4 + n])
        i += 4 + n
    return i == len(b) and len(seen) >= 2 and seen[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def block_key(headers: str, body: str) -> bool:
    """Whether the inside of a private key block is a key, or cipher blocks where its headers say so."""
    b = _unbase64("".join(body.split()))
    if "Proc-Type: 4,ENCRYPTED" in headers:
        named = CIPHER.search(headers)
        return named is not None and bool(b) and len(b) % (len(named[1]) // 2) == 0
    return asn1_key(b) or ssh_key(b)


def wrapped_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys over several lines: all lines but the last are equally long. The last line found may be other text after a key."""
    for m in WRAPPED.finditer(text):
        lines = m[0].split("\n")
        if len({len(x.rstrip("\r")) for x in lines[:-1]}) > 1:
            continue
        for some in (lines, lines[:-1]):
            b = _unbase64("".join(x.rstrip("\r") for x in some))
            kind = "der" if asn1_key(b) else "ssh" if ssh_key(b) else None
            if kind and len(some) > 1:
                yield kind, m.start(), m.start() + len("\n".join(some).rstrip("\r"))
                break


def spans(text: str) -> list[tuple[str, int, int]]:
    """All findings of a text as (kind, start, end)."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if signed_token(m[0])]
    pem = [m.span() for m in PEM.finditer(text) if block_key(m[2], m[3])] if "-----BEGIN " in text else []
    out += [("pem", *s) for s in pem]
    if max(map(len, text.split()), default=0) >= LONG:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        keys: list[tuple[str, int, int]] = []
        for m in BASE64.finditer(text):
            b = _unbase64(m[0])
            keys += [(k, *m.span()) for k, fits in (("der", asn1_key), ("ssh", ssh_key)) if fits(b)]
        keys += [x for x in wrapped_keys(text) if x not in keys]
        keys += [("hexkey", *m.span()) for m in ANY_HEX.finditer(text) if asn1_key(bytes.fromhex(m[0]))]
        out += [k for k in keys if not any(lo <= k[1] and k[2] <= hi for lo, hi in pem)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(text: Column | str) -> Column:
    """array<struct<kind, start, end>> of each whole text."""
    @F.arrow_udf(_SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            yield pa.array([[dict(zip(("kind", "start", "end"), x)) for x in spans(t.as_py())] for t in b], kind)

    return scan(text_or_empty(text))


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    rows = df.select(F.col(doc_id).alias("doc_id"), find(text).alias("s"))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("s", lambda x: x["kind"].isin(*kinds))

    base = of(*KINDS[:3])
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
