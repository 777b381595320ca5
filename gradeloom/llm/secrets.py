"""Secret scans: patterns, and candidates that are decoded and confirmed by their structure.

Three plain patterns (assignments, access ids, hex runs) always report. Beyond
them, runs of base64 or hex are decoded, and only what parses is reported:

- `key`: a private key in DER, as PKCS#1, PKCS#8 (plain or encrypted), SEC1 or
  DSA numbers. All nested lengths have to fit each other to the last byte, and
  the key inside a PKCS#8 wrapping has to be one whole DER value.
- `ssh`: an OpenSSH private key, a chain of length-prefixed strings that fills it.
- `token`: a signed or encrypted JSON web token. Its header is JSON and names an
  algorithm, its signature has the length of that algorithm.

Base64 may be wrapped in lines (also by a written-out backslash n, as in JSON).
Whole texts are scanned, in one task per text, with work linear in its length
besides what candidates themselves declare as their length.

Null or empty texts have no spans. Null ids pass through, repeated rows stay
apart, other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import mapped, table, texts

#: All kinds of spans; spans of one start are in this order. The first three are the base ones.
KINDS = ["assign", "access", "hex", "key", "ssh", "token"]
BASE = KINDS[:3]

# Texts are searched as UTF-8 bytes, where `lower` lowers A-Z alone.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")

_SIX = rb"[A-Za-z0-9+/_-]"
#: A DER sequence in base64: the tag and the upper half of the length fix the first two characters.
_DER = re.compile(rb"(?<![A-Za-z0-9+/_-])M[A-I](?=" + _SIX + rb"{2})")
_SSH = re.compile(rb"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjEA")
#: Characters of one line, after a line break or its written form.
_CHUNK = re.compile(rb"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*)?(" + _SIX + rb"+)")
_HEX_KEY = re.compile(rb"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}")
#: A JSON object in base64 starts with one of these pairs.
_WEB = re.compile(rb"(?<![A-Za-z0-9_.-])e[wxyz0-3][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")

_SSH_MAGIC = b"openssh-key-v1\0"

#: Bytes of a signature by algorithm; RSA ones have the length of the key, 1024 bits at least.
_SIGNED = {
    "HS256": {32}, "HS384": {48}, "HS512": {64},
    "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114},
}
_RSA_SIGNED = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}


def decoded(chars: bytes) -> bytes | None:
    """Bytes of unpadded base64 in either alphabet."""
    if len(chars) % 4 == 1:
        return None
    try:
        return base64.b64decode(chars.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-len(chars) % 4), validate=True)
    except binascii.Error:
        return None


# --- key encodings ----------------------------------------------------------------------------

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at a place; None if its length doesn't fit or is not in shortest form."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or start + width > end:
            return None
        size = int.from_bytes(data[start : start + width], "big")
        if size < 0x80 or size >> 8 * (width - 1) == 0:
            return None
        start += width
    return (tag, start, start + size) if start + size <= end else None


def parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill a range, with all nested lengths checked."""
    found: list[tuple[int, int, int]] = []
    todo = [(start, end, True)]
    while todo:
        at, stop, outer = todo.pop()
        while at < stop:
            value = header(data, at, stop)
            if value is None:
                return None
            if outer:
                found.append(value)
            if value[0] & 0x20:
                todo.append((value[1], value[2], False))
            at = value[2]
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one private key in DER, and nothing else."""
    whole = header(data, 0, len(data))
    if whole is None or whole[0] != SEQUENCE or whole[2] != len(data):
        return False
    inside = parts(data, whole[1], whole[2])
    if not inside:
        return False
    tags = [t for t, _, _ in inside]

    def number(i: int) -> int | None:
        tag, start, end = inside[i]
        return data[start] if tag == INTEGER and end == start + 1 else None

    def is_algorithm(i: int) -> bool:
        tag, start, end = inside[i]
        named = parts(data, start, end) if tag == SEQUENCE else None
        return bool(named) and named[0][0] == OID and named[0][2] > named[0][1]

    def holds_a_value(i: int) -> bool:
        tag, start, end = inside[i]
        value = header(data, start, end) if tag == OCTETS else None
        return value is not None and value[2] == end and (not value[0] & 0x20 or parts(data, value[1], end) is not None)

    if all(t == INTEGER for t in tags[:9]) and number(0) in (0, 1) and all(e > s for _, s, e in inside):
        primes = len(tags) == 9 or (number(0) == 1 and tags[9:] == [SEQUENCE])
        return (len(tags) >= 9 and primes) or (len(tags) == 6 and number(0) == 0)
    if number(0) == 1 and tags[1:2] == [OCTETS] and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) <= 4:
        return inside[1][2] - inside[1][1] >= 20
    if number(0) in (0, 1) and len(tags) >= 3 and is_algorithm(1) and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        return holds_a_value(2)
    return tags == [SEQUENCE, OCTETS] and is_algorithm(0) and inside[1][2] - inside[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are one OpenSSH private key: cipher, derivation and its options, public keys, private part."""
    at, keys, left = len(_SSH_MAGIC), None, 3
    if not data.startswith(_SSH_MAGIC):
        return False
    while left:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, left = at + 4 + size, left - 1
        if left == 0 and keys is None:
            keys = int.from_bytes(data[at : at + 4], "big")
            at, left = at + 4, keys + 1
            if keys == 0 or at + 4 * left > len(data):
                return False
    return at == len(data)


def run_of(data: bytes, at: int, wanted: int) -> tuple[bytes, int] | None:
    """Exactly so many base64 characters from a place on, over line breaks, and where they end; the run must end there."""
    got, n = [], 0
    while n < wanted:
        chunk = _CHUNK.match(data, at)
        # Only the first line may start without a break.
        if chunk is None or (got and chunk.start() == chunk.start(1)):
            return None
        got.append(chunk[1])
        n, at = n + len(chunk[1]), chunk.end()
    return (b"".join(got), at) if n == wanted else None


def padded(data: bytes, end: int, chars: int) -> int:
    """The end with its padding."""
    pad = -chars % 4
    return end + pad if data[end : end + pad] == b"=" * pad else end


def der_at(data: bytes, at: int) -> int | None:
    """Where the base64 private key that starts at a place ends."""
    first = _CHUNK.match(data, at)
    head = decoded(first[1][:8][: len(first[1]) // 4 * 4])
    if not head or head[0] != SEQUENCE:
        return None
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    if width > 4 or len(head) < 2 + width:
        return None
    total = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    chars = (total * 8 + 5) // 6
    if chars > len(data) - at:
        return None
    run = run_of(data, at, chars)
    if run is None or not is_private_key(decoded(run[0]) or b""):
        return None
    return padded(data, run[1], chars)


def ssh_at(data: bytes, at: int) -> int | None:
    """Where the OpenSSH key that starts at a place ends: with the last line after which it parses."""
    got, end = [], at
    while (chunk := _CHUNK.match(data, end)) and not (got and chunk.start() == chunk.start(1)):
        got.append(chunk[1])
        end = chunk.end()
        # A full line that lines of the same length follow can't be the last one.
        follows = _CHUNK.match(data, end)
        if follows and follows.start() != follows.start(1) and len(follows[1]) == len(chunk[1]):
            continue
        chars = b"".join(got)
        if is_ssh_key(decoded(chars) or b""):
            return padded(data, end, len(chars))
    return None


# --- web tokens -------------------------------------------------------------------------------


def json_object(chars: bytes) -> dict | None:
    try:
        value = json.loads(decoded(chars) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_web_token(segments: list[bytes]) -> bool:
    head = json_object(segments[0])
    alg = head.get("alg") if head else None
    if not isinstance(alg, str):
        return False
    if len(segments) == 5:
        binary = [decoded(s) for s in segments[1:]]
        return isinstance(head.get("enc"), str) and None not in binary and all(binary[1:])
    signature = decoded(segments[-1]) if len(segments) == 3 else None
    if not signature or json_object(segments[1]) is None:
        return False
    return len(signature) in _SIGNED.get(alg, ()) or (alg in _RSA_SIGNED and len(signature) >= 128)


# --- spans ------------------------------------------------------------------------------------


def byte_spans(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes, in no order."""
    for m in _ASSIGN.finditer(data.lower()):
        if m.end(1) - m.start(1) >= 12:
            yield m.start(), 0, m.end()
    for number, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(data):
            yield m.start(), number, m.end()
    for m in _HEX_KEY.finditer(data):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0].decode())):
            yield m.start(), 3, m.end()
    for number, pattern, parse in ((3, _DER, der_at), (4, _SSH, ssh_at)):
        at = 0
        while m := pattern.search(data, at):
            end = parse(data, m.start())
            if end is not None:
                yield m.start(), number, end
            at = end or m.end()
    for m in _WEB.finditer(data):
        token = m[0].rstrip(b".")
        if is_web_token(token.split(b".")):
            yield m.start(), 5, m.start() + len(token)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    data = text.encode()
    found = sorted(byte_spans(data))
    if len(data) != len(text):
        # Spans start and end beside ASCII characters, so no cut falls inside a character.
        places, at, chars = {}, 0, 0
        for cut in sorted({x for s, _, e in found for x in (s, e)}):
            chars += len(data[at:cut].decode())
            places[cut], at = chars, cut
        found = [(places[s], k, places[e]) for s, k, e in found]
    return [(KINDS[k], s, e) for s, k, e in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return mapped(rows, scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, confirmed ones included."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(written_out(of(BASE)), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans")
    )
