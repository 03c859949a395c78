"""Secret scan by structural confirmation.

A JVM regular expression keeps the rows that hold any long run of base64 or hex
characters, a PEM header or a token prefix; only these reach Python.  There a
candidate is reported only when its decoded form has the structure of a secret:
nested DER lengths of a private key, the length-prefixed fields of an OpenSSH
key, the JSON header and payload of a signed token with a signature as long as
its algorithm makes it, an account number within an access key id that isn't
assigned to a name, a checksum, or a raw key of LEAST bytes or more that is
assigned to a name such as token or secret, which ends at most NAME_REACH
characters in front of it.  Runs
that are wrapped over lines are joined first, escaped line ends (backslash and n)
count as such.  What decodes to text is searched again, until nothing decodes.

Defined results: null and empty texts give no row; whole texts are searched.
A secret that occurs twice is reported twice, at both places; repeated rows are
reported as often as they occur; a row with a null doc_id is reported with a null.
start and end count characters of the outermost text.  The secret itself is
never returned, only its fingerprint.  No shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernel import mapped

ANY = r"-----BEGIN|eyJ[A-Za-z0-9_-]{8}|AKIA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|[A-Za-z0-9+/_-]{22}"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----(.+?)-----END \1-----", re.S)
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
GITHUB = re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ACCESS = re.compile(r"(?<![A-Za-z0-9])AKIA([A-Z2-7]{16})(?![A-Za-z0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}(?![A-Za-z0-9+/_=-])")
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}(?:[ \t]*\r?\n\s*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
ESCAPED = re.compile(r"\\+[rn]")
HEX = re.compile(r"(?:0x)?([0-9a-fA-F]{2})+\Z")
NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|\bkey)[\w-]{0,20}[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}[\"']?(?:bearer\s)?\Z")
LEAST = 16
NAME_REACH = 60
#: Bytes of a signature by algorithm; those of RSA are as long as the key.
SIGNED = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}} | {a + n: {128, 256, 384, 512, 1024} for a in ("RS", "PS") for n in ("256", "384", "512")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
Found = tuple[int, int, str, str, int, bytes]


def der(raw: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill raw[at:end] exactly, or None."""
    end = len(raw) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n or raw[at] == 0:
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def private_key(raw: bytes) -> str | None:
    """The kind of DER private key that raw is, if it is one."""
    top = der(raw)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    inner = der(raw, top[0][1], top[0][2])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    if tags == [2] * 9 and raw[inner[0][1] : inner[0][2]] == b"\0" and inner[1][2] - inner[1][1] >= 32:
        return "rsa_private_key"
    if tags == [2] * 6 and raw[inner[0][1] : inner[0][2]] == b"\0":
        return "dsa_private_key"
    if tags[:2] == [2, 4] and raw[inner[0][1] : inner[0][2]] == b"\1" and inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66):
        return "ec_private_key"
    if tags[:3] == [2, 0x30, 4] and raw[inner[0][1] : inner[0][2]] in (b"\0", b"\1"):
        name = der(raw, inner[1][1], inner[1][2])
        if name and name[0][0] == 6:
            return "pkcs8_private_key"
    if tags == [0x30, 4]:
        name = der(raw, inner[0][1], inner[0][2])
        if name and name[0][0] == 6 and len(name) > 1:
            return "encrypted_private_key"
    return None


def openssh(raw: bytes) -> str | None:
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return None
    at = len(magic)
    for _ in range(3):
        if len(raw) - at < 4:
            return None
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    if len(raw) - at < 4:
        return None
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    for _ in range(keys + 1 if keys < 16 else 0):
        if len(raw) - at < 4:
            return None
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return "openssh_private_key" if keys and at == len(raw) else None


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1 or ({*"+/"} & {*s} and {*"-_"} & {*s}):
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def signed_token(head: str, body: str, sign: str) -> str | None:
    try:
        header, payload = json.loads(unbase64(head) or b""), json.loads(unbase64(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return None
    raw = unbase64(sign) if sign else b""
    if raw is None:
        return None
    return "signed_token" if len(raw) in SIGNED.get(header["alg"], ()) else None


def account(s: str) -> bool:
    """Whether the base32 of an access key id decodes to ten bytes with an account number, which isn't zero, in front."""
    raw = base64.b32decode(s)
    return len(raw) == 10 and int.from_bytes(raw[:6], "big") >> 7 & (1 << 40) - 1 > 0


def spread(raw: bytes) -> bool:
    """Whether bytes look drawn at random: nearly as many values as a random key has, and no text."""
    n = len(raw)
    return len(set(raw)) >= 256 * (1 - (1 - 1 / 256) ** n) * 0.75 and sum(32 <= b < 127 for b in raw) < 0.85 * n


def drawn(s: str) -> bool:
    """False for names: letters of one case and no digit, which no random key of LEAST bytes is."""
    return any(c.isdigit() for c in s) or (s.lower() != s and s.upper() != s)


def plain_text(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def confirm(raw: bytes) -> str | None:
    return private_key(raw) or openssh(raw)


def wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """The lines, as (start, end), of what may be one run over several lines: all lines that
    follow each other, and those of one length with the shorter one after them, each also
    without its last, which may be a word."""
    for m in BLOCK.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        yield lines
        yield lines[:-1]
        first = 0
        while first < len(lines):
            size, stop = lines[first][1] - lines[first][0], first + 1
            while stop < len(lines) and lines[stop][1] - lines[stop][0] == size:
                stop += 1
            if stop < len(lines) and lines[stop][1] - lines[stop][0] < size:
                yield lines[first : stop + 1]
            yield lines[first:stop]
            first = stop


def scan(text: str, depth: int = 0) -> list[Found]:
    """(start, end, kind, encoding, depth, secret) of each confirmed secret of a text, by place."""
    plain = ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text)
    found = search(plain, depth)
    if plain != text:
        found += [f for f in search(text, depth) if not any(f[0] < b and a < f[1] for a, b, *_ in found)]
    return sorted(found, key=lambda f: f[:4])


def search(text: str, depth: int) -> list[Found]:
    out: list[Found] = []
    taken: list[tuple[int, int]] = []

    def add(m: re.Match, kind: str, encoding: str, secret: bytes) -> None:
        out.append((*m.span(), kind, encoding, depth, secret))
        taken.append(m.span())

    def decode(s: str, start: int, end: int) -> None:
        if any(a < end and start < b for a, b in taken):
            return
        bare = s[2:] if s.startswith("0x") else s
        tries = [("hex", bytes.fromhex(bare))] if HEX.match(s) else []
        if not tries and (raw := unbase64(s)):
            tries.append(("base64", raw))
        for encoding, raw in tries:
            found = []
            if kind := confirm(raw):
                found = [(kind, encoding, depth, raw)]
            elif len(raw) >= LEAST and drawn(s) and spread(raw) and NAMED.search(text[max(0, start - NAME_REACH) : start]):
                found = [("assigned_key", encoding, depth, raw)]
            elif len(raw) >= 20 and (inner := plain_text(raw)):
                found = [(kind, f"{encoding}/{how}", level, secret) for _, _, kind, how, level, secret in scan(inner, depth + 1)]
            out.extend((start, end, *f) for f in found)
            if found:
                taken.append((start, end))

    for m in PEM.finditer(text):
        body = re.split(r"\n[ \r]*\n", m[2])[-1] if "Proc-Type" in m[2] else m[2]
        raw = unbase64(re.sub(r"[\s\\]+", "", body))
        if raw and "Proc-Type: 4,ENCRYPTED" in m[2]:
            kind = "encrypted_private_key" if "PRIVATE KEY" in m[1] and len(raw) % 8 == 0 else None
        else:
            kind = raw and confirm(raw)
        if kind:
            add(m, kind, "pem", raw)
    for m in JWT.finditer(text):
        if kind := signed_token(*m.groups()):
            add(m, kind, "base64url", m[0].encode())
    for m in GITHUB.finditer(text):
        crc, check = zlib.crc32(m[2].encode()), ""
        for _ in range(6):
            crc, r = divmod(crc, 62)
            check = BASE62[r] + check
        if check == m[3]:
            add(m, "checksummed_token", "base62", m[0].encode())
    for m in ACCESS.finditer(text):
        named = NAMED.search(text[max(0, m.start() - NAME_REACH) : m.start()])
        if named or (account(m[1]) and re.search(r"[2-7]", m[1])):
            add(m, "access_key_id", "base32", m[0].encode())
    for lines in wrapped(text):
        if len(lines) > 1:
            decode("".join(text[a:b] for a, b in lines), lines[0][0], lines[-1][1])
    for m in RUN.finditer(text):
        decode(m[0], *m.span())
    return out


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, encoding, depth, n_bytes, fingerprint), a row for each confirmed secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f[:5], len(f[5]), hashlib.sha256(f[5]).hexdigest()[:16]) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for f in scan(t)]
            columns = [*zip(*rows)] or [[]] * 8
            types = [batch.column("id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "start", "end", "kind", "encoding", "depth", "n_bytes", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)])
    for name, kind in (("start", T.IntegerType()), ("end", T.IntegerType()), ("kind", T.StringType()), ("encoding", T.StringType()), ("depth", T.IntegerType()), ("n_bytes", T.IntegerType()), ("fingerprint", T.StringType())):
        schema.add(name, kind)
    likely = docs.where(docs[text].rlike(ANY)).select(docs[key].alias("id"), docs[text].alias("text"))
    return likely.transform(mapped, run, schema).withColumnRenamed("id", key)
