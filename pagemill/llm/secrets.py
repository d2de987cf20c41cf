"""Secret scan with structural confirmation.

The JVM's regular expressions keep texts with a candidate; only those go to Python. A candidate is reported when its
structure holds: private keys must decode from base64 or hex to nested DER lengths of a known key form or to the length-
prefixed fields of an OpenSSH key, those encrypted under a DEK-Info header must have whole cipher blocks, signed tokens must have a JSON header that names an algorithm and a JSON payload,
access key ids must decode from base32, and other hex or base64 strings must decode to a usual key size with well mixed
bytes, 12 at least, and be assigned to a name such as token or secret. Digests and long words without such structure are left alone.

Defined results: null and empty texts hold none; overlapping finds give the first kind of KINDS; each repeated row is
reported; offsets are in characters; a null doc_id is reported as null; long texts are searched whole, in time that
follows their length and finds; an empty table gives no rows; scan() ignores other columns, redact() keeps them with
their types and brings n_chars up to date where there is such a column of whole numbers.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship

FOUND = "doc_id bigint, kind string, start bigint, end bigint, detail string, digest string"
KINDS = ("private_key", "signed_token", "access_key_id", "assigned_hex", "assigned_base64")
MARK = "[secret]"
#: Texts without a match of this hold no candidate.
CANDIDATE = r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z2-7]{16}|[A-Za-z0-9+/_=\-]{24}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{2,}\.|-----BEGIN"
_PEM = re.compile(r"(?s)-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:(?!-----).)*)-----END \1PRIVATE KEY-----")
#: Line ends and slashes as strings of JSON and of programs write them.
_ESCAPED = re.compile(r"\\+([nrt/])")
_HEADERS = re.compile(r"\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)*)")
_DEK = re.compile(r"(?m)^DEK-Info:\s*[A-Z0-9-]+,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$")
_TOKEN = re.compile(r"(?<![\w.-])(eyJ[\w-]{8,})\.([\w-]{2,})\.([\w-]*)")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z2-7]{16}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![\w+/-])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![\w+/=-])")
_BASE64 = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{24,}={0,2}(?![\w+/=-])")
_NAMED = re.compile(r"(?i)(?:token|secret|passw\w*|pwd|api[_-]?key|[_-]key|\bkey|auth\w*|bearer|credential\w*)(?:[_.-][a-z0-9]+)*[\"']?\s{0,3}(?:[=:]|=>|:=|\bis\b)?\s{0,3}[\"']?$")
#: Characters before a candidate in which its name is looked for.
BEFORE = 256


def tlv(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the DER value at a place, or nothing where its length doesn't fit."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(b) else None


def children(b: bytes, first: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill first to end without a gap."""
    out = []
    while first < end:
        v = tlv(b[:end], first)
        if v is None:
            return None
        out.append(v)
        first = v[2]
    return out


def key_form(b: bytes) -> str | None:
    """Which private key these bytes encode."""
    if b.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        for k in range(6):  # cipher, derivation, its options, number of keys, public key, private part
            if at + 4 > len(b):
                return None
            n = int.from_bytes(b[at : at + 4], "big")
            at += 4 if k == 3 else 4 + n
            fields += 1
        return "openssh" if at == len(b) else None
    top = tlv(b)
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return None
    parts = children(b, top[1], top[2])
    if not parts or parts[0][0] != 0x02:
        return None
    tags = [p[0] for p in parts]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "rsa"
    if len(tags) == 6 and set(tags) == {0x02}:
        return "dsa"
    if tags[:3] == [0x02, 0x30, 0x04]:
        inner = children(b, parts[1][1], parts[1][2])
        return "pkcs8" if inner and inner[0][0] == 0x06 else None
    if tags[:2] == [0x02, 0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and parts[1][2] - parts[1][1] in (28, 32, 48, 66):
        return "ec"
    return None


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str):
    raw = unbase64(part)
    try:
        return json.loads(raw) if raw else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None


def mixed(b: bytes) -> bool:
    """Whether bytes look drawn at random: most are different, and they aren't text."""
    return len(b) >= 12 and len(set(b)) >= min(len(b) * 0.7, 100) and sum(31 < x < 127 for x in b) < len(b) * 0.85


def pem_form(label: str, body: str) -> str | None:
    """Which private key stands between the lines of a PEM block."""
    body = re.sub(r"\r\n?", "\n", _ESCAPED.sub(lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), body))
    headers = _HEADERS.match(body)
    raw = unbase64(re.sub(r"\s", "", body[headers.end() :]))
    if not raw:
        return None
    dek = _DEK.search(headers[1])
    if dek and re.search(r"(?m)^Proc-Type:\s*4,\s*ENCRYPTED\s*$", headers[1]):
        return "encrypted" if len(raw) >= 32 and len(raw) % (len(dek[1]) // 2) == 0 else None
    return key_form(raw) or ("encrypted" if "ENCRYPTED" in label and tlv(raw) and tlv(raw)[2] == len(raw) else None)


def secrets(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of all confirmed secrets, in order."""
    if not text:
        return []
    found: list[tuple[int, str, int, int, str]] = []
    for m in _PEM.finditer(text):
        if form := pem_form(m[1], m[2]):
            found.append((0, KINDS[0], m.start(), m.end(), form))
    for m in _TOKEN.finditer(text):
        head, body = _json(m[1]), _json(m[2])
        if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict):
            found.append((1, KINDS[1], m.start(), m.end(), head["alg"]))
    for m in _ACCESS.finditer(text):
        if len(base64.b32decode(m[0][4:])) == 10:
            found.append((2, KINDS[2], m.start(), m.end(), m[0][:4]))
    for k, pattern in ((3, _HEX), (4, _BASE64)):
        for m in pattern.finditer(text):
            s = m[0]
            if k == 3 and len(s) % 2:
                continue
            raw = bytes.fromhex(s) if k == 3 else unbase64(s)
            if not raw:
                continue
            if len(raw) > 30 and (form := key_form(raw)):
                found.append((0, KINDS[0], m.start(), m.end(), form))
            elif mixed(raw) and _NAMED.search(text[max(0, m.start() - BEFORE) : m.start()]) and (k == 3 or (re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search(r"\d", s))):
                found.append((k, KINDS[k], m.start(), m.end(), f"{len(raw)} bytes"))
    starts: list[int] = []
    out: list[tuple[str, int, int, str]] = []  # in order, none over another
    for _, kind, a, b, detail in sorted(found):
        k = bisect.bisect(starts, a)
        if (not k or out[k - 1][2] <= a) and (k == len(out) or b <= out[k][1]):
            starts.insert(k, a)
            out.insert(k, (kind, a, b, detail))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """All confirmed secrets; digest tells equal ones without showing them. Narrow: nothing is shuffled."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc_id, kind, a, b, detail, hashlib.sha256(text[a:b].encode()).hexdigest()[:16]) for kind, a, b, detail in secrets(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], ["doc_id", "kind", "start", "end", "detail", "digest"])

    return docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)).mapInArrow(run, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """All rows with all their columns; a mark stands in place of each confirmed secret."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            found, parts, at = secrets(text), [], 0
            for _, a, b, _ in found:
                parts += [text[at:a], MARK]
                at = b
            return "".join([*parts, text[at:]])

        return texts.map(one, na_action="ignore")

    # texts without a candidate are null on their way to Python and stay as they are
    suspect = F.when(F.col("text").rlike(CANDIDATE), F.col("text"))
    out = docs.withColumn("text", F.coalesce(clean(suspect), "text"))
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("smallint", "int", "bigint"):
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
