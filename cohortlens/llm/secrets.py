"""Secret scans with structural confirmation.

The base kinds (assignments, access keys, long hex runs) are reported as they
are found.  Beyond them, runs of base64 or hex are decoded and reported only if
their bytes parse: DER key structures whose nested lengths fill the buffer
exactly, private-key files between BEGIN and END lines, and signed tokens whose
header is a JSON object naming an algorithm.

Spans are in code points, end exclusive, over the whole text.  Defined cases:
null text counts as empty; a text without secrets has zero counts and the digest
of the empty string; spans of equal starts (ties) are in the order of their kinds;
a text is scanned whole, in time that grows with its length; rows that repeat a
doc_id or have none are scanned each; an empty table gives an empty result; other
columns are ignored by the scan and kept by ``redact``.
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

from .common import kept_columns, small_batches, table, texts

#: Fixed patterns of the contract; a class for each letter keeps "either case" to ASCII.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in _NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "private_key", "der_key")
_RANK = {k: i for i, k in enumerate(KINDS)}
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: A body goes on to the next five dashes, so that a file without an end costs its own length only.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s\\:,]|-(?!----))*+)-----END \1-----")
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: DER tags of a key: integer, bit string, octet string, null, object identifier, sequence, set, and the context tags (primitive ones: 0x81 is the public key of a PKCS#8 v2 key).
_PRIMITIVE = {2, 3, 4, 5, 6, 0x80, 0x81, 0x82, 0x83}
_NESTED = {0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, start: int, stop: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the values that fill b[start:stop] exactly, or None."""
    out = []
    while start < stop:
        if start + 2 > stop:
            return None
        tag, n, at = b[start], b[start + 1], start + 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > stop:
                return None
            n, at = int.from_bytes(b[at : at + size], "big"), at + size
        if at + n > stop:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_key(b: bytes) -> bool:
    """A sequence that fills the buffer, every nested length fits, and it has a key's parts: a version or an encryption's algorithm, and key bytes."""
    top = der_items(b, 0, len(b)) if len(b) >= 24 and b[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    todo, parts = [(*top[0], 0)], []
    while todo:
        tag, a, z, depth = todo.pop()
        if tag in _NESTED:
            inner = der_items(b, a, z)
            if inner is None or depth > 16:
                return False
            todo += [(*x, depth + 1) for x in inner]
        elif tag in _PRIMITIVE:
            parts.append((tag, z - a, depth))
        elif tag >= 0x20:
            return False
    first = der_items(b, top[0][1], top[0][2])
    version = bool(first) and first[0][0] == 2 and first[0][2] - first[0][1] == 1
    return (version or is_encrypted(b, first)) and any(tag in (2, 3, 4) and n >= 16 for tag, n, _ in parts)


def is_encrypted(b: bytes, items: list[tuple[int, int, int]]) -> bool:
    """An encrypted PKCS#8 key: an algorithm with parameters of its own (a digest's are null or absent), and its octets."""
    if [tag for tag, _, _ in items] != [0x30, 4] or items[1][2] - items[1][1] < 16:
        return False
    return [tag for tag, _, _ in der_items(b, items[0][1], items[0][2]) or []] == [6, 0x30]


def is_key_bytes(b: bytes) -> bool:
    return b.startswith(b"openssh-key-v1\0") or is_der_key(b)


def is_signed_token(head: str, body: str) -> bool:
    """The header decodes to a JSON object with an algorithm, and the body to JSON."""
    raw = unbase64(head)
    if not raw or raw[:1] != b"{":
        return False
    try:
        obj = json.loads(raw)
        json.loads(unbase64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(obj, dict) and isinstance(obj.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], _RANK[x[2]]))


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "." in text:
        found += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if (b := unbase64(re.sub(r"[^A-Za-z0-9+/=]", "", m[2].replace("\\n", "").rsplit("\n\n", 1)[-1]))) and is_key_bytes(b):
                found.append((m.start(), m.end(), "private_key"))
    for m in RUN64.finditer(text):
        s = m[0]
        if (s[0] == "M" or s.startswith("b3BlbnNzaC1rZXktdjE")) and (b := unbase64(s)) and is_key_bytes(b):
            found.append((m.start(), m.end(), "der_key"))
    for m in RUN16.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), "der_key"))
    return found


def find_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans, in order."""
    base = base_spans(text)
    return base, sorted(base + confirmed_spans(text), key=lambda x: (x[0], _RANK[x[2]], x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (a string) and n_spans; one row a document."""
    small_batches(docs.sparkSession)
    kinds = KINDS[:3]
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                base, spans = find_spans(text)
                counts = [sum(x[2] == k for x in base) for k in kinds]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    ddl = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"
    return kept_columns(docs, "doc_id", "text").mapInArrow(run, ddl)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; spans that overlap are joined."""
    out, at = [], 0
    for a, z, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, z)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with every secret in text replaced by its kind; n_chars, if there is one, follows."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t and mask(t, find_spans(t)[1]) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [n if t == o else len(t) for n, t, o in zip(cols[k].to_pylist(), new, old, strict=True)]
                cols[k] = pa.array(sizes, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("n_spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_secret_scan(spark, sf_dir).drop("spans")


#: Each match of a pattern is the first occurrence of its own text after the end of the match before it.
BASE_SQL = rf"""
with recursive d as (select doc_id, coalesce(text, '') as text from documents),
p(kind, k, pattern) as (values ('assign', 0, '{ASSIGN.pattern.replace("'", "''")}'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{{24,}}')),
m as (select doc_id, kind, k, text, case k when 0 then regexp_extract_all(text, (select pattern from p where k = 0)) when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]+') else regexp_extract_all(text, '[0-9a-f]{{24,}}') end as l from d, p),
r(doc_id, kind, k, text, l, i, a, z) as (
  select doc_id, kind, k, text, l, 0, 0::bigint, 0::bigint from m where len(l) > 0
  union all select doc_id, kind, k, text, l, i + 1, z + instr(substr(text, z + 1), l[i + 1]) - 1, z + instr(substr(text, z + 1), l[i + 1]) - 1 + length(l[i + 1]) from r where i < len(l)),
s as (select * from r where i > 0 and (k <> 1 or z - a >= 20) and (k <> 0 or length(regexp_extract(l[i], '^(?:{_EITHER})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6)),
n as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || a || ':' || z, ',' order by a, k) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join n using (doc_id)
"""

QUERIES = {"op10_secret_scan": op10_secret_scan, "secret_base_spans": secret_base_spans}
ORACLES = {"secret_base_spans": BASE_SQL}
