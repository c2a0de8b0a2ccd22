"""Secret scan: one Aho-Corasick pass over the text finds keywords, a regular expression anchored at
each hit decides, and kinds with an embedded checksum must also pass it.

Kinds, in the order that breaks ties between spans with one start:

* ``assign`` -- a keyword, ``:`` or ``=`` and a value of 8 or more characters;
* ``access`` -- ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex`` -- 32 or more lower-case hexadecimal digits.  They have no keyword; the text is folded to
  digit / no digit and searched for a run of 32 before the expression is tried there;
* ``github`` and ``npm`` -- tokens whose last 6 characters are the base-62 CRC-32 of the 30 before;
* ``age`` -- secret keys with a bech32 checksum;
* ``xprv`` -- extended private keys with a base58 double SHA-256 checksum.

A null text reads as empty and has no spans; offsets are code points, ends exclusive.  Rows are
independent: repeated rows and ids give repeated results, an empty table gives an empty one, and
columns other than the two named ones are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from railpulse.llm.common import bounded_batches, map_batches, table, utf8

KINDS = ("assign", "access", "hex", "github", "npm", "age", "xprv")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
    "xprv": ("xprv",),
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "age": re.compile(rb"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![0-9A-Za-z])"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: generator of the bech32 checksum: fixed values
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_HEX_FOLD = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


def crc62(payload: bytes) -> str:
    """CRC-32 of ``payload`` as 6 base-62 digits."""
    n, out = zlib.crc32(payload), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def bech32_ok(prefix: str, data: str) -> bool:
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                state ^= g
    return state == 1


def base58check_ok(text: str, size: int) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 8 * size:
        return False
    raw = n.to_bytes(size, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def valid(kind: str, m: re.Match) -> bool:
    """Whether a match of ``kind`` is long enough or passes its checksum."""
    if kind == "assign":
        return len(m[1]) >= MIN_VALUE
    if kind == "access":
        return m.end() - m.start() >= MIN_ACCESS
    if kind == "hex":
        return m.end() - m.start() >= MIN_HEX
    if kind in ("github", "npm"):
        return crc62(m[1]) == m[2].decode()
    if kind == "age":
        return bech32_ok("age-secret-key-", m[1].decode().lower())
    return base58check_ok(m[0].decode(), 82)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in UTF-8 ``data``, in code points, by start, then kind."""
    found: list[tuple[int, int, str]] = []
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last + 1 - size)
    for kind, starts in hits.items():
        done = 0
        for at in sorted(starts):
            if at >= done and (m := PATTERNS[kind].match(data, at)):
                done = m.end()
                if valid(kind, m):
                    found.append((at, done, kind))
    folded, at = data.translate(_HEX_FOLD), 0
    while (at := folded.find(b"h" * MIN_HEX, at)) >= 0:
        m = PATTERNS["hex"].match(data, at)
        found.append((at, m.end(), "hex"))
        at = m.end()
    if not found:
        return []
    if not data.isascii():
        points, at, seen = {}, 0, 0
        for x in sorted({x for s, e, _ in found for x in (s, e)}):
            seen += len(data[at:x].decode())
            points[x], at = seen, x
        found = [(points[s], points[e], k) for s, e, k in found]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [(k, s, e) for s, e, k in found]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row of ``docs``; spans: array of (kind, start, end)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(x)] for x in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, spans)], names=[id_col, "spans"])

    return map_batches(docs.select(id_col, text_col), rows,
                       f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]`` (overlapping spans by one), and the character
    count, if there is such a column, made to fit.  All rows, columns and types stay; null stays null."""
    bounded_batches(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    count = schema.fieldNames().index(chars_col) if chars_col in schema.fieldNames() else None

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        texts, counts = cols[at].to_pylist(), None if count is None else cols[count].to_pylist()
        for i, x in enumerate(utf8(cols[at])):
            if spans := scan(x):
                out, done, text = [], 0, texts[i]
                for _, s, e in spans:
                    if s >= done:
                        out += [text[done:s], "[SECRET]"]
                    done = max(done, e)
                texts[i] = "".join([*out, text[done:]])
                if counts is not None:
                    counts[i] = len(texts[i])
        cols[at] = pa.array(texts, cols[at].type)
        if counts is not None:
            cols[count] = pa.array(counts, cols[count].type)
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_batches(docs, rows, schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``: counts, digest of the base kinds, all spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column(1).to_pylist()]
        base = [[s for s in x if s[0] in KINDS[:3]] for x in got]
        counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
        digests = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base])
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(map(joined, got), pa.string())],
                                          names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(found, rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                    "base_sha256 string, spans string")
