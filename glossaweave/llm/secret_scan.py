"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, then embedded checksums.

One automaton holds the keywords of all kinds. It runs over the whole text, its ASCII letters in lower case; only where
it stops is a pattern tried, with match() at the hit. Long hexadecimal runs have no keyword: they are found as a byte
string in an image of the text that has one byte for hexadecimal digits and another for the rest.

Kinds: assign, access and hex are kept as they match. github and npm tokens are kept if their last six characters are the
base-62 CRC-32 of the thirty before; jwt if its first part is the base64 of a JSON object with "alg"; pem private key
headers have no checksum and are kept with the next footer, however far, unless another header or the text's end comes first.

Defined results: a null text counts as empty; an empty text has no spans. Spans of a kind do not overlap, spans of
different kinds may. Every row is scanned by itself, so repeated rows give repeated results and no shuffle is needed.
Offsets are code points, ends exclusive. An empty table gives an empty result. Very long texts are scanned whole, few at a
time. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}
#: A token whose first run is not followed by a second fails at every place of that run.
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")
FOOTER = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
HEX_RUN = 32
_DIGITS = b"0123456789abcdef"
_IMAGE = bytes(104 if b in _DIGITS else 46 for b in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out.rjust(6, "0")


def _json_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    return kind != "jwt" or _json_header(m[1])


def pem_end(text: str, at: int) -> int:
    """The end of the footer that belongs to the private key header ending at `at`; `at` itself if there is none."""
    header = PATTERNS["pem"].search(text, at)
    footer = FOOTER.search(text, at, header.start() if header else len(text))
    return footer.end() if footer else at


def hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    image, probe, at = raw.translate(_IMAGE), b"h" * HEX_RUN, 0
    while (start := image.find(probe, at)) >= 0:
        end = image.find(b".", start)
        at = len(image) if end < 0 else end
        yield start, at


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then by kind."""
    raw = text.encode("utf-8", "surrogatepass")
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(raw.lower().decode("utf-8", "surrogatepass")):
        start = last - length + 1
        # A match, kept or dropped, uses up its characters for its kind.
        if start < ends[kind]:
            continue
        if not (m := PATTERNS[kind].match(text, start)):
            if kind == "jwt" and text.startswith("eyJ", start):
                ends[kind] = _TOKEN_RUN.match(text, start).end()
        else:
            ends[kind] = pem_end(text, m.end()) if kind == "pem" else m.end()
            if _valid(kind, m):
                spans.append((kind, start, ends[kind]))
    plain, done, chars = text.isascii(), 0, 0
    for start, end in hex_runs(raw):
        at = start
        if not plain:
            chars += len(raw[done:start].decode("utf-8", "surrogatepass"))
            at, done = chars, start
        spans.append(("hex", at, at + end - start))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_scan_batches, SCHEMA)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by the mask."""

    def masked(batches):
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                parts, done = [], 0
                for _, start, end in scan(text or ""):
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = max(done, end)
                out.append(text if not parts else "".join(parts) + text[done:])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(masked, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts, digest of the base spans and all spans of every document."""

    def digested(batches):
        for batch in slices(batches, "text"):
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in rows]
            base = [",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE) for spans in rows]
            counts = [pa.array([sum(k == kind for k, *_ in spans) for spans in rows], pa.int64()) for kind in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(joined, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(digested, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
