"""Secret scans: keyword automaton, anchored expressions at its hits, embedded checksums.

An Aho-Corasick automaton runs over the lower-cased bytes of runs of documents; only at its hits an expression
is tried, anchored there. Runs of hexadecimal digits have no keyword and are found by their length. Kinds:

- assign: a keyword, optional quote, `:` or `=`, optional quote, and a value of at least 8 characters
- access: `AKIA` and capital letters or digits, at least 16 characters in all
- hex: at least 32 characters [0-9a-f]
- github, npm: a prefix and 36 base-62 digits, of which the last six are the CRC-32 of the others; a token
  whose checksum does not hold is none

Matches of assign and access are leftmost and do not overlap within a kind; a match that is too short is
dropped but its text stays used. Positions are code points, ends exclusive. Null text is empty. A document
never takes part in its neighbour's matches. A text is scanned by one task as a whole, however long. An empty table gives an empty
one. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import slices

KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})"), "npm": re.compile(rb"npm_([A-Za-z0-9]{36})")}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True


def checksum_holds(token: bytes) -> bool:
    """The last six base-62 digits are the CRC-32 of the digits before."""
    n = zlib.crc32(token[:-6])
    told = 0
    for c in token[-6:]:
        told = told * 62 + DIGITS.index(c)
    return told == n


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(automaton, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, kind, start byte, end byte) of all spans in a run of rows, kinds in turn for a row not guaranteed."""
    raw = data.tobytes()
    ends, free = offs[1:], {}
    hits = [(i - n + 1, i, kind) for i, (kind, n) in automaton.iter(raw.lower().decode("latin-1"))]
    for start, last, kind in sorted(hits):
        row = int(np.searchsorted(ends, start, "right"))
        stop = int(ends[row])
        if last >= stop or start < free.get(kind, 0):
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, start, stop)
            good = m and m.end(2) - m.start(2) >= 8
        elif kind == "access":
            m = ACCESS.match(raw, start, stop)
            good = m and m.end() - m.start() >= 16
        else:
            m = CHECKED[kind].match(raw, start, stop)
            good = m and checksum_holds(m[1])
        if m:
            if good or kind in ("assign", "access"):
                free[kind] = m.end()
            if good:
                yield row, KINDS.index(kind), start, m.end()
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = HEX[data]
    edges = offs[(offs > 0) & (offs < len(data))]
    first = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    last = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if len(edges):  # runs end where a row ends
        cut = edges[HEX[data[edges - 1]] & HEX[data[edges]]]
        first, last = np.unique(np.concatenate([first, cut])), np.unique(np.concatenate([last, cut]))
    long = last - first >= 32
    for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
        yield int(np.searchsorted(ends, a, "right")), KINDS.index("hex"), a, b


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_checked."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, empty = _automaton(), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                n = np.zeros((hi - lo, len(KINDS)), np.int64)
                digest, spans, by_row = [empty] * (hi - lo), [""] * (hi - lo), {}
                for row, k, a, b in find(automaton, data, offs):
                    by_row.setdefault(row, []).append((a, k, b))
                    n[row, k] += 1
                if by_row:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for row, found in by_row.items():
                    zero = points[offs[row]]
                    said = [(k, f"{KINDS[k]}:{points[a] - zero}:{points[b] - zero}") for a, k, b in sorted(found)]
                    spans[row] = ",".join(s for _, s in said)
                    digest[row] = hashlib.sha256(",".join(s for k, s in said if k < 3).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(n[:, k]) for k in range(3)), pa.array(digest), pa.array(spans), pa.array(n[:, 3:].sum(1))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
