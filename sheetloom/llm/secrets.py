"""Operator 5: secrets, by patterns and by the entropy of sliding windows.

Candidate strings are long runs of token characters. A window slides over each one; the counts
of its characters are kept up to date step by step, and with them the sum of c*log2(c), so that
each step costs two table lookups. A candidate is reported when its highest window entropy
reaches the limit of its character class and no allow-list rule knows it as harmless.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import each_text

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
WINDOW = 20
#: Least entropy in bits of the best window, by character class. Fixed values.
LIMITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CLASSES = (("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
#: Harmless shapes: rulers and padding, UUIDs, dates and times.
_ALLOWED = tuple(re.compile(p) for p in (r"(.)\1+", r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", r"[0-9_/=+-]+"))
#: Identifiers and paths, harmless if they are made of words: one case or a capital at the start, vowels, no long run of consonants.
_NAMED = re.compile(r"(?:[A-Za-z]+[_/+=-]+)*[A-Za-z]+[0-9]{0,4}[_/+=-]*")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOWELS, _CLUSTER = re.compile(r"[aeiouyAEIOUY]"), re.compile(r"[^aeiouyAEIOUY]{5}")
_NLOGN = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def window_entropy(s: str, width: int = WINDOW) -> float:
    """Highest Shannon entropy, in bits a character, of the windows of `width` characters of `s`."""
    width = min(width, len(s))
    if not width:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c*log2(c)
    best = 0.0
    for k, c in enumerate(s):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if k >= width:
            old = s[k - width]
            n = counts[old]
            total -= _NLOGN[n] - _NLOGN[n - 1]
            counts[old] = n - 1
        if k >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def wordy(s: str) -> bool:
    """Do the letters of `s` look like words? Two thirds of them must stand in pieces of four or more that could be spoken."""
    spoken = sum(len(p) for p in _PIECE.findall(s) if len(p) >= 4 and 5 * len(_VOWELS.findall(p)) >= len(p) and not _CLUSTER.search(p))
    return 3 * spoken >= 2 * sum(map(str.isalpha, s))


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in _ALLOWED) or bool(_NAMED.fullmatch(s)) and wordy(s)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    candidates = [(m.start(), m.end()) for m in _CANDIDATE.finditer(text)]
    # a run of 24 or more hexadecimal digits lies inside one candidate and ends where it does or at another character
    for b, e in candidates:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, b, e)]
        s = text[b:e]
        kind = next(name for name, p in _CLASSES if p.fullmatch(s))
        if not allowed(s) and window_entropy(s) >= LIMITS[kind]:
            out.append((b, 3, e))
    return sorted(out)


def _row(text: str) -> tuple:
    told = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in find(text)]
    base = ",".join(x for k, x in told if k < len(BASE))
    counts = [sum(k == b for k, _ in told) for b in range(len(BASE))]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in told))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every text: doc_id, counts by kind, digest of the base spans, all spans.

    One row for each input row, repeated rows included. A null or empty text has no spans, and
    base_sha256 is then that of the empty string. The allow-list only holds back spans that the
    entropy adds. Very long texts are read whole. Other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_text(schema, _row), "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string"
    )
