"""Operator 1: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, `://`, plus signs, digits and words
that announce an identifier. At each anchor a local parser expands to both sides and validates
what it got. No parser looks further than its own match, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import each_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Words before an account or identity number. Fixed values.
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "tax id", "sort code", "customer id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`]+")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|id))?\.?\x20?[:#=]?\x20?([A-Za-z]{0,2}[0-9](?:[\x20-]?[A-Za-z0-9]){4,32})(?![A-Za-z0-9])")


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for anchor in ("@", "://", "+", *_DIGITS):
        a.add_word(anchor, (anchor if anchor not in _DIGITS else "0", len(anchor)))
    for cue in CUES:
        for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    return s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in code points, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    after = [0] * len(KINDS)  # end of the last match of each kind
    for last, (anchor, length) in _automaton().iter(text):
        at = last - length + 1
        if anchor == "0":
            if at >= after[2]:
                if m := _CARD.match(text, at):
                    after[2] = m.end()
                    digits = re.sub("[ -]", "", m[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
                else:
                    after[2] = at + 1
            # an address can only begin where a run of digits begins
            if at >= after[1] and (not at or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                after[1] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append((at, 1, m.end()))
        elif anchor == "@":
            begin = at
            while begin > after[0] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                after[0] = m.end()
                out.append((begin, 0, m.end()))
        elif anchor == "+":
            if at >= after[3] and (m := _PHONE.match(text, at)):
                after[3] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif anchor == "://":
            begin = at
            while begin > after[4] and text[begin - 1] in _SCHEME:
                begin -= 1
            if begin < at and text[begin].isalpha() and (m := _URL.match(text, at + 3)):
                end = at + 3 + len(m[0].rstrip(".,;:!?)]}"))
                if end > at + 3:
                    after[4] = end
                    out.append((begin, 4, end))
        elif at >= after[5] and (not at or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            found = re.sub("[ -]", "", m[1])
            if sum(c in _DIGITS for c in found) >= 6 and (not found[:2].isalpha() or iban(found) or len(found) <= 12):
                after[5] = m.end(1)
                out.append((m.start(1), 5, m.end(1)))
    return sorted(out)


def _row(text: str) -> tuple:
    found = find(text)
    told = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
    base = ",".join(x for k, x in told if k < len(BASE))
    counts = [sum(k == b for k, _ in told) for b in range(len(BASE))]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in told))


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every text: doc_id, counts by kind, digest of the base spans, all spans.

    One row for each input row, repeated rows included. A null or empty text has no spans, and
    base_sha256 is then that of the empty string. Very long texts are read whole. Other columns are
    ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_text(schema, _row), "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string"
    )


def redact(text: str) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s, k, e in find(text):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
