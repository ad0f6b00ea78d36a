"""KEY: VALUE text as ordered arrays of (key, value), unique by key, first one wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import KEY_ALIASES
from .text import let, nonempty, strip

KV = "array<struct<key:string,value:string>>"
#: A key begins with a letter; it holds letters, digits, blanks, slashes, ampersands and dashes.
_KEY = r"(?U)^[A-Za-z][A-Za-z0-9\s/&-]*$"
_LONGEST = 30


def normalize_key(c: Column) -> Column:
    key = F.upper(strip(c))
    known = F.create_map(*[F.lit(x) for pair in KEY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), key)


def _halves(line: Column, at: Column) -> Column:
    """What stands before and after the character at `at`, and the untrimmed part after it; null at 0."""
    rest = F.substring(line, at + 1, F.length(line))
    return F.when(at > 0, F.struct(strip(F.substring(line, F.lit(1), at - 1)).alias("key"), rest.alias("rest"), strip(rest).alias("value")))


def _pair(halves: Column) -> Column:
    """The halves as a pair, if the first can be a key and the second says something."""
    fits = F.length(halves["key"]).between(1, _LONGEST) & (halves["value"] != "") & halves["key"].rlike(_KEY)
    return F.when(fits, F.struct(normalize_key(halves["key"]).alias("key"), halves["value"].alias("value")))


def _parsed(lines: Column) -> Column:
    """(key, value) of each line of an array, or null.

    A line is cut at its first colon; if that gives no pair, at its first dash, which a blank
    must follow; if that gives none either, at its first equals sign. Each step names its result once.
    """
    cuts = F.transform(
        F.transform(lines, strip),
        lambda x: F.struct(*[_halves(x, F.instr(x, sep)).alias(name) for name, sep in (("colon", ":"), ("dash", "-"), ("equals", "="))]),
    )
    spaced = lambda h: F.length(h["rest"]) > F.length(h["value"])  # noqa: E731  the line ends without blanks
    return F.transform(cuts, lambda c: F.coalesce(_pair(c["colon"]), F.when(spaced(c["dash"]), _pair(c["dash"])), _pair(c["equals"])))


def parse_line(c: Column) -> Column:
    """(key, value) of one line, or null. A key of over 30 characters lets the next separator try."""
    return F.get(_parsed(F.array(c)), F.lit(0))


def first_wins(pairs: Column) -> Column:
    named = let(pairs, lambda p: F.struct(p.alias("pairs"), F.transform(p, lambda e: e["key"]).alias("keys")))
    return let(named, lambda n: F.filter(n["pairs"], lambda e, i: F.array_position(n["keys"], e["key"]) == i + 1))


def _pairs(lines: Column) -> Column:
    return F.filter(_parsed(lines), lambda e: e.isNotNull())


def parse_kv(c: Column) -> Column:
    """All pairs of a text; lines are cut at `|` too. Null and text without pairs: an empty array."""
    return F.coalesce(first_wins(_pairs(F.split(c, r"[\n|]"))), F.array().cast(KV))


def line_pairs(c: Column) -> Column:
    """(line, pair) of every line of a text, not cut at `|`; pair is null where the line isn't one."""
    return let(F.transform(F.split(c, "\n"), strip), lambda x: F.arrays_zip(x.alias("line"), _parsed(x).alias("pair")))


def multi_of(lines: Column) -> Column:
    """Every value of each key of `line_pairs`, in order."""

    def by_key(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
        return F.transform(
            keys,
            lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda e: e["key"] == k), lambda e: e["value"]).alias("values")),
        )

    found = F.filter(F.transform(lines, lambda e: e["pair"]), lambda p: p.isNotNull())
    return F.map_from_entries(let(F.coalesce(found, F.array().cast(KV)), by_key))


def plain_of(lines: Column) -> Column:
    """The lines of `line_pairs` that aren't blank and aren't pairs."""
    plain = F.filter(lines, lambda e: (e["line"] != "") & e["pair"].isNull())
    return F.coalesce(F.transform(plain, lambda e: e["line"]), F.array().cast("array<string>"))


def parse_kv_multi(c: Column) -> Column:
    return multi_of(line_pairs(c))


def non_kv_lines(c: Column) -> Column:
    return plain_of(line_pairs(c))


def merge_kv(*kvs: Column) -> Column:
    return first_wins(F.concat(*kvs))


def _is(key: str):
    return lambda e: e["key"] == key


def kv_get(kv: Column, *keys: str, default: Column | None = None) -> Column:
    """The value of the first key that is there."""
    found = [F.get(F.filter(kv, _is(k)), F.lit(0))["value"] for k in keys]
    return F.coalesce(*found, *([default] if default is not None else []))


def format_kv(kv: Column, exclude: Column | None = None) -> Column:
    """`K: V | K: V` of the pairs whose key isn't excluded; null if none is left."""
    kept = kv if exclude is None else F.filter(kv, lambda e: ~F.array_contains(exclude, e["key"]))
    return F.nullif(F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | "), F.lit(""))


def has_kv(c: Column) -> Column:
    return F.size(parse_kv(c)) > 0


def details_to_kv(details: Column) -> Column:
    """Pairs of detail rows (key, value), keys normalised, blanks left out."""
    made = F.transform(details, lambda d: F.struct(normalize_key(d["key"]).alias("key"), nonempty(d["value"]).alias("value")))
    return F.coalesce(first_wins(F.filter(made, lambda e: e["value"].isNotNull() & (F.coalesce(e["key"], F.lit("")) != ""))), F.array().cast(KV))
