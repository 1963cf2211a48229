"""Text, path, hash and validation columns of the note engine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space and line ends that trimming and splitting know.
BLANK = r"\t\x20\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
NEWLINE = r"\n-\r\u0085\u2028\u2029"
SPACE = rf"[{BLANK}{NEWLINE}]"
#: The same, one by one.
SPACES = "\t \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\n\x0b\x0c\r\u0085\u2028\u2029"
BLANKS = "\t \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
# Where sentences end.
SENTENCE_END = ".!?;。！？"
# Words for the three actions.
ACTIONS = {
    "added": ["added", "add", "created", "create"],
    "modified": ["modified", "modify", "changed", "updated", "update"],
    "deleted": ["deleted", "delete", "removed", "remove"],
}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it names several times, but which is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space and line ends around it."""
    return F.trim(c, F.lit(SPACES))


def is_ascii(c: Column) -> Column:
    """Whether all characters are ASCII: told by counting bytes, without a search."""
    return F.octet_length(c) == F.char_length(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


# The marks of emphasis, headings and quotes, and white space. Latin characters stand one by one, as Java
# tells those by one look at a table; only characters from U+1680 on are held against the others.
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_ODD = rf"[*_~#>\t\n\x0b\x0c\r\x85\xa0{_WIDE}]"
#: Runs of marks and white space, but for one space alone.
_ASCII_RUNS = r"[*_~#>\t\n\x0b\x0c\r][*_~#>\t\n\x0b\x0c\r\x20]*+|\x20[*_~#>\t\n\x0b\x0c\r\x20]++"
_RUNS = rf"{_ODD}[*_~#>\t\n\x0b\x0c\r\x20\x85\xa0{_WIDE}]*+|\x20[*_~#>\t\n\x0b\x0c\r\x20\x85\xa0{_WIDE}]++"


def _without_wiki_links(c: Column) -> Column:
    # A wiki link gives its alias, or its target where the alias is blank; both end before the first "]]".
    c = F.regexp_replace(c, rf"!?\[\[(?:(?!\]\]|\|).)*\|{SPACE}*((?:(?!\]\]).)*?(?!\]\])[^{BLANK}{NEWLINE}]){SPACE}*\]\]", "$1")
    return F.regexp_replace(c, rf"!?\[\[{SPACE}*((?:(?!\]\]|\|).)*?){SPACE}*(?:\|{SPACE}*)?\]\]", "$1")


def inline_normalised(c: Column) -> Column:
    """Markdown inline marks resolved: wiki links, links, code, emphasis; white space collapsed.

    Patterns of links and code are tried only on texts that can have them. ``c`` is named several times.
    What is left of white space are single spaces.
    """
    spans = lambda x: F.regexp_replace(F.regexp_replace(x, r"\[(.*?)\]\((.*?)\)", "$1"), r"`([^`]*)`", "$1")
    runs = lambda x: F.trim(F.when(is_ascii(c), F.regexp_replace(x, _ASCII_RUNS, " ")).otherwise(F.regexp_replace(x, _RUNS, " ")))
    return (
        F.when(F.contains(c, F.lit("[[")), runs(spans(_without_wiki_links(c))))
        .when(F.contains(c, F.lit("](")) | F.contains(c, F.lit("`")), runs(spans(c))).otherwise(runs(c)))


def normalised_again(c: Column) -> Column:
    """:func:`inline_normalised` of a trimmed piece of a normalised text: what is left to do is links and code that came about."""
    return F.when(F.contains(c, F.lit("[[")) | F.contains(c, F.lit("](")) | F.contains(c, F.lit("`")), inline_normalised(c)).otherwise(c)


def sentences(c: Column, normalised: bool = False) -> Column:
    """An array of sentences, cut after every end mark; blank ones are left out. Normalised texts have no white space but spaces."""
    bare = (lambda s: F.trim(s)) if normalised else trimmed  # F.trim itself would get a place as its second argument
    flat = c if normalised else trimmed(F.replace(c, F.lit("\n"), F.lit(" ")))
    wide = [e for e in SENTENCE_END if e > "\xff"]
    cut = lambda t, ends: F.regexp_extract_all(t, F.lit(f"[^{ends}]*+[{ends}]|[^{ends}]+$"), F.lit(0))
    # Latin ends alone are told by one look at a table.
    latin = "".join(e for e in SENTENCE_END if e not in wide)
    some = lambda t: F.when(reduce(or_, [F.contains(t, F.lit(e)) for e in wide]), cut(t, SENTENCE_END)).otherwise(cut(t, latin))
    parts = once(flat, some)
    return F.filter(F.transform(parts, bare), lambda s: s != "")


def query_terms(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.filter(F.split(F.lower(trimmed(c)), rf"{SPACE}+"), lambda t: F.length(t) >= 2)


def action_of(c: Column) -> Column:
    """added, modified or deleted from its synonyms in any case; null for anything else."""
    word = F.lower(trimmed(c))
    out = F.lit(None).cast("string")
    for action, names in ACTIONS.items():
        out = F.when(word.isin(names), action).otherwise(out)
    return out


def path_parts(c: Column) -> Column:
    slashed = F.replace(trimmed(c), F.lit("\\"), F.lit("/"))
    return F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))


def path_of(c: Column) -> Column:
    """A relative path with forward slashes and no empty or ``.`` parts; null if it is not allowed.

    Not allowed: blank, absolute, with a ``..`` part or a NUL, or longer than 2048 characters in the end.
    """
    slashed = F.replace(trimmed(c), F.lit("\\"), F.lit("/"))
    path = F.array_join(path_parts(c), "/")
    bad = (path == "") | slashed.startswith("/") | F.contains(c, F.lit("\0")) | (F.length(path) > 2048) | F.array_contains(F.split(slashed, "/"), "..")
    return F.when(~bad, path)


def vault_uid_of(c: Column) -> Column:
    """A trimmed vault id; null if blank, ``.``, ``..``, with a slash, backslash or NUL, or over 255 characters."""
    uid = trimmed(c)
    bad = (uid == "") | uid.isin(".", "..") | uid.rlike(r"[/\\\x00]") | (F.length(uid) > 255)
    return F.when(~bad, uid)


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[^/\\])\.[^./\\]+$", "")


def file_stem(c: Column) -> Column:
    return without_extension(F.regexp_extract(c, r"([^/]*)/?$", 1))


def link_target(c: Column) -> Column:
    """What a wiki link to the file says; expects composed characters (see :func:`nfc`)."""
    return F.replace(without_extension(c), F.lit("\\"), F.lit("/"))


#: Characters that may compose with others: all but Latin, Cyrillic, punctuation, kana, Han, Hangul syllables. Most are told by the first range.
_COMPOSING = r"[\u0300-\x{10ffff}&&[^\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff60]]"


def nfc(c: Column) -> Column:
    """Canonical composition, by the ICU library that comes with Spark; only of texts that may need it."""
    made = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(is_ascii(c), c).when(~c.rlike(_COMPOSING), c).when(c.isNotNull(), made)


# The public constants of FNV-1a with 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_FNV_BLOCK = 1 << 16


def fnv1a64_of(data: bytes, state: int = FNV_START) -> int:
    """FNV-1a of ``data``, carried on from ``state``, so that a long file can be read piece by piece.

    Only the low byte of the state meets a byte of the data, and bit k of a product with an odd
    number depends on the bits up to k. So the low bytes are found bit by bit, as running
    exclusive-ors over all positions; what they add to the state is then one sum of multiples of
    powers of the prime.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), _FNV_BLOCK):
        part = raw[at : at + _FNV_BLOCK].astype(np.int64)
        low = state & 0xFF
        mixed = np.zeros(len(part), dtype=np.int64)  # (low byte before) xor (byte), by rising bits
        for k in range(8):
            carried = ((mixed * (FNV_PRIME & 0xFF)) >> k) & 1  # what the bits below add to bit k of the product
            given = (part >> k) & 1
            steps = np.append((low >> k) & 1, (given ^ carried)[:-1])
            mixed |= (np.bitwise_xor.accumulate(steps) ^ given) << k
        before = mixed ^ part
        powers = np.multiply.accumulate(np.full(len(part), FNV_PRIME, dtype=np.uint64))
        total = ((mixed - before).astype(np.uint64) * powers[::-1]).sum(dtype=np.uint64)
        state = (int(total) + state * int(powers[-1])) & 0xFFFFFFFFFFFFFFFF
    return state


@F.pandas_udf(T.StringType())
def fnv1a64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of bytes as 16 hexadecimal digits; Spark's integers don't wrap around."""
    for s in batches:
        yield s.map(lambda data: f"{fnv1a64_of(data):016x}", na_action="ignore")


def base64_of(data: Column) -> Column:
    """Base64 in one line; Spark's own function breaks it into several."""
    return F.translate(F.base64(data), "\r\n", "")


def strict_base64(c: Column) -> Column:
    """The bytes of a base64 text; null if it isn't strictly one (padded, nothing else in it)."""
    ok = c.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(c) % 4 == 0)
    return F.when(ok, F.unbase64(F.when(ok, c)))


def text_of(data: Column) -> Column:
    """Bytes as text if they look like it: valid UTF-8 with at most 5 % control characters. Empty bytes are ''."""
    text = F.try_validate_utf8(data.cast("string"))
    odd = F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}&&[^\t\n\r]]"))
    return F.when(text == "", "").when(odd <= F.length(text) * 0.05, text)


def digest_of(data: Column) -> Column:
    return F.sha2(data, 256)


def masked_key(key: Column, prefix: str = "key_") -> Column:
    """An API key with its first four characters after the prefix shown and 60 stars."""
    bare = F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 4)).otherwise(F.substring(key, 1, 4))
    return F.concat(F.lit(prefix), bare, F.lit("*" * 60))


def highlighted(c: Column, query: str) -> Column:
    """HTML-escaped text with every occurrence of the query's terms, in any case, between mark tags.

    Longer terms first, so that of two that start together the longer one is marked.
    """
    terms = sorted({t for t in query.lower().split() if len(t) >= 2}, key=lambda t: (-len(t), t))
    safe = html_escaped(c)
    if not terms:
        return safe
    escaped = [re.escape(t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for t in terms]
    return F.regexp_replace(safe, f"(?i)({'|'.join(escaped)})", "<mark>$1</mark>")


def masked_setting(c: Column) -> Column:
    """``abcd********wxyz``; stars only if short, ``(not set)`` if empty."""
    v = F.coalesce(c, F.lit(""))
    return F.when(v == "", "(not set)").when(F.length(v) <= 8, "*" * 8).otherwise(F.concat(F.substring(v, 1, 4), F.lit("*" * 8), F.right(v, F.lit(4))))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_of(c: Column) -> Column:
    """Objects and arrays as normalised JSON, any other text as a JSON string; null for blank."""
    c = blank_to_null(c)
    parsed = F.when(c.rlike(r"^[\[{]"), F.try_parse_json(c))
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return F.when(c.isNotNull(), F.coalesce(F.to_json(parsed), quoted))


def matches_any(columns: list[Column], needle: str) -> Column:
    """Case-insensitive search in the non-blank ones of ``columns``, joined by spaces."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])), F.lit(needle.lower()))
