"""Text helpers as Column expressions.

White space and word characters are spelled out as classes, because the Java
shorthands are ASCII-only while the texts are multilingual.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed

SPACE = r"[\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# whether a character is visible ASCII is asked first, as most are, and all of the class takes many times as long
SPACE_RUN = rf"[[^!-~]&&{SPACE}]+"
# the same characters one by one, for the native trim functions
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
WORD_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_pattern(pattern: str) -> str:
    """A fixed pattern with Unicode-aware case folding, spaces and word edges."""
    out = pattern.replace(r"\b", WORD_EDGE).replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
    flags = re.match(r"\(\?([a-z]+)\)", out)
    if flags and "i" in flags.group(1):
        out = f"(?{flags.group(1)}u)" + out[flags.end():]
    return out


def matches(x: str | Column, pattern: str) -> Column:
    """True where the pattern is found anywhere in the text (null counts as no match)."""
    return F.coalesce(col(x).rlike(java_pattern(pattern)), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: str | Column) -> Column:
    return F.btrim(col(x), F.lit(SPACES))


def rstrip(x: str | Column) -> Column:
    return F.rtrim(col(x), F.lit(SPACES))


def lstrip(x: str | Column) -> Column:
    return F.ltrim(col(x), F.lit(SPACES))


def collapse(x: str | Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col(x), SPACE_RUN, " "))


def is_blank(x: str | Column) -> Column:
    return strip(F.coalesce(col(x), F.lit(""))) == ""


def default_if_blank(x: str | Column, default: str | Column) -> Column:
    """The trimmed value, or the default when it is null or blank."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(strip(col(x)), F.lit("")), d)


def tokens(x: str | Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_set(x: str | Column) -> Column:
    return F.array_distinct(tokens(x))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct tokens in common."""
    return F.size(F.array_intersect(a, b))


def split_lines(x: str | Column) -> Column:
    """Lines of a text; a final line end opens no further line, an empty text has none."""
    body = F.regexp_replace(col(x), rf"(?:{LINE_END})\z", "")
    return F.when(col(x) == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def heading_slug(x: str | Column) -> Column:
    """Slug used in chunk ids."""
    s = F.replace(strip(F.lower(col(x))), F.lit(" "), F.lit("_"))
    s = F.regexp_replace(s, r"[^a-z0-9_:-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("chunk"))


def source_slug(x: str | Column, now: str | Column = "") -> Column:
    """Slug used as source id; ``now`` (yyyyMMdd_HHmmss) names a file without usable characters."""
    s = F.regexp_replace(F.lower(strip(col(x))), "[^a-zA-Z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    stamp = F.lit(now) if isinstance(now, str) else now
    return F.coalesce(F.nullif(s, F.lit("")), F.concat(F.lit("library_"), stamp))


def file_slug(x: str | Column) -> Column:
    return F.regexp_replace(col(x), "[^a-zA-Z0-9._-]+", "_")


def compact(x: str | Column, limit: int) -> Column:
    """Collapsed text, cut with an ellipsis above ``limit`` characters."""
    s = collapse(F.coalesce(col(x), F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(
        F.concat(rstrip(F.substring(s, 1, limit - 3)), F.lit("..."))
    )


def clean_line(x: str | Column) -> Column:
    """Dashes and bullets unified, white space collapsed."""
    return collapse(F.translate(col(x), "\u00a0\u2013\u2014\uf0b7", " --\u2022"))


def line_key(x: str | Column) -> Column:
    """Comparison key of a line: edges, case and a trailing number do not count."""
    s = F.lower(F.btrim(collapse(x), F.lit(" |:-")))
    return F.trim(F.regexp_replace(s, r" \p{Nd}+$", ""))


def is_noise_line(x: str | Column) -> Column:
    """Blank, page count, draft mark or contents line."""
    s = F.lower(collapse(x))
    return (s == "") | matches(s, rf"^{fixed.PAGE_LINE_PATTERN}$") | s.isin(*fixed.NOISE_LINES)


def looks_like_table(x: str | Column) -> Column:
    return lstrip(x).startswith("|") & rstrip(x).endswith("|")


def looks_like_list(x: str | Column) -> Column:
    return matches(lstrip(x), r"^([-*+]|\d+\.)\s+")


def is_true_text(x: str | Column) -> Column:
    return F.lower(strip(col(x))).isin("1", "true", "yes", "y")


def decode_bytes(x: str | Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; nothing is lost."""
    return F.coalesce(
        F.try_validate_utf8(col(x).cast("string")), F.decode(col(x), "ISO-8859-1")
    )


def stable_id(x: str | Column) -> Column:
    """63-bit id of a text, the same in every run."""
    return F.pmod(F.conv(F.substring(F.md5(col(x)), 1, 15), 16, 10).cast("bigint"), F.lit(2**63 - 1))


def excerpt(x: str | Column) -> Column:
    """The part of a chunk shown with a search hit."""
    return F.left(col(x), F.lit(fixed.EXCERPT_CHARS))


def fill(template: str, **parts: Column) -> Column:
    """A text with its {named} gaps filled by columns."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(F.coalesce(parts[piece].cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def lookup(x: Column, table: dict[str, str], default: Column) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), default)


def first_word_of(x: Column, words: list[str]) -> Column:
    """True where any of the fixed words occurs in the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def with_previous(items: Column) -> Column:
    """Array of (before, now): each entry with the one ahead of it, null for the first."""
    before = F.slice(F.concat(F.array(F.lit(None)), items), F.lit(1), F.size(items))
    return F.arrays_zip(before.alias("before"), items.alias("now"))


def rounded(x: Column, digits: int) -> Column:
    """The double next to :func:`to_fixed`; only what lies close to a tie is taken apart."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    # scaling errs by far less than this below the limit
    clear = (scaled < 2.0**32) & (F.abs(scaled - F.floor(scaled) - 0.5) > 2.0**-16)
    near = F.floor(scaled + 0.5).cast("double") / F.lit(10.0**digits)
    return F.when(clear, F.when(x < 0, -near).otherwise(near)).otherwise(to_fixed(x, digits).cast("double"))


def to_fixed(x: Column, digits: int, ties_up: bool = False) -> Column:
    """A double with a fixed number of decimals, rounded by its exact binary value.

    Spark's own number formatting rounds the shortest decimal form, which differs where
    that form ends in a five. Here the double is taken apart into whole numbers; an exact
    tie goes to the even digit, or up.
    """
    size = F.abs(x.cast("double"))
    unit = F.when(size < 4, F.lit(2.0**60))
    for top, bits in ((11, 51), (21, 41), (31, 31)):
        unit = unit.when(size < 2**top, F.lit(2.0**bits))
    unit = unit.otherwise(F.lit(1024.0))
    whole = (size * unit).cast("bigint").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(4,0)")
    base = unit.cast("bigint").cast("decimal(19,0)")
    rest = whole % base
    down = ((whole - rest) / base).cast("bigint")
    twice = rest * F.lit(2).cast("decimal(1,0)")
    tie = F.lit(True) if ties_up else down % 2 == 1
    n = down + F.when((twice > base) | ((twice == base) & tie), 1).otherwise(0)
    tail = F.lpad((n % 10**digits).cast("string"), digits, "0")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / 10**digits).cast("string"), F.lit("."), tail)
