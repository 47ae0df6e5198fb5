"""Text of translation units as column expressions: marks, entities, white space. All run inside the JVM."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the wide sense (code points), the secondary class, and the marks of a core.
_SPACES = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x005F, 0x0085, 0x00A0, 0x00B7, 0x0332, 0x0333, 0x2002, 0x2003, 0x2017,
    0x2022, 0x2023, 0x2043, 0x204C, 0x204D, 0x2219, 0x2381, 0x2382, 0x25C9, 0x25D8, 0x25E6, 0x2751, 0x2752, 0xFEFF,
)
# With the characters that are canonically equivalent to them: matching is on the normal form, place by place, and the text stays as it is.
WIDE_SPACE = _SPACES + tuple(c for c in range(0xD800) if c not in _SPACES and all(ord(x) in _SPACES for x in normalize("NFD", chr(c))))
CORE_START, CORE_END = "<mrk mtype='x-coretext'>", "</mrk>"
LEGACY_START, LEGACY_END = "<lt:core>", "</lt:core>"
ENTITIES = (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))

SPACE_CLASS = "[" + "".join(f"\\x{{{c:04x}}}" for c in WIDE_SPACE) + "]"
ANY_CODE = "<[be]?x[^>]*>"
START_PATTERN = "<mrk\\s+mtype=['\"]x-coretext['\"]>"
BARE_AMPERSAND = "&(?!(amp|lt|gt|apos|quot);)"


def guarded(column: Column, has: str, made: Column) -> Column:
    """made where the column contains `has`, else the column: a cheap test before a regular expression."""
    return F.when(column.contains(has), made).otherwise(column)


def escape(column: Column) -> Column:
    for plain, entity in ENTITIES:
        column = F.replace(column, F.lit(plain), F.lit(entity))
    return column


def unescape(column: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        column = F.replace(column, F.lit(entity), F.lit(plain))
    return column


def repair_entities(column: Column) -> Column:
    """Bare ampersands and the four other special characters as entities; a text without any ampersand is left as it is."""
    fixed = F.regexp_replace(column, BARE_AMPERSAND, "&amp;")
    for plain, entity in ENTITIES[1:]:
        fixed = F.replace(fixed, F.lit(plain), F.lit(entity))
    return guarded(column, "&", fixed)


def collapse_space(column: Column) -> Column:
    return F.regexp_replace(column, "\\s+", " ")


def trim_controls(column: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(column, "^[\\x{0000}-\\x{0020}]+|(?<![\\x{0000}-\\x{0020}])[\\x{0000}-\\x{0020}]++\\z", "")


def core_text(column: Column) -> Column:
    """What stands between the marks, up to the last end mark; the whole text where there are none. Soft hyphens go."""
    legacy = F.regexp_extract(column, "(?s)^.*?<lt:core>(.*)</lt:core>", 1)
    marked = F.regexp_extract(column, "(?s)^.*?" + START_PATTERN + "(.*)</mrk>", 1)
    found = F.when(column.rlike("(?s)<lt:core>.*</lt:core>"), legacy).when(column.rlike("(?s)" + START_PATTERN + ".*</mrk>"), marked).otherwise(column)
    return F.replace(found, F.lit("­"), F.lit(""))


def prefix_text(column: Column) -> Column:
    return F.regexp_extract(column, "(?s)^(.*?)(?:" + START_PATTERN + "|<lt:core>)", 1)


def suffix_text(column: Column) -> Column:
    """What follows the first end mark of a marked text."""
    return F.when(column.rlike(START_PATTERN), F.regexp_extract(column, "(?s)^.*?</mrk>(.*)$", 1)).otherwise(F.regexp_extract(column, "(?s)^.*?</lt:core>(.*)$", 1))


def remove_core_marks(column: Column) -> Column:
    legacy = F.replace(F.replace(column, F.lit(LEGACY_START), F.lit("")), F.lit(LEGACY_END), F.lit(""))
    return F.when(legacy.rlike(START_PATTERN), F.replace(F.regexp_replace(legacy, START_PATTERN, ""), F.lit(CORE_END), F.lit(""))).otherwise(legacy)


def remove_merger_marks(column: Column) -> Column:
    return guarded(column, "x-mergeboundary", F.regexp_replace(column, "<mrk\\s[^>]*x-mergeboundary[^>]*>", ""))


def replace_core(full: Column, new: Column) -> Column:
    wrapped = F.concat(F.lit(CORE_START), new, F.lit(CORE_END))
    swapped = F.concat(prefix_text(full), wrapped, suffix_text(full))
    return F.when(new.isNull(), full).when(F.coalesce(full, F.lit("")) == "", wrapped).otherwise(F.when(full.rlike(START_PATTERN + "|<lt:core>"), swapped).otherwise(wrapped))


def is_standalone(column: Column) -> Column:
    return column.rlike("(?s)<x\\s[^>]*/>|<x/>")


def is_translatable(column: Column) -> Column:
    """Something other than wide white space, hyphens and codes."""
    return F.regexp_replace(column, ANY_CODE, "").rlike("[^-" + SPACE_CLASS[1:])


def mark_core(column: Column) -> Column:
    """The core of a text without codes, marked; '' where nothing is to be translated."""
    wide = "".join(map(chr, WIDE_SPACE))
    rest = F.ltrim(column, F.lit(wide))
    lead = F.left(column, F.length(column) - F.length(rest))
    body = F.rtrim(rest, F.lit(wide + "".join(map(chr, range(0x21)))))
    tail = F.right(rest, F.length(rest) - F.length(body))
    return (
        F.when(F.coalesce(column, F.lit("")) == "", "")
        .when(column.contains(LEGACY_START), F.replace(F.replace(column, F.lit(LEGACY_START), F.lit(CORE_START)), F.lit(LEGACY_END), F.lit(CORE_END)))
        .when(column.rlike(START_PATTERN), column)
        .when(~is_translatable(body), "")
        .otherwise(F.concat(lead, F.lit(CORE_START), body, F.lit(CORE_END), tail))
    )


def plain_source(column: Column) -> Column:
    """A source as plain text: tabs, spaces and line breaks as one space, other codes gone, white space collapsed."""
    spaced = F.regexp_replace(column, "<x\\s[^>]*ctype=['\"](?:x-[a-z]+-tab|x-[a-z]+-s|lb)['\"][^>]*>", " ")
    return F.trim(collapse_space(F.regexp_replace(spaced, "<[^>]*>", "")))


def smart_quotes(column: Column) -> Column:
    """Quotes between tags as entities; those inside tags stay: splits at tags, rewrites the pieces between."""
    pieces = F.regexp_extract_all(column, F.lit("(?s)(<[^>]*>|[^<]+|<)"), 1)
    rewritten = F.transform(pieces, lambda p: F.when(p.startswith("<"), p).otherwise(F.replace(F.replace(F.replace(p, F.lit("&apos;"), F.lit("&#x27;")), F.lit("'"), F.lit("&#x27;")), F.lit('"'), F.lit("&quot;"))))
    return F.when(column.contains("<"), F.array_join(rewritten, "")).otherwise(column)


def rewrite_meta_charset(column: Column, charset: str) -> Column:
    """The charset that content-type meta elements state, exchanged; other meta elements stay."""
    swapped = F.regexp_replace(column, "(?is)(<meta\\s+http-equiv=['\"]?content-type['\"]?[^>]*?charset=['\"]?)[A-Za-z0-9_:.-]+", "$1" + charset)
    return F.when(column.rlike("(?i)<meta\\s+http-equiv"), swapped).otherwise(column)
