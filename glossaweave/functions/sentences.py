"""Sentences of a text by the rules of its language, as column expressions: all inside the JVM.

The host's sentences(text, language, country) asks the JVM's own break iterator but gives words without their places. Here a text
is cut after every sign that can end a sentence, with the closing signs and the space that follow it: no sentence ends
elsewhere. Signs that always end one are ends, and so is a full stop with space and a capital after it; one with a small
letter or digit after the space, or any right after it, is none. Else the break iterator, which costs far more, is asked
about the full stop, what closes and parts, and what follows up to its first letter or digit: two sentences, or one.
Pieces between ends are joined. Every step takes time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Signs that end a sentence always, or depending on what follows; those beyond ASCII apart, since classes that mix both are slow.
WIDE = "．。！？।॥\u2029"
_IGNORED = "\\p{Mn}\\p{Me}\\p{Cf}"
_SPACE = f"[\\t\\n\\f\\r\\p{{Zs}}\\x{{2028}}{_IGNORED}]"
#: What stands before a sign, and the signs with what closes and parts; a danda closes at once.
_BODY = {False: "[^.!?]*+", True: "[^.．!?。！？।॥\\x{2029}]*+"}
_RUN = f"[.．!?。！？][.．!?。！？\"'\\p{{Pe}}\\p{{Pf}}{_IGNORED}]*+{_SPACE}*+\\x{{2029}}?|[।॥]{_SPACE}*+|\\x{{2029}}"
_SURE = "[!?。！？।॥\\x{2029}]"
_SPACED = "[.．\"'\\p{Pe}\\p{Pf}][ \\t\\r\\n\\f]++\\z"
_HEAD = "^[^\\p{L}\\p{N}]*+.?"


def _slices(parts: Column, starts: Column) -> Column:
    """The parts joined from each start to the next; the last to the end."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(parts))
    return F.transform(starts, lambda s, i: F.array_join(F.slice(parts, s + 1, end(i) - s), ""))


def _indices(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))


def cut(text: Column, language: Column | None = None) -> Column:
    """The text's sentences; joined they are the text. language: a code such as 'de'; null or '' is the root's rules."""
    spoken = F.coalesce(language, F.lit("")) if language is not None else F.lit("en")
    wide = F.lit(False)
    for sign in WIDE:
        wide = wide | text.contains(sign)
    return F.when(wide, _cut(text, spoken, True)).otherwise(_cut(text, spoken, False))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _cut(text: Column, language: Column, wide: bool) -> Column:
    pieces = F.filter(F.regexp_extract_all(text, F.lit(f"(?s){_BODY[wide]}(?:{_RUN}|\\z)"), F.lit(0)), lambda p: p != "")
    tails = lambda p: F.transform(p, lambda x: F.regexp_replace(x, f"(?s)^{_BODY[wide]}", ""))
    whole = lambda p: _let(tails(p), lambda t: _joined(p, t, language))
    return _let(pieces, lambda p: _let(_end_apart(p, wide, language), whole))


def _asked(tail: Column, after: Column, language: Column) -> Column:
    """How many sentences the break iterator sees where signs meet the next piece."""
    return F.size(F.sentences(F.concat(F.lit("a"), tail, F.regexp_extract(after, _HEAD, 0)), language, F.lit("")))


def _end_apart(pieces: Column, wide: bool, language: Column) -> Column:
    """Where signs alone follow a text's last full stop, the break iterator makes the full stop a sentence of its own: a piece of its own here."""
    n = F.size(pieces)
    before, last = F.get(pieces, n - 2), F.get(pieces, n - 1)
    stop = F.regexp_replace(before, f"(?s)^{_BODY[wide]}", "")
    body = F.length(before) - F.length(stop)
    split = F.array(F.substr(before, F.lit(1), body), stop, last)
    odd = (n > 1) & ~last.rlike("[\\p{L}\\p{N}]") & (body > 0) & (_asked(stop, last, language) > 2)
    return F.when(odd, F.concat(F.slice(pieces, F.lit(1), F.greatest(n - 2, F.lit(0))), split)).otherwise(pieces)


def _joined(pieces: Column, tails: Column, language: Column) -> Column:
    def begins(i: Column) -> Column:
        tail, piece = F.get(tails, i - 1), F.get(pieces, i)
        spaced = tail.rlike(_SPACED)
        sure = F.when(spaced & piece.rlike("^\\p{Lu}"), True).when((spaced & piece.rlike("^[\\p{Ll}\\p{Nd}]")) | (tail.endswith(".") & piece.rlike("^[\\p{L}\\p{Nd}]")), False)
        return (i == 0) | (tail == "") | tail.rlike(_SURE) | F.coalesce(sure, _asked(tail, piece, language) > 1)

    return _let(F.filter(_indices(pieces), begins), lambda starts: _slices(pieces, starts))


def cores(sentences: Column, marked: Column) -> Column:
    """Segments of sentences and their marked forms ('' where nothing is to be translated): such a sentence follows the segment before it as it
    is; those that lead are dropped."""
    starts = F.filter(_indices(sentences), lambda i: F.get(marked, i) != "")
    return _let(starts, lambda at: F.transform(at, lambda s, i: F.concat(F.get(marked, s), F.array_join(F.slice(sentences, s + 2, F.coalesce(F.get(at, i + 1), F.size(sentences)) - s - 1), ""))))


def core_segments(text: Column, language: Column | None = None) -> Column:
    """The marked segments of a text without codes."""
    return _let(cut(text, language), lambda s: _let(F.transform(s, tx.mark_core), lambda m: cores(s, m)))


def counted(segments: Column) -> Column:
    """An array of (seg_no, marked, seg_of) of the segments."""
    return _let(segments, lambda m: F.transform(m, lambda s, i: F.struct(i.alias("seg_no"), s.alias("marked"), F.size(m).alias("seg_of"))))
