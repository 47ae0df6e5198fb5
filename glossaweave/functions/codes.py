"""Inline codes of translation units: cores round tags, repair of tags, nested codes, segments of sentences.

Each function takes and gives one text; `column` wraps one as a pandas UDF, for texts with codes. Texts without codes go
through the column expressions of functions.text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CORE_END, CORE_START, ENTITIES, LEGACY_END, LEGACY_START, WIDE_SPACE

_WIDE = "[" + "".join(re.escape(chr(c)) for c in WIDE_SPACE) + "]"
# Tags that a generic XML document hides as entities.
_HIDDEN_TAG = "&lt;/?[a-zA-Z][a-zA-Z0-9]*[^&]*/?&gt;"
_LOW = "".join(map(chr, range(33)))
_MARKED = re.compile(r"<mrk\s+mtype=(['\"])x-coretext\1>")
_TAG_AT_START, _TAG_AT_END = re.compile(r"<[^>]+>"), re.compile(r"<[^>]+>\Z")
_CODE = re.compile(r"<(/?[A-Za-z][\w:.-]*)([^>]*)>")
_BARE = re.compile(r"&(?!(?:amp|lt|gt|apos|quot);)")


def attribute(tag: str, name: str) -> str:
    m = re.search(rf"(?<![\w:-]){name}=(['\"])(.*?)\1", tag, re.S)
    return m[2] if m else ""


def repair_entities(text: str) -> str:
    if "&" not in text:
        return text
    text = _BARE.sub("&amp;", text)
    for plain, entity in ENTITIES[1:]:
        text = text.replace(plain, entity)
    return text


class _Space:
    """Wide white space at either end, with hidden tags if asked for."""

    def __init__(self, hidden: bool):
        one = f"(?:{_WIDE}|{_HIDDEN_TAG})" if hidden else _WIDE
        self.lead, self.tail = re.compile(one + "+"), re.compile(one + r"+\Z")
        self.nothing = re.compile(rf"(?:{_WIDE}|-|<[be]?x[^>]*>{'|' + _HIDDEN_TAG if hidden else ''})*\Z", re.S)

    def peel_lead(self, text: str) -> tuple[str, str]:
        m = self.lead.match(text)
        return (m[0], text[m.end() :]) if m else ("", text)

    def peel_tail(self, text: str) -> tuple[str, str]:
        m = self.tail.search(text)
        return (text[: m.start()], m[0]) if m else (text, "")


_SPACES = {False: _Space(False), True: _Space(True)}


def _outer(prefix: list[str], suffix: list[str], core: str, sentences: bool) -> tuple[int, int]:
    """How many tags of the prefix (from its start) and of the suffix (from its end) stay outside the core."""
    rid_p, rid_s = [attribute(t, "rid") for t in prefix], [attribute(t, "rid") for t in suffix]
    out_p, out_s = [False] * len(prefix), [False] * len(suffix)  # suffix: outermost first
    for i, rid in enumerate(rid_p):
        partner = rid_s.index(rid) if rid and rid in rid_s else None
        later = next((j for j in range(i + 1, len(rid_p)) if rid and rid_p[j] == rid), None)
        if is_standalone(prefix[i]):
            out_p[i] = True
        elif partner is not None:
            out_p[i] = out_s[partner] = True
        elif later is not None:
            out_p[i] = out_p[later] = True
        elif sentences and rid and prefix[i].startswith("<bx") and not re.search(rf"<ex\s[^>]*?rid=['\"]{re.escape(rid)}['\"]", core):
            out_p[i] = True
    # All tags beyond one that is outside are outside as well; inwards of it more may follow.
    inmost = max((j for j, o in enumerate(out_s) if o), default=-1)
    out_s[: inmost + 1] = [True] * (inmost + 1)
    for j in range(inmost + 1, len(suffix)):
        rid = rid_s[j]
        later = next((k for k in range(j + 1, len(rid_s)) if rid and rid_s[k] == rid), None)
        if is_standalone(suffix[j]):
            out_s[j] = True
        elif later is not None:
            out_s[j] = out_s[later] = True
        elif sentences and rid and suffix[j].startswith("<ex") and not re.search(rf"<bx\s[^>]*?rid=['\"]{re.escape(rid)}['\"]", core):
            out_s[j] = True
    count = lambda flags: next((k for k, o in enumerate(flags) if not o), len(flags))
    return count(out_p), count(out_s)


def is_standalone(tag: str) -> bool:
    return bool(re.search(r"<x\s[^>]*/>|<x/>", tag))


def split_core(text: str, sentences: bool = True, hidden: bool = False) -> tuple[str, str, str] | None:
    """prefix, core, suffix; None where nothing is to be translated. Leading and trailing space and tags are peeled; tags
    whose partner stays in the core go back in."""
    if not text or not text.strip(_LOW):
        return None
    space = _SPACES[hidden]
    lead, core = space.peel_lead(text)
    trimmed = core.strip(_LOW)
    trail = core[len(trimmed) :] if len(trimmed) < len(core) else ""
    core, wide = space.peel_tail(trimmed)
    trail = wide + trail
    prefix, suffix = [], []  # (tag, the space on its inner side)
    while m := _TAG_AT_START.match(core):
        gap, core = space.peel_lead(core[m.end() :])
        prefix.append((m[0], gap))
    while core and (m := _TAG_AT_END.search(core, core.rfind("<"))):
        core, gap = space.peel_tail(core[: m.start()])
        suffix.append((m[0], gap))
    if not core.strip(_LOW) or space.nothing.match(core):
        return None
    a, b = _outer([t for t, _ in prefix], [t for t, _ in suffix], core, sentences)
    outside = "".join(t + g for t, g in prefix[:a])
    inside = "".join(t + g for t, g in prefix[a:]) + core + "".join(g + t for t, g in reversed(suffix[b:]))
    return lead + outside, inside, "".join(g + t for t, g in reversed(suffix[:b])) + trail


def mark_core(text: str | None, sentences: bool = True, hidden: bool = False) -> str:
    if not text or not text.strip(_LOW):
        return ""
    if LEGACY_START in text:
        return text.replace(LEGACY_START, CORE_START).replace(LEGACY_END, CORE_END)
    if _MARKED.search(text):
        return text
    found = split_core(text, sentences, hidden)
    return "" if found is None else found[0] + CORE_START + found[1] + CORE_END + found[2]


def core_segments(sentences: Sequence[str], hidden: bool = False) -> list[str]:
    """The segments of a paragraph's sentences with marked cores. A sentence with nothing to translate is put after the core of the one
    before it; one that leads is dropped."""
    out: list[str] = []
    for piece in sentences:
        marked = mark_core(piece, True, hidden)
        if marked:
            out.append(marked)
        elif out:
            out[-1] += piece
    return out


def keep_codes(text: str | None) -> str:
    """The lenient repair: bx, ex, x and core marks stay, other tags go, special characters between become entities."""
    out, at = [], 0
    for m in re.finditer(r"<(/?)([A-Za-z][\w:.-]*)[^>]*>", text or ""):
        out.append(repair_entities((text or "")[at : m.start()]))
        if m[2] in ("bx", "ex", "x", "mrk"):
            out.append(m[0])
        at = m.end()
    return "".join(out) + repair_entities((text or "")[at:])


def repair_strict(text: str | None) -> str:
    """The strict repair: every ex closes the bx opened last; else all bx and ex go, and all tags if others than x are left.
    A tag without an id is dropped."""
    if not text or not text.strip(_LOW) or ("<bx" not in text and "<ex" not in text):
        return text or ""
    out, at, stack, broken = [], 0, [], False
    for m in re.finditer(r"<([be]?x|/?mrk)\b[^>/]*/?>", text):
        out.append(repair_entities(text[at : m.start()]))
        at = m.end()
        if not attribute(m[0], "id"):
            continue
        rid = attribute(m[0], "rid")
        if m[1] == "bx" and rid:
            stack.append(rid)
        elif m[1] in ("bx", "ex") and not (m[1] == "ex" and rid and stack and stack.pop() == rid):
            broken = True
            break
        out.append(m[0])
    rest = text[at:]
    if not broken and not stack:
        return "".join(out) + repair_entities(rest)
    fixed = re.sub(r"<[be]x[^>]*>", "", "".join(out) + (rest if broken else repair_entities(rest)))
    return re.sub(r"<[^>]*>", "", fixed) if re.search(r"</?[^x/]|</x", fixed) else fixed


_PAIRED = re.compile(r"<([be])x\s+id=(?:'|\")(\d+)['\"](?:\s+ctype=['\"]([^'\"]*)['\"])?(?:\s+rid=['\"](\d+)['\"])?\s*/>")


def _preferred(outer: str, inner: str) -> str:
    if "link" in (outer, inner):
        return "link"
    return outer if inner.startswith("x-") and not outer.startswith("x-") else inner


def collapse_nested(text: str | None, codes: list[dict] | None = None) -> str:
    """Pairs of codes right inside each other become one, until none is left; an empty pair becomes a standalone code. Of the
    two types a link is preferred, then a common one over an x- one, then the inner; the outer id stays and takes on the inner's markup.
    One pass: an outer pair takes in what lies right inside its two ends, from both sides at once."""
    text = text or ""
    if "<bx" not in text:
        return text
    pieces: list[re.Match | str | None] = []
    at = 0
    for m in _PAIRED.finditer(text):
        pieces += [text[at : m.start()], m] if m.start() > at else [m]
        at = m.end()
    pieces.append(text[at:])
    end_of = {m[4]: i for i, m in enumerate(pieces) if isinstance(m, re.Match) and m[1] == "e"}
    begins = lambda i: isinstance(pieces[i], re.Match) and pieces[i][1] == "b"
    body = lambda m: codes[int(m[2]) - 1]
    for i in range(len(pieces)):
        if not begins(i):
            continue
        outer, last = pieces[i], end_of.get(pieces[i][4])
        kind, a = outer[3] or "", i + 1
        if last is None or last < i:
            continue
        z = last - 1
        while a < z and begins(a) and end_of.get(pieces[a][4]) == z:
            inner, close = pieces[a], pieces[z]
            kind = _preferred(kind, inner[3] or "")
            if codes:
                body(outer)["body"] += body(inner)["body"]
                body(pieces[last])["body"] = body(close)["body"] + body(pieces[last])["body"]
            pieces[a] = pieces[z] = None
            a, z = a + 1, z - 1
        if a > z:
            if codes:
                body(outer)["body"] += body(pieces[last])["body"]
            pieces[i], pieces[last] = f"<x id='{outer[2]}' ctype='{kind}'/>", None
        elif a > i + 1:
            pieces[i] = f"<bx id='{outer[2]}' ctype='{kind}' rid='{outer[4]}'/>"
    return "".join(x if isinstance(x, str) else x[0] for x in pieces if x is not None)


def bookmarks_first(text: str, codes: list[dict]) -> str:
    """Anchors that name a place and lead nowhere, moved with their ends to the front of the text, where translators need not see
    them. Text inside such an anchor stays where it was."""
    if "ctype='link'" not in text:
        return text
    front = ""
    for m in list(re.finditer(r"<bx id='(\d+)' ctype='link' rid='(\d+)'/>", text)):
        body = codes[int(m[1]) - 1]["body"]
        if not re.search(r"(?i)\sname\s*=", body) or re.search(r"(?i)\shref\s*=", body):
            continue
        end = re.search(rf"<ex id='\d+' rid='{m[2]}'/>", text)
        front += m[0] + (end[0] if end else "")
        text = text.replace(m[0], "", 1)
        text = text.replace(end[0], "", 1) if end else text
    return front + text


def column(function: Callable, kind: str = "string") -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore") if kind == "string" else pd.Series([function(t) for t in texts])

    return run
