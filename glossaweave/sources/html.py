"""HTML: a cheap text-only slice in column expressions, and a tokenizer with inline codes, attributes and skeleton.

The tokenizer keeps every character of the document: tags that break units and all that is not shown are literals, the
rest paragraphs. So a document is built again from its parts, without a second parse.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import bookmarks_first, collapse_nested
from ..functions.text import is_translatable
from ..schema import Parts, tokenise

# Tags that break units (for pages and for text extracted from PDF), inline tags with their types, ignored elements, attributes.
BREAK_TAGS = (
    "address", "blockquote", "body", "br", "caption", "center", "dd", "dfn", "div", "dl", "dt", "fieldset", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "html", "input", "label", "li", "menu", "noframes", "noscript", "ol", "option", "p", "pre",
    "q", "script", "select", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul",
)
INLINE_TAGS = {
    "a": "link", "b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "img": "image",
    **{t: f"x-html-{t}" for t in (
        "abbr", "acronym", "applet", "big", "blink", "cite", "code", "del", "embed", "font", "ins", "kbd", "nobr", "object", "param",
        "s", "samp", "small", "span", "strike", "sub", "sup", "tt", "var",
    )},
}
PDF_BREAK_TAGS = (
    "br", "center", "div", "dfn", "dd", "dt", "dl", "form", "h1", "h2", "h3", "h4", "h5", "h6", "html", "input", "li", "menu", "noscript", "ol",
    "option", "p", "pre", "q", "script", "select", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "ul",
)
PDF_INLINE_TAGS = {"spacecount": "x-html-spacecount"}  # besides those of pages
PDF_PREFIX = "x-pdf-"
EMPTY_INLINE = ("img", "param")
HIDDEN = ("style", "script", "comment")
TEXT_ATTRIBUTES = ("alt", "title", "summary")
VALUE_TAGS = ("button", "input", "option")

_HIDDEN_PATTERN = "(?is)<!--.*?-->|<style\\b.*?</style\\s*>|<script\\b.*?</script\\s*>|<comment\\b.*?</comment\\s*>"


def break_pattern(tags: tuple[str, ...] = BREAK_TAGS) -> str:
    return "(?is)</?(?:" + "|".join(tags) + ")(?:\\s[^>]*)?/?>"


def visible(column: F.col) -> F.col:
    """Without comments, styles, scripts and the doctype."""
    return F.regexp_replace(F.regexp_replace(column, _HIDDEN_PATTERN, ""), "(?is)<!doctype[^>]*>", "")


def text_units(pages: DataFrame, key: str = "page_id", html: str = "html", tags: tuple[str, ...] = BREAK_TAGS) -> DataFrame:
    """key, pos, text: one row a unit, other tags dropped, white space collapsed, entities left as they are. No shuffle, no Python."""
    pieces = F.transform(F.split(visible(F.col(html)), break_pattern(tags), -1), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "(?s)<[^>]*>", ""), "\\s+", " ")))
    rows = pages.select(key, F.posexplode(pieces).alias("pos", "text"))
    return rows.filter(is_translatable(F.col("text")))


_NAME = re.compile(r"(?i)(/?)([a-z][\w:-]*)")
_END_OF = {name: re.compile(rf"(?i)</{name}\s*>") for name in HIDDEN}
_ATTRIBUTE = re.compile(r"""(?<![\w:.-])([A-Za-z_:][\w:.-]*)(\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)""")
_STRAY = re.compile(r"[<>]")


def _tag_ends(html: str) -> tuple[list[int], list[int | None]]:
    """The places of > and quotes, and for each where a tag ends that reaches it outside of quotes (None: nowhere)."""
    at = [m.start() for m in re.finditer("[>\"']", html)]
    ends: list[int | None] = [None] * (len(at) + 1)
    later = {}  # the next quote of its kind, by its number
    for k in range(len(at) - 1, -1, -1):
        sign = html[at[k]]
        if sign == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[later[sign] + 1] if sign in later else None
            later[sign] = k
    return at, ends


def tokens(html: str):
    """(start, end, /, name, markup) of tags; comments, the doctype and hidden elements whole, without a name. Each place is looked at a bounded
    number of times: a search that finds nothing is not done again, as nothing lies further on either."""
    at, ends = _tag_ends(html)
    missing, start = set(), html.find("<")

    def ahead(key, found: int) -> int:
        if found < 0:
            missing.add(key)
        return found

    while start >= 0:
        end = -1
        if html.startswith("<!--", start):
            if "--" not in missing and (found := ahead("--", html.find("-->", start + 4))) >= 0:
                end, token = found + 3, ("", "", "")
        elif html[start : start + 9].lower() == "<!doctype":
            if ">" not in missing and (found := ahead(">", html.find(">", start))) >= 0:
                end, token = found + 1, ("", "", "")
        elif m := _NAME.match(html, start + 1):
            name = m[2].lower()
            # As a word, whatever follows: script-x begins a script too.
            hidden = next((h for h in HIDDEN if name == h or (name.startswith(h) and name[len(h)] in ":-")), None)
            if hidden and not m[1] and hidden not in missing:
                found = _END_OF[hidden].search(html, m.end())
                if found:
                    end, token = found.end(), ("", "", "")
                else:
                    missing.add(hidden)
            if end < 0 and (close := ends[bisect_left(at, m.end())]) is not None:
                end, token = close + 1, (m[1], m[2], html[m.end() : close])
        if end >= 0:
            yield start, end, *token
        start = html.find("<", end if end >= 0 else start + 1)


# Elements without an end; what the start of an element ends; what bounds that.
VOID = ("area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link", "meta", "param", "wbr")
ENDS_P = ("address", "blockquote", "center", "dd", "div", "dl", "dt", "fieldset", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "menu", "ol", "p", "pre", "table", "ul")
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
LISTS, CELLS, GROUPS = ("dl", "menu", "ol", "select", "ul"), ("caption", "td", "th"), ("tbody", "tfoot", "thead")


class Balance:
    """The elements that are open, and what a start or an end tag closes besides. Every element is put on and taken off once; whether a name is
    open at all within the bounds that hold for it is counted, not searched.

    A table and its cells bound all searches, a list those for its items. Inline elements end with the block that they began in, and an end
    tag of theirs does not reach across a block's start."""

    def __init__(self, inline):
        self.inline, self.stack = inline, []
        #: (number of elements below, counts of names) of the bounds that hold: cells and tables; these and lists; these and blocks.
        self.levels, self.scopes, self.runs = [(0, Counter())], [(0, Counter())], [(0, Counter())]

    def _kinds(self, name: str):
        block = name not in self.inline
        return (self.levels, name == "table" or name in CELLS), (self.scopes, name == "table" or name in CELLS or name in LISTS), (self.runs, block)

    def push(self, name: str) -> None:
        self.stack.append(name)
        for bounds, opens in self._kinds(name):
            bounds[-1][1][name] += 1
            if opens:
                bounds.append((len(self.stack), Counter()))

    def pop(self) -> str:
        name = self.stack.pop()
        for bounds, opens in self._kinds(name):
            if opens:
                bounds.pop()
            bounds[-1][1][name] -= 1
        return name

    def _until(self, *names: str) -> list[str]:
        out = [self.pop()]
        while out[-1] not in names:
            out.append(self.pop())
        return out

    def _holder(self) -> str | None:
        """The element whose content this level is."""
        below = self.levels[-1][0]
        return self.stack[below - 1] if below else None

    def start(self, name: str) -> list[str]:
        """What the start of an element ends, innermost first."""
        out = []
        if name in ("tr", *CELLS, *GROUPS):
            if self._holder() in CELLS:
                out += self._until(*CELLS)
            if name not in ("td", "th"):
                for group in (("tr",), *([GROUPS] if name != "tr" else [])):
                    if any(self.scopes[-1][1][g] for g in group):
                        out += self._until(*group)
            return out
        if name in ENDS_P and self.scopes[-1][1]["p"]:
            out += self._until("p")
        same = SIBLINGS.get(name, ())
        if any(self.scopes[-1][1][s] for s in same):
            out += self._until(*same)
        return out

    def end(self, name: str) -> list[str] | None:
        """What an end tag ends, itself last; None if nothing that it names is open."""
        if name in self.inline:
            return self._until(name) if self.runs[-1][1][name] else None
        if self.levels[-1][1][name]:
            return self._until(name)
        if name in CELLS and self._holder() == name:
            return self._until(name)
        if name in ("table", "tr", *GROUPS) and len(self.levels) > 1:
            cell = self._holder() in CELLS
            table = self.levels[-2] if cell else self.levels[-1]
            if name == "table":
                return self._until(name) if table[0] and self.stack[table[0] - 1] == "table" else None
            if table[1][name]:
                return self._until(name)
        return None


class _Tokenizer:
    def __init__(self, out: Parts, breaks: frozenset[str], prefix: str, move: bool, balance: bool = False):
        self.out, self.breaks, self.prefix, self.move = out, breaks, prefix, move
        self.types = INLINE_TAGS | PDF_INLINE_TAGS if prefix == PDF_PREFIX else INLINE_TAGS
        self.texts, self.raws, self.open, self.rid = [], [], {}, 0
        self.pre = 0
        self.balance = Balance({t for t in self.types if t not in breaks}) if balance else None

    def flush(self) -> None:
        """What has been gathered becomes a paragraph if it has text, else a literal as it stood."""
        text = "".join(self.texts)
        bare = re.sub(r"<[be]?x\s[^>]*>", "", text)
        if bare.strip():
            # Codes left open end here; their ends elsewhere are standalone.
            text = text if self.pre else re.sub(r"\s+", " ", text)
            if self.move:
                text = bookmarks_first(text, self.out.codes)
            self.out.para(collapse_nested(text, self.out.codes))
        else:
            self.out.literal("".join(self.raws))
        self.texts, self.raws = [], []
        self.open.clear()

    def attributes(self, tag: str, name: str, markup: str) -> str:
        """The markup with the values of translatable attributes as references to paragraphs of their own."""
        hidden = re.search(r"""(?i)\btype\s*=\s*["']?hidden""", markup)

        def swap(m: re.Match) -> str:
            attr, value = m[1].lower(), m[3].strip("\"'")
            wanted = attr in TEXT_ATTRIBUTES or (attr == "value" and name in VALUE_TAGS and not hidden)
            if not wanted or not value.strip():
                return m[0]
            number = self.out.para(value, name=f"{name}@{attr}", kind="aside")
            return f'{m[1]}{m[2]}"{{{{tu:{number}}}}}"'

        return tag[: tag.index(markup)] + _ATTRIBUTE.sub(swap, markup) + ">" if markup.strip() else tag

    def inline(self, tag: str, close: bool, name: str, markup: str) -> None:
        kind = self.types[name].replace("x-html-", self.prefix)
        body = tag if close else self.attributes(tag, name, markup)
        code = self.out.code(body)
        if close:
            if self.open.get(name):
                self.texts.append(f"<ex id='{code}' rid='{self.open[name].pop()}'/>")
            else:
                self.texts.append(f"<x id='{code}' ctype='{kind}'/>")
        elif name in EMPTY_INLINE or markup.rstrip().endswith("/"):
            self.texts.append(f"<x id='{code}' ctype='{kind}'/>")
        else:
            self.rid += 1
            self.open.setdefault(name, []).append(self.rid)
            self.texts.append(f"<bx id='{code}' ctype='{kind}' rid='{self.rid}'/>")
        self.raws.append(body)

    def tag(self, whole: str, close: bool, name: str, markup: str) -> None:
        if name in self.types and name not in self.breaks:
            self.inline(whole, close, name, markup)
            return
        self.flush()
        self.out.literal(whole if close or not name else self.attributes(whole, name, markup))
        if name == "pre":
            self.pre += -1 if close and self.pre else 0 if close else 1

    def implied(self, names: list[str]) -> None:
        for name in names:
            self.tag(f"</{name}>", True, name, "")

    def run(self, html: str) -> None:
        at, strays = 0, 0
        for start, end, slash, name, markup in tokens(html):
            self.plain(html[at:start])
            at, name = end, name.lower()
            if self.balance and name:
                if slash:
                    ended = self.balance.end(name)
                    if ended is None:
                        strays += 1
                        continue
                    self.implied(ended[:-1])
                else:
                    self.implied(self.balance.start(name))
                    if name not in VOID and not markup.rstrip().endswith("/"):
                        self.balance.push(name)
            self.tag(html[start:end], bool(slash), name, markup)
        self.plain(html[at:])
        if self.balance:
            self.implied([self.balance.pop() for _ in range(len(self.balance.stack))])
            if strays:
                self.out.notice(1, f"{strays} end tags without an element were dropped")
        self.flush()

    def plain(self, text: str) -> None:
        if text:
            self.texts.append(_STRAY.sub(lambda m: "&lt;" if m[0] == "<" else "&gt;", text))
            self.raws.append(text)


def tokenizer(tags: tuple[str, ...] = BREAK_TAGS, ctype_prefix: str = "x-html-", move_bookmarks: bool = False, balance: bool = False):
    breaks = frozenset(tags)
    return lambda html, out: _Tokenizer(out, breaks, ctype_prefix, move_bookmarks, balance).run(html)


def read(docs: DataFrame, column: str = "text", tags: tuple[str, ...] = BREAK_TAGS, move_bookmarks: bool = False, balance: bool = False) -> DataFrame:
    """tags: those that break units, to be added to or taken from; move_bookmarks puts anchors without a target first, so that export
    puts them there as well; balance adds the end tags that are missing, to codes and skeleton, and drops those that end nothing."""
    return tokenise(docs, tokenizer(tags, move_bookmarks=move_bookmarks, balance=balance), column)


def read_pdf(docs: DataFrame, column: str = "text") -> DataFrame:
    """Tagged text that a library has taken from PDF pages: fewer tags break units, and codes have types of their own."""
    return tokenise(docs, tokenizer(PDF_BREAK_TAGS, PDF_PREFIX), column)
