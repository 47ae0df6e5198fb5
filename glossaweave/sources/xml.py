"""Generic XML in two passes: discovery of the elements and attributes that hold text, then extraction of the chosen ones.

Discovery gives a table of candidates with absolute paths; a skip list is taken off by an anti join; extraction reads each
document with the places that are left. The tokenizer works on byte offsets of the parser, so all else stays as it was.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import collapse_nested
from ..functions.text import WIDE_SPACE
from ..schema import Parts, tokenise

# Names and values of attributes that hold no text.
IGNORED_NAME = re.compile(r"xml:space|xml:lang|xml:id|xmlns(?::.+)?")
IGNORED_VALUE = re.compile(r"yes|no|true|false|https?://.*||\.\..*|#.*|[a-fA-F0-9]{6}")
_WIDE = frozenset(map(chr, WIDE_SPACE))


def holds_text(value: str) -> bool:
    """Whether an attribute's value may be text: none of the ignored ones, nor digits, punctuation and wide white space alone."""
    return not IGNORED_VALUE.fullmatch(value) and not all(c in "0123456789" or c in _WIDE or category(c)[0] == "P" for c in value)


CANDIDATES = "doc_id string, xpath string, line int, col int, attribute string"


def _events(raw: bytes) -> list[tuple]:
    """(kind, byte offset, line, column, value) of a document's parts, and the end of the document."""
    events: list[tuple] = []
    parser = expat.ParserCreate()
    parser.buffer_text = False
    parser.ordered_attributes = True

    def add(kind):
        return lambda *value: events.append((kind, parser.CurrentByteIndex, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1, value))

    for kind, slot in (("start", "StartElementHandler"), ("end", "EndElementHandler"), ("text", "CharacterDataHandler"), ("comment", "CommentHandler"), ("pi", "ProcessingInstructionHandler"), ("cdata", "StartCdataSectionHandler"), ("cdata-end", "EndCdataSectionHandler")):
        setattr(parser, slot, add(kind))
    parser.Parse(raw, True)
    return [*events, ("eof", len(raw), 0, 0, ())]


def _paths(events: list[tuple]) -> Iterator[tuple[int, str]]:
    """Each start event's place in the list and its path with ordinals among equal siblings."""
    seen: Counter[str] = Counter()
    stack = [""]
    for i, (kind, _, _, _, value) in enumerate(events):
        if kind == "start":
            path = f"{stack[-1]}/{value[0]}"
            seen[path] += 1
            stack.append(f"{path}[{seen[path]}]")
            yield i, stack[-1]
        elif kind == "end":
            stack.pop()


def candidates_of(text: str) -> list[tuple[str, int, int, str | None]]:
    events = _events(text.encode("utf-8"))
    paths = dict(_paths(events))
    out, stack, texts = [], [], set()
    inside = False
    for i, (kind, _, line, col, value) in enumerate(events):
        if kind == "start":
            stack.append(i)
            for name, v in zip(value[1][::2], value[1][1::2]):
                if not IGNORED_NAME.fullmatch(name) and holds_text(v):
                    out.append((f"{paths[i]}/@{name}", line, col, name))
        elif kind == "end":
            stack.pop()
        elif kind in ("cdata", "cdata-end"):
            inside = kind == "cdata"
        elif kind == "text" and not inside and value[0].strip() and stack:
            texts.add(stack[-1])
    return out + [(paths[i], events[i][2], events[i][3], None) for i in sorted(texts)]


def candidates(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every element with text of its own and every attribute whose value may be text; documents that are not XML have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["body"]):
                try:
                    rows += [(doc, *c) for c in candidates_of(text or "")]
                except expat.ExpatError:
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "xpath", "line", "col", "attribute"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("body")).mapInPandas(run, CANDIDATES)


def without(found: DataFrame, skip: DataFrame) -> DataFrame:
    """The candidates that are not on the skip list: alike are those with equal line, column and attribute (or none)."""
    s = skip.select(F.col("doc_id").alias("_d"), F.col("line").alias("_l"), F.col("col").alias("_c"), F.col("attribute").alias("_a"))
    same = (found["doc_id"] == s["_d"]) & (found["line"] == s["_l"]) & (found["col"] == s["_c"]) & found["attribute"].eqNullSafe(s["_a"])
    return found.join(s, same, "left_anti")


def _with_places(body: str, out: Parts) -> None:
    given = json.loads(body)
    tokenizer(given["text"], out, [(p["line"], p["col"], p.get("attribute")) for p in given.get("places") or []])


def tokenizer(text: str, out: Parts, places: list[tuple] | None = None) -> None:
    """places: line, column and attribute (or none) of what is taken; all candidates where they are not given."""
    raw = text.encode("utf-8")
    elements, attributes = set(), {}
    for line, col, attribute in [c[1:] for c in candidates_of(text)] if places is None else places:
        if attribute is None:
            elements.add((line, col))
        else:
            attributes.setdefault((line, col), set()).add(attribute)
    events = _events(raw)
    at, depth, text, stack, rid = 0, 0, "", [], 0

    def piece(i: int) -> str:
        return raw[events[i][1] : events[i + 1][1]].decode("utf-8")

    def with_attributes(tag: str, names: set[str], element: str) -> str:
        def swap(m: re.Match) -> str:
            if m[1] not in names or not m[3].strip("\"'").strip():
                return m[0]
            number = out.para(m[3][1:-1], name=f"{element}@{m[1]}", kind="aside")
            return f"{m[1]}{m[2]}{m[3][0]}{{{{tu:{number}}}}}{m[3][0]}"

        return re.sub(r"""([\w:.-]+)(\s*=\s*)("[^"]*"|'[^']*')""", swap, tag)

    i = 0
    while i < len(events) - 1:
        kind, start, line, col, value = events[i]
        own = piece(i)
        if kind == "start" and (line, col) in attributes:
            own = with_attributes(own, attributes[line, col], value[0])
        if not depth:
            out.literal(raw[at:start].decode("utf-8") + own)
            if kind == "start" and (line, col) in elements and not own.endswith("/>"):
                depth, text, stack = 1, "", []
        elif kind == "start":
            code = out.code(own)
            if own.endswith("/>"):
                text += f"<x id='{code}' ctype='x-xml-{value[0].replace(':', '-')}'/>"
            else:
                rid += 1
                stack.append(rid)
                text += f"<bx id='{code}' ctype='x-xml-{value[0].replace(':', '-')}' rid='{rid}'/>"
                depth += 1
        elif kind == "end":
            if not raw[start : start + 2] == b"</":
                pass  # the end of an empty element
            elif depth == 1:
                if re.sub(r"<[be]?x\s[^>]*>", "", text).strip():
                    out.para(collapse_nested(text, out.codes), name=value[0])
                else:
                    out.literal(re.sub(r"<([be]?x)\s+id='(\d+)'[^>]*>", lambda m: out.codes[int(m[2]) - 1]["body"], text))
                depth = 0
                out.literal(own)
            else:
                depth -= 1
                text += f"<ex id='{out.code(own)}' rid='{stack.pop()}'/>"
        elif kind == "cdata":
            end = next(j for j in range(i, len(events)) if events[j][0] == "cdata-end")
            body_text = raw[start : events[end + 1][1]].decode("utf-8")
            text += f"<x id='{out.code(body_text)}' ctype='x-ctype'/>"
            i = end
        elif kind in ("comment", "pi"):
            text += f"<x id='{out.code(own)}' ctype='x-xml-{kind}'/>"
        elif kind == "text":
            text += own
        i += 1
        at = events[i][1]
    out.literal(raw[at:].decode("utf-8"))


def read(docs: DataFrame, chosen: DataFrame | None = None, column: str = "text") -> DataFrame:
    """chosen: the candidates to extract; all, in the pass that finds them and without a shuffle, where it is not given."""
    if chosen is None:
        return tokenise(docs, tokenizer, column)
    places = chosen.groupBy("doc_id").agg(F.collect_set(F.struct("line", "col", "attribute")).alias("places"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("_text")).join(places, "doc_id", "left")
    return tokenise(rows.select("doc_id", F.to_json(F.struct(F.col("_text").alias("text"), "places")).alias("_json")), _with_places, "_json")
