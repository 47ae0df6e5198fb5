"""OpenDocument archives and FrameMaker interchange files; documents of other office formats come through a converter.

An archive's content and styles are read from its bytes inside the task; the rest of it is never unpacked. Word, Excel,
PowerPoint and RTF need an external converter to OpenDocument: `converted` applies one given by the caller to the bytes
and is not tested against a real office suite here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charset import frame_characters
from ..functions.codes import collapse_nested
from ..schema import Parts, tokenise
from .xml import _events

MEMBERS = ("content.xml", "styles.xml")
# Inline elements that are codes without content; characters that MIF names.
STANDALONE = {"text:tab": "x-odf-tab", "text:s": "x-odf-s", "text:line-break": "lb"}
MIF_CHARS = {
    "HardSpace": 0x00A0, "SoftHyphen": 0x00AD, "DiscHyphen": 0x00AD, "NoHyphen": 0x200D, "Tab": 0x0009, "Cent": 0x00A2, "Pound": 0x00A3,
    "Yen": 0x00A5, "EnDash": 0x2013, "EmDash": 0x2014, "Dagger": 0x2020, "DoubleDagger": 0x2021, "Bullet": 0x2022, "NumberSpace": 0x2007,
    "ThinSpace": 0x2009, "EnSpace": 0x2002, "EmSpace": 0x2003,
}


def style_types(events: list[tuple]) -> dict[str, str]:
    """ctype of each text style: wingdings, bold, italic, underline, sub- and superscript, joined by '-' where several hold."""
    out: dict[str, list[str]] = {}
    name = None
    for kind, _, _, _, value in events:
        if kind == "start":
            attrs = dict(zip(value[1][::2], value[1][1::2]))
            if value[0] == "style:style":
                name = attrs.get("style:name")
            elif value[0] == "style:text-properties" and name:
                place = attrs.get("style:text-position", "")
                found = [
                    ("x-odf-wingdings", "wingdings" in (attrs.get("style:font-name", "") + attrs.get("fo:font-family", "")).lower()),
                    ("bold", attrs.get("fo:font-weight") == "bold"),
                    ("italic", attrs.get("fo:font-style") == "italic"),
                    ("x-odf-sub", place.startswith("sub") or place.startswith("-")),
                    ("x-odf-super", bool(place) and not place.startswith("sub") and not place.startswith("-") and not place.startswith("0")),
                    ("underline", attrs.get("style:text-underline-style", "none") != "none"),
                ]
                out[name] = [k for k, holds in found if holds]
    return {n: "-".join(k) for n, k in out.items() if k}


def odf_part(raw: bytes, out: Parts) -> None:
    """One unit a paragraph or heading; notes, annotations and paragraphs in it are units of their own, referred to by its codes."""
    events = _events(raw)
    styles = style_types(events)
    at = 0
    levels: list[dict] = []  # open paragraphs: text, stack of open codes, elements open inside
    rid = 0

    def piece(i: int) -> str:
        return raw[events[i][1] : events[i + 1][1]].decode("utf-8")

    for i in range(len(events) - 1):
        kind, start, _, _, value = events[i]
        own = piece(i)
        name = value[0] if kind in ("start", "end") else ""
        empty = own.endswith("/>")
        if kind == "start" and name in ("text:p", "text:h") and not empty:
            if levels:
                levels[-1]["text"] += f"<x id='{out.code(own)}' ctype='x-odf-imbedded-text-p'/>"
            else:
                out.literal(raw[at:start].decode("utf-8") + own)
            levels.append({"text": "", "stack": [], "tag": name})
        elif kind == "end" and name in ("text:p", "text:h") and levels and raw[start : start + 2] == b"</":
            done = levels.pop()
            bare = re.sub(r"<[be]?x\s[^>]*>", "", done["text"])
            if levels:
                number = out.para(collapse_nested(done["text"], out.codes), name=name, kind="aside")
                levels[-1]["text"] += f"<x id='{out.code('{{tu:%d}}' % number + own)}' ctype='x-odf-note-target' xid='{number}'/>"
            elif bare.strip():
                out.para(collapse_nested(done["text"], out.codes), name=name)
                out.literal(own)
            else:
                out.literal(re.sub(r"<[be]?x\s+id='(\d+)'[^>]*>", lambda m: out.codes[int(m[1]) - 1]["body"], done["text"]) + own)
        elif not levels:
            out.literal(raw[at:start].decode("utf-8") + own)
        elif kind == "start":
            attrs = dict(zip(value[1][::2], value[1][1::2]))
            ctype = STANDALONE.get(name) or ("link" if name == "text:a" else styles.get(attrs.get("text:style-name", ""), "x-odf-span") if name == "text:span" else "x-odf-" + name.split(":")[-1])
            code = out.code(own)
            if empty or name in STANDALONE:
                levels[-1]["text"] += f"<x id='{code}' ctype='{ctype}'/>"
            else:
                rid += 1
                levels[-1]["stack"].append(rid)
                levels[-1]["text"] += f"<bx id='{code}' ctype='{ctype}' rid='{rid}'/>"
        elif kind == "end":
            if raw[start : start + 2] == b"</" and levels[-1]["stack"] and name not in STANDALONE:
                levels[-1]["text"] += f"<ex id='{out.code(own)}' rid='{levels[-1]['stack'].pop()}'/>"
        elif kind == "text":
            levels[-1]["text"] += own
        at = events[i + 1][1]
    out.literal(raw[at:].decode("utf-8"))


def unzipped(docs: DataFrame, column: str = "content") -> DataFrame:
    """doc_id ('id/member'), text of the members that hold text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, raw in zip(pdf["doc_id"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        rows += [(f"{doc}/{m}", z.read(m).decode("utf-8")) for m in MEMBERS if m in z.namelist()]
                except (zipfile.BadZipFile, TypeError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("content")).mapInPandas(run, "doc_id string, text string")


def odf_tokenizer(text: str, out: Parts) -> None:
    odf_part(text.encode("utf-8"), out)


def read_odf(docs: DataFrame, column: str = "content") -> DataFrame:
    return tokenise(unzipped(docs, column), odf_tokenizer)


def rezipped(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, content: each archive with its members exchanged for the texts of `members` (doc_id 'id/member', text); null for what is no archive."""
    member = F.substring_index("doc_id", "/", -1)  # the members that hold text lie at the top
    owner = F.expr("left(doc_id, length(doc_id) - length(substring_index(doc_id, '/', -1)) - 1)")
    parts = members.select(owner.alias("owner"), member.alias("member"), "text")
    packed = parts.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("member", "text"))).alias("new"))
    joined = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(packed, F.col("doc_id") == F.col("owner"), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, raw, new in zip(pdf["doc_id"], pdf["content"], pdf["new"]):
                new, buffer = dict(new or {}), io.BytesIO()
                if not zipfile.is_zipfile(io.BytesIO(raw)):
                    rows.append((doc, None))
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(buffer, "w") as z:
                    for item in old.infolist():
                        z.writestr(item, new[item.filename].encode("utf-8") if item.filename in new else old.read(item.filename))
                rows.append((doc, buffer.getvalue()))
            yield pd.DataFrame(rows, columns=["doc_id", "content"])

    return joined.select("doc_id", "content", "new").mapInPandas(run, "doc_id string, content binary")


def converted(docs: DataFrame, convert: Callable[[bytes], bytes]) -> DataFrame:
    """The documents' bytes through a converter to OpenDocument, run inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[convert(bytes(c)) for c in pdf["content"]])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, "doc_id string, content binary")


_MIF = re.compile(r"(?s)<(Para|ParaLine|String|Char|Font|XRef|XRefEnd)\b[ \t]*(?:`((?:[^'\\]|\\.)*)'|(\w+))?\s*(>)?|(>)|<\w+|`(?:[^'\\]|\\.)*'|#[^\n]*")


_FRAME = frame_characters()


def mif_unescape(text: str) -> str:
    named = {"t": "\t", ">": ">", "q": "'", "Q": "`", "\\": "\\"}
    return re.sub(r"\\(?:x([0-9a-fA-F]{2}) ?|(.))", lambda m: _FRAME[int(m[1], 16)] if m[1] else named.get(m[2], m[0]), text)


def mif_escape(text: str) -> str:
    for plain, made in (("\\", "\\\\"), ("\t", "\\t"), (">", "\\>"), ("'", "\\q"), ("`", "\\Q")):
        text = text.replace(plain, made)
    return text


def mif_tokenizer(text: str, out: Parts) -> None:
    """One unit a paragraph: its strings joined in the place of the first; named characters within are text, breaks are codes."""
    depth, para, at, pieces, last = 0, None, 0, [], 0
    for m in _MIF.finditer(text):
        if m[5] or (m[4] and m[1] is None):
            depth -= 1
            if para is not None and depth < para:
                if "".join(pieces).strip():
                    out.para("".join(pieces))
                    out.literal(text[last : m.end()])
                else:
                    out.literal(text[at : m.end()])
                at, para, pieces = m.end(), None, []
            continue
        if not m[0].startswith("<"):
            continue
        depth += 0 if m[4] else 1
        if m[1] == "Para" and para is None:
            para, pieces = depth, []
        elif m[1] == "String" and m[2] is not None and para is not None:
            if not pieces:
                out.literal(text[at : m.start(2)])
            body = mif_unescape(m[2])
            pieces.append(body.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            at = last = m.end(2)
        elif m[1] == "Char" and pieces:
            if m[3] == "HardReturn":
                pieces.append(f"<x id='{out.code('')}' ctype='lb'/>")
            elif m[3] in MIF_CHARS:
                pieces.append(chr(MIF_CHARS[m[3]]))
    out.literal(text[at:])


def read_mif(docs: DataFrame, column: str = "text") -> DataFrame:
    return tokenise(docs, mif_tokenizer, column)
