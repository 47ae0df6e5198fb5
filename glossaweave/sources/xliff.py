"""XLIFF: units and targets by column expressions; inline elements rewritten to bx, ex and x with a format table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import attribute
from ..functions.text import escape
from ..schema import Parts, tokenise


def _attr(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, f"(?is)\\s{name}=(['\"])(.*?)\\1", 2), F.lit(""))


def files(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, original, source_language, datatype, segtype of each file element."""
    tags = F.regexp_extract_all(text, F.lit("(?s)(<file\\s[^>]*>(?:\\s*<header[^>]*>)?)"), 1)
    rows = docs.select("doc_id", F.explode(tags).alias("tag"))
    return rows.select("doc_id", _attr(F.col("tag"), "original").alias("original"), _attr(F.col("tag"), "source-language").alias("source_language"), _attr(F.col("tag"), "datatype").alias("datatype"), _attr(F.col("tag"), "lt:segtype").alias("segtype"))


def raw_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ordinal (from 1), tu_id, para_id, mergeable, next_tu_id, source, body; a unit without its end is dropped."""
    units = F.regexp_extract_all(text, F.lit("(?s)(<trans-unit\\s.*?</trans-unit>)"), 1)
    rows = docs.select("doc_id", F.posexplode(units).alias("n", "body"))
    tag = F.regexp_extract("body", "(?s)^<trans-unit\\s[^>]*>", 0)
    source = F.regexp_extract("body", "(?s)<source[^>]*>(.*?)</source>", 1)
    return rows.select("doc_id", (F.col("n") + 1).alias("ordinal"), _attr(tag, "id").alias("tu_id"), _attr(tag, "lt:paraID").alias("para_id"), F.coalesce(_attr(tag, "lt:mergeable") == "true", F.lit(False)).alias("mergeable"), _attr(tag, "lt:next-tu-id").alias("next_tu_id"), source.alias("source"), "body")


def targets(units: DataFrame) -> DataFrame:
    """doc_id, tu_id, lang, phase, kind, ordinal, text: targets and those in alternatives, in document order."""
    alternative = "(?s)<alt-trans\\b.*?</alt-trans>"
    direct = F.regexp_extract_all(F.regexp_replace("body", alternative, ""), F.lit("(?s)(<target\\b.*?</target>)"), 1)
    nested = F.regexp_extract_all("body", F.lit(f"({alternative})"), 1)
    tagged = F.concat(F.transform(direct, lambda t: F.struct(F.lit("target").alias("kind"), t.alias("xml"))), F.transform(nested, lambda t: F.struct(F.lit("alt-trans").alias("kind"), t.alias("xml"))))
    rows = units.select("doc_id", "tu_id", F.posexplode(tagged).alias("ordinal", "t")).select("doc_id", "tu_id", "ordinal", "t.kind", "t.xml")
    tag = F.regexp_extract("xml", "(?s)<target[^>]*>", 0)
    own = F.regexp_extract("xml", "(?s)<target[^>]*>(.*?)</target>", 1)
    lang = F.coalesce(_attr(F.regexp_extract("xml", "(?s)^<[^>]*>", 0), "xml:lang"), _attr(tag, "xml:lang"))
    return rows.select("doc_id", "tu_id", lang.alias("lang"), _attr(tag, "phase-name").alias("phase"), "kind", "ordinal", own.alias("text"))


def rewrite_inline(text: str) -> dict:
    """g, mrk and foreign elements become bx and ex; bpt and ept likewise with their content as markup; ph and it become x; a sub
    element is a text of its own, which the code's markup refers to."""
    out, rid, stack, made, subs = Parts(), 0, [], "", []
    pairs: dict[str, int] = {}
    token = re.compile(r"(?s)<(bpt|ept|ph|it)\b([^>]*?)(?:/>|>(.*?)</\1>)|<(/?)([A-Za-z][\w:.-]*)([^>]*?)(/?)>")
    at = 0
    for m in token.finditer(text):
        made += text[at : m.start()]
        at = m.end()
        if m[1]:
            body = m[3] or ""

            def lift(s: re.Match) -> str:
                subs.append(s[1])
                return "{{sub:%d}}" % (len(subs) - 1)

            code = out.code(re.sub(r"(?s)<sub\b[^>]*>(.*?)</sub>", lift, body))
            key = attribute(" " + m[2], "rid") or attribute(" " + m[2], "id")
            kind = attribute(" " + m[2], "ctype") or f"x-xliff-{m[1]}"
            if m[1] == "bpt":
                rid += 1
                pairs[key] = rid
                made += f"<bx id='{code}' ctype='{kind}' rid='{rid}'/>"
            elif m[1] == "ept" and key in pairs:
                made += f"<ex id='{code}' rid='{pairs.pop(key)}'/>"
            else:
                place = attribute(" " + m[2], "pos")
                made += f"<x id='{code}' ctype='{kind + ('-' + place if m[1] == 'it' and place else '')}'/>"
            continue
        name, code = m[5], out.code(m[0])
        kind = attribute(" " + m[6], "ctype") or (f"x-xliff-mrk-mtype-{attribute(' ' + m[6], 'mtype')}" if name == "mrk" else f"x-xliff-{name.replace(':', '-')}")
        if name == "x" or (m[7] and name not in ("bx", "ex")):
            made += f"<x id='{code}' ctype='{kind}'/>"
        elif name == "bx" or (not m[4] and name != "ex"):
            rid += 1
            stack.append((name, rid))
            made += f"<bx id='{code}' ctype='{kind}' rid='{rid}'/>"
        elif stack:
            made += f"<ex id='{code}' rid='{stack.pop()[1]}'/>"
    return {"text": made + text[at:], "codes": out.codes, "subs": subs}


INLINE = "struct<text:string,codes:array<struct<code_id:int,body:string>>,subs:array<string>>"


def normalised(units: DataFrame) -> DataFrame:
    """units with `inline`: the source in bx, ex and x, its codes, and the texts of its sub elements. Plain sources stay in the JVM."""
    @F.pandas_udf(INLINE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite_inline(t or "") for t in texts], columns=["text", "codes", "subs"])

    return units.withColumn("inline", run(F.col("source")))


def tokenizer(text: str, out: Parts) -> None:
    """A paragraph a source of a unit, its inline elements as codes; a sub element is an aside that the code's markup refers to."""
    at = 0
    for m in re.finditer(r"(?s)(<trans-unit\s[^>]*>)(.*?)</trans-unit>", text):
        source = re.search(r"(?s)(<source[^>]*>)(.*?)</source>", m[2])
        if not source or not re.sub(r"<[^>]*>", "", source[2]).strip():
            continue
        start = m.start(2) + source.start(2)
        out.literal(text[at:start])
        found = rewrite_inline(source[2])
        first = len(out.codes)
        subs = [out.para(s, name=f"{attribute(m[1], 'id')}@sub", kind="aside") for s in found["subs"]]
        for code in found["codes"]:
            out.code(re.sub(r"\{\{sub:([0-9]+)\}\}", lambda r: "{{tu:%d}}" % subs[int(r[1])], code["body"]))
        out.para(re.sub(r"(<(?:bx|ex|x) id=')([0-9]+)", lambda c: c[1] + str(int(c[2]) + first), found["text"]), name=attribute(m[1], "id"))
        at = start + len(source[2])
    out.literal(text[at:])


def read(docs: DataFrame, column: str = "text") -> DataFrame:
    return tokenise(docs, tokenizer, column)


def write(units: DataFrame, lang: str, names: DataFrame, segtype: str = "sentence", chosen: DataFrame | None = None) -> DataFrame:
    """doc_id, text: an XLIFF document of the units of each document, in order of part and segment. names: doc_id, name, datatype. chosen: targets
    (tu_id, lang, phase, kind, ordinal, text) to be written with their units."""
    from ..operators.merge import joined_text

    quoted = lambda c: F.concat(F.lit("'"), escape(F.coalesce(c, F.lit(""))), F.lit("'"))
    rows = units
    if chosen is not None:
        phase = F.when(F.col("phase").isNull(), "").otherwise(F.concat(F.lit(" phase-name="), quoted(F.col("phase"))))
        target = F.concat(F.lit("<target xml:lang="), quoted(F.col("lang")), phase, F.lit(">"), F.col("text"), F.lit("</target>\n"))
        target = F.when(F.col("kind") == "target", target).otherwise(F.concat(F.lit("<alt-trans>"), target, F.lit("</alt-trans>\n")))
        lines = joined_text(chosen.select("tu_id", F.struct((F.col("kind") != "target").alias("alt"), "ordinal").alias("place"), target.alias("xml")), ["tu_id"], "place", "xml", "targets")
        rows = units.join(lines, "tu_id", "left")
    else:
        rows = units.withColumn("targets", F.lit(""))
    optional = lambda name, c: F.coalesce(F.concat(F.lit(f" {name}="), quoted(F.nullif(c, F.lit("")))), F.lit(""))
    attrs = F.concat(F.lit("<trans-unit id="), quoted(F.col("tu_id")), F.lit(" lt:paraID="), quoted(F.col("para_id")), F.when(F.col("mergeable"), " lt:mergeable='true'").otherwise(""), F.when(F.col("next_tu_id").isNull(), "").otherwise(optional("lt:next-tu-id", F.col("next_tu_id"))), F.lit(">\n"))
    body = F.concat(attrs, F.lit("<source xml:lang="), quoted(F.lit(lang)), F.lit(">"), "prefix", F.lit("<mrk mtype='x-coretext'>"), "core", F.lit("</mrk>"), "suffix", F.lit("</source>\n"), F.coalesce("targets", F.lit("")), F.lit("</trans-unit>\n"))
    whole = joined_text(rows.select("doc_id", F.struct("part_no", "seg_no").alias("place"), body.alias("xml")), ["doc_id"], "place", "xml", "units")
    named = names.select(F.col("doc_id").cast("string").alias("doc_id"), "name", "datatype").join(whole, "doc_id", "left")
    head = F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<xliff version='1.1' xmlns='urn:oasis:names:tc:xliff:document:1.1' xmlns:lt='urn:glossaweave:units'>\n<file original="), quoted(F.col("name")), F.lit(" source-language="), quoted(F.lit(lang)), F.lit(" datatype="), quoted(F.col("datatype")), F.lit(f">\n<header lt:segtype='{segtype}'></header>\n<body>\n"))
    return named.select("doc_id", F.concat(head, F.coalesce("units", F.lit("")), F.lit("</body>\n</file>\n</xliff>\n")).alias("text"))
