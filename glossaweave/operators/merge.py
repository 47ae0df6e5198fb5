"""Documents built again from tokenised documents and texts: one join, and one Arrow pass that puts a document's parts together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<(?:bx|ex|x)\s[^>]*>|\{\{tu:([0-9]+)\}\}")
_REFERENCE = re.compile(r"\{\{tu:([0-9]+)\}\}")
_CODE_ID = re.compile(r"\sid=['\"]([0-9]+)['\"]")
BUILT = "doc_id string, text string, notices array<string>"


def joined_text(rows: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """The column's texts of each group, in order, as one."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias(name))


def paragraph_texts(units: DataFrame, column: str = "target") -> DataFrame:
    """doc_id, part_no, text: prefix, target (or core) and suffix of a paragraph's segments in order."""
    whole = units.withColumn("_piece", F.concat("prefix", F.coalesce(F.col(column), F.col("core")), "suffix"))
    return joined_text(whole, ["doc_id", "part_no"], "seg_no", "_piece", "text")


def assemble(parts: list[dict], codes: list[dict]) -> tuple[str, list[str]]:
    """A document's text and notices. A code stands for the first markup of its id (none: it goes); a reference in a text, a literal or a
    markup stands for an aside, whose text may have codes again, to any depth. A reference that leads back to itself goes, with a notice."""
    markup, asides, notices, out = {}, {}, [], []
    for code in codes:
        markup.setdefault(code["code_id"], code["body"] or "")
    for part in parts:
        if part["kind"] == "aside":
            asides[part["part_no"]] = part["text"] or ""

    def pieces(text: str, coded: bool) -> Iterator[tuple[str, object]]:
        at = 0
        for m in (_TOKEN if coded else _REFERENCE).finditer(text):
            yield "text", text[at : m.start()]
            at = m.end()
            if m[1] is None:
                known = _CODE_ID.search(m[0])
                yield "markup", markup.get(int(known[1]), "") if known else ""
            elif int(m[1]) in asides:
                yield "aside", int(m[1])
            else:
                yield "text", m[0]
        yield "text", text[at:]

    for part in parts:
        if part["kind"] == "aside":
            continue
        stack: list[tuple[Iterator, int | None]] = [(pieces(part["text"] or "", part["kind"] == "para"), None)]
        while stack:
            kind, value = next(stack[-1][0], ("end", None))
            if kind == "end":
                stack.pop()
            elif kind == "text":
                out.append(value)
            elif kind == "markup":
                stack.append((pieces(value, False), None))
            elif any(number == value for _, number in stack):
                notices.append(f"paragraph {value} refers to itself")
            else:
                stack.append((pieces(asides[value], True), value))
    return "".join(out), notices


def documents(tokenised: DataFrame, texts: DataFrame | None = None, finish: Callable[[Column], Column] | None = None, codes: bool = True) -> DataFrame:
    """doc_id, text, notices. texts: doc_id, part_no, text of paragraphs (one without keeps its own); `finish` turns a paragraph's text, free
    of core marks, into the format's writing; codes: whether paragraphs have any. Tokenised documents are read once; they and the
    texts move to the document's task, where all else happens."""
    own, kept = F.col("p.text"), ["codes"]
    if texts is not None:
        given = texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part_no", "text"))).alias("_given"))
        tokenised, kept = tokenised.join(given, "doc_id", "left"), ["codes", "_given"]
        own = F.coalesce(F.try_element_at("_given", F.col("part_no")), own)
    behind = F.array(F.lit(None).cast("struct<kind:string,text:string,name:string>"))
    rows = tokenised.select("doc_id", F.posexplode(F.concat("parts", behind)).alias("part_no", "p"), *kept)
    last = F.col("p").isNull()  # the row behind a document's parts has its codes
    rows = rows.select("doc_id", "part_no", F.coalesce("p.kind", F.lit("codes")).alias("kind"), F.when(F.coalesce(F.col("p.kind"), F.lit("")).isin("para", "aside"), own).alias("para"), F.col("p.text").alias("literal"), F.when(last, F.col("codes")).alias("codes"))
    if finish:
        rows = rows.withColumn("para", finish(F.col("para")))
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part_no", "kind", F.coalesce("para", "literal").alias("text")))).alias("parts"), F.first("codes", ignorenulls=True).alias("codes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [assemble([p for p in parts if p["kind"] != "codes"], list(own) if codes and own is not None else []) for parts, own in zip(pdf["parts"], pdf["codes"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [t for t, _ in made], "notices": [n for _, n in made]})

    return whole.mapInPandas(run, BUILT)
