"""Table shapes shared by sources, operators and sinks.

Every source turns documents (doc_id, text or content) into one row a document: `parts`, the document cut into literal
pieces and paragraphs in order, and `codes`, the markup that paragraphs refer to. Paragraph text is XML-escaped; inline
markup stands in it as <bx id rid ctype/>, <ex id rid/> and <x id ctype/>. A code's or literal's body may refer to a
paragraph of its own as {{tu:number}}.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,name:string>>"
CODES = "array<struct<code_id:int,body:string>>"
TOKENISED = f"doc_id string, status string, parts {PARTS}, codes {CODES}, notices array<struct<severity:int,message:string>>"
OK, FAILED = "CONVERSION_SUCCEEDED", "ERROR_IMPORT_FAILED"


class Parts:
    """What a tokenizer collects of one document. Literals next to each other are joined."""

    def __init__(self):
        self.parts: list[dict] = []
        self.codes: list[dict] = []
        self.notices: list[dict] = []

    def literal(self, text: str) -> None:
        if not text:
            return
        if self.parts and self.parts[-1]["kind"] == "literal":
            joined = self.parts[-1].pop("text")  # held once alone, it grows in place
            joined += text
            self.parts[-1]["text"] = joined
        else:
            self.parts.append({"kind": "literal", "text": text, "name": None})

    def para(self, text: str, name: str | None = None, kind: str = "para") -> int:
        """A paragraph's number; kind 'aside' is one that only codes or literals refer to."""
        self.parts.append({"kind": kind, "text": text, "name": name})
        return len(self.parts) - 1

    def code(self, body: str) -> int:
        self.codes.append({"code_id": len(self.codes) + 1, "body": body})
        return len(self.codes)

    def notice(self, severity: int, message: str) -> None:
        self.notices.append({"severity": severity, "message": message})


def tokenise(docs: DataFrame, tokenizer: Callable[[object, Parts], None], column: str = "text") -> DataFrame:
    """The tokenizer run over every document by itself; a document that fails is a row with that status, not an error."""
    return tokenise_kinds(docs.withColumn("format", F.lit("")), {"": tokenizer}, column).drop("format")


def tokenise_kinds(docs: DataFrame, tokenizers: dict[str, Callable[[object, Parts], None]], column: str = "text") -> DataFrame:
    """Documents of different formats (column format) in one pass, each by its format's tokenizer. A column `notice` is what reading their
    bytes had to say; with it, a document without text has failed."""
    told = F.col("notice") if "notice" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, kind, text, notice in zip(pdf["doc_id"], pdf["format"], pdf["_body"], pdf["_notice"]):
                out, status = Parts(), FAILED if notice and text is None else OK
                try:
                    if text is not None:
                        tokenizers[kind](text, out)
                except Exception as e:  # noqa: BLE001  one bad document must not end the job
                    out, status = Parts(), FAILED
                    out.notice(2, f"{type(e).__name__}: {e}")
                if notice:
                    out.notice(2 if text is None else 1, notice)
                rows.append((doc, status, out.parts, out.codes, out.notices, kind))
            yield pd.DataFrame(rows, columns=["doc_id", "status", "parts", "codes", "notices", "format"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "format", F.col(column).alias("_body"), told.alias("_notice")).mapInPandas(run, TOKENISED + ", format string")


def kept(df: DataFrame) -> list[str]:
    """The document's format, in tables that have it."""
    return ["format"] if "format" in df.columns else []


def paragraphs(tokenised: DataFrame) -> DataFrame:
    """doc_id, part_no, name, text of every paragraph."""
    own = kept(tokenised)
    return tokenised.select("doc_id", *own, F.posexplode("parts").alias("part_no", "p")).filter("p.kind <> 'literal'").select("doc_id", "part_no", "p.name", "p.text", *own)


def skeleton(tokenised: DataFrame) -> DataFrame:
    """doc_id, part_no, kind, literal: the document in order; kinds literal, para and aside."""
    own = kept(tokenised)
    return tokenised.select("doc_id", *own, F.posexplode("parts").alias("part_no", "p")).select("doc_id", "part_no", "p.kind", F.when(F.col("p.kind") == "literal", F.col("p.text")).alias("literal"), *own)


def formats(tokenised: DataFrame) -> DataFrame:
    own = kept(tokenised)
    return tokenised.select("doc_id", *own, F.explode("codes").alias("c")).select("doc_id", "c.code_id", "c.body", *own)


def diagnostics(tokenised: DataFrame, origin: str | Column) -> DataFrame:
    """doc_id, notice_id, origin, severity, message."""
    name = F.lit(origin) if isinstance(origin, str) else origin
    own = kept(tokenised)
    rows = tokenised.select("doc_id", *own, name.alias("origin"), F.posexplode("notices").alias("n", "x"))
    return rows.select("doc_id", F.concat_ws("-", "origin", F.col("n").cast("string")).alias("notice_id"), "origin", "x.severity", "x.message", *own)


def stable_id(*columns: str | Column) -> Column:
    """A surrogate key of the columns: a repeated task gives the same id."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))
