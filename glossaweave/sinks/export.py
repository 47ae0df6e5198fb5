"""Documents in their own format again, from tokenised documents and a table of units with targets; files of them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import merge
from ..sources.lines import rc_encode
from ..sources.office import mif_escape

_bare = lambda c: text.remove_merger_marks(text.remove_core_marks(c))


def _properties(value: Column) -> Column:
    return F.regexp_replace(text.unescape(_bare(value)), "\\s*\\r?\\n\\s*", " ")


def _catalogue(value: Column) -> Column:
    plain = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("&quot;"), F.lit('\\"')), F.lit('"'), F.lit('"'))
    return text.unescape(_bare(plain))


#: How a paragraph's text is written in each format.
FINISH: dict[str, Callable[[Column], Column]] = {
    "HTML": lambda c: text.smart_quotes(codes.column(codes.keep_codes)(_bare(c))),
    "XML": lambda c: codes.column(codes.repair_strict)(_bare(c)),
    "ODT": lambda c: codes.column(codes.repair_strict)(_bare(c)),
    "PLAINTEXT": lambda c: text.unescape(F.regexp_replace(_bare(c), "<[^>]*>", "")),
    "JAVA_PROPERTIES": _properties,
    "XULDTD": _bare,
    "PO": _catalogue,
    "WINRC": lambda c: codes.column(rc_encode)(text.unescape(_bare(c))),
    "MIF": lambda c: codes.column(mif_escape)(text.unescape(F.regexp_replace(_bare(c), "<[^>]*>", ""))),
}
#: Name of a document's translation: base.lang.ext, or base_lang.ext.
UNDERSCORE = ("JAVA_PROPERTIES",)


def output_name(name: Column, lang: str, kind: str) -> Column:
    mark = "_" if kind in UNDERSCORE else "."
    return F.when(name.contains("."), F.regexp_replace(name, "\\.([^.]*)$", f"{mark}{lang}.$1")).otherwise(F.concat(name, F.lit(f"{mark}{lang}")))


def export(tokenised: DataFrame, units: DataFrame, kind: str, column: str = "target") -> DataFrame:
    """doc_id, text, notices. units: doc_id, part_no, seg_no, prefix, suffix and the text to put in (the core where it is null)."""
    return merge.documents(tokenised, merge.paragraph_texts(units, column), FINISH[kind], kind in ("HTML", "XML", "ODT", "PO"))


def with_charset(docs: DataFrame, kind: str, charset: str) -> DataFrame:
    """docs (text) with what the text itself says about its character set exchanged: meta elements of HTML, the catalogue's header once."""
    if kind == "HTML":
        return docs.withColumn("text", text.rewrite_meta_charset(F.col("text"), charset))
    if kind == "PO":
        stated = F.regexp_extract("text", "(?is)^(.*?Content-Type:\\s+text/plain;\\s+charset=)([-_a-zA-Z0-9]+)", 1)
        rest = F.regexp_replace(F.substr("text", F.length(stated) + 1), "^[-_a-zA-Z0-9]+", charset)
        return docs.withColumn("text", F.when(stated == "", F.col("text")).otherwise(F.concat(stated, rest)))
    return docs


def listing(units: DataFrame, kind: str = "text") -> DataFrame:
    """doc_id, text: the plain texts of the units one below the other, or as items of an HTML list; for documents that have no writer."""
    plain = text.plain_source(F.coalesce("target", "core"))
    line = F.concat(F.lit("<li>"), plain, F.lit("</li>\n")) if kind == "html" else F.concat(text.unescape(plain), F.lit("\n"))
    rows = units.select("doc_id", F.struct("part_no", "seg_no").alias("place"), line.alias("line"))
    joined = merge.joined_text(rows, ["doc_id"], "place", "line", "text")
    return joined.withColumn("text", F.concat(F.lit("<html><body><ul>\n"), "text", F.lit("</ul></body></html>\n"))) if kind == "html" else joined


def well_formed(docs: DataFrame) -> DataFrame:
    """doc_id, well_formed, status of XML texts."""
    @F.pandas_udf("boolean")
    def parses(texts: pd.Series) -> pd.Series:
        def test(t):
            try:
                expat.ParserCreate().Parse((t or "").encode("utf-8"), True)
                return True
            except expat.ExpatError:
                return False

        return texts.map(test)

    checked = docs.withColumn("well_formed", parses(F.col("text")))
    return checked.select("doc_id", "well_formed", F.when(F.col("well_formed"), "CONVERSION_SUCCEEDED").otherwise("WARNING_INVALID_XML_EXPORTED").alias("status"))


def write_files(docs: DataFrame, folder: str) -> DataFrame:
    """name, written: docs (name, content) as files below a folder that all executors see, each written by its task under a name of its own
    first, so that a repeated task leaves whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for name, content in zip(pdf["name"], pdf["content"]):
                path = os.path.join(folder, name)
                if content is None:
                    done.append(False)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                own = f"{path}.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(content)
                os.replace(own, path)
                done.append(True)
            yield pd.DataFrame({"name": pdf["name"], "written": done})

    return docs.select("name", "content").mapInPandas(run, "name string, written boolean")
