"""Conversion of whole collections: detection, reading, tables of units, and writing in the same format.

The registry of formats is the plug-in point: `register` adds a tokenizer and a writer of paragraph texts. The output folder
of an export has to be one that all executors see.

    python -m glossaweave.plans.convert import  INPUT_FOLDER  TABLES_FOLDER  en
    python -m glossaweave.plans.convert export  TABLES_FOLDER OUTPUT_FOLDER  fr [PHASE MAX_PHASE]
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charset, detect
from ..operators import targets, units
from ..schema import Parts, diagnostics, formats, paragraphs, skeleton, tokenise_kinds
from ..sinks import export
from ..sources import html, lines, office, plaintext, xliff, xml

NOT_IMPLEMENTED, SUCCEEDED = "ERROR_NOT_IMPLEMENTED", "CONVERSION_SUCCEEDED"


@dataclass
class Format:
    """tokenizer: of one document's text; finish: a paragraph's text in the format's writing (none: it is only read); archive: of members."""

    tokenizer: Callable[[str, Parts], None]
    finish: Callable[[Column], Column] | None = None
    archive: bool = False


FORMATS: dict[str, Format] = {}


def register(kind: str, tokenizer: Callable[[str, Parts], None], finish: Callable[[Column], Column] | None = None, archive: bool = False) -> None:
    FORMATS[kind] = Format(tokenizer, finish, archive)
    if finish:
        export.FINISH[kind] = finish


register("HTML", html.tokenizer(), export.FINISH["HTML"])
register("PLAINTEXT", plaintext.tokenizer, export.FINISH["PLAINTEXT"])
register("XML", xml.tokenizer, export.FINISH["XML"])
register("XLIFF", xliff.tokenizer)
register("MIF", office.mif_tokenizer, export.FINISH["MIF"])
for _kind in ("ODT", "ODS", "ODP"):
    register(_kind, office.odf_tokenizer, export.FINISH["ODT"], archive=True)
for _kind, _tokenizer in lines.TOKENIZERS.items():
    register(_kind, _tokenizer, export.FINISH[_kind])


#: All types; those that need an office suite or a PDF library have no tokenizer here.
KINDS = ("HTML", "PLAINTEXT", "XML", "XLIFF", "MIF", "ODT", "ODS", "ODP", "JAVA_PROPERTIES", "XULDTD", "PO", "WINRC", "WORD", "RTF", "EXCEL", "PPT", "PDF")


def status(source: str, target: str) -> str:
    """Whether documents of one type convert into another: into XLIFF by import, from XLIFF by export (PDF is written as a list in HTML)."""
    if target == "XLIFF":
        return SUCCEEDED if source in FORMATS else NOT_IMPLEMENTED
    if source != "XLIFF":
        return NOT_IMPLEMENTED
    return SUCCEEDED if target == "PDF" or (target in FORMATS and FORMATS[target].finish) else NOT_IMPLEMENTED


def matrix(spark: SparkSession) -> DataFrame:
    """source, target, status of every two types."""
    return spark.createDataFrame([(a, b, status(a, b)) for a in KINDS for b in KINDS], "source string, target string, status string")


#: The same, written out: what is imported and what is exported; nothing else is.
_IMPORTED = ("HTML", "PLAINTEXT", "XML", "XLIFF", "MIF", "ODT", "ODS", "ODP", "JAVA_PROPERTIES", "XULDTD", "PO", "WINRC")
_EXPORTED = ("HTML", "PLAINTEXT", "XML", "MIF", "ODT", "ODS", "ODP", "JAVA_PROPERTIES", "XULDTD", "PO", "WINRC", "PDF")
WANTED = [(a, b, SUCCEEDED if (b == "XLIFF" and a in _IMPORTED) or (a == "XLIFF" and b in _EXPORTED) else NOT_IMPLEMENTED) for a in KINDS for b in KINDS]


def documents(spark: SparkSession, folder: str, declared: str | None = None, lang: str = "en") -> DataFrame:
    """doc_id, name, path (below the folder), content, kind, encoding, lang, status of the files below a folder. Types are detected; plain text is
    what is left with a .txt name or declared so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    kind = detect.resolve(F.lit(declared).cast("string"), F.col("content"), name)
    kind = F.coalesce(kind, F.when(F.lower(name).endswith(".txt"), "PLAINTEXT"))
    below = F.substring_index("path", folder.rstrip("/") + "/", -1)
    rows = files.select(F.col("path").alias("doc_id"), name.alias("name"), below.alias("path"), "content", kind.alias("kind"), F.lit(lang).alias("lang"))
    return rows.withColumn("encoding", encoding(F.col("kind"), F.col("content"), F.col("lang"))).withColumn("status", F.when(F.col("kind").isin(*FORMATS), SUCCEEDED).otherwise(NOT_IMPLEMENTED))


def encoding(kind: Column, content: Column, lang: Column) -> Column:
    """The character set by the rules of each type; lines are counted in the whole document, as Latin-1."""
    head = F.decode(content, "ISO-8859-1")
    by_type = {
        "HTML": F.coalesce(charset.html_charset(head), F.lit("UTF-8")),
        "XML": charset.xml_charset(head),
        "XLIFF": charset.xml_charset(head),
        "PO": charset.catalogue_charset(head, lang),
        "MIF": charset.mif_charset(content),
        "WINRC": F.lit("windows-1252"),
        "JAVA_PROPERTIES": F.lit("ISO-8859-1"),
        "PLAINTEXT": charset.plaintext_charset(lang),
    }
    out = F.lit("UTF-8")
    for label, rule in by_type.items():
        out = F.when(kind == label, rule).otherwise(out)
    return out


def tokenised(docs: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """The documents of all known types, tokenised in one pass, with their `format`. skip: candidates of XML (doc_id, line, col, attribute) that are
    not to be taken."""
    archives = [kind for kind, form in FORMATS.items() if form.archive]
    known = docs.filter(F.col("kind").isin(*FORMATS))
    texts = known.filter(~F.col("kind").isin(archives)).select("doc_id", "kind", charset.decoded(F.col("content"), F.col("encoding")).alias("d"))
    texts = texts.select("doc_id", "kind", "d.text", "d.notice")
    packed = known.filter(F.col("kind").isin(archives))
    members = office.unzipped(packed).withColumn("owner", F.expr("left(doc_id, length(doc_id) - length(substring_index(doc_id, '/', -1)) - 1)"))
    members = members.join(packed.select(F.col("doc_id").alias("owner"), "kind"), "owner").select("doc_id", "kind", "text", F.lit(None).cast("string").alias("notice"))
    tokenizers = {kind: form.tokenizer for kind, form in FORMATS.items()}
    plain, chosen = texts, None
    if skip is not None:
        trees = texts.filter("kind = 'XML'")
        chosen = xml.read(trees, xml.without(xml.candidates(trees), skip)).withColumn("format", F.lit("XML"))
        plain = texts.filter("kind <> 'XML'")
    out = tokenise_kinds(plain.unionByName(members).withColumnRenamed("kind", "format"), tokenizers)
    return out if chosen is None else out.unionByName(chosen)


def tables_of(read: DataFrame, boundary: str = "SENTENCE") -> dict[str, DataFrame]:
    """The tables trans_units, formats, skeleton_parts and diagnostics of tokenised documents, each with `format`. No shuffle."""
    by = lambda part, hidden: units.trans_units(units.segments(paragraphs(part), boundary, hidden))
    made = by(read.filter("format = 'XML'"), True).unionByName(by(read.filter("format <> 'XML'"), False))
    return {"trans_units": made, "formats": formats(read), "skeleton_parts": skeleton(read), "diagnostics": diagnostics(read, F.col("format"))}


def write_tables(docs: DataFrame, folder: str, boundary: str = "SENTENCE", skip: DataFrame | None = None) -> None:
    """All tables, partitioned by format. Files are read and tokenised once; the other tables come from the tokenised ones."""
    spark = docs.sparkSession
    docs.drop("content").write.mode("overwrite").parquet(f"{folder}/documents")
    archives = [kind for kind, form in FORMATS.items() if form.archive]
    docs.filter(F.col("kind").isin(archives)).select("doc_id", "kind", "content").write.mode("overwrite").parquet(f"{folder}/archives")
    read = tokenised(docs, skip)
    read.write.mode("overwrite").partitionBy("format").parquet(f"{folder}/tokenised")
    for name, table in tables_of(spark.read.schema(read.schema).parquet(f"{folder}/tokenised"), boundary).items():
        table.write.mode("overwrite").partitionBy("format").parquet(f"{folder}/{name}")


def export_documents(spark: SparkSession, folder: str, lang: str, phase: str | None = None, most: int = 0, encoding: str = "UTF-8") -> DataFrame:
    """doc_id, name, path, kind, text, content (bytes in the encoding, or the archive; null if one cannot be opened) of every document in the
    given language. A table `targets` (tu_id, lang, phase, kind, ordinal, text) below the folder holds the translations; what has none
    is marked so. Documents of types that are only read have no row."""
    chosen = targets.choose(spark.read.parquet(f"{folder}/targets"), lang, phase, most)
    names = spark.read.parquet(f"{folder}/documents").filter(F.col("status") == SUCCEEDED).select("doc_id", "name", "path", "kind")
    # Units count from 1 in their document's order.
    place = Window.partitionBy("doc_id").orderBy("part_no", "seg_no")
    every = spark.read.parquet(f"{folder}/trans_units").withColumn("ordinal", F.row_number().over(place))
    made, read = targets.with_default(every, chosen), spark.read.parquet(f"{folder}/tokenised")
    out = None
    for kind in [r["kind"] for r in names.select("kind").distinct().orderBy("kind").collect()]:  # at most one a format
        form = FORMATS[kind]
        if not form.finish:
            continue
        texts = export.export(read.filter(F.col("format") == kind), made.filter(F.col("format") == kind), "ODT" if form.archive else kind)
        if form.archive:
            archives = spark.read.parquet(f"{folder}/archives").filter(F.col("kind") == kind)
            texts = office.rezipped(archives, texts).withColumn("text", F.lit(None).cast("string"))
        else:
            texts = export.with_charset(texts, kind, encoding)
            texts = texts.withColumn("content", charset.encoded(F.col("text"), F.lit(encoding)))
        own = names.filter(F.col("kind") == kind)
        named = texts.join(own, "doc_id").select("doc_id", export.output_name(F.col("name"), lang, kind).alias("name"), export.output_name(F.col("path"), lang, kind).alias("path"), "kind", "text", "content")
        out = named if out is None else out.unionByName(named)
    return out


def xliff_documents(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """doc_id, text: an XLIFF document of every imported one, with the targets there are."""
    names = spark.read.parquet(f"{folder}/documents").select("doc_id", "name", F.lower("kind").alias("datatype"))
    return xliff.write(spark.read.parquet(f"{folder}/trans_units"), lang, names, chosen=spark.read.parquet(f"{folder}/targets"))


def main(arguments: list[str]) -> None:
    mode, source, out, lang, *rest = arguments
    spark = SparkSession.builder.appName("convert").getOrCreate()
    if mode == "import":
        write_tables(documents(spark, source, lang=lang), out)
    elif mode == "export":
        phase, most = (rest[0], int(rest[1])) if len(rest) == 2 else (None, 0)
        done = export.write_files(export_documents(spark, source, lang, phase, most).select(F.col("path").alias("name"), "content"), out)
        done.write.format("noop").mode("overwrite").save()
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
