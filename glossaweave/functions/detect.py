"""Format detection from a document's first bytes and its name, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_BYTES = 3072
# The type names of XLIFF's datatype attribute, extensions, and OLE's first bytes.
OLE = "D0CF11E0A1B11AE1"
EXTENSIONS = {"doc": "WORD", "xls": "EXCEL", "ppt": "PPT"}
FALLBACK = {"properties": "JAVA_PROPERTIES", "dtd": "XULDTD", "po": "PO", "pot": "PO", "rc": "WINRC"}
DATATYPES = {
    "xml": "XML", "html": "HTML", "mif": "MIF", "rtf": "RTF", "x-word": "WORD", "x-excel": "EXCEL", "x-odp": "ODP", "x-ods": "ODS",
    "x-odt": "ODT", "x-ppt": "PPT", "x-pdf": "PDF", "javapropertyresourcebundle": "JAVA_PROPERTIES", "xmldtd": "XULDTD", "po": "PO",
    "winres": "WINRC", "plaintext": "PLAINTEXT",
}
MAY_LIE = ("EXCEL", "WORD", "PPT", "MSOFFICEDOC")


def signature(content: Column) -> Column:
    return F.substring(content, 1, SIGNATURE_BYTES)


def _at(content: Column, start: int, text: str) -> Column:
    return F.substring(content, start + 1, len(text)) == F.lit(text.encode())


def _text(content: Column) -> Column:
    """The bytes as Latin-1 characters, for patterns."""
    return F.decode(signature(content), "ISO-8859-1")


def _opendocument(content: Column, name: str) -> Column:
    kind = f"vnd.oasis.opendocument.{name}"
    dash = F.substring(content, 51 + len(kind), 1) == F.lit(b"-")
    return _at(content, 0, "PK\x03\x04") & _at(content, 30, "mimetype") & _at(content, 50, kind) & ~dash


def tests(content: Column) -> list[tuple[str, Column]]:
    """(type, predicate) in the order in which types are tried."""
    head, text = F.hex(F.substring(content, 1, 8)), _text(content)
    word = head.startswith("FE370023") | head.startswith("DBA52D000000") | head.startswith("31BE0000") | _at(content, 0, "PO^Q`") | _at(content, 2112, "MSWordDoc")
    sheet = _at(content, 2080, "Microsoft Excel 5.0 Worksheet") | _at(content, 2080, "Foglio di lavoro Microsoft Exce")
    excel = (head == "0904060000001000") | sheet | _at(content, 2114, "Biff5") | _at(content, 2121, "Biff5")
    html = (F.length(content) >= 5) & F.substring(text, 1, 256).rlike("(?is)<!DOCTYPE\\s+html|<head|<title|<html")
    return [
        ("MSOFFICEDOC", head == OLE),
        ("EXCEL", excel),
        ("WORD", word),
        ("ODT", _opendocument(content, "text")),
        ("ODS", _opendocument(content, "spreadsheet")),
        ("ODP", _opendocument(content, "presentation")),
        ("RTF", text.rlike("^\\{\\\\rtf[0-9]\\s*\\\\(ansi|mac|pc)")),
        ("MIF", text.rlike("^<MIFFile [0-9]\\.[0-9]")),
        ("PDF", text.rlike("^%PDF-[0-9]\\.[0-9]")),
        ("XLIFF", text.rlike("(?s)^.{0,3}<\\?xml.*<xliff")),
        ("HTML", html),
        ("XML", text.rlike("(?s)^.{0,3}<\\?xml version")),
    ]


def _choice(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, label in table.items():
        out = F.when(key == value, label).otherwise(out)
    return out


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))


def by_signature(content: Column) -> Column:
    kind = F.lit(None).cast("string")
    for label, test in reversed(tests(content)):
        kind = F.when(test, label).otherwise(kind)
    return kind


def identify(content: Column, name: Column | None = None) -> Column:
    """The type by the first test that holds; OLE is told apart by the name's extension, and some types are known by it alone."""
    kind = by_signature(content)
    if name is None:
        return kind
    office = F.when(kind == "MSOFFICEDOC", F.coalesce(_choice(extension(name), EXTENSIONS), kind)).otherwise(kind)
    return F.coalesce(office, _choice(extension(name), FALLBACK))


def resolve(declared: Column, content: Column, name: Column) -> Column:
    """The declared type if its own test holds, office types aside; else the detected one. Where nothing is detected, or no more than that it
    is some office document, the caller is trusted."""
    agrees, detected = F.lit(False), by_signature(content)
    for label, test in tests(content):
        agrees = agrees | ((declared == label) & test)
    detected = F.when(detected == "MSOFFICEDOC", F.coalesce(_choice(extension(name), EXTENSIONS), detected)).otherwise(detected)
    trusted = detected.isNull() | ((detected == "MSOFFICEDOC") & declared.isin("EXCEL", "WORD", "PPT"))
    return F.when(declared.isNull(), identify(content, name)).when((agrees & ~declared.isin(*MAY_LIE)) | trusted, declared).otherwise(detected)


def from_datatype(xliff: Column) -> Column:
    """The type named by the datatype attribute of an XLIFF file element."""
    name = F.lower(F.regexp_extract(xliff, "(?s)<file\\s[^>]*datatype=['\"]([^'\"]*)['\"]", 1))
    kind = F.lit(None).cast("string")
    for label, t in DATATYPES.items():
        kind = F.when(name == label, t).otherwise(kind)
    return kind
