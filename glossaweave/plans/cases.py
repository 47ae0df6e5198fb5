"""Queries of rules that the given tables do not show by themselves: small cases, each filled with a word of every turn of a conversation.

A case is (name, input, wanted); `{t}` stands for the turn's word (its role, conversation and number). The SQL gives what is
wanted; the query runs the operator on the inputs. So every row of the table takes part in every case.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charset, codes, detect, sentences, text
from ..operators import merge, targets, units
from ..schema import TOKENISED, diagnostics, paragraphs, tokenise
from ..sinks import export
from ..sources import html, lines, office, plaintext, xliff, xml

_WORD = "role || conv_id || 'x' || turn"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inputs(spark, folder: str, cases: list[tuple[str, str, str]]) -> DataFrame:
    """doc_id, conv_id, turn, name, text (the input, filled)."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.concat("role", F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string")).alias("t"))
    given = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(body).alias("body")) for name, body, _ in cases])).alias("c")
    rows = turns.select("conv_id", "turn", "t", given)
    filled = F.replace(F.col("c.body"), F.lit("{t}"), F.col("t"))
    return rows.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "c.name").alias("doc_id"), "conv_id", "turn", F.col("c.name").alias("name"), filled.alias("text"))


def wanted(cases: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"({_sql(name)}, {_sql(want)})" for name, _, want in cases)
    return f"SELECT conv_id, turn, name, replace(want, '{{t}}', {_WORD}) AS got FROM conversations, (VALUES {rows}) c(name, want)"


def of_column(made: Callable[[Column], Column]):
    """A query of a column function."""
    return lambda spark, folder, cases: inputs(spark, folder, cases).select("conv_id", "turn", "name", made(F.col("text")).alias("got"))


def of_documents(made: Callable[[DataFrame], DataFrame]):
    """A query of a function from documents (doc_id, text) to results (doc_id, text)."""

    def run(spark, folder, cases):
        docs = inputs(spark, folder, cases)
        parts = F.split("doc_id", "/")
        return made(docs.select("doc_id", "text")).select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), parts[2].alias("name"), F.col("text").alias("got"))

    return run


def _paragraphs(read: DataFrame) -> DataFrame:
    """The paragraphs of a document, one behind the other."""
    found = F.transform(F.filter("parts", lambda p: p["kind"] != "literal"), lambda p: p["text"])
    return read.select("doc_id", F.array_join(found, " | ").alias("text"))


def _exported(read_of: Callable[[DataFrame], DataFrame], kind: str, target: Callable[[Column], Column] | None = None):
    """Documents read, every unit given a target (its core in capitals, tags left as they are), and written again."""

    def run(docs: DataFrame) -> DataFrame:
        read = read_of(docs)
        made = units.trans_units(units.segments(paragraphs(read), "PARAGRAPH", kind == "XML"))
        return export.export(read, made.withColumn("target", (target or (lambda c: F.concat(c, F.lit("+"))))(F.col("core"))), kind)

    return run


def _bytes(column: Column) -> Column:
    return F.unbase64(column)


def _b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


OLE = bytes.fromhex("d0cf11e0a1b11ae1")


def _zip_head(kind: str, behind: str = "") -> bytes:
    return b"PK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/" + f"vnd.oasis.opendocument.{kind}{behind}".encode() + b"\0" * 8


SIGNATURES = [
    ("ole", OLE + b"x", "MSOFFICEDOC"), ("excel4", bytes.fromhex("0904060000001000"), "EXCEL"), ("excel-product", b"\0" * 2080 + b"Microsoft Excel 5.0 Worksheet", "EXCEL"), ("biff5", b"\0" * 2114 + b"Biff5", "EXCEL"),
    ("word-fe", bytes.fromhex("fe370023"), "WORD"), ("word-db", bytes.fromhex("dba52d000000"), "WORD"), ("word-31", bytes.fromhex("31be0000"), "WORD"), ("word-po", b"PO^Q`", "WORD"), ("word-doc", b"\0" * 2112 + b"MSWordDoc", "WORD"),
    ("odt", _zip_head("text"), "ODT"), ("ods", _zip_head("spreadsheet"), "ODS"), ("odp", _zip_head("presentation"), "ODP"), ("odt-template", _zip_head("text", "-template"), ""),
    ("rtf", b"{\\rtf1\\ansi x}", "RTF"), ("rtf-mac", b"{\\rtf1 \\mac", "RTF"), ("rtf-none", b"{\\rtf", ""), ("mif", b"<MIFFile 7.00>", "MIF"), ("pdf", b"%PDF-1.4", "PDF"),
    ("xliff", b"<?xml version='1.0'?>\n<xliff version='1.1'>", "XLIFF"), ("xliff-bom", b"\xef\xbb\xbf<?xml version='1.0'?><xliff>", "XLIFF"), ("xml", b"<?xml version='1.0'?><a/>", "XML"),
    ("html", b"  <HTML><p>", "HTML"), ("html-title", b"<title>", "HTML"), ("html-late", b" " * 300 + b"<html>", ""), ("none", b"abc", ""),
]
DECLARED = [
    ("word-as-rtf", "WORD|a|" + _b64(b"{\\rtf1\\ansi x}"), "RTF"), ("word-as-ole", "WORD|a|" + _b64(OLE), "WORD"), ("word-ole-xls", "WORD|{t}.XLS|" + _b64(OLE), "EXCEL"), ("html-as-ole", "HTML|a.txt|" + _b64(OLE), "MSOFFICEDOC"),
    ("xml-is-xliff", "XML|a|" + _b64(b"<?xml version='1.0'?><xliff>"), "XML"), ("html-is-xliff", "HTML|a|" + _b64(b"<?xml version='1.0'?><xliff>"), "XLIFF"), ("html-unknown", "HTML|{t}|" + _b64(b"plain"), "HTML"),
    ("none-po", "|{t}.po|" + _b64(b"plain"), "PO"), ("none-rc", "|{t}.RC|" + _b64(b"plain"), "WINRC"), ("none-pot", "|a.pot|" + _b64(b""), "PO"), ("none-dtd", "|a.dtd|" + _b64(b"x"), "XULDTD"), ("none-doc", "|{t}.doc|" + _b64(OLE), "WORD"), ("none-ppt", "|{t}.ppt|" + _b64(OLE), "PPT"), ("none", "|a.bin|" + _b64(b"x"), ""),
]
#: The head of a catalogue, and the bytes of an encoding statement's sample text.
PO_HEAD = "\nmsgid \"\"\nmsgstr \"\"\n\"Language: x\\n\"\n\"Content-Type: text/plain; charset={}\\n\"\n"
MIF_SAMPLES = {"Shift_JIS": "93fa967b8cea", "EUC-JP": "c6fccbdcb8ec", "Big5": "a4a4a4e5", "EUC-TW": "c4e3c5c6", "GB2312": "d6d0cec4", "EUC-KR": "c7d1b1b9beee"}
SAMPLES = {"ISO-8859-1": "é ß", "ISO-8859-2": "ąčř", "ISO-8859-3": "ħ", "ISO-8859-5": "мир", "ISO-8859-6": "اب", "ISO-8859-7": "αβ", "ISO-8859-8": "אב", "ISO-8859-9": "ğış", "ISO-8859-13": "ąčė", "windows-1251": "мир", "windows-1252": "€ œ", "KOI8-R": "мир", "KOI8-T": "мир", "KOI8-U": "їє", "EUC-JP": "日本", "EUC-KR": "한국", "Shift_JIS": "日本", "TIS-620": "ไทย", "Big5": "中文", "GB2312": "中文", "UTF-8": "é日", "UTF-16": "é日"}


def _declared(c: Column) -> Column:
    piece = lambda i: F.get(F.split(c, "\\|"), F.lit(i))
    return F.coalesce(detect.resolve(F.nullif(piece(0), F.lit("")), _bytes(piece(2)), piece(1)), F.lit(""))


def _decoded(c: Column) -> Column:
    name, body = F.get(F.split(c, "\\|"), F.lit(0)), _bytes(F.get(F.split(c, "\\|"), F.lit(1)))
    d = charset.decoded(body, name)
    return F.concat(F.coalesce(d["text"], F.lit("no text")), F.lit(" / "), F.coalesce(d["notice"], F.lit("")))


def _odf(body: str) -> str:
    return f"<?xml version='1.0'?><d xmlns:office='o' xmlns:style='s' xmlns:text='t' xmlns:fo='f'><style:style style:name='B'><style:text-properties fo:font-weight='bold' fo:font-style='italic'/></style:style><style:style style:name='U'><style:text-properties style:text-position='-33% 58%' style:text-underline-style='solid'/></style:style>{body}</d>"


_read_xml = xml.read
_read_odf = lambda docs: tokenise(docs, office.odf_tokenizer)
_read_xliff = xliff.read
_tags = lambda c: F.upper(c)

#: name: (rule, cases, query)
CASES: dict[str, tuple[str, list[tuple[str, str, str]], Callable]] = {
    "detect_all_signatures": ("D6, D8b-D8h", [(n, _b64(raw), want) for n, raw, want in SIGNATURES], of_column(lambda c: F.coalesce(detect.by_signature(_bytes(c)), F.lit("")))),
    "detect_declared_type": ("D3, D4, D7", DECLARED, of_column(_declared)),
    "detect_xliff_datatype": ("D5", [(k, f"<xliff><file original='{{t}}' source-language='en' datatype='{k}'>", v) for k, v in detect.DATATYPES.items()] + [("other", "<file datatype='x-other'>", "")], of_column(lambda c: F.coalesce(detect.from_datatype(c), F.lit("")))),
    "decode_charsets": ("E2, E3, E5", [(n, f"{n}|" + _b64(s.encode(n)), f"{s} / ") for n, s in SAMPLES.items()] + [("bad-byte", "UTF-8|" + _b64(b"a\xffb"), "a\ufffdb / bytes that are not UTF-8 were replaced"), ("unknown", "EUC-TW|" + _b64(b"x"), "no text / unknown character set EUC-TW")], of_column(_decoded)),
    "decode_frame_roman": ("E7", [("frame", "x-frame-roman|" + _b64(bytes([0x41, 0x80, 0xA5, 0xAD, 0xB3, 0xD0, 0xF5, 0x10, 0x11, 0x04, 0xFF, 0x01])), "AÄ•¦Š–€\u2007\u00a0\u00ad\ufffd\ufffd / ")], of_column(_decoded)),
    "html_stated_charset": ("E1", [
        ("equiv", "<html><META HTTP-EQUIV=\"Content-Type\" content=\"text/html; charset=Shift_JIS\"><p>{t}", "Shift_JIS"), ("short", "<meta charset='utf-8'>{t}", "none"), ("comment", "<!-- <meta http-equiv='content-type' content='x; charset=a'> -->{t}", "none"),
        ("deep", "<!-- x -->\n" * 1000 + "<meta http-equiv='content-type' content='text/html; charset=koi8-r'>", "koi8-r"), ("too-deep", "\n" * 1100 + "<meta http-equiv='content-type' content='text/html; charset=koi8-r'>", "none"),
    ], of_column(lambda c: F.coalesce(charset.html_charset(c), F.lit("none")))),
    "catalogue_charsets": ("E3", [(k, f"|{k}", v) for k, v in charset.CATALOGUE.items()] + [("pl_PL", "|pl_PL", "ISO-8859-2"), ("zh", "|zh", "UTF-8"), ("zh-TW", "|zh-TW", "Big5"), ("xx", "|xx", "UTF-8"), ("header", "# {t}" + PO_HEAD.format("koi8-r") + "|de", "koi8-r"), ("placeholder", PO_HEAD.format("CHARSET") + "|de", "ISO-8859-1"), ("in-a-text", "msgid \"use charset=koi8-r here\"\nmsgstr \"{t}\"|de", "ISO-8859-1"), ("in-a-later-entry", PO_HEAD.format("big5") + "\nmsgid \"a\"\nmsgstr \"Content-Type: text/plain; charset=koi8-r\"|de", "big5"), ("no-type", "msgid \"\"\nmsgstr \"\"\n\"charset=koi8-r\\\\n\"\n|xx", "UTF-8")], of_column(lambda c: charset.catalogue_charset(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)))),
    "mif_charsets": ("E4", [(n, _b64(b"<MIFFile 7.00>\n<MIFEncoding `" + bytes.fromhex(raw) + b"'>"), n) for n, raw in MIF_SAMPLES.items()] + [("half-bytes", _b64(b"<MIFFile 7.00>\n<MIFEncoding `ZJJNP'>"), "x-frame-roman"), ("sample-alone", _b64(b"<MIFFile 7.00> \xa4\xa4\xa4\xe5"), "x-frame-roman"), ("font", _b64(b"<MIFFile 7.00>\n<FEncoding `BIG5'>"), "Big5"), ("own", _b64(b"<MIFFile 7.00>"), "x-frame-roman")], of_column(lambda c: charset.mif_charset(_bytes(c)))),
    "xml_charsets": ("E6", [("stated", "<?xml version='1.0' encoding='ISO-8859-2'?><{t}/>", "ISO-8859-2"), ("none", "<?xml version='1.0'?><{t}/>", "UTF-8"), ("late", "{t}<?xml version='1.0' encoding='x'?>", "UTF-8")], of_column(charset.xml_charset)),
    "mark_core_tagged": ("N2, N2a, N2c, N2e", [
        ("pair", "<bx id='1' rid='1'/>{t}<ex id='2' rid='1'/>", "<bx id='1' rid='1'/><mrk mtype='x-coretext'>{t}</mrk><ex id='2' rid='1'/>"), ("inner", "a <bx id='1' rid='1'/>{t}<ex id='2' rid='1'/>", "<mrk mtype='x-coretext'>a <bx id='1' rid='1'/>{t}<ex id='2' rid='1'/></mrk>"),
        ("half", "<bx id='1' rid='1'/>{t} <ex id='2' rid='1'/> b", "<mrk mtype='x-coretext'><bx id='1' rid='1'/>{t} <ex id='2' rid='1'/> b</mrk>"), ("single", " <x id='1'/> {t}\u2022 ", " <x id='1'/> <mrk mtype='x-coretext'>{t}</mrk>\u2022 "),
        ("marked", "<mrk mtype='x-coretext'>{t}</mrk>", "<mrk mtype='x-coretext'>{t}</mrk>"), ("legacy", "<lt:core>{t}</lt:core>", "<mrk mtype='x-coretext'>{t}</mrk>"), ("nothing", "<x id='1'/> - \u2022", ""),
    ], of_column(lambda c: codes.column(codes.mark_core)(c))),
    "core_segments_glued": ("N1", [("two", "{t} One! ___", "<mrk mtype='x-coretext'>{t} One!</mrk> ___"), ("three", "{t} a. B b! C c?", "<mrk mtype='x-coretext'>{t} a.</mrk> || <mrk mtype='x-coretext'>B b!</mrk> || <mrk mtype='x-coretext'>C c?</mrk>")], of_column(lambda c: F.array_join(F.transform(sentences.core_segments(c), lambda s: F.rtrim(s)), " || "))),
    "remove_merger_marks": ("N6", [("mark", "a<mrk mtype='x-mergeboundary' id='{t}'>b", "ab"), ("other", "a<mrk mtype='x'>{t}", "a<mrk mtype='x'>{t}")], of_column(text.remove_merger_marks)),
    "replace_core": ("N7", [("marked", "p<mrk mtype='x-coretext'>{t}</mrk>s", "p<mrk mtype='x-coretext'>new</mrk>s"), ("empty", "", "<mrk mtype='x-coretext'>new</mrk>")], of_column(lambda c: text.replace_core(c, F.lit("new")))),
    "standalone_codes": ("N8", [("x", "{t}<x id='1' ctype='lb'/>", "true"), ("bx", "{t}<bx id='1' rid='1'/>", "false"), ("none", "{t}", "false")], of_column(lambda c: text.is_standalone(c).cast("string"))),
    "repair_lenient": ("N9", [("tags", "<bx id='1' rid='1'/>{t}<foo a='b'>& \"q\"</foo><ex id='2' rid='1'/>", "<bx id='1' rid='1'/>{t}&amp; &quot;q&quot;<ex id='2' rid='1'/>"), ("plain", "{t} & &lt; &amp;", "{t} &amp; &lt; &amp;")], of_column(lambda c: codes.column(codes.keep_codes)(c))),
    "repair_strict": ("N10", [("good", "<bx id='1' rid='1'/>{t}<ex id='2' rid='1'/>", "<bx id='1' rid='1'/>{t}<ex id='2' rid='1'/>"), ("crossed", "<bx id='1' rid='1'/><bx id='2' rid='2'/>{t}<ex id='3' rid='1'/><ex id='4' rid='2'/>", "{t}"), ("open", "<bx id='1' rid='1'/>{t}", "{t}"), ("no-id", "<bx id='1' rid='1'/><x/>{t}<ex id='2' rid='1'/>", "<bx id='1' rid='1'/>{t}<ex id='2' rid='1'/>")], of_column(lambda c: codes.column(codes.repair_strict)(c))),
    "html_text_attributes": ("N18", [("alt", "<img alt='{t} cat'>", "{t} cat"), ("button", "<p>x<input type=\"button\" value=\"{t}\"></p>", "x | {t}"), ("hidden", "<input type='hidden' value='{t}'>", ""), ("title", "<p>See <a href='{t}' title='tip {t}'>it</a></p>", "tip {t} | See <bx id='1' ctype='link' rid='1'/>it<ex id='2' rid='1'/>"), ("table", "<table summary='{t}'></table>", "{t}")], of_documents(lambda d: _paragraphs(html.read(d)))),
    "collapse_nested_codes": ("N20", [("nested", "<p><b><i>{t}</i></b> z</p>", "<bx id='1' ctype='italic' rid='1'/>{t}<ex id='4' rid='1'/> z"), ("link", "<p>a <span><a href='x'>{t}</a></span></p>", "a <bx id='1' ctype='link' rid='1'/>{t}<ex id='4' rid='1'/>"), ("empty", "<p>{t} <b></b> z</p>", "{t} <x id='1' ctype='bold'/> z")], of_documents(lambda d: _paragraphs(html.read(d)))),
    "html_bookmarks_first": ("N19", [("bookmark", "<p>One <a name=\"{t}\"></a>two</p>", "<x id='1' ctype='link'/>One two"), ("link", "<p>One <a href=\"{t}\">two</a></p>", "One <bx id='1' ctype='link' rid='1'/>two<ex id='2' rid='1'/>")], of_documents(lambda d: _paragraphs(html.read(d, move_bookmarks=True)))),
    "pdf_tagged_text": ("N16, N17", [("codes", "<p>{t} <sub>2</sub> <spacecount n='3'/>z</p><li>b</li>", "{t} <bx id='1' ctype='x-pdf-sub' rid='1'/>2<ex id='2' rid='1'/> <x id='3' ctype='x-pdf-spacecount'/>z | b"), ("bold", "<div>a <b>{t}</b></div>", "a <bx id='1' ctype='bold' rid='1'/>{t}<ex id='2' rid='1'/>")], of_documents(lambda d: _paragraphs(html.read_pdf(d)))),
    "html_ctypes": ("N17", [(t, f"<p>a <{t}>{{t}}</{t}> z</p>", f"a <bx id='1' ctype='{c}' rid='1'/>{{t}}<ex id='2' rid='1'/> z") for t, c in html.INLINE_TAGS.items() if t not in html.EMPTY_INLINE] + [("image", "<p>a <img src='{t}'> z</p>", "a <x id='1' ctype='image'/> z")], of_documents(lambda d: _paragraphs(html.read(d)))),
    "output_names": ("K1, K7", [("html", "{t}.html", "{t}.fr.html"), ("none", "{t}", "{t}.fr"), ("folders", "a.b/{t}.tar.html", "a.b/{t}.tar.fr.html")], of_column(lambda c: export.output_name(c, "fr", "HTML"))),
    "output_names_properties": ("K7", [("properties", "{t}.properties", "{t}_fr.properties")], of_column(lambda c: export.output_name(c, "fr", "JAVA_PROPERTIES"))),
    "odf_inline_codes": ("S5, N22", [("span", _odf("<text:p>a <text:span text:style-name='B'>{t}</text:span></text:p>"), "a <bx id='1' ctype='bold-italic' rid='1'/>{t}<ex id='2' rid='1'/>"), ("sub", _odf("<text:p>a <text:span text:style-name='U'>{t}</text:span></text:p>"), "a <bx id='1' ctype='x-odf-sub-underline' rid='1'/>{t}<ex id='2' rid='1'/>"), ("tab", _odf("<text:h>a<text:tab/>{t}<text:line-break/>b</text:h>"), "a<x id='1' ctype='x-odf-tab'/>{t}<x id='2' ctype='lb'/>b"), ("link", _odf("<text:p>a <text:a href='{t}'>b</text:a></text:p>"), "a <bx id='1' ctype='link' rid='1'/>b<ex id='2' rid='1'/>")], of_documents(lambda d: _paragraphs(_read_odf(d)))),
    "odf_notes_are_asides": ("N23", [("note", _odf("<text:p>a<text:note><text:note-body><text:p>{t} note</text:p></text:note-body></text:note> b</text:p>"), "{t} note")], of_documents(lambda d: _paragraphs(_read_odf(d)).withColumn("text", F.substring_index("text", " | ", 1)))),
    "mif_paragraphs": ("S8, N26, N29", [("joined", "<MIFFile 7.00>\n<Para <ParaLine <String `{t} \\>a'>\n<Char EmDash>\n<String `end'>>>\n", "{t} &gt;a\u2014end"), ("break", "<MIFFile 7.00>\n<Para <ParaLine <String `{t}'><Char HardReturn>>\n<ParaLine <String `b\\x80 '>>>\n", "{t}<x id='1' ctype='lb'/>bÄ"), ("quotes", "<MIFFile 7.00>\n<Para <ParaLine <String `\\Q{t}\\q\\t\\\\'>>>", "`{t}'\t\\")], of_documents(lambda d: _paragraphs(office.read_mif(d)))),
    "xliff_inline": ("S4", [("g", "<xliff><trans-unit id='u'><source>a <g id='1' ctype='bold'>{t}</g></source></trans-unit></xliff>", "a <bx id='1' ctype='bold' rid='1'/>{t}<ex id='2' rid='1'/>"), ("bpt", "<trans-unit id='u'><source><bpt id='1'>&lt;b&gt;</bpt>{t}<ept id='1'>&lt;/b&gt;</ept></source></trans-unit>", "<bx id='1' ctype='x-xliff-bpt' rid='1'/>{t}<ex id='2' rid='1'/>"), ("sub", "<trans-unit id='u'><source>a<ph id='1'>p<sub>{t} in</sub></ph></source></trans-unit>", "{t} in | a<x id='1' ctype='x-xliff-ph'/>"), ("it", "<trans-unit id='u'><source>{t}<it id='1' pos='open'>i</it></source></trans-unit>", "{t}<x id='1' ctype='x-xliff-it-open'/>"), ("mrk", "<trans-unit id='u'><source><mrk mtype='term'>{t}</mrk> b</source></trans-unit>", "<bx id='1' ctype='x-xliff-mrk-mtype-term' rid='1'/>{t}<ex id='2' rid='1'/> b")], of_documents(lambda d: _paragraphs(_read_xliff(d)))),
    "xml_extraction": ("S3, X2, X3, X7", [("cdata", "<d><p>{t} <![CDATA[<raw>]]></p></d>", "{t} <x id='1' ctype='x-ctype'/>"), ("nested", "<d><p>a <b k='{t}'>{t}</b></p></d>", "{t} | a <bx id='1' ctype='x-xml-b' rid='1'/>{t}<ex id='2' rid='1'/>"), ("broken", "<d><p>{t}</d>", "")], of_documents(lambda d: _paragraphs(_read_xml(d)))),
    "xml_attribute_values": ("X3", [(n, f"<d a='{v}'>{{t}}</d>", w) for n, v, w in (("yes", "yes", "0"), ("url", "https://x.y/z", "0"), ("up", "../a", "0"), ("hash", "#top", "0"), ("hex", "ffAA00", "0"), ("empty", "", "0"), ("dashes", "\u2014 \u00ab1\u00bb", "0"), ("bullets", "\u2022\u00a02", "0"), ("math", "$ + = ^", "1"), ("words", "two words", "1"), ("Yes", "Yes", "1"), ("seven", "ffAA000", "1"))], of_documents(lambda d: d.join(xml.candidates(d).filter("attribute IS NOT NULL").groupBy("doc_id").count(), "doc_id", "left").select("doc_id", F.coalesce("count", F.lit(0)).cast("string").alias("text")))),
    "rc_escapes": ("N28, S13", [("wide", "STRINGTABLE\nBEGIN\n IDS_1, L\"\\x0041{t}\"\nEND\n", "A{t}"), ("narrow", "IDD DIALOG\nCAPTION \"\\x41 \"\"{t}\"\"\"\n", "A &quot;{t}&quot;"), ("braces", "STRINGTABLE {\n IDS_2 \"{t}\"\n}\nCAPTION \"z\"\n", "{t} | z")], of_documents(lambda d: _paragraphs(lines.read(d, "WINRC")))),
    "po_paragraphs": ("S12", [("lines", "msgid \"\"\nmsgstr \"\"\n\n#: f\nmsgid \"{t} \"\n\"two\\n\"\nmsgstr \"old\"\nmsgid \"q \\\"x\\\"\"\nmsgstr \"\"\n", "{t} two<x id='1' ctype='lb'/> | q &quot;x&quot;")], of_documents(lambda d: _paragraphs(lines.read(d, "PO")))),
    "smart_quotes": ("L11", [("between", "<a t='x'>it's \"{t}\"</a>", "<a t='x'>it&#x27;s &quot;{t}&quot;</a>"), ("plain", "it's {t}", "it's {t}")], of_column(text.smart_quotes)),
    "meta_charset_rewritten": ("L12", [("meta", "<META http-equiv='Content-Type' content='text/html; charset=koi8-r'><p>{t}", "<META http-equiv='Content-Type' content='text/html; charset=UTF-8'><p>{t}"), ("other", "<p>charset=koi8-r {t}", "<p>charset=koi8-r {t}")], of_column(lambda c: text.rewrite_meta_charset(c, "UTF-8"))),
    "catalogue_header_rewritten": ("K9", [("header", "msgid \"\"\nmsgstr \"Content-Type: text/plain; charset=koi8-r\\n\"\n\nmsgid \"charset=koi8-r {t}\"\n", "msgid \"\"\nmsgstr \"Content-Type: text/plain; charset=UTF-8\\n\"\n\nmsgid \"charset=koi8-r {t}\"\n"), ("none", "msgid \"{t}\"\n", "msgid \"{t}\"\n")], of_documents(lambda d: export.with_charset(d, "PO", "UTF-8"))),
    "missing_target_note": ("L5", [("core", "a <x id='1' ctype='lb'/>{t} &amp;", " [Segment 7 not yet translated: a {t} &amp;] ")], of_column(lambda c: targets.untranslated(F.lit(7), c))),
    "export_html": ("K1, L6, L9, L10", [("codes", "<p>a <b>{t}</b> z</p><img alt=\"{t}\">", "<p>a <b>{t}</b> z+</p><img alt=\"{t}+\">"), ("kept", "<p>___</p><p>{t}</p>", "<p>___</p><p>{t}+</p>")], of_documents(_exported(html.read, "HTML"))),
    "export_plaintext": ("K2", [("paragraphs", "{t} a\n\n  b < c\n", "{t} a+\n\n  b < c+\n")], of_documents(_exported(plaintext.read, "PLAINTEXT"))),
    "export_xml": ("K3", [("tree", "<?xml version='1.0'?>\n<d n='two {t}'><p>a <b>{t}</b></p><!-- c --></d>", "<?xml version='1.0'?>\n<d n='two {t}+'><p>a <b>{t}</b>+</p><!-- c --></d>")], of_documents(_exported(_read_xml, "XML"))),
    "export_odf": ("K4", [("content", _odf("<text:p>a <text:span text:style-name='B'>{t}</text:span> b</text:p>"), _odf("<text:p>a <text:span text:style-name='B'>{t}</text:span> b+</text:p>"))], of_documents(_exported(_read_odf, "ODT"))),
    "export_mif": ("K6", [("string", "<MIFFile 7.00>\n<Para <ParaLine <String `{t} \\>'>>>\n", "<MIFFile 7.00>\n<Para <ParaLine <String `{t} \\>+'>>>\n")], of_documents(_exported(office.read_mif, "MIF"))),
    "export_dtd": ("K8", [("entity", "<!-- c -->\n<!ENTITY a \"{t}\">\n", "<!-- c -->\n<!ENTITY a \"{t}+\">\n")], of_documents(_exported(lambda d: lines.read(d, "XULDTD"), "XULDTD"))),
    "export_po": ("K9", [("lines", "msgid \"{t}\\nb\"\nmsgstr \"old\"\n", "msgid \"{t}\\nb\"\nmsgstr \"{t}\\nb+\"\n")], of_documents(_exported(lambda d: lines.read(d, "PO"), "PO"))),
    "export_rc": ("K10", [("wide", "CAPTION \"{t}\"\n", "CAPTION L\"{t}\\x20ac\"\n"), ("quotes", "CAPTION \"a \"\"{t}\"\"\"\n", "CAPTION L\"a \"\"{t}\"\"\\x20ac\"\n")], of_documents(_exported(lambda d: lines.read(d, "WINRC"), "WINRC", lambda c: F.concat(c, F.lit("€"))))),
    "export_listing": ("K11", [("items", "<p>a <b>{t}</b></p><p>z</p>", "<html><body><ul>\n<li>a {t}</li>\n<li>z</li>\n</ul></body></html>\n")], of_documents(lambda d: export.listing(units.trans_units(units.segments(paragraphs(html.read(d)), "PARAGRAPH")).withColumn("target", F.lit(None).cast("string")), "html"))),
    "write_xliff": ("K12", [("unit", "{t} a", "<file original='{t}&apos;' source-language='en' datatype='plaintext'> | <source xml:lang='en'><mrk mtype='x-coretext'>{t} a</mrk></source>")], of_documents(lambda d: _written_xliff(d))),
    "well_formed_xml": ("K13", [("good", "<a>{t}</a>", "CONVERSION_SUCCEEDED"), ("bad", "<a><b>{t}</a>", "WARNING_INVALID_XML_EXPORTED")], of_documents(lambda d: export.well_formed(d).select("doc_id", F.col("status").alias("text")))),
    "import_notices": ("D13", [("broken", "<d><p>{t}</d>", "2"), ("good", "<d>{t}</d>", "0")], of_documents(lambda d: _severities(d))),
    "references_to_any_depth": ("L7, L9", [("deep", "{t}", "<x>(1(2(3(4(5(6{t})))))) end")], of_documents(lambda d: _nested(d))),
}


def _written_xliff(docs: DataFrame) -> DataFrame:
    made = units.trans_units(units.segments(plaintext.paragraphs(docs)))
    names = docs.select("doc_id", F.concat(F.substring_index("text", " ", 1), F.lit("'")).alias("name"), F.lit("plaintext").alias("datatype"))
    whole = xliff.write(made, "en", names)
    return whole.select("doc_id", F.concat_ws(" | ", F.regexp_extract("text", "<file [^>]*>", 0), F.regexp_extract("text", "<source.*</source>", 0)).alias("text"))


def _severities(docs: DataFrame) -> DataFrame:
    told = diagnostics(_read_xml(docs), "XML").groupBy("doc_id").agg(F.max("severity").alias("severity"))
    return docs.join(told, "doc_id", "left").select("doc_id", F.coalesce("severity", F.lit(0)).cast("string").alias("text"))


def _nested(docs: DataFrame) -> DataFrame:
    part = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"), F.lit(None).cast("string").alias("name"))
    asides = [part("aside", F.concat(F.lit(f"({n}<x id='{n}'/>"), F.col("text") if n == 6 else F.lit(""), F.lit(")"))) for n in range(1, 7)]
    parts = F.array(part("literal", F.lit("<x>{{tu:1}} end")), *asides)
    codes_ = F.array(*[F.struct(F.lit(n).alias("code_id"), F.lit("{{tu:%d}}" % (n + 1)).alias("body")) for n in range(1, 6)])
    made = docs.select("doc_id", F.lit("").alias("status"), parts.alias("parts"), codes_.alias("codes"), F.array().cast("array<struct<severity:int,message:string>>").alias("notices"))
    return merge.documents(made.to(_schema()))


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TOKENISED)
