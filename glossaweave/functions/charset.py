"""Character sets of documents, from their own statements, their language or their bytes."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_LINES = 1024
# Languages whose plain texts are read as Latin-1; character sets of message catalogues by language; byte signatures.
LATIN_1 = ("da", "nl", "fi", "fr", "de", "is", "it", "nb", "no", "pt", "es", "sv", "en")
CATALOGUE = {
    "af": "ISO-8859-1", "ar": "ISO-8859-6", "be": "windows-1251", "bg": "windows-1251", "br": "ISO-8859-1",
    "bs": "ISO-8859-2", "ca": "ISO-8859-1", "cs": "ISO-8859-2", "da": "ISO-8859-1", "de": "ISO-8859-1",
    "el": "ISO-8859-7", "en": "ISO-8859-1", "es": "ISO-8859-1", "et": "ISO-8859-1", "eu": "ISO-8859-1",
    "fi": "ISO-8859-1", "fo": "ISO-8859-1", "fr": "ISO-8859-1", "ga": "ISO-8859-1", "gl": "ISO-8859-1",
    "gv": "ISO-8859-1", "he": "ISO-8859-8", "hr": "ISO-8859-2", "hu": "ISO-8859-2", "id": "ISO-8859-1",
    "is": "ISO-8859-1", "it": "ISO-8859-1", "ja": "EUC-JP", "kl": "ISO-8859-1", "ko": "EUC-KR",
    "kw": "ISO-8859-1", "lt": "ISO-8859-13", "lv": "ISO-8859-13", "mi": "ISO-8859-13", "mk": "ISO-8859-5",
    "ms": "ISO-8859-1", "mt": "ISO-8859-3", "nb": "ISO-8859-1", "nl": "ISO-8859-1", "nn": "ISO-8859-1",
    "oc": "ISO-8859-1", "pl": "ISO-8859-2", "pt": "ISO-8859-1", "ro": "ISO-8859-2", "ru": "KOI8-R",
    "sk": "ISO-8859-2", "sl": "ISO-8859-2", "sq": "ISO-8859-1", "sr": "ISO-8859-5", "sv": "ISO-8859-1",
    "tg": "KOI8-T", "th": "TIS-620", "tl": "ISO-8859-1", "tr": "ISO-8859-9", "uk": "KOI8-U",
    "uz": "ISO-8859-1", "wa": "ISO-8859-1", "zh_cn": "GB2312", "zh_tw": "Big5",
}
MIF_SETS = {
    "Shift_JIS": b"\x93\xfa\x96\x7b\x8c\xea",
    "EUC-JP": b"\xc6\xfc\xcb\xdc\xb8\xec",
    "Big5": b"\xa4\xa4\xa4\xe5",
    "EUC-TW": b"\xc4\xe3\xc5\xc6",
    "GB2312": b"\xd6\xd0\xce\xc4",
    "EUC-KR": b"\xc7\xd1\xb1\xb9\xbe\xee",
}
MIF_NAMES = {"JISX0208.ShiftJIS": "Shift_JIS", "BIG5": "Big5", "GB2312-80.EUC": "GB2312", "KSC5601-1992": "EUC-KR"}
# Where the frame's own set differs from Mac Roman; all other controls but tab, line feed and return are undefined.
FRAME_CONTROLS = {0x04: 0x00AD, 0x05: 0x200D, 0x06: 0x2010, 0x08: 0x0009, 0x10: 0x2007, 0x11: 0x00A0, 0x12: 0x2009, 0x13: 0x2002, 0x14: 0x2003, 0x15: 0x2011}
FRAME_LETTERS = {
    0xAD: 0x00A6, 0xB0: 0x00D7, 0xB2: 0x00F0, 0xB3: 0x0160, 0xB6: 0x00B9, 0xB7: 0x00B2, 0xB8: 0x00B3, 0xB9: 0x00BC, 0xBA: 0x00BD, 0xBD: 0x00BE, 0xC3: 0x00D0,
    0xC5: 0x00DD, 0xC6: 0x00FD, 0xCA: 0x00FE, 0xD7: 0x00DE, 0xDB: 0x00A4, 0xF0: 0x0161, 0xF5: 0x20AC, 0xF9: 0x02C7, 0xFA: 0x017D, 0xFE: 0x017E, 0xFF: 0xFFFD,
}
FRAME_ROMAN = "x-frame-roman"


def html_charset(html: Column) -> Column:
    """The charset of a content-type meta element within the first lines, comments aside; null if there is none."""
    head = F.regexp_replace(F.substring_index(html, "\n", HEAD_LINES), "(?s)<!--.*?-->", "")
    tag = F.regexp_extract(head, "(?is)<meta\\s[^>]*http-equiv=['\"]?content-type['\"]?[^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, "(?i)charset=['\"]?([A-Za-z0-9_:.-]+)", 1), F.lit(""))


def plaintext_charset(lang: Column) -> Column:
    return F.when(F.lower(F.substring(lang, 1, 2)).isin(*LATIN_1), "ISO-8859-1").otherwise("UTF-8")


def catalogue_charset(header: Column, lang: Column) -> Column:
    """A message catalogue's charset: that of the content type in its head (the first msgstr, up to the next entry), else that of its language
    (with country for Chinese), else UTF-8."""
    head = F.regexp_extract(header, "(?s)\\A(?:.*?\\n)??\\s*msgstr (.*?)(?:\\n\\s*\\n|\\nmsgid|\\z)", 1)
    stated = F.nullif(F.regexp_extract(head, "(?i)Content-Type:\\s+text/plain;\\s+charset=([-_a-zA-Z0-9]+)", 1), F.lit(""))
    stated = F.when(F.upper(stated) == "CHARSET", F.lit(None)).otherwise(stated)
    key = F.lower(F.replace(lang, F.lit("-"), F.lit("_")))
    table = F.create_map(*[F.lit(x) for pair in CATALOGUE.items() for x in pair])
    known = F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == key)), F.lit(0)), F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.substring_index(key, "_", 1))), F.lit(0)))
    return F.coalesce(stated, known, F.lit("UTF-8"))


def mif_charset(content: Column) -> Column:
    """By the sample text of an encoding statement, else by the first known font encoding, else the frame's own set."""
    head = F.decode(F.substring(content, 1, 3072), "ISO-8859-1")  # a character a byte
    by_sample = F.lit(None).cast("string")
    for name, mark in reversed(MIF_SETS.items()):
        by_sample = F.when(head.contains(mark.decode("latin-1")), name).otherwise(by_sample)
    font = F.upper(F.regexp_extract(F.decode(content, "ISO-8859-1"), "(?i)FEncoding\\s+`?(" + "|".join(MIF_NAMES).replace(".", "\\.") + ")", 1))
    by_font = F.lit(None).cast("string")
    for label, name in MIF_NAMES.items():
        by_font = F.when(font == label.upper(), name).otherwise(by_font)
    stated = head.contains("<MIFEncoding")
    return F.coalesce(F.when(stated, by_sample), by_font, F.lit("x-frame-roman"))


def xml_charset(prolog: Column, given: Column | None = None) -> Column:
    stated = F.nullif(F.regexp_extract(prolog, "^.{0,3}<\\?xml[^>]*encoding=['\"]([A-Za-z0-9_:.-]+)['\"]", 1), F.lit(""))
    return F.coalesce(stated, *([given] if given is not None else []), F.lit("UTF-8"))


def frame_characters() -> str:
    """The character of each byte of the frame's own set."""
    out = list(bytes(range(256)).decode("mac_roman"))
    for code in range(32):
        out[code] = chr(FRAME_CONTROLS.get(code, code if code in (0x09, 0x0A, 0x0D) else 0xFFFD))
    for code, point in FRAME_LETTERS.items():
        out[code] = chr(point)
    return "".join(out)


def decode_bytes(raw: bytes, charset: str) -> tuple[str | None, str | None]:
    """Text and notice: bytes that the set does not have become U+FFFD, with a notice; a set that is not known gives no text."""
    if charset.lower() == FRAME_ROMAN:
        return raw.decode("latin-1").translate(dict(enumerate(frame_characters()))), None
    try:
        decoder = codecs.lookup(charset)
    except LookupError:
        return None, f"unknown character set {charset}"
    try:
        return decoder.decode(raw, "strict")[0], None
    except ValueError:
        return decoder.decode(raw, "replace")[0], f"bytes that are not {charset} were replaced"


def encode_text(text: str, charset: str) -> bytes:
    """A document's bytes in a set; characters that it does not have become question marks."""
    if charset.lower() == FRAME_ROMAN:
        places = {c: i for i, c in reversed(list(enumerate(frame_characters())))}
        return bytes(places.get(c, 0x3F) for c in text)
    return text.encode(charset, "replace")


def decoded(content: Column, charset: Column) -> Column:
    """struct(text, notice) of bytes whose charset differs by row; no row fails the job. Runs in Arrow batches, with Python's codecs."""

    @F.pandas_udf("struct<text:string,notice:string>")
    def run(raws: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if r is None else decode_bytes(bytes(r), n or "UTF-8") for r, n in zip(raws, names)]
        return pd.DataFrame(rows, columns=["text", "notice"])

    return run(content, charset)


def encoded(text: Column, charset: Column) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else encode_text(t, n or "UTF-8") for t, n in zip(texts, names)])

    return run(text, charset)
