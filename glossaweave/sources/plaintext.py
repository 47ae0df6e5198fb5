"""Plain text: blank lines part paragraphs; the lines of one are joined. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape, guarded
from ..schema import Parts, tokenise

# Spaces and dashes after which no space is put between lines; ranges of ideographs.
SPACES = (0x0020, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x3000)
DASHES = (0x002D, 0x058A, 0x2010, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212)
CJK = ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x20000, 0x2A6DF), (0x2F800, 0x2FA1F))
SOFT_HYPHEN, TODO_HYPHEN = 0x00AD, 0x1806


def _class(points, ranges=()) -> str:
    return "[" + "".join(f"\\x{{{c:04x}}}" for c in points) + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in ranges) + "]"


TIGHT = _class(SPACES + DASHES, CJK)
BLANK_LINES = "(?:\\r\\n|\\r|\\n)(?:[\\x{0001}-\\x{0009}\\x{000b}\\x{000c}\\x{000e}-\\x{0020}]*(?:\\r\\n|\\r|\\n))+"


def join_lines(column: Column) -> Column:
    """The lines of a paragraph as one: soft hyphens at an end and todo hyphens at a start go, dashes, spaces and ideographs join
    without a space."""
    joined = guarded(column, "\r", F.regexp_replace(column, "\\r\\n|\\r", "\n"))
    joined = F.replace(joined, F.lit("\n" + chr(TODO_HYPHEN)), F.lit("\n"))
    joined = F.replace(joined, F.lit(chr(SOFT_HYPHEN) + "\n"), F.lit(""))
    joined = F.regexp_replace(joined, f"\n(?<={TIGHT}\n)", "")  # looks back from line ends alone
    return F.replace(joined, F.lit("\n"), F.lit(" "))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """key, part_no, text and more columns of the document: a row a paragraph that is not blank, XML-escaped."""
    pieces = F.split(F.col(text), BLANK_LINES, -1)
    rows = docs.select(key, *more, F.posexplode(pieces).alias("part_no", "piece"))
    trimmed = F.regexp_replace(F.col("piece"), "^[\\r\\n]+|[\\r\\n]+$", "")
    # Blank pieces go before the lines are joined, so that the joining is not done twice.
    full = rows.filter(F.col("piece").rlike("[^\\x20\\r\\n]"))
    return full.select(key, "part_no", escape(join_lines(trimmed)).alias("text"), *more)


def tokenizer(text: str, out: Parts) -> None:
    import re

    tight = re.compile("[" + "".join(map(chr, SPACES)) + "".join(re.escape(chr(c)) for c in DASHES) + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK) + "]\\Z")
    for piece in re.split(r"((?:\r\n|\r|\n)(?:[\x01-\x09\x0b\x0c\x0e-\x20]*(?:\r\n|\r|\n))+)", text):
        if not piece.strip():
            out.literal(piece)
            continue
        lead, body = re.match(r"([\r\n]*)(.*)\Z", piece, re.S).groups()
        tail = body[len(body.rstrip("\r\n")) :]
        joined = ""
        for line in re.split(r"\r\n|\r|\n", body[: len(body) - len(tail)]):
            if joined:
                line = line[1:] if line[:1] == chr(TODO_HYPHEN) else line
                joined = joined[:-1] if joined[-1] == chr(SOFT_HYPHEN) else joined if tight.search(joined) else joined + " "
            joined += line
        out.literal(lead)
        out.para(joined.replace("&", "&amp;").replace("'", "&apos;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;"))
        out.literal(tail)


def read(docs: DataFrame, column: str = "text") -> DataFrame:
    return tokenise(docs, tokenizer, column)
