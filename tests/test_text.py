import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaweave.functions import codes, sentences, text
from glossaweave.operators import units

PIECES = ["a", "Word ", " ", "• ", "-", "___", "<bx id='1' rid='1'/>", "<ex id='2' rid='1'/>", "<x id='3'/>", "<bx id='4' rid='2'/>", "<ex id='5' rid='2'/>", "\u00a0", ". ", "&amp;", "\n"]


def value(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


@pytest.mark.parametrize(
    "raw, marked",
    [
        ("", ""),
        ("  ", ""),
        ("Hello", "<mrk mtype='x-coretext'>Hello</mrk>"),
        (" • Hello _ ", " • <mrk mtype='x-coretext'>Hello</mrk> _ "),
        ("___", ""),
        ("• — ", "• <mrk mtype='x-coretext'>—</mrk> "),
        ("- -", ""),
        ("<bx id='1' rid='1'/>big<ex id='2' rid='1'/>", "<bx id='1' rid='1'/><mrk mtype='x-coretext'>big</mrk><ex id='2' rid='1'/>"),
        ("<bx id='1' rid='1'/>a<ex id='2' rid='1'/> b", "<mrk mtype='x-coretext'><bx id='1' rid='1'/>a<ex id='2' rid='1'/> b</mrk>"),
        ("<x id='1'/> <x id='2'/>text<x id='3'/>", "<x id='1'/> <x id='2'/><mrk mtype='x-coretext'>text</mrk><x id='3'/>"),
        ("<bx id='1' rid='9'/>open", "<bx id='1' rid='9'/><mrk mtype='x-coretext'>open</mrk>"),
        ("<lt:core>old</lt:core>", "<mrk mtype='x-coretext'>old</mrk>"),
        ("<bx id='1' rid='484'/><bx id='2' rid='485'/>t<ex id='3' rid='487'/><ex id='4' rid='486'/><ex id='5' rid='484'/>", "<bx id='1' rid='484'/><bx id='2' rid='485'/><mrk mtype='x-coretext'>t</mrk><ex id='3' rid='487'/><ex id='4' rid='486'/><ex id='5' rid='484'/>"),
    ],
)
def test_mark_core(raw, marked):
    assert codes.mark_core(raw) == marked


def test_mark_core_by_paragraph_keeps_open_codes_inside():
    assert codes.mark_core("<bx id='1' rid='9'/>open", sentences=False) == "<mrk mtype='x-coretext'><bx id='1' rid='9'/>open</mrk>"


def test_hidden_tags_of_generic_xml():
    assert codes.mark_core("&lt;b&gt;text&lt;/b&gt;", hidden=True) == "&lt;b&gt;<mrk mtype='x-coretext'>text</mrk>&lt;/b&gt;"
    assert codes.mark_core("&lt;br&gt; ", hidden=True) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10).map("".join))
def test_marks_lose_nothing(raw):
    marked = codes.mark_core(raw)
    assert marked in ("",) or marked.replace("<mrk mtype='x-coretext'>", "").replace("</mrk>", "") == raw
    assert codes.mark_core(marked) == marked


def test_columns_agree_with_functions(spark):
    raws = ["Hello", " • Hello _ ", "___", "-", "a & b", 'a &lt; "q" & <', "no special", "x\u00ady", "", "  two  words "]
    df = spark.createDataFrame([(r,) for r in raws], "t string")
    c = F.col("t")
    rows = df.select("t", text.mark_core(c).alias("m"), text.repair_entities(c).alias("r"), text.unescape(text.escape(c)).alias("u")).collect()
    for r in rows:
        if "<" not in r.t:
            assert r.m == codes.mark_core(r.t)
        assert r.r == codes.repair_entities(r.t) and r.u == r.t


def test_parts_of_a_marked_text(spark):
    full = "pre <mrk mtype='x-coretext'>co\u00adre</mrk> suf"
    got = spark.range(1).select(*[f(F.lit(full)) for f in (text.prefix_text, text.core_text, text.suffix_text, text.remove_core_marks)]).first()
    assert tuple(got) == ("pre ", "core", " suf", "pre co\u00adre suf")
    new = lambda a, b: spark.range(1).select(text.replace_core(F.lit(a), F.lit(b))).first()[0]
    assert new(full, "neu") == "pre <mrk mtype='x-coretext'>neu</mrk> suf" and new(full, None) == full and new("", "x") == "<mrk mtype='x-coretext'>x</mrk>"


def test_quotes_between_tags_only(spark):
    got = spark.range(1).select(text.smart_quotes(F.lit("""<a href="x">say "hi" isn't &apos;</a>"""))).first()[0]
    assert got == """<a href="x">say &quot;hi&quot; isn&#x27;t &#x27;</a>"""
    assert spark.range(1).select(text.plain_source(F.lit("<bx id='1'/>a<x id='2' ctype='lb'/>b  c<ex id='3'/>"))).first()[0] == "a b c"


def test_repairs():
    assert codes.repair_strict("<bx id='1' rid='1'/>a & b<ex id='2' rid='1'/>") == "<bx id='1' rid='1'/>a &amp; b<ex id='2' rid='1'/>"
    assert codes.repair_strict("<bx id='1' rid='1'/>a<ex id='2' rid='9'/>") == "a"
    assert codes.repair_strict("<bx id='1' rid='1'/>a") == "a"
    assert codes.repair_strict("plain <") == "plain <"
    assert codes.keep_codes("<b>a</b> <bx id='1' rid='1'/>&") == "a <bx id='1' rid='1'/>&amp;"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_strict_repair_balances(raw):
    stack = []
    for m in re.finditer(r"<([be])x[^>]*rid='(\d+)'[^>]*>", codes.repair_strict(raw)):
        if m[1] == "b":
            stack.append(m[2])
        else:
            assert stack.pop() == m[2]
    assert not stack


def test_nested_codes():
    nested = "<bx id='1' ctype='bold' rid='1'/><bx id='2' ctype='link' rid='2'/>x<ex id='3' rid='2'/><ex id='4' rid='1'/>"
    assert codes.collapse_nested(nested) == "<bx id='1' ctype='link' rid='1'/>x<ex id='4' rid='1'/>"
    assert codes.collapse_nested("<bx id='1' ctype='bold' rid='1'/><ex id='2' rid='1'/>t") == "<x id='1' ctype='bold'/>t"


def cut(spark, texts, language="en"):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sentences.cut(F.col("t"), F.lit(language)).alias("s")).collect()
    return [r.s for r in sorted(rows)]


def test_sentences(spark):
    want = {
        "One! Two? Three. four. Five": ["One! ", "Two? ", "Three. four. ", "Five"],
        "It is 3.5 m. \"Yes.\" he said.": ["It is 3.5 m. ", "\"Yes.\" he said."],
        "foo.Bar": ["foo.Bar"], "A.-b": ["A.", "-b"], "A. * b": ["A. * b"], "日。本": ["日。", "本"], "Wait?!) no": ["Wait?!) ", "no"],
        "a । b": ["a । ", "b"], "x y": ["x ", "y"], "": [], "   ": ["   "], "End.***": ["End", ".", "***"], "A. B c.d. E": ["A. ", "B c.d. ", "E"],
    }
    assert dict(zip(want, cut(spark, want))) == want


def test_sentences_join_to_the_text_and_agree_with_the_break_iterator(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["Word", "word", " ", ". ", ".", "! ", "?", "\"", "'", "(", ")", "1", "\n", "é", "É", ", ", "“", "”", "。", "&amp;", "*"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", sentences.cut(F.col("t")).alias("s"), F.expr("size(sentences(t, 'en', ''))").alias("n")).collect()
    assert all("".join(r.s) == r.t for r in rows)
    assert sum(len(r.s) == r.n for r in rows) / len(rows) > 0.97  # strings of signs at random


def test_sentence_counts_of_documents_are_the_hosts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs.filter(F.size(sentences.cut(F.col("text"), F.col("lang"))) != F.expr("size(sentences(text, lang, ''))"))
    assert odd.count() == 0


@pytest.mark.parametrize("piece", ["One two. ", ".", " ", "a. ", "?! ", "<", " ", ". b. C "])
def test_long_texts_take_time_in_proportion(spark, piece):
    text_of = spark.range(1).select(F.repeat(F.lit(piece), 1_000_000 // len(piece)).alias("text"))
    began = time.monotonic()
    made = text_of.select(F.size(sentences.core_segments(F.col("text"))).alias("n")).first()
    assert made.n >= 0 and time.monotonic() - began < 20


def test_segments(spark):
    rows = [("1", 0, "One! ___"), ("2", 0, "One! ___ Two"), ("3", 0, "<x id='1'/> One! <x id='2'/>"), ("4", 0, "___")]
    made = units.segments(spark.createDataFrame(rows, "doc_id string, part_no int, text string")).select("doc_id", "marked").collect()
    core = "<mrk mtype='x-coretext'>{}</mrk>".format
    assert sorted(map(tuple, made)) == [("1", core("One!") + " ___"), ("2", core("One!") + " "), ("2", "___ " + core("Two")), ("3", "<x id='1'/> " + core("One!") + " <x id='2'/>")]


def test_spaces_that_are_canonically_equivalent(spark):
    """En quad and em quad are en space and em space, the Greek ano teleia is a middle dot."""
    assert set(text.WIDE_SPACE) - set(text._SPACES) == {0x0387, 0x2000, 0x2001}
    raw = ["\u2000word\u2001", "\u2002word\u2003", "\u0387 \u00b7", "cafe\u0301\u2000", "caf\u00e9\u2000"]
    want = ["\u2000<mrk mtype='x-coretext'>word</mrk>\u2001", "\u2002<mrk mtype='x-coretext'>word</mrk>\u2003", "", "<mrk mtype='x-coretext'>cafe\u0301</mrk>\u2000", "<mrk mtype='x-coretext'>caf\u00e9</mrk>\u2000"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, t string").select("i", text.mark_core(F.col("t")).alias("m")).collect()
    assert [r.m for r in sorted(rows)] == want == [codes.mark_core(t) for t in raw]
