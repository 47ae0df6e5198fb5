import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaweave import schema
from glossaweave.functions import charset, detect
from glossaweave.functions.codes import collapse_nested
from glossaweave.operators import chains, merge, targets, units
from glossaweave.sinks import export
from glossaweave.sources import html, lines, office, plaintext, xliff, xml
from glossaweave.streaming import arrivals


def one(spark, body, doc="d"):
    return spark.createDataFrame([(doc, body)], "doc_id string, text string")


def texts(read):
    return [(r.name, r.text) for r in schema.paragraphs(read).orderBy("part_no").collect()]


def round_trip(spark, read, kind, column="core"):
    made = units.trans_units(units.segments(schema.paragraphs(read)))
    return export.export(read, made, kind, column).first().text


def test_html_inline(spark):
    read = html.read(one(spark, "<p>Hi <b>big</b> <i>world</i>.</p>"))
    assert texts(read) == [(None, "Hi <bx id='1' ctype='bold' rid='1'/>big<ex id='2' rid='1'/> <bx id='3' ctype='italic' rid='2'/>world<ex id='4' rid='2'/>.")]
    assert [r.body for r in schema.formats(read).orderBy("code_id").collect()] == ["<b>", "</b>", "<i>", "</i>"]


def test_html_attributes_hidden_and_ignored(spark):
    page = '<img alt="A cat"><p>x<input type="button" value="Go"><input type="hidden" value="no"></p><style>p{}</style><script>"</p>"</script>'
    names = [n for n, _ in texts(html.read(one(spark, page)))]
    assert names.count("img@alt") == 1 and names.count("input@value") == 1 and len(names) == 3


@pytest.mark.parametrize("page", ["<!DOCTYPE html><html><head><title>T</title></head><body><p>One <b>two</b>. Three!</p><p class='a'>&amp; four</p><ul><li>five<li><i></i></ul><!-- c --></body></html>", '<p>See <a href="x.html" title="A tip">it</a> now</p><br/><p>___</p>', "<p>open <b>bold<p>next</b> end"])
def test_html_round_trip(spark, page):
    assert round_trip(spark, html.read(one(spark, page)), "HTML") == page


def test_html_translated(spark):
    read = html.read(one(spark, '<p>Hi <b>you</b></p><img alt="cat">'))
    made = units.trans_units(units.segments(schema.paragraphs(read))).withColumn("target", F.upper(F.regexp_replace("core", "<[^>]*>", "")))
    assert export.export(read, made, "HTML").first().text == '<p>HI YOU</p><img alt="CAT">'


def test_plaintext(spark):
    body = "one\ntwo-\nthree\u00ad\nfour\n\n\u4e2d\n\u6587\r\n \r\nlast & <line>\n"
    want = ["one two-threefour", "\u4e2d\u6587", "last &amp; &lt;line&gt;"]
    assert [t for _, t in texts(plaintext.read(one(spark, body)))] == want
    assert [r.text for r in plaintext.paragraphs(one(spark, body)).orderBy("part_no").collect()] == want
    assert round_trip(spark, plaintext.read(one(spark, "A b. C d!\n\nE f")), "PLAINTEXT") == "A b. C d!\n\nE f"


CASES = {
    "JAVA_PROPERTIES": ("# c\na=1<2\nb = x & y\\\n  z\n\nempty=\n", ["1&lt;2", "x &amp; yz"], "# c\na=1<2\nb = x & yz\n\nempty=\n"),
    "XULDTD": ('<!-- c -->\n<!ENTITY a "one">\n<!ENTITY b.c "two\n  lines &amp; &x;">\n', ["one", "two lines &amp; &x;"], '<!-- c -->\n<!ENTITY a "one">\n<!ENTITY b.c "two lines &amp; &x;">\n'),
    "WINRC": ('IDD DIALOG\nCAPTION "a ""b"""\n  LTEXT L"\\x0041z", 5\nSTRINGTABLE\nBEGIN\n  IDS_1, "s"\nEND\nSTRINGTABLE {\n IDS_2 "\u00e9"\n}\n', ["a &quot;b&quot;", "Az", "s", "\u00e9"], 'IDD DIALOG\nCAPTION "a ""b"""\n  LTEXT "Az", 5\nSTRINGTABLE\nBEGIN\n  IDS_1, "s"\nEND\nSTRINGTABLE {\n IDS_2 L"\\x00e9"\n}\n'),
    "PO": ('msgid ""\nmsgstr "Content-Type: text/plain; charset=UTF-8\\n"\n\n#: f\nmsgid "one "\n"two\\n"\nmsgstr "old"\nmsgid "q \\"x\\""\nmsgstr ""\n', ["one two<x id='1' ctype='lb'/>", "q &quot;x&quot;"], None),
}


@pytest.mark.parametrize("kind", CASES)
def test_line_formats(spark, kind):
    body, want, back = CASES[kind]
    read = lines.read(one(spark, body), kind)
    assert [t for _, t in texts(read)] == want
    got = round_trip(spark, read, kind)
    if back:
        assert got == back
    else:
        assert 'msgstr "one two\\n"' in got and 'msgstr "q \\"x\\""' in got and "charset=UTF-8" in got


XML = "<?xml version='1.0'?>\n<doc xml:lang='en' note='two words' url='http://x.y/' c='ffAA00'><t>Hi <b a='1'>big</b> &amp; <![CDATA[<raw>]]></t><e/><t>  </t><t>end</t></doc>"


def test_xml_discovery_skip_and_round_trip(spark):
    docs = one(spark, XML)
    found = xml.candidates(docs)
    assert {(r.xpath, r.attribute) for r in found.collect()} == {("/doc[1]/@note", "note"), ("/doc[1]/t[1]", None), ("/doc[1]/t[1]/b[1]", None), ("/doc[1]/t[3]", None)}
    read = xml.read(docs)
    assert ("doc@note", "two words") in texts(read) and ("t", "end") in texts(read)
    assert round_trip(spark, read, "XML") == XML
    skip = found.filter("xpath like '%t[3]'")
    assert ("t", "end") not in texts(xml.read(docs, xml.without(found, skip)))
    broken = xml.read(one(spark, "<a><b></a>"))
    assert broken.first().status == schema.FAILED and schema.diagnostics(broken, "xml").first().severity == 2
    assert [r.status for r in export.well_formed(one(spark, "<a><b></a>")).collect()] == ["WARNING_INVALID_XML_EXPORTED"]


def test_xliff(spark):
    body = """<xliff><file original='f.html' source-language='en' datatype='html'><body>
<trans-unit id='u1' lt:paraID='p' lt:mergeable='true'><source>Hi <g id='1' ctype='bold'>x</g></source>
<target xml:lang='fr-FR' phase-name='1'>Un</target><target xml:lang='fr-FR' phase-name='3'>Trois</target>
<alt-trans xml:lang='fr-FR'><target phase-name='2'>Deux</target></alt-trans></trans-unit>
<trans-unit id='cut'><source>no end</source>"""
    read = xliff.raw_units(one(spark, body))
    assert [(r.tu_id, r.para_id, r.mergeable) for r in read.collect()] == [("u1", "p", True)]
    t = xliff.targets(read).cache()
    pick = lambda phase, most: [r.text for r in targets.choose(t, "FR-fr", phase, most).collect()]
    assert pick("3", 3) == ["Trois"] and pick("2", 3) == ["Deux"] and pick("0", 3) == ["Trois"] and pick("4", 3) == [] and pick(None, 0) == ["Un"]
    inline = xliff.normalised(read).first().inline
    assert inline.text == "Hi <bx id='1' ctype='bold' rid='1'/>x<ex id='2' rid='1'/>"
    got = xliff.rewrite_inline("a<bpt id='1'>&lt;b&gt;</bpt>b<ept id='1'>&lt;/b&gt;</ept><ph id='2'>p<sub>inner</sub></ph><it id='3' pos='open'>i</it>")
    assert got["subs"] == ["inner"] and "<bx id='1' ctype='x-xliff-bpt' rid='1'/>b<ex id='2' rid='1'/>" in got["text"] and got["codes"][2]["body"] == "p{{sub:0}}"
    assert [r.datatype for r in xliff.files(one(spark, body)).collect()] == ["html"]
    made = units.trans_units(units.segments(schema.paragraphs(plaintext.read(one(spark, "One. Two.")))))
    names = spark.createDataFrame([("d", "f'<.txt", "plaintext")], "doc_id string, name string, datatype string")
    chosen = made.select("tu_id", F.lit("fr").alias("lang"), F.lit("2").alias("phase"), F.lit("target").alias("kind"), F.lit(0).alias("ordinal"), F.lit("&amp;").alias("text"))
    written = xliff.write(made, "en", names, chosen=chosen)
    assert export.well_formed(written).first().well_formed and xliff.files(written).first().original == "f&apos;&lt;.txt"
    assert [(r.lang, r.phase, r.text) for r in xliff.targets(xliff.raw_units(written)).collect()] == [("fr", "2", "&amp;")] * 2
    back = xliff.raw_units(written).orderBy("ordinal").collect()
    assert [r.mergeable for r in back] == [True, False] and back[0].next_tu_id == back[1].tu_id


def test_target_phases(spark):
    rows = [("a", "fr", p, "target", i, f"t{p}") for i, p in enumerate(["1", "3"])]
    t = spark.createDataFrame(rows, "tu_id string, lang string, phase string, kind string, ordinal int, text string")
    pick = lambda phase: [r.text for r in targets.choose(t, "fr", phase, 3).collect()]
    assert (pick("3"), pick("2"), pick("0"), pick("4"), pick(None)) == (["t3"], ["t1"], ["t3"], [], ["t1"])


def test_units_are_linked(spark):
    made = units.trans_units(units.segments(schema.paragraphs(plaintext.read(one(spark, "One. Two. Three.\n\nFour"))))).orderBy("part_no", "seg_no").collect()
    assert [r.seg_of for r in made] == [3, 3, 3, 1] and [r.mergeable for r in made] == [True, True, False, False]
    assert made[0].next_tu_id == made[1].tu_id and {r.para_id for r in made[:3]} == {made[0].tu_id}


def odf():
    content = "<?xml version='1.0'?><office:document-content xmlns:office='o' xmlns:style='s' xmlns:text='t' xmlns:fo='f'><style:style style:name='T1'><style:text-properties fo:font-weight='bold'/></style:style><office:body><text:p>Hi <text:span text:style-name='T1'>big</text:span><text:tab/>x<text:note><text:note-body><text:p>A note</text:p></text:note-body></text:note></text:p><text:p/></office:body></office:document-content>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text", zipfile.ZIP_STORED)
        z.writestr("content.xml", content)
        z.writestr("other.bin", b"\x00\x01")
    return content, buffer.getvalue()


def test_odf(spark):
    content, raw = odf()
    docs = spark.createDataFrame([("d", bytearray(raw))], "doc_id string, content binary")
    read = office.read_odf(docs).cache()
    got = texts(read)
    assert ("text:p", "A note") in got and "ctype='bold'" in got[-1][1] and "ctype='x-odf-tab'" in got[-1][1] and "x-odf-note-target" in got[-1][1]
    made = units.trans_units(units.segments(schema.paragraphs(read), "PARAGRAPH"))
    back = export.export(read, made, "ODT", "core")
    assert back.first().text == content
    zipped = office.rezipped(docs, back).first().content
    with zipfile.ZipFile(io.BytesIO(bytes(zipped))) as z:
        assert z.read("content.xml").decode() == content and z.read("other.bin") == b"\x00\x01"
    assert office.read_odf(spark.createDataFrame([("d", bytearray(b"no zip"))], "doc_id string, content binary")).count() == 0


def test_mif(spark):
    body = "<MIFFile 7.00>\n<Para \n <ParaLine \n  <String `Hello \\>there'>\n  <Char EmDash>\n  <String `end'>\n > # end of ParaLine\n> # end of Para\n<Para <ParaLine <String `x'>>>\n"
    read = office.read_mif(one(spark, body))
    assert [t for _, t in texts(read)] == ["Hello &gt;there\u2014end", "x"]
    assert "Hello \\>there\u2014end'" in round_trip(spark, read, "MIF")


SIGNATURES = [
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.xls", "EXCEL"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.doc", "WORD"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a", "MSOFFICEDOC"),
    (b"\x09\x04\x06\x00\x00\x00\x10\x00", "a", "EXCEL"), (b"\xfe\x37\x00\x23", "a", "WORD"), (b"{\\rtf1\\ansi x", "a", "RTF"), (b"<MIFFile 7.00>", "a", "MIF"), (b"%PDF-1.4", "a", "PDF"),
    (b"<?xml version='1.0'?><xliff>", "a", "XLIFF"), (b"<!DOCTYPE html><p>", "a", "HTML"), (b"\xef\xbb\xbf<?xml version='1.0'?><a/>", "a", "XML"), (b"a=b", "x.properties", "JAVA_PROPERTIES"), (b"plain", "x.txt", None),
    (odf()[1], "a.odt", "ODT"),
]


def test_detection(spark):
    df = spark.createDataFrame([(bytearray(c), n, w or "") for c, n, w in SIGNATURES], "content binary, name string, want string")
    for r in df.select("want", F.coalesce(detect.identify(F.col("content"), F.col("name")), F.lit("")).alias("got")).collect():
        assert r.got == r.want
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(detect.from_datatype(F.lit("<file original='x' datatype='winres'>"))) == "WINRC"
    resolved = lambda declared, content, name: f(detect.resolve(F.lit(declared), F.lit(content), F.lit(name)))
    ole, rtf, tree = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"{\\rtf1\\ansi x", b"<?xml version='1.0'?><xliff>"
    assert resolved("WORD", rtf, "a") == "RTF" and resolved("HTML", b"?", "a") == "HTML"
    assert resolved("WORD", ole, "a") == "WORD" and resolved("WORD", ole, "a.xls") == "EXCEL" and resolved("HTML", ole, "a") == "MSOFFICEDOC"
    assert resolved("XML", tree, "a") == "XML" and resolved("HTML", tree, "a") == "XLIFF"


def test_charsets(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(charset.html_charset(F.lit("<!-- <meta http-equiv='content-type' content='x; charset=a'> --><META HTTP-EQUIV=Content-Type content='text/html; charset=Shift_JIS'>"))) == "Shift_JIS"
    assert f(charset.html_charset(F.lit("<meta charset='utf-8'>"))) is None
    head = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset={}\\n"\n\nmsgid "use charset=koi8-r here"\nmsgstr ""'
    assert f(charset.catalogue_charset(F.lit(head.format("koi8-u")), F.lit("de"))) == "koi8-u" and f(charset.catalogue_charset(F.lit(head.format("CHARSET")), F.lit("de"))) == "ISO-8859-1"
    assert f(charset.catalogue_charset(F.lit("charset=koi8-r"), F.lit("ru"))) == "KOI8-R" and f(charset.catalogue_charset(F.lit(""), F.lit("zh_TW"))) == "Big5"
    assert f(charset.catalogue_charset(F.lit(""), F.lit("ru_RU"))) == "KOI8-R" and f(charset.plaintext_charset(F.lit("ja"))) == "UTF-8"
    assert f(charset.mif_charset(F.lit(b"<MIFEncoding `\xc6\xfc\xcb\xdc\xb8\xec'>"))) == "EUC-JP" and f(charset.mif_charset(F.lit(b"<FEncoding `BIG5'>"))) == "Big5"
    assert f(charset.xml_charset(F.lit("<?xml version='1.0' encoding='ISO-8859-2'?>"))) == "ISO-8859-2"
    assert tuple(f(charset.decoded(F.lit("é".encode("latin-1")), F.lit("iso-8859-1")))) == ("é", None)
    for name in {*charset.CATALOGUE.values(), "windows-1252", "Shift_JIS", "UTF-16"}:
        text = {"EUC-JP": "日本", "Shift_JIS": "日本", "Big5": "中文", "GB2312": "中文", "EUC-KR": "한국", "TIS-620": "ไทย", "ISO-8859-7": "αβ", "ISO-8859-8": "אב", "ISO-8859-6": "اب", "KOI8-R": "мир", "KOI8-U": "мир", "KOI8-T": "мир", "windows-1251": "мир", "ISO-8859-5": "мир"}.get(name, "abc")
        assert charset.decode_bytes(text.encode(name), name) == (text, None)
    assert charset.decode_bytes(b"a\xffb", "UTF-8") == ("a\ufffdb", "bytes that are not UTF-8 were replaced") and charset.decode_bytes(b"x", "EUC-TW")[0] is None
    assert charset.decode_bytes(bytes([0x80, 0xAD, 0x10, 0xF5, 0x41]), charset.FRAME_ROMAN)[0] == "\u00c4\u00a6\u2007\u20acA" and charset.encode_text("\u20acA", charset.FRAME_ROMAN) == b"\xf5A"


def test_stream_of_documents(spark, tmp_path):
    one(spark, "One. Two.\n\nThree").write.parquet(str(tmp_path / "in"))
    stream = arrivals.stream_segments(arrivals.arriving(spark, str(tmp_path / "in"), "doc_id string, text string"), plaintext.read)
    arrivals.write_units(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_codes_within_codes():
    part = lambda n, kind, text: {"part_no": n, "kind": kind, "text": text}
    code = lambda n, body: {"code_id": n, "body": body}
    got = merge.assemble([part(0, "para", "a <x id='1'/><x id='9'/>"), part(1, "aside", "tip")], [code(1, "<i t='{{tu:1}}'>"), code(1, "later")])
    assert got == ("a <i t='tip'>", [])
    # Any depth, and a reference that leads back to itself.
    deep = [part(0, "literal", "[{{tu:1}}]<x id='1'/>{{tu:9999}}")] + [part(i, "aside", f"({i}<x id='{i}'/>)") for i in range(1, 2001)]
    text, notices = merge.assemble(deep, [code(i, "{{tu:%d}}" % (i + 1)) for i in range(1, 2000)])
    assert text.startswith("[(1(2(3(4(5(6(7") and text.endswith("))]<x id='1'/>{{tu:9999}}") and "(2000)" in text and notices == []
    text, notices = merge.assemble([part(0, "para", "{{tu:1}}"), part(1, "aside", "b<x id='1'/>")], [code(1, "{{tu:1}}")])
    assert text == "b" and notices == ["paragraph 1 refers to itself"]


def test_export_plan_reads_and_tokenises_once(spark):
    from glossaweave.plans import registry

    plan = registry.QUERIES["html_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 3 and plan.count("MapInPandas") == 2


def test_bookmarks_move_to_the_front(spark):
    page = '<p>One <a name="here"></a>two <a href="x">three</a></p>'
    read = html.read(one(spark, page), move_bookmarks=True)
    got = texts(read)[0][1]
    assert got.startswith("<x id='1' ctype='link'/>One two <bx id='3'")
    assert round_trip(spark, read, "HTML") == '<p><a name="here"></a>One two <a href="x">three</a></p>'


def test_collection_import_and_export(spark, tmp_path):
    from glossaweave.plans import convert

    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    for name, body in {"a.html": b"<html><p>One. Two.</p></html>", "b.properties": b"k=v\n", "c.txt": b"Plain text.\n", "d.bin": b"\x00\x01", "e.po": b'msgid "x"\nmsgstr ""\n', "f.rc": b'IDD DIALOG\nCAPTION "a\xe9"\n', "g.po": b'msgid ""\nmsgstr "Content-Type: text/plain; charset=ISO-8859-2\\n"\n\nmsgid "\xb1"\nmsgstr ""\n', "h.html": b"<html>" + b"<!-- x -->\n" * 700 + b"<meta http-equiv=content-type content='text/html; charset=windows-1252'><p>\x80\x81 z</p></html>", "i.xlf": b"<?xml version='1.0'?><xliff><trans-unit id='u'><source>Hi <g id='1'>x</g></source></trans-unit></xliff>"}.items():
        (source / name).write_bytes(body)
    docs = convert.documents(spark, str(source))
    assert {r.name: (r.kind, r.status) for r in docs.collect()} == {
        "a.html": ("HTML", convert.SUCCEEDED), "b.properties": ("JAVA_PROPERTIES", convert.SUCCEEDED), "c.txt": ("PLAINTEXT", convert.SUCCEEDED), "d.bin": (None, convert.NOT_IMPLEMENTED), "e.po": ("PO", convert.SUCCEEDED),
        "f.rc": ("WINRC", convert.SUCCEEDED), "g.po": ("PO", convert.SUCCEEDED), "h.html": ("HTML", convert.SUCCEEDED), "i.xlf": ("XLIFF", convert.SUCCEEDED),
    }
    convert.write_tables(docs, tables)
    made = spark.read.parquet(f"{tables}/trans_units")
    cores = {(r.doc_id.rsplit("/", 1)[1], r.core) for r in made.collect()}
    assert cores == {("a.html", "One."), ("a.html", "Two."), ("b.properties", "v"), ("c.txt", "Plain text."), ("e.po", "x"), ("f.rc", "a\u00e9"), ("g.po", "\u0105"), ("h.html", "\u20ac\ufffd z"), ("i.xlf", "Hi <bx id='1' ctype='x-xliff-g' rid='1'/>x<ex id='2' rid='1'/>")}
    assert [(r.severity, r.message) for r in spark.read.parquet(f"{tables}/diagnostics").collect()] == [(1, "bytes that are not windows-1252 were replaced")]
    done = made.filter("core <> 'Two.'").select("tu_id", F.lit("fr").alias("lang"), F.lit("1").alias("phase"), F.lit("target").alias("kind"), F.lit(0).alias("ordinal"), F.upper("core").alias("text"))
    done.write.parquet(f"{tables}/targets")
    got = {r.name: r.text for r in convert.export_documents(spark, tables, "fr").collect()}
    assert got["a.fr.html"].startswith("<html><p>ONE.") and "not yet translated: Two." in got["a.fr.html"]
    assert "charset=UTF-8'>" in got["h.fr.html"] and "charset=UTF-8" in got["g.fr.po"] and "i.fr.xlf" not in got and 'L"A\\x00c9"' in got["f.fr.rc"]
    assert "[Segment 2 not yet" in got["a.fr.html"]
    folder = str(tmp_path / "out")
    convert.main(["export", tables, folder, "fr"])
    assert (tmp_path / "out" / "b_fr.properties").read_bytes() == b"k=V\n" and not list((tmp_path / "out").glob("*.xlf"))
    whole = convert.xliff_documents(spark, tables, "en")
    assert export.well_formed(whole).filter("NOT well_formed").count() == 0 and whole.count() == 9
    assert got["b_fr.properties"] == "k=V\n" and got["c.fr.txt"] == "PLAIN TEXT.\n" and 'msgstr "X"' in got["e.fr.po"]


def test_archives_are_exported_from_a_folder(spark, tmp_path):
    from glossaweave.plans import convert

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.odt", "sub/b.odt"):
        (tmp_path / "in" / name).write_bytes(bytes(odf()[1]))
    tables = str(tmp_path / "tables")
    convert.write_tables(convert.documents(spark, str(tmp_path / "in")), tables)
    made = spark.read.parquet(f"{tables}/trans_units/format=ODT")
    made.select("tu_id", F.lit("fr").alias("lang"), F.lit("1").alias("phase"), F.lit("target").alias("kind"), F.lit(1).alias("ordinal"), F.lit("Traduit").alias("text")).write.parquet(f"{tables}/targets")
    got = {r.name: bytes(r.content) for r in convert.export_documents(spark, tables, "fr").collect()}
    assert sorted(got) == ["a.fr.odt", "b.fr.odt"]
    for content in got.values():
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert "Traduit" in z.read("content.xml").decode() and "A note" not in z.read("content.xml").decode()


BALANCED = [
    ("<p>one<p>two", "<p>one</p><p>two</p>"),
    ("<p>a <b>bold<p>c", "<p>a <b>bold</b></p><p>c</p>"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>e"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>"),
    ("<table><thead><tr><td>a<tbody><tr><td><p>b<tfoot><tr><td>c</table>d", "<table><thead><tr><td>a</td></tr></thead><tbody><tr><td><p>b</p></td></tr></tbody><tfoot><tr><td>c</td></tr></tfoot></table>d"),
    ("<table><tr><td><table><tr><td>in</tr></table><td>out</table>", "<table><tr><td><table><tr><td>in</td></tr></table></td><td>out</td></tr></table>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
    ("<b><i>x</b></i>y", "<b><i>x</i></b>y"),
    ("<p><table><tr><td></p>a</table>", "<p></p><table><tr><td>a</td></tr></table>"),
    ("a</td></tr></table></p></b>", "a"),
    ("<div><p>a</div>b<br><img src=x><hr/>", "<div><p>a</p></div>b<br><img src=x><hr/>"),
    ("<b><p>a</b></p>c", "<b><p>a</p>c</b>"),
    ("<td>a<td>b</td>", "<td>a</td><td>b</td>"),
    ("<script>if (a) '<p>';</script><p>x<!-- <p> -->", "<script>if (a) '<p>';</script><p>x<!-- <p> --></p>"),
]


def test_missing_end_tags_are_added(spark):
    docs = spark.createDataFrame([(str(i), raw) for i, (raw, _) in enumerate(BALANCED)], "doc_id string, text string")
    read = html.read(docs, balance=True)
    got = {r.doc_id: r.text for r in merge.documents(read).collect()}
    assert [got[str(i)] for i in range(len(BALANCED))] == [want for _, want in BALANCED]
    texts = {(r.doc_id, r.part_no): r.text for r in schema.paragraphs(read).collect()}
    assert any(t == "a <bx id='1' ctype='bold' rid='1'/>bold<ex id='2' rid='1'/>" for (d, _), t in texts.items() if d == "1")
    assert {r.doc_id for r in read.filter("size(notices) > 0").collect()} >= {"8", "10"}


@pytest.mark.parametrize("piece", ["<script ", "<a '", '<a "', "<!--", "<", "<!doctype ", "<a b", "</x>", "<style></x>", "'><a "])
def test_pages_of_one_bad_pattern_take_time_in_proportion(piece):
    for balance in (False, True):
        began = time.monotonic()
        html.tokenizer(balance=balance)(piece * (1_000_000 // len(piece)), schema.Parts())
        assert time.monotonic() - began < 10


def test_nested_codes_in_one_pass():
    n = 20_000
    text = "".join(f"<bx id='{i + 1}' ctype='x-html-i' rid='{i}'/>" for i in range(n)) + "x" + "".join(f"<ex id='{n + i + 1}' rid='{n - 1 - i}'/>" for i in range(n))
    began = time.monotonic()
    assert collapse_nested(text) == f"<bx id='1' ctype='x-html-i' rid='0'/>x<ex id='{2 * n}' rid='0'/>"
    assert time.monotonic() - began < 2


def chain_rows(spark, rows):
    made, told = chains.follow(spark.createDataFrame(rows, "doc_id string, tu_id string, next_tu_id string, ordinal int, text string"))
    return {(r.doc_id, r.tu_id): (r.units, r.text) for r in made.collect()}, {(r.doc_id, r.tu_id): r.message for r in told.collect()}


def test_chains_of_units(spark):
    rows = [
        ("a", "2", "3", 1, "two "), ("a", "1", "2", 2, "one "), ("a", "3", "gone", 3, "three"), ("a", "alone", None, 4, "x"),
        ("b", "1", "2", 1, "other document"), ("b", "2", None, 2, None), ("c", "1", "2", 1, "a"), ("c", "2", "3", 2, "b"), ("c", "3", "1", 3, "c"), ("c", "4", "4", 4, "self"), ("c", "5", "1", 5, "into"),
        ("d", "1", "3", 1, "first "), ("d", "2", "3", 2, "second"), ("d", "3", None, 3, "shared"), ("e", "1", None, 1, "old"), ("e", "1", None, 2, "new"), ("e", None, "1", 3, "no id"),
    ]
    made, told = chain_rows(spark, rows)
    assert made == {
        ("a", "1"): (3, "one two three"), ("a", "alone"): (1, "x"), ("b", "1"): (2, "other document"), ("c", "1"): (1, "a"), ("c", "2"): (1, "b"), ("c", "3"): (1, "c"), ("c", "4"): (1, "self"), ("c", "5"): (1, "into"),
        ("d", "1"): (2, "first shared"), ("d", "2"): (1, "second"), ("e", "1"): (1, "new"),
    }
    assert set(told) == {("c", "1"), ("c", "2"), ("c", "3"), ("c", "4"), ("c", "5"), ("d", "2")}
    assert chain_rows(spark, []) == ({}, {})


@pytest.mark.parametrize("length", [1, 2, 1000, 10_000])
def test_long_chains_out_of_order(spark, length):
    order = sorted(range(length), key=lambda i: i * 7919 % 10_007)
    rows = [("d", f"u{i}", f"u{i + 1}" if i + 1 < length else None, n, f"{i} ") for n, i in enumerate(order)]
    made, told = chain_rows(spark, rows)
    assert made == {("d", "u0"): (length, "".join(f"{i} " for i in range(length)))} and told == {}


def test_every_conversion(spark):
    from glossaweave.plans import convert

    assert sorted(map(tuple, convert.matrix(spark).collect())) == sorted(convert.WANTED)
