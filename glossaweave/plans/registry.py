"""The engine's queries over the given tables and, where SQL can express them, their SQL.

Queries over tables that have no meaning for localization (orders, labels, conversations) exercise the relational shape of
an operator: they are named so below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charset, codes, detect, sentences, text
from ..operators import chains, merge, targets, units
from ..schema import paragraphs, stable_id
from ..sinks import export as sink
from ..sources import html, lines, plaintext, xliff, xml
from . import convert

QUERIES: dict = {}
ORACLE: dict = {}

# White space in the wide sense for the SQL engine's regular expressions.
_W = text.SPACE_CLASS
_BREAKS = "|".join(html.BREAK_TAGS)
_HIDDEN = "(?is)<!--.*?-->|<style\\b.*?</style\\s*>|<script\\b.*?</script\\s*>|<comment\\b.*?</comment\\s*>"
_VISIBLE = f"regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'g'), '(?is)<!doctype[^>]*>', '', 'g')"
_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '''', '&apos;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')"""


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    rf"""
WITH p AS (SELECT page_id, regexp_split_to_array({_VISIBLE}, '(?is)</?(?:{_BREAKS})(?:\s[^>]*)?/?>') AS a FROM pages),
q AS (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS t FROM p),
c AS (SELECT page_id, pos::INTEGER AS pos, trim(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '[\s\x{{000b}}]+', ' ', 'g')) AS text FROM q)
SELECT * FROM c WHERE NOT regexp_matches(text, '(?s)^(?:{_W}|-|<[be]?x[^>]*>)*$')"""
)
def html_text_units(spark, d):
    """S1, N14-N16, N2d: one row a unit of every page."""
    return html.text_units(_table(spark, d, "pages"))


@query(
    r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
       nullif(regexp_extract(html, '(?i)<meta\s[^>]*charset=[''"]?([A-Za-z0-9_:.-]+)', 1), '') AS meta_charset,
       nullif(regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv=[''"]?content-type[''"]?[^>]*>', 0), '(?i)charset=[''"]?([A-Za-z0-9_:.-]+)', 1), '') AS stated_charset
FROM pages"""
)
def html_title_and_meta_charset(spark, d):
    """The charset by the content-type rule, beside the short form of meta elements."""
    pages = _table(spark, d, "pages")
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    short = F.nullif(F.regexp_extract("html", "(?i)<meta\\s[^>]*charset=['\"]?([A-Za-z0-9_:.-]+)", 1), F.lit(""))
    return pages.select("page_id", title.alias("title"), short.alias("meta_charset"), charset.html_charset(F.col("html")).alias("stated_charset"))


@query(
    rf"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all({_VISIBLE}, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages),
dim AS (SELECT unnest({list(html.INLINE_TAGS)!r}) AS tag, unnest({list(html.INLINE_TAGS.values())!r}) AS ctype)
SELECT lower(t.tag) AS tag, ctype, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t JOIN dim ON lower(t.tag) = dim.tag GROUP BY ALL"""
)
def html_inline_code_census(spark, d):
    """Inline tags joined with their types (a fixed dimension table)."""
    pages = _table(spark, d, "pages")
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(html.visible(F.col("html")), F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("t")).select("page_id", F.lower("t").alias("tag"))
    dim = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in html.INLINE_TAGS.items() for x in pair])).alias("tag", "ctype"))
    return tags.join(F.broadcast(dim), "tag").groupBy("tag", "ctype").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("page_id").alias("pages"))


@query(
    r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)\shref=["'']([^"'']*)["'']', 1) AS v FROM pages)
SELECT page_id, unnest(range(len(v)))::INTEGER AS n, unnest(v) AS value FROM a"""
)
def html_attr_values(spark, d):
    """N18 on href: the pages have none of the translatable attributes."""
    found = F.regexp_extract_all("html", F.lit("(?i)\\shref=[\"']([^\"']*)[\"']"), 1)
    return _table(spark, d, "pages").select("page_id", F.posexplode(found).alias("n", "value"))


@query(
    r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a(\s[^>]*)?>', 0)) AS tag FROM pages)
SELECT page_id, count(*) AS anchors, count(*) FILTER (WHERE regexp_matches(tag, '(?i)\sname=') AND NOT regexp_matches(tag, '(?i)\shref=')) AS bookmarks FROM a GROUP BY page_id"""
)
def html_link_bookmark_flag(spark, d):
    """N19's predicate: anchors with a name and no target."""
    tags = _table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?i)<a(\\s[^>]*)?>"), 0)).alias("tag"))
    mark = F.col("tag").rlike("(?i)\\sname=") & ~F.col("tag").rlike("(?i)\\shref=")
    return tags.groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"), F.count_if(mark).alias("bookmarks"))


@query(
    r"""
WITH t AS (SELECT 'page' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT origin, id, CASE WHEN regexp_matches(left(body, 256), '(?is)<!DOCTYPE\s+html|<head|<title|<html') AND strlen(body) >= 5 THEN 'HTML'
                        WHEN regexp_matches(body, '^<\?xml version') THEN 'XML' END AS kind FROM t"""
)
def format_detect_signature(spark, d):
    """Types by first bytes."""
    pages = _table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    docs = _table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    return pages.union(docs).select("origin", "id", detect.identify(F.col("content")).alias("kind"))


@query(f"SELECT doc_id, {_ESCAPED.format('text')} AS escaped FROM documents")
def escape_text(spark, d):
    """N12."""
    return _table(spark, d, "documents").select("doc_id", text.escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, text, true AS same FROM documents")
def unescape_roundtrip(spark, d):
    """Unescaping undoes escaping."""
    back = text.unescape(text.escape(F.col("text")))
    return _table(spark, d, "documents").select("doc_id", back.alias("text"), (back == F.col("text")).alias("same"))


@query(
    r"""
WITH c AS (SELECT doc_id, text || ' & &amp; <b> "q" &lt;' AS t FROM documents),
m AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&amp;', chr(1)), '&lt;', chr(2)), '&gt;', chr(3)), '&apos;', chr(4)), '&quot;', chr(5)), '&', '&amp;') AS t FROM c),
e AS (SELECT doc_id, replace(replace(replace(replace(replace(t, chr(1), '&amp;'), chr(2), '&lt;'), chr(3), '&gt;'), chr(4), '&apos;'), chr(5), '&quot;') AS t FROM m)
SELECT doc_id, replace(replace(replace(replace(t, '''', '&apos;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS repaired FROM e"""
)
def repair_entities(spark, d):
    """N11, on documents with special characters put at their end."""
    made = F.concat("text", F.lit(' & &amp; <b> "q" &lt;'))
    return _table(spark, d, "documents").select("doc_id", text.repair_entities(made).alias("repaired"))


_TALK = "(SELECT conv_id, turn, '• ' || text || ' — ' AS t FROM conversations)"
_MARKED = rf"""
WITH c AS {_TALK}, l AS (SELECT conv_id, turn, regexp_extract(t, '^{_W}+', 0) AS lead, t FROM c),
r AS (SELECT *, substr(t, length(lead) + 1) AS rest FROM l),
b AS (SELECT *, regexp_replace(rest, '(?:{_W}|[\x{{0001}}-\x{{0020}}])+$', '') AS body FROM r),
m AS (SELECT conv_id, turn, lead, body, substr(rest, length(body) + 1) AS tail FROM b)"""


@query(
    _MARKED
    + rf""" SELECT conv_id, turn, CASE WHEN regexp_matches(body, '(?s)^(?:{_W}|-|<[be]?x[^>]*>)*$') THEN ''
       ELSE lead || '<mrk mtype=''x-coretext''>' || body || '</mrk>' || tail END AS marked FROM m"""
)
def mark_core_untagged(spark, d):
    """N2b-N2d on turns with a bullet before and a dash behind."""
    made = F.concat(F.lit("• "), "text", F.lit(" — "))
    return _table(spark, d, "conversations").select("conv_id", "turn", text.mark_core(made).alias("marked"))


@query(_MARKED + " SELECT conv_id, turn, lead AS prefix, body AS core, tail AS suffix, t AS whole FROM m JOIN c USING (conv_id, turn) WHERE body <> ''")
def core_prefix_suffix(spark, d):
    """The three parts of a marked text, and the text without marks."""
    marked = mark_core_untagged(spark, d).filter("marked <> ''")
    m = F.col("marked")
    return marked.select("conv_id", "turn", text.prefix_text(m).alias("prefix"), text.core_text(m).alias("core"), text.suffix_text(m).alias("suffix"), text.remove_core_marks(m).alias("whole"))


@query(
    rf"""
WITH j AS (SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g'), '\n\x{{1806}}', chr(10), 'g'), '\x{{00ad}}\n', '', 'g'), '({plaintext.TIGHT})\n', '\1', 'g'), chr(10), ' ') AS t FROM documents)
SELECT doc_id, 0 AS part_no, {_ESCAPED.format('t')} AS text FROM j WHERE trim(t) <> ''"""
)
def plaintext_paragraph_join(spark, d):
    """Documents without blank lines are one paragraph each."""
    return plaintext.paragraphs(_table(spark, d, "documents"))


@query(
    """
SELECT conv_id, turn, md5(conv_id || ':' || first_value(turn) OVER w) AS para_id, md5(conv_id || ':' || turn) AS tu_id,
       count(*) OVER (PARTITION BY conv_id) AS seg_of, lead(turn) OVER w IS NOT NULL AS mergeable,
       CASE WHEN lead(turn) OVER w IS NOT NULL THEN md5(conv_id || ':' || lead(turn) OVER w) END AS next_tu_id
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def tu_table_mergeable(spark, d):
    """Keys of units: a conversation as paragraph, its turns as segments."""
    turns = _table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    key = stable_id("conv_id", "turn")
    following = F.lead("turn").over(w)
    return turns.select(
        "conv_id", "turn", stable_id(F.col("conv_id"), F.first("turn").over(w)).alias("para_id"), key.alias("tu_id"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("seg_of"),
        following.isNotNull().alias("mergeable"), F.when(following.isNotNull(), stable_id(F.col("conv_id"), following)).alias("next_tu_id"),
    )


_PHASES = "(SELECT o_custkey AS tu_id, left(o_orderpriority, 1) AS phase, o_orderkey AS ordinal, o_orderstatus AS text FROM orders)"


@query(
    f"""
WITH t AS {_PHASES}, r AS (SELECT *, CASE WHEN phase::INTEGER BETWEEN 1 AND 3 THEN 3 - phase::INTEGER END AS rank FROM t)
SELECT tu_id, phase, text FROM (SELECT *, row_number() OVER (PARTITION BY tu_id ORDER BY rank, ordinal) AS n FROM r WHERE rank IS NOT NULL) WHERE n = 1"""
)
def select_target_by_phase(spark, d):
    """L3, L4 with orders as a stand-in: priorities as phases, the third wanted of four."""
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("tu_id"), F.lit("xx").alias("lang"), F.substring("o_orderpriority", 1, 1).alias("phase"), F.lit("target").alias("kind"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("text"))
    return targets.choose(rows, "XX", "3", 4)


@query(
    """
WITH u AS (SELECT doc_id AS tu_id, row_number() OVER (ORDER BY doc_id) AS ordinal, text AS core FROM documents),
t AS (SELECT doc_id AS tu_id, 'quality ' || quality AS target FROM labels)
SELECT u.tu_id, ordinal, coalesce(target, ' [Segment ' || ordinal || ' not yet translated: ' || trim(regexp_replace(core, '\\s+', ' ', 'g')) || '] ') AS target
FROM u LEFT JOIN t USING (tu_id)"""
)
def missing_target_default(spark, d):
    """L5 with labels as a stand-in for targets. The position comes from counting smaller ids: a join on ranges of ids, no global sort."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("tu_id"), F.col("text").alias("core"))
    numbered = _positions(docs, "tu_id")
    chosen = _table(spark, d, "labels").select(F.col("doc_id").alias("tu_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return targets.with_default(numbered, chosen).select("tu_id", "ordinal", "target")


def _positions(df: DataFrame, key: str) -> DataFrame:
    """`ordinal` from 1 by the key: counted in ranges of 1024 ids, whose totals are summed (one row a range), then within each."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / 1024))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return placed.join(before, "_range").withColumn("ordinal", F.col("_i") + F.col("_before")).drop("_range", "_i", "_before")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def skip_list_antijoin(spark, d):
    """Candidates off a skip list, labels as a stand-in."""
    return _table(spark, d, "documents").select("doc_id", "source").join(_table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def candidate_semijoin(spark, d):
    """The text elements among all, labels as a stand-in."""
    return _table(spark, d, "documents").select("doc_id", "source").join(_table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT conv_id, string_agg('[' || role || '] ' || text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def placeholder_expand_listagg(spark, d):
    """Units joined with their places in a skeleton and put together in order."""
    turns = _table(spark, d, "conversations")
    skeleton = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), F.concat(F.lit("["), "role", F.lit("] ")).alias("literal"))
    texts = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), "text")
    filled = skeleton.join(texts, ["doc_id", "part_no"]).select("doc_id", "part_no", F.concat("literal", "text").alias("piece"))
    return merge.joined_text(filled, ["doc_id"], "part_no", "piece", "text").withColumnRenamed("doc_id", "conv_id")


@query("SELECT md5(text) AS tu_id, arg_max(source, doc_id) AS source, max(doc_id) AS ordinal FROM documents GROUP BY md5(text)")
def dup_tu_last_wins(spark, d):
    """L1: of units with one id (here the text's hash) the last stays."""
    return targets.last_wins(_table(spark, d, "documents").select(F.md5("text").alias("tu_id"), "source", F.col("doc_id").alias("ordinal")))


@query(
    rf"""
WITH t AS (SELECT page_id, regexp_extract_all({_VISIBLE}, '<([A-Za-z][A-Za-z0-9]*)', 1) AS a FROM pages),
u AS (SELECT page_id, unnest(range(len(a)))::INTEGER AS seq, lower(unnest(a)) AS tag FROM t)
SELECT page_id, seq, tag, row_number() OVER (PARTITION BY page_id, tag ORDER BY seq)::INTEGER AS nth FROM u"""
)
def xpath_running_ordinal(spark, d):
    """Ordinals among equal names, in document order."""
    found = F.regexp_extract_all(html.visible(F.col("html")), F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)
    tags = _table(spark, d, "pages").select("page_id", F.posexplode(found).alias("seq", "t")).select("page_id", "seq", F.lower("t").alias("tag"))
    return tags.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("seq")))


def _as_lines(spark, d, made) -> DataFrame:
    return _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.regexp_replace("text", "\\s+", " ").alias("text")))), made), "").alias("text"))


_TURNS = r"SELECT conv_id::VARCHAR AS doc_id, '{0}' || turn AS name, " + _ESCAPED.format(r"trim(regexp_replace(text, '\s+', ' ', 'g'))") + " AS text FROM conversations WHERE trim(text) <> ''"


@query(_TURNS.format("turn."))
def properties_lines(spark, d):
    """Conversations written as property files and read again."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.lit("# "), t["role"], F.lit("\nturn."), t["turn"].cast("string"), F.lit(" = "), F.trim(F.replace(t["text"], F.lit("\\"), F.lit("\\\\"))), F.lit("\n")))
    return paragraphs(lines.read(docs, "JAVA_PROPERTIES")).select("doc_id", "name", "text")


@query(_TURNS.format("turn."))
def dtd_entities(spark, d):
    """Conversations written as entity files and read again."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.lit("<!ENTITY turn."), t["turn"].cast("string"), F.lit(' "'), text.escape(F.trim(t["text"])), F.lit('">\n')))
    return paragraphs(lines.read(docs, "XULDTD")).select("doc_id", "name", "text")


@query("SELECT conv_id::VARCHAR AS doc_id, count(*) AS entries FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def po_entries(spark, d):
    """Conversations written as message catalogues; units a catalogue."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.lit("#: "), t["role"], F.lit('\nmsgid "'), F.replace(F.replace(t["text"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"\nmsgstr ""\n\n')))
    return paragraphs(lines.read(docs, "PO")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT conv_id::VARCHAR AS doc_id, " + _ESCAPED.format(r"regexp_replace(text, '\s+', ' ', 'g')") + " AS text FROM conversations WHERE trim(text) <> ''")
def rc_strings(spark, d):
    """Conversations written as string tables and read again."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.when(t["turn"] == 0, "STRINGTABLE\nBEGIN\n").otherwise(""), F.lit("  IDS_"), t["turn"].cast("string"), F.lit(', "'), F.replace(t["text"], F.lit('"'), F.lit('""')), F.lit('"\n')))
    return paragraphs(lines.read(docs, "WINRC")).select("doc_id", "text")


@query("SELECT conv_id::VARCHAR AS doc_id, string_agg('turn.' || turn || ' = ' || translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'aeiou', 'AEIOU') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def properties_translated(spark, d):
    """Property files with every value translated (its vowels to capitals) and written again."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.lit("turn."), t["turn"].cast("string"), F.lit(" = "), F.trim(t["text"]), F.lit("\n")))
    read = lines.read(docs, "JAVA_PROPERTIES")
    made = paragraphs(read).select("doc_id", "part_no", F.lit(0).alias("seg_no"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("text").alias("core"), text.escape(F.translate(text.unescape(F.col("text")), "aeiou", "AEIOU")).alias("target"))
    return sink.export(read, made, "JAVA_PROPERTIES").select("doc_id", "text")


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN 'ISO-8859-1' ELSE 'UTF-8' END AS plain_charset, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN 'ISO-8859-1' ELSE 'UTF-8' END AS catalogue_charset FROM documents")
def charset_by_language(spark, d):
    """E2, E3."""
    return _table(spark, d, "documents").select("doc_id", charset.plaintext_charset(F.col("lang")).alias("plain_charset"), charset.catalogue_charset(F.lit(""), F.col("lang")).alias("catalogue_charset"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' end' AS plain FROM documents")
def source_plain_text(spark, d):
    """Codes out of a source, line breaks as spaces."""
    made = F.concat(F.lit("<bx id='1' rid='1'/>"), F.col("text"), F.lit("<x id='2' ctype='lb'/>"), F.lit("<ex id='3' rid='1'/>end"))
    return _table(spark, d, "documents").select("doc_id", text.plain_source(made).alias("plain"))


@query("SELECT l_orderkey, substr(min(lpad(l_linenumber::VARCHAR, 9, '0') || l_returnflag), 10) AS body FROM lineitem GROUP BY l_orderkey")
def format_first_match(spark, d):
    """L8 with lineitem as a stand-in: the first markup of each code."""
    return _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("body"))


def _spread(docs: DataFrame) -> DataFrame:
    """The table in as many tasks as there are cores, where its files have fewer splits: for Python stages over small files alone."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _pages(spark, d) -> DataFrame:
    return _spread(_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query(r"SELECT page_id::VARCHAR AS doc_id, md5(regexp_replace(html, '\s+', '', 'g')) AS squeezed FROM pages")
def html_roundtrip(spark, d):
    """Every page tokenised with codes and built again; alike but for white space, which import collapses."""
    read = html.read(_pages(spark, d))
    return merge.documents(read).select("doc_id", F.md5(F.regexp_replace("text", "\\s+", "")).alias("squeezed"))


@query("SELECT conv_id::VARCHAR AS doc_id, 'u' || min(turn) AS tu_id, count(*)::INTEGER AS units, string_agg(" + _ESCAPED.format(r"regexp_replace(text, '\s+', ' ', 'g')") + ", '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def next_tu_chains(spark, d):
    """Conversations written as XLIFF whose units stand in another order than they are to be read, each with the id of the next; joined by
    following the ids."""
    turns = _table(spark, d, "conversations")
    unit = lambda t: F.concat(F.lit("<trans-unit id='u"), t["turn"].cast("string"), F.lit("' lt:mergeable='true' lt:next-tu-id='u"), (t["turn"] + 1).cast("string"), F.lit("'><source>"), text.escape(t["text"]), F.lit("</source></trans-unit>"))
    mixed = F.array_sort(F.collect_list(F.struct(F.md5(F.concat("role", "text")).alias("o"), "turn", F.regexp_replace("text", "\\s+", " ").alias("text"))))
    docs = turns.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_join(F.transform(mixed, unit), "").alias("text"))
    units_read = xliff.raw_units(docs).withColumn("text", F.col("source"))
    return chains.follow(units_read)[0]


_PAIRED = ("p", "b", "i", "a", "em", "li", "ul", "td", "tr", "table", "div")


@query(
    f"""
WITH v AS (SELECT page_id::VARCHAR AS doc_id, {_VISIBLE} AS html FROM pages), t(tag) AS (VALUES {", ".join(f"('{t}')" for t in _PAIRED)})
SELECT doc_id, tag, len(regexp_extract_all(html, '(?i)<' || tag || '[\\s>/]'))::INTEGER AS opened, opened AS closed FROM v, t WHERE regexp_matches(html, '(?i)<' || tag || '[\\s>/]')"""
)
def html_balanced(spark, d):
    """Pages built again with the end tags that their elements lack: as many ends as starts of every element."""
    built = merge.documents(html.read(_pages(spark, d), balance=True))
    count = lambda h, pattern: F.size(F.regexp_extract_all(h, F.lit(pattern), F.lit(0)))
    row = lambda h, t: F.struct(F.lit(t).alias("tag"), count(h, f"(?i)<{t}[\\s>/]").alias("opened"), count(h, f"(?i)</{t}\\s*>").alias("closed"))
    # One array holds the visible part, so that it is computed once.
    counts = F.flatten(F.transform(F.array(html.visible(F.col("text"))), lambda h: F.array(*[row(h, t) for t in _PAIRED])))
    each = built.select("doc_id", F.explode(counts).alias("x"))
    return each.select("doc_id", "x.*").filter("opened + closed > 0")


@query()
def html_trans_units(spark, d):
    """Units of every page with inline codes, by sentence."""
    read = html.read(_pages(spark, d))
    return units.trans_units(units.segments(paragraphs(read)))


# The break iterator's rules in SQL: what ends a sentence always; after a full stop, a capital after space, or signs right before a letter. Signs
# alone after the last full stop leave the full stop by itself.
_CLOSERS = r"[.!?\"''\p{Pe}\p{Pf}]*"
_SIGNS = r"[^\p{L}\p{N}\p{Pe}\p{Pf}\s,.!?]+"


@query(
    rf"""
WITH d AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g'), '({plaintext.TIGHT})\n', '\1', 'g'), chr(10), ' ') AS t FROM documents),
e AS (SELECT doc_id, {_ESCAPED.format('t')} AS t FROM d WHERE trim(t) <> ''),
p AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS p FROM
      (SELECT doc_id, list_filter(regexp_extract_all(t, '[^.!?]*(?:[.!?]{_CLOSERS}\s*|$)'), lambda x: x <> '') AS a FROM e)),
q AS (SELECT *, lag(p) OVER w AS before, lead(p) OVER w AS after, lead(p, 2) OVER w IS NULL AS near_end FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, before IS NULL OR regexp_matches(before, '[!?]{_CLOSERS}\s*$') OR regexp_matches(p, '^{_SIGNS}\p{{L}}')
             OR (regexp_matches(before, '\s$') AND regexp_matches(p, '^[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{Lm}}]')) OR (after IS NULL AND regexp_matches(before, '\.{_CLOSERS}\s*$') AND regexp_matches(p, '^{_SIGNS}$')) AS begins,
             after IS NOT NULL AND near_end AND regexp_matches(p, '[^.!?]\.{_CLOSERS}\s*$') AND NOT regexp_matches(p, '[!?]') AND regexp_matches(after, '^{_SIGNS}$') AS odd FROM q),
s AS (SELECT doc_id, 2 * i AS i, begins, CASE WHEN odd THEN regexp_extract(p, '^[^.]*') ELSE p END AS p FROM r
      UNION ALL SELECT doc_id, 2 * i + 1, true, regexp_extract(p, '\..*$') FROM r WHERE odd),
n AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
j AS (SELECT doc_id, k, string_agg(p, '' ORDER BY i) AS s FROM n GROUP BY ALL),
l AS (SELECT *, regexp_extract(s, '^{_W}+') AS lead, regexp_replace(substr(s, len(regexp_extract(s, '^{_W}+')) + 1), '[{_W[1:-1]}\x01-\x20]+$', '') AS body FROM j),
m AS (SELECT *, regexp_matches(body, '[^-{_W[1:-1]}]') AS core FROM l),
g AS (SELECT *, count(*) FILTER (WHERE core) OVER (PARTITION BY doc_id ORDER BY k) AS seg FROM m)
SELECT doc_id, 0::INTEGER AS part_no, (seg - 1)::INTEGER AS seg_no,
       string_agg(CASE WHEN core THEN lead || '<mrk mtype=''x-coretext''>' || body || '</mrk>' || substr(s, len(lead) + len(body) + 1) ELSE s END, '' ORDER BY k) AS marked
FROM g WHERE seg > 0 GROUP BY doc_id, seg"""
)
def sentence_segments(spark, d):
    """Sentences of every document, in its language, with marked cores: no Python in the plan."""
    docs = _spread(_table(spark, d, "documents"))
    return units.segments(plaintext.paragraphs(docs, "doc_id", "text", "lang"), language=F.col("lang"), coded=False).select("doc_id", "part_no", "seg_no", "marked")


@query("SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def sentences_lose_nothing(spark, d):
    """The pieces of a text, joined, are the text: words are counted on the joined pieces."""
    joined = F.array_join(sentences.cut(F.col("text"), F.col("lang")), "")
    return _spread(_table(spark, d, "documents")).select("doc_id", F.size(F.split(joined, " ", -1)).cast("long").alias("words"))


@query("SELECT conv_id::VARCHAR AS doc_id, '/talk[1]/turn[' || (turn + 1) || ']' AS xpath FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def xml_candidates(spark, d):
    """Conversations written as XML; candidates of the user's turns, the others on a skip list."""
    docs = _as_lines(spark, d, lambda t: F.concat(F.lit("<turn role='"), t["role"], F.lit("' url='http://example.org/'>"), text.escape(t["text"]), F.lit("</turn>\n")))
    docs = docs.select("doc_id", F.concat(F.lit("<talk>"), "text", F.lit("</talk>")).alias("text"))
    found = xml.candidates(docs).filter("attribute IS NULL")
    roles = _table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c"), F.concat(F.lit("/talk[1]/turn["), (F.col("turn") + 1).cast("string"), F.lit("]")).alias("x"), "role")
    skip = found.join(roles.filter("role <> 'user'"), (F.col("doc_id") == F.col("c")) & (F.col("xpath") == F.col("x"))).select("doc_id", "line", "col", "attribute")
    return xml.without(found, skip).select("doc_id", "xpath")


@query("SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS ordinal, 'u' || turn AS tu_id, role AS text FROM conversations")
def xliff_targets(spark, d):
    """Conversations written as XLIFF with a target of phase 2 and one of phase 1, and one in another language."""
    t = lambda lang, phase, body: F.concat(F.lit(f"<target xml:lang='{lang}' phase-name='{phase}'>"), body, F.lit("</target>"))
    docs = _as_lines(spark, d, lambda x: F.concat(F.lit("<trans-unit id='u"), x["turn"].cast("string"), F.lit("'><source>"), text.escape(x["text"]), F.lit("</source>"), t("de", 2, F.lit("zwei")), t("fr", 1, F.lit("un")), F.lit("<alt-trans xml:lang='fr'>"), t("fr", 2, x["role"]), F.lit("</alt-trans></trans-unit>\n")))
    read = xliff.raw_units(docs)
    # One id of a unit within all documents, for the choice.
    found = xliff.targets(read).withColumn("tu_id", F.concat_ws("/", F.col("doc_id").cast("string"), "tu_id"))
    chosen = targets.choose(found, "FR", "2", 3).withColumnsRenamed({"tu_id": "k", "text": "chosen"})
    return read.join(chosen, F.concat_ws("/", F.col("doc_id").cast("string"), "tu_id") == F.col("k")).select("doc_id", "ordinal", "tu_id", F.col("chosen").alias("text"))


@query(
    "WITH m(source, target, status) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in convert.WANTED) + """),
f AS (SELECT 'HTML' AS source, count(*) AS found FROM pages UNION ALL SELECT 'XLIFF', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'PLAINTEXT', count(*) FROM documents)
SELECT m.*, found FROM m JOIN f USING (source)"""
)
def conversion_matrix(spark, d):
    """What the documents of the tables convert into: the types of pages and of conversations written as XLIFF are detected, texts are declared."""
    talk = _as_lines(spark, d, lambda t: F.concat(F.lit("<trans-unit id='u"), t["turn"].cast("string"), F.lit("'/>")))
    talk = talk.select(F.concat(F.lit("<?xml version='1.0'?><xliff version='1.1'>"), "text", F.lit("</xliff>")).alias("body"))
    raw = _table(spark, d, "pages").select(F.col("html").alias("body")).union(talk)
    kinds = raw.select(detect.by_signature(F.encode("body", "UTF-8")).alias("source")).union(_table(spark, d, "documents").select(F.lit("PLAINTEXT")))
    found = kinds.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    return convert.matrix(spark).join(found, "source")


def _of_cases(name: str) -> None:
    from . import cases

    rule, table, made = cases.CASES[name]
    query(cases.wanted(table))(_named(name, rule, lambda spark, d: made(spark, d, table)))


def _named(name: str, rule: str, function):
    function.__name__, function.__doc__ = name, f"{rule}, on cases filled from every turn."
    return function


def _register_cases() -> None:
    from . import cases

    for name in cases.CASES:
        _of_cases(name)


_register_cases()
