"""Spelling variants of a corpus's words, grouped without pairs.

Two words are near if they differ by one replaced, inserted or deleted code point.

* Replacements: a word of L code points enters L wildcard groups, (position, prefix, suffix) with the code point at the
  position left open. Two words share a group exactly if they differ at its position alone, and then no other. A group
  has at most one member a letter of the alphabet (26 + 64), so its size and its two most frequent words answer for all
  members: size - 1 near words each, the best of them the first, for the first itself the second.
* Insertions and deletions: a word's different deletions join the vocabulary. Each hit is one near word of either side;
  those of the shorter side are counted and their best kept by an aggregation before anything moves on.

Both give (word, near words, best) and add up by word. Forms double the count at least, so chains hold no cycle and are
no longer than the logarithm of the largest count; roots come from pointer doubling, in rounds of the logarithm of that.

A word longer than WHOLE code points has as many keys as code points, each as long: its keys are 127-bit polynomial
hashes with the length and position instead, made in linear time, and its text joins where two words meet. A word of
exactly WHOLE code points is met by longer ones under its hash.

Defined results: a null text has no words; a null doc_id counts as empty in the damage rule. Runs of one document that
are damaged are damaged alike. Repeated rows count as often as they occur. Ties between forms go to the smallest in
code-point order. An empty table gives an empty result. Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a word, occurrences of a word, one run in EVERY loses a code point, how much more frequent a form is.
LEAST, OFTEN, EVERY, TIMES = 5, 3, 97, 2
#: The longest word whose keys are its own text.
WHOLE = 64
PRIME, BASE, OPEN = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1), 1 << 24


def words(docs: DataFrame, least: int = LEAST, often: int = OFTEN, every: int = EVERY) -> DataFrame:
    """(word, n): the words of all documents after the damage rule, in the JVM, counted before the shuffle."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = hashed.select(F.when(F.col("h") % every == 0, damaged).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _without(word: Column, place: Column, mark: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.lit(mark), F.substring(word, place + 2, F.length(word)))


def _places(mark: str) -> Column:
    """The column `word` with each of its code points in turn replaced by mark, which is no letter."""
    word = F.col("word")
    return F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: _without(word, i, mark))


def _hashed(whole: int):
    """(word, n) of long words -> (key, id, kind, word, n): the word under its own hash (o), wildcard groups (w), different deletions (d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "kind", "word", "n"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                points, powers, before, h, power = [ord(c) for c in word], [], [], 0, 1
                for c in points:
                    before.append(h)
                    powers.append(power)
                    h, power = (h * BASE + c) % PRIME, power * BASE % PRIME
                length, after = len(points), 0
                me = f"#{length}:{h:x}"
                rows = [(me, me, "o", word, n)]
                if length > whole:
                    deleted = set()
                    for i in range(length - 1, -1, -1):
                        high = powers[length - 1 - i]
                        deleted.add((before[i] * high + after) % PRIME)
                        rows.append((f"{length}:{i}:{(h + (OPEN - points[i]) * high) % PRIME:x}", me, "w", None, None))
                        after = (points[i] * high + after) % PRIME
                    rows += [(f"#{length - 1}:{d:x}", me, "d", None, None) for d in deleted]
                for start in range(0, len(rows), 50_000):
                    columns = zip(*rows[start : start + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _best(n: str = "n", word: str = "word") -> Column:
    """Smallest for the word of largest count; ties by code points."""
    return F.struct((-F.col(n)).alias("m"), F.col(word).alias("w"))


def near(vocabulary: DataFrame, whole: int = WHOLE) -> DataFrame:
    """vocabulary (word, n) -> (word, n_near, best struct<m: minus its count, w: the word>) of every word that has a near word."""
    short = vocabulary.filter(F.length("word") <= whole)
    wild = short.select(F.explode(_places("*")).alias("key"), "n", "word")
    deleted = short.filter(F.length("word") > 1).select("word", "n", F.explode(F.array_distinct(_places(""))).alias("d"))
    met = deleted.join(vocabulary.filter(F.length("word") < whole).select(F.col("word").alias("d"), F.col("n").alias("n_d")), "d")
    longer = vocabulary.filter(F.length("word") >= whole)
    if not longer.isEmpty():
        keys = written(longer.mapInArrow(_hashed(whole), "key string, id string, kind string, word string, n long"), "spelling-long")
        own = keys.filter("kind = 'o'").select("id", "word", "n")
        members = keys.filter("kind = 'w'").select("key", "id")
        shared = members.groupBy("key").count().filter("count > 1").select("key")
        wild = wild.union(members.join(shared, "key").join(own, "id").select("key", "n", "word"))
        found = keys.filter("kind = 'd'").select(F.col("key").alias("s"), "id")
        found = found.join(own.select(F.col("id").alias("s"), F.col("word").alias("d"), F.col("n").alias("n_d")), "s").join(own, "id")
        met = met.union(found.select("d", "word", "n", "n_d"))
    groups = wild.groupBy("key").agg(F.sort_array(F.collect_list(_best())).alias("all")).filter(F.size("all") > 1)
    member = groups.select((F.size("all") - 1).alias("near"), F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), F.explode("all.w").alias("word"))
    replaced = member.select("word", F.col("near").cast("long").alias("near"), F.when(F.col("word") == F.col("first.w"), F.col("second")).otherwise(F.col("first")).alias("best"))
    both = met.select(F.explode(F.array(F.struct("word", _best("n_d", "d").alias("best")), F.struct(F.col("d").alias("word"), _best().alias("best")))).alias("x"))
    indel = both.groupBy("x.word").agg(F.count(F.lit(1)).alias("near"), F.min("x.best").alias("best"))
    return replaced.union(indel).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), acyclic, one form a word -> (word, root), by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def variants(vocabulary: DataFrame, times: int = TIMES, whole: int = WHOLE) -> DataFrame:
    """vocabulary (word, n) -> (word, form, root, n, n_near, form_n)."""
    joined = vocabulary.join(near(vocabulary, whole), "word", "left")
    chosen = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best"))
    known = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), chosen["w"].alias("form"), (-chosen["m"]).alias("form_n")), "spelling-near")
    last = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: words of all documents with their spelling forms."""
    return variants(written(words(documents(spark, sf_dir)), "spelling-words"))


#: The same in SQL: CRC-32 by its table of 256 steps over the UTF-8 bytes of code points below U+0100.
SQL = f"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, flatten(list_transform(list_transform(string_split(d || run, ''), lambda x: unicode(x)), lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)) AS bytes FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM coded, steps),
damaged AS (SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
k AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS wild, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.wild = b.wild AND a.word <> b.word
         UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.less = v.word UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.less = v.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, place) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.place AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word JOIN forms l ON l.word = walk.place AND l.form IS NULL"""
