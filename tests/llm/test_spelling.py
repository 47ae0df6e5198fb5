"""Spelling variants against all pairs of words compared one by one."""

import re
import zlib
from collections import Counter

import duckdb
import pytest

from glossaweave.llm import spelling

from . import helpers as h

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % 97 == 0:
                at = crc % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    lengths = {}
    for w in n:
        lengths.setdefault(len(w), []).append(w)
    near = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in lengths.get(size, []) if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = {"word": w, "form": form[w], "root": root, "n": n[w], "n_near": len(near[w]), "form_n": n.get(form[w])}
    return out


def found(spark, folder, whole=None):
    if whole:
        return h.collected(spelling.variants(spelling.words(spark.read.parquet(f"{folder}/documents.parquet")), whole=whole), "word")
    return h.collected(spelling.query(spark, folder), "word")


def test_whole_small_table(spark):
    assert found(spark, "/root/testdata/sf0.001") == brute(h.sf_documents(spark))


LONG = "abcdefghij" * 8
TEXTS = [
    None, "", " \n", "colour color colour colour colour Colour color color", "color colour cölor cölor cölor CÖLOR", "aaaaa aaaaaa aaaaa aaaaaa aaaaa aaaaaa aaaaa aaaaaa",
    "tiesa tiesb tiesc " * 3, "tiesa tiesb " * 4, "x÷abcd×y " * 3, "abcd " * 9, "don't " * 3, f"{LONG} {LONG} {LONG} {LONG} {LONG} {LONG} " + f"{LONG[:30]}{LONG[31:]} " * 3 + f"{LONG[:40]}z{LONG[41:]} " * 3 + f"{LONG}a " * 8,
    f"{LONG[:64]} " * 3 + f"{LONG[:65]} " * 6 + f"{LONG[:63]} " * 12 + f"{LONG[:20]}q{LONG[21:64]} " * 5 + f"q{LONG[1:65]} " * 3, "chaina " * 3 + "chainab " * 6 + "chainabc " * 12 + "chainabcd " * 24,
]


@pytest.mark.parametrize("whole", [64, 6])
def test_awkward_words(spark, tmp_path, whole):
    data = h.rows(TEXTS) + h.rows(TEXTS)[3:9] + [(None, "nowhere nowhere nowhere elsewhere", "en", None, 1)]
    assert found(spark, h.table(spark, tmp_path, data), whole) == brute([r[:2] for r in data])


def test_damage_loses_one_code_point(spark, tmp_path):
    docs = [(i, f"Straße{'abcdefghij'[i % 10]}ö") for i in range(900)]
    data = [(i, t, "en", "s", 1) for i, t in docs]
    assert found(spark, h.table(spark, tmp_path, data)) == brute(docs)
    assert any(zlib.crc32(f"{i}:{t.lower()}".encode()) % 97 == 0 for i, t in docs if "ß" in t)


def test_very_long_words_take_linear_keys(spark, tmp_path):
    word = "abcdefghijklmnop" * 2000
    data = h.rows([word, word, word + " " + word[:-1], word[:-1] + " x" * 50_000, word[:-1]] * 2)
    assert found(spark, h.table(spark, tmp_path, data)) == brute([r[:2] for r in data])


def test_no_rows(spark, tmp_path):
    assert found(spark, h.table(spark, tmp_path, [])) == {}


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.SQL})").fetchall()
        got = spelling.query(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
