import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaweave.llm import exact_dedup as e

from . import helpers as h


def brute(docs):
    """docs: (doc_id, text) -> {doc_id: (keep_id, group_size, kept, sha)}"""
    groups = {}
    for doc, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), doc))
    out = {}
    for text, rows in groups.items():
        best = min(rows)[1]
        for _, doc in rows:
            out[doc] = (best, len(rows), doc == best, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(got, docs):
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == want[r.doc_id]


def test_query_against_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = e.query(spark, folder).collect()
    check(got, h.sf_documents(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({e.SQL})").fetchall()) == sorted(tuple(r[n] for n in names) for r in got)


def test_edges(spark, tmp_path):
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "ab ", " ab", "x" * 300_000, "x " * 300_000, "é", "é"]
    check(e.query(spark, h.table(spark, tmp_path, h.rows(texts))).collect(), list(enumerate(texts)))
    assert e.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []


def test_repeated_and_missing_ids(spark, tmp_path):
    data = [(None, "a", None, None, 1), (None, "a", None, None, 1), (3, "a", None, None, 1), (3, "a", None, None, 1), (None, "z", None, None, 1)]
    got = e.query(spark, h.table(spark, tmp_path, data)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("3", "3", 4, False), ("3", "3", 4, True), ("None", "3", 4, False), ("None", "3", 4, False), ("None", "None", 1, True)]


@pytest.mark.parametrize("split", ["false", "true", "doc_id % 3 = 0", "doc_id > 150"])
def test_result_does_not_depend_on_what_is_history(spark, split):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda df: sorted(map(str, df.select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert rows(e.dedup(docs, F.expr(split))) == rows(e.dedup(docs))


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_minimal_perfect_hash(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(n, 32)
    sizes, bits, slot = e.build_table(digests)
    assert sorted(slot.tolist()) == list(range(n))
    slots = np.zeros((n, 32), np.uint8)
    slots[slot] = digests
    assert e.look_up(digests, sizes, bits, slots).tolist() == slot.tolist()
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    assert (e.look_up(other, sizes, bits, slots) == -1).all()
