import hashlib
import random

import numpy as np
import pytest

from glossaweave.llm import substring_dedup as s

from . import helpers as h


def brute(docs):
    """docs: (key, text), any order -> list of (n_words, n_removed, sha)"""
    words = [h.WORD.findall(t or "") for _, t in docs]
    first = {}
    for (key, _), w in zip(docs, words):
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            first[x] = min(first.get(x, key), key)
    out = []
    for (key, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < key:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(got, docs):
    assert len(got) == len(docs)
    want = dict(zip([d for d, _ in docs], brute(docs)))
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_query_against_brute_force(spark):
    docs = h.sf_documents(spark)
    got = s.query(spark, "/root/testdata/sf0.001").collect()
    check(got, docs)
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("flush", [s.FLUSH, 500])
def test_planted_passages(spark, tmp_path, monkeypatch, flush):
    monkeypatch.setattr(s, "FLUSH", flush)
    monkeypatch.setattr(s, "CHUNK", 2000)
    monkeypatch.setattr(s, "RANGE", 3000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 99, 120, 400)]
    texts = [None, "", " \n\t", "one"]
    for i in range(60):
        parts = [word() for _ in range(rng.randrange(60))]
        for p in rng.sample(passages, rng.randrange(4)):
            cut = rng.randrange(0, 20)
            parts += p[cut : len(p) - rng.randrange(0, 10)] + [word() for _ in range(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[10], texts[11], " ".join(["same"] * 130), " ".join(["same"] * 90), "x " * 49, "x " * 49]
    rng.shuffle(texts)
    check(s.query(spark, h.table(spark, tmp_path, h.rows(texts))).collect(), list(enumerate(texts)))


def test_edges(spark, tmp_path):
    assert s.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []
    long = " ".join(str(i % 7919) for i in range(120_000))
    texts = [long, "a b " + long + " c", None]
    check(s.query(spark, h.table(spark, tmp_path / "long", h.rows(texts))).collect(), list(enumerate(texts)))
    own = " ".join(str(i) for i in range(80))
    data = [(None, own, None, None, 1), (3, own, None, None, 1), (3, own, None, None, 1), (9, own + " z", None, None, 1)]
    got = s.query(spark, h.table(spark, tmp_path / "ids", data)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("3", 0), ("9", 80), ("None", 80)]


def test_sets_round_trip():
    rng = np.random.default_rng(0)
    for top in (1000, 2**40, 2**62):
        v = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        f = rng.integers(0, 4, len(v)).astype(np.uint8)
        a, b = s.decode_set(s.encode_set(v, f))
        assert (a == v).all() and (b == f).all()


def test_rolling_hash_depends_on_the_words_alone():
    hashes = np.random.default_rng(0).integers(0, 2**64, 300, dtype=np.uint64)
    hashes[200:260] = hashes[20:80]
    for which in (0, 1):
        out = s.rolling(hashes, 50, which)
        assert (out[200:211] == out[20:31]).all() and len(set(out.tolist())) == len(out) - 11
