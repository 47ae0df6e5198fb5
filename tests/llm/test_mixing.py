import numpy as np
import pytest

from glossaweave.llm import mixing

from . import helpers as h


def plain_targets(sizes):
    """{source: size} -> {source: target}, by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def check(got, docs):
    """docs: (doc_id, text, source)"""
    size = {d: len(h.WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    sizes = {}
    for d, n in size.items():
        sizes[source[d]] = sizes.get(source[d], 0) + n
    want = plain_targets(sizes)
    assert len(got) == len(docs)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS, s


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = mixing.query(spark, "/root/testdata/sf0.001")
    got = df.collect()
    check(got, docs)
    again = mixing.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark, tmp_path):
    texts = [None, "", " ", "a b c", "word " * 100_000, "x y", "x y", "é ü"]
    sources = ["b", None, "empty", "b", "B", "ü", "ü", None]
    check(mixing.query(spark, h.table(spark, tmp_path, h.rows(texts, sources))).collect(), list(zip(range(8), texts, sources)))
    assert mixing.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []
    blank = mixing.query(spark, h.table(spark, tmp_path / "blank", h.rows([None, ""]))).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_repeated_rows(spark, tmp_path):
    data = [(1, "a b c d", None, "s", 7)] * 3 + [(None, "e f", None, "t", 3)]
    got = mixing.query(spark, h.table(spark, tmp_path, data)).collect()
    assert len(got) == 4 and sum(r.taken for r in got if r.doc_id == 1) <= 36


def test_splitting_tree_is_exact_and_even():
    quotas = [1000, 0, 3, 777, 50_000]
    out = mixing.splitting_tree(quotas, 13)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 2
    many = np.array([mixing.splitting_tree([100, 300], 4, seed)[0, 0] for seed in range(800)])
    assert abs(many.mean() - 25) < 0.6 and abs(many.var() - 100 * 0.25 * 0.75 * 300 / 399) < 2
    big = mixing.splitting_tree([5 * 10**9, 7 * 10**9], 8)
    assert big.sum(axis=0).tolist() == [5 * 10**9, 7 * 10**9]


def test_draws_are_disjoint_runs(spark):
    rows, aims, draws = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), block_words=64, shards=8)
    got = draws.collect()
    assert len({(r.doc_id, r.copy, r.block, r["pass"]) for r in got}) == len(got)
    counts = np.bincount([r.shard for r in got], minlength=8)
    assert counts.max() - counts.min() <= 3


def test_stage_repeats_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    counts = out.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in counts) <= 3 and sum(r["count"] for r in counts) > 50


def test_hypergeometric_against_exact_probabilities():
    from math import comb

    rng = np.random.default_rng(8)
    for good, bad, draws in ((5, 7, 6), (1, 30, 3), (40, 2, 20), (3, 3, 6), (0, 4, 2), (9, 0, 4)):
        got = np.bincount([mixing.hypergeometric(rng, good, bad, draws) for _ in range(4000)], minlength=draws + 1) / 4000
        want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(draws + 1)])
        assert abs(got - want).max() < 0.035 and (got[want == 0] == 0).all()
    # The same method far beyond a thousand million.
    many = np.array([mixing.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**9) for _ in range(60)])
    sd = (10**9 * 0.4 * 0.6 * 0.99) ** 0.5
    assert abs(many.mean() - 4 * 10**8) < 6 * sd / 60**0.5 and 0.6 < many.std() / sd < 1.5


def test_shards_follow_the_size():
    assert [mixing.shards_for(n) for n in (0, 10**9, 64 * mixing.SHARD_WORDS, 64 * mixing.SHARD_WORDS + 1, 10**12)] == [64, 64, 64, 128, 65536]


def test_equal_ids_sources_and_sizes_with_different_texts(spark, tmp_path):
    data = [(7, f"text number {i} " + "w " * (i // 40), "en", "s", None, f"x{i}") for i in range(80)] + [(None, "other words", "en", None, None, "y")] * 3
    docs = spark.createDataFrame(data, h.SCHEMA + ", copy string")
    runs = []
    for parts in (1, 5):
        out = mixing.stage(spark, docs.repartition(parts), "")
        assert out.columns == docs.columns
        runs.append(sorted(map(tuple, out.collect()), key=str))
    assert runs[0] == runs[1]
    _, _, draws = mixing.mix(docs, block_words=None)
    assert len(runs[0]) == draws.count()
    words = sum(len(h.WORD.findall(r[1])) for r in runs[0])
    assert abs(words - sum(len(h.WORD.findall(t[1])) for t in data)) <= 10


def test_stage_is_in_shards_and_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.stage(spark, docs, "")
    _, _, draws = mixing.mix(docs, block_words=None)
    want = [[r.doc_id for r in sorted((r for r in draws.collect() if r.shard == k), key=lambda r: r.position)] for k in range(64)]
    assert [[r.doc_id for r in part] for part in out.rdd.glom().collect()] == want
