import numpy as np

import corpus_pipeline
from glossaweave.llm import exact_dedup, mixing, quality, simhash

from . import helpers as h
from .test_tokens import check_packing


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_go_and_others_stay(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, group = [], []
    for g in range(60):
        base = [word() for _ in range(int(rng.integers(200, 400)))]
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for i in rng.choice(len(own), len(own) // 200, False):
                own[i] = word()
            # Two such copies agree in 0.9 or more of their shingles.
            texts.append(" ".join(own))
            group.append(g)
    docs = spark.createDataFrame(h.rows(texts), h.SCHEMA)
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())


def first_of_groups(docs, least=0.8):
    """Smallest doc_id of each group of texts that are linked by a similarity of `least` or more: all pairs."""
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = {d: shingles(t) for d, t in docs}
    for d, x in sets.items():
        for e, y in sets.items():
            if d < e and min(len(x), len(y)) >= 0.7 * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {find(d) for d in root}


def test_near_dedup_on_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in simhash.stage(spark, df, "").collect()} == first_of_groups(h.sf_documents(spark))


def test_recall_and_precision_round_the_limit(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    texts, near, far = [], [], []
    for _ in range(400):
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        own, want = list(base), rng.uniform(0.66, 0.9)
        while (j := jaccard(" ".join(base), " ".join(own))) > want:
            own[int(rng.integers(len(own)))] = word()
        # j of this pair alone: texts of different pairs share nothing
        (near if j >= 0.8 else far).append(len(texts) + 1)
        texts += [" ".join(base), " ".join(own)]
    kept = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(h.rows(texts), h.SCHEMA), "").collect()}
    assert min(len(near), len(far)) > 100
    assert set(far) <= kept and set(range(0, len(texts), 2)) <= kept
    assert sum(d not in kept for d in near) >= 0.97 * len(near)


def test_a_component_that_falls_apart_is_compared_whole(spark, monkeypatch):
    """A template whose fillings drift: chains of near copies with far ends, in several small blocks."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    own, texts = [word() for _ in range(120)], []
    for i in range(160):
        own = list(own)
        for k in rng.choice(120, 1 if i % 20 else 9, False):
            own[k] = word()
        texts.append(" ".join(own))
    docs = spark.createDataFrame(h.rows(texts), h.SCHEMA)
    want = first_of_groups(list(enumerate(texts)))
    assert 1 < len(want) < 20
    for least in (500, 10):
        monkeypatch.setattr(simhash, "BLOCK_LEAST", least)
        assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == want


def test_links_of_unit_join_what_can_be_joined():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(80)]
    sigs = np.zeros((80, 64), np.uint8)
    tree = np.arange(80)
    for side in (np.zeros(80, int), np.arange(80) % 2):
        forest, want = simhash.Forest(80), simhash.Forest(80)
        for i, j in simhash.links_of_unit(tree, side, sigs, sets):
            assert simhash.near(sets[i], sets[j])
            forest.join(np.array([i]), np.array([j]))
        for i in range(80):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if (not side.any() or side[i] != side[j]) and len(x & y) >= 0.8 * len(x | y):
                    want.join(np.array([i]), np.array([j]))
        assert (forest.label == want.label).all()


def test_crowded_groups_are_joined_whole():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2, 512)
    rows = np.repeat(centre[None], 400, 0)
    for r in rows[1:]:
        r[rng.choice(512, 15, False)] ^= 1
    rows = np.concatenate([rows, rng.integers(0, 2, (50, 512))]).astype(np.uint8)
    bits = np.packbits(rows, axis=1)
    for dense in (10_000, 50):
        x, y = simhash.near_pairs(np.zeros(450, np.int64), bits, dense=dense)
        f = simhash.Forest(450)
        f.join(x, y)
        assert len(set(f.label[:400])) == 1 and len(set(f.label)) == 51


def test_stages_in_turn(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near-dedup", "mixing", "packing"]
    scores = {r.doc_id: r.predicted for r in quality.query(spark, folder).collect()}
    kept = quality.stage(spark, docs, folder)
    assert {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if p} and kept.columns == docs.columns
    single = exact_dedup.stage(spark, docs, folder)
    want = {r.doc_id for r in exact_dedup.query(spark, folder).collect() if r.kept}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want) and single.columns == docs.columns
    rows, _, draws = mixing.mix(docs, block_words=None)
    taken = {r.doc_id: r["count"] for r in draws.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in mixing.stage(spark, docs, folder).groupBy("doc_id").count().collect()} == taken


def test_pipeline_runs_from_end_to_end(spark):
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert {r.doc_id for r in got} == set(ids)
    text = {r.doc_id: r.text for r in docs.collect()}
    total = {r.doc_id: r.doc_tokens for r in got}
    for d in set(ids):
        assert sum(r.length for r in got if r.doc_id == d) == total[d] * ids.count(d)
    assert len(text) == len(set(ids))


def test_edges(spark, tmp_path):
    texts = [None, "", " ", "one", "one", "One", "a b c d e f"] + ["x " * 100_000]
    data = h.rows(texts) + [(None, "null id", None, None, None)] * 2
    folder = h.table(spark, tmp_path, data)
    h.table(spark, tmp_path, [(0, 1, 0)], "doc_id long, quality int, toxic int", "labels")
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= {None, *range(8)}
    none = h.table(spark, tmp_path / "none", [])
    h.table(spark, tmp_path / "none", [], "doc_id long, quality int, toxic int", "labels")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    names = ["digest", "keep_id", "copy", "kept", "n_chars", "fp", "sig", "root", "size", "block", "range", "pass", "shard", "part", "key", "score", "_text", "_row"]
    data = [(i, f"some words of text number {i}", *[f"{n}{i}" for n in names], f"s{i % 2}") for i in range(12)]
    data += [data[3]]
    docs = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", source string")
    h.table(spark, tmp_path, [(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int", "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(data), name
