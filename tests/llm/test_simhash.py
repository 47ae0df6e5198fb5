import numpy as np
import pytest
from xxhash import xxh64_intdigest

from glossaweave.llm import components, simhash

from . import helpers as h


def plain_fingerprint(text):
    words = [w.encode() for w in h.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hashes) * 2 > len(hashes))


def plain_components(fps, budget=3):
    """fps: {doc: fingerprint} -> {doc: smallest reachable}"""
    docs = sorted(fps)
    label = {d: d for d in docs}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: root(d) for d in docs}


def check(rows, docs):
    fps = {d: plain_fingerprint(t) for d, t in docs}
    want = plain_components(fps)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_query_against_brute_force(spark, tmp_path):
    docs = h.sf_documents(spark)
    check(simhash.query(spark, "/root/testdata/sf0.001").collect(), docs)
    base = docs[0][1].split()[:400]
    texts = [None, "", " \n", "one", "ONE", "a b", "a  B", "É é x", "word " * 100_000]
    texts += [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(60)]
    check(simhash.query(spark, h.table(spark, tmp_path, h.rows(texts))).collect(), list(enumerate(texts)))
    assert simhash.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []


def clusters(rng, n):
    centres = rng.integers(0, 2**64, n // 20, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False)) for _ in range(n)], dtype=np.uint64)
    return np.unique(centres[rng.integers(0, len(centres), n)] ^ flips)


@pytest.mark.parametrize("hot", [50_000, 20])
def test_links_of_many_fingerprints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "BUFFER", 300)
    fps = clusters(np.random.default_rng(5), 1500)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, hot=hot)).collect()}
    want = plain_components({int(i): int(x) for i, x in enumerate(fps)})
    groups = {}
    for i, x in enumerate(fps.view(np.int64)):
        groups.setdefault(want[i], set()).add(found.get(int(x), int(x)))
    assert all(len(v) == 1 for v in groups.values())
    assert len(groups) == len({next(iter(v)) for v in groups.values()})


def test_walk_finds_every_pair_once_at_least():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**10, 120, dtype=np.uint64) << np.uint64(54))
    got = {tuple(sorted(p)) for x, y in simhash.walk(keys, np.zeros(len(keys), int), 0) for p in zip(x.tolist(), y.tolist())}
    want = {(i, j) for j in range(len(keys)) for i in range(j) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 3}
    assert got == want


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components.components(df).collect()} == {0}


def test_repeated_and_missing_ids(spark, tmp_path):
    data = [(None, "x y z", None, None, None), (5, "x y z", None, None, 4), (5, "x y z", None, None, 4), (None, "other words here now", None, None, None)]
    got = simhash.query(spark, h.table(spark, tmp_path, data)).collect()
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "None"]


def _spread(pairs, n):
    f = simhash.Forest(n)
    f.join(*pairs)
    return f.label


def test_chains_linked_by_other_members_and_equal_keys():
    rng = np.random.default_rng(5)
    # Two chains that drift away from a middle, where two members are near; and members with the same first 64 bits that are near in pairs alone.
    rows = [rng.integers(0, 2, 512)]
    for _ in range(119):
        row = rows[-1].copy()
        row[rng.choice(512, 60, False)] ^= 1
        rows.append(row)
    for k in (0, 0, 1, 1) * 20:
        row = np.random.default_rng(90 + k).integers(0, 2, 512)
        row[:64] = rows[0][:64]
        row[64 + rng.choice(448, 10, False)] ^= 1
        rows.append(row)
    bits = np.packbits(np.array(rows, np.uint8), axis=1)
    n, words = len(rows), bits.view("<u8")
    x, y = np.triu_indices(n, 1)
    near = (simhash._distance(words, x, y) <= simhash.MOST_DIFFER) & (np.bitwise_count(words[x, 0] ^ words[y, 0]) <= simhash.WALK_BITS)
    want = _spread((x[near], y[near]), n)
    for dense in (10_000, 20):
        assert (_spread(simhash.near_pairs(np.zeros(n, np.int64), bits, dense=dense), n) == want).all()
    # Each pair by itself is found, whatever else is near.
    for i, j in list(zip(x[near].tolist(), y[near].tolist()))[:60]:
        assert len(simhash.near_pairs(np.zeros(2, np.int64), bits[[i, j]])[0]) == 1


def test_hot_tops_are_dealt_in_blocks_without_loss(spark):
    rng = np.random.default_rng(6)
    rows = np.repeat(rng.integers(0, 2, (3, 512)), 60, 0)
    for r in rows:
        r[rng.choice(512, 20, False)] ^= 1
    data = [(i, bytes(np.packbits(r.astype(np.uint8)))) for i, r in enumerate(rows)]
    sigs = spark.createDataFrame(data, "node long, sig binary")
    for hot in (1000, 7):
        got = simhash.near_copy_links(sigs, (2, 6), hot).distinct().collect()
        label = _spread((np.array([r.a for r in got]), np.array([r.b for r in got])), 180)
        assert [len(set(label[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(label)) == 3


def test_exact_similarity_decides_near_copies(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for n in [10, 14] * 8 + [120] * 30 + [300] * 20:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(2):
            # The last words change: similarities on both sides of 0.8, and chains over the base.
            k = max(1, int(n * rng.uniform(0.03, 0.16)))
            texts.append(" ".join(base[:-k] + [word() for _ in range(k)]))
    sets = [simhash.shingles_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _spread((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])), len(texts))
    kept = simhash.stage(spark, spark.createDataFrame(h.rows(texts), h.SCHEMA), "").collect()
    assert 50 < len(set(want)) < len(texts) - 20
    assert sorted(r.doc_id for r in kept) == sorted(set(want.tolist()))
