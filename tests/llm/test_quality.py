import zlib

import numpy as np

from glossaweave.llm import quality as q

from . import helpers as h

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    got = h.collected(q.query(spark, "/root/testdata/sf0.1"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [d for d in labels if got[d]["held_out"]]
    bad = [d for d in held if labels[d] == 0]
    assert np.mean([got[d]["predicted"] == labels[d] for d in held]) > 0.97
    assert np.mean([got[d]["predicted"] == 0 for d in bad]) > 0.9


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(200)]
    good = np.array([int(x.sum() + rng.normal(0, 30) > 110) for x in rows])
    r = rng.normal(size=q.BUCKETS)
    w, b = q.coordinate_descent(rows, good, r, passes=300)
    x = np.zeros((200, 41))
    for i, own in enumerate(rows):
        x[i, own] = r[own]
    x[:, 40] = 1
    y = np.where(good == 1, 1.0, -1.0)
    cost = np.where(y > 0, 200 / (2 * (y > 0).sum()), 200 / (2 * (y < 0).sum())) ** 0.5
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    v = np.append(w[:40], b)
    best = loss(v)
    for _ in range(300):
        assert loss(v + rng.normal(size=41) * 10 ** rng.uniform(-4, -1)) > best * (1 - 1e-4)


def test_edges(spark, tmp_path):
    texts = [None, "", " ", "word " * 100_000, "a b", "a b"] + [f"good words here {i}" for i in range(40)] + [f"BAD!! ###{i} $$$" for i in range(40)]
    folder = h.table(spark, tmp_path, h.rows(texts))
    labels = [(i, int(i < 46), None) for i in range(6, 86)] + [(0, None, 1), (None, 1, 1), (999, 1, 0), (50, 0, 1)]
    h.table(spark, tmp_path, labels, LABELS, "labels")
    got = h.collected(q.query(spark, folder))
    assert len(got) == 86 and got[0]["score"] == got[1]["score"] and got[4]["score"] == got[5]["score"]
    assert all(got[i]["predicted"] == 1 for i in range(6, 46)) and all(got[i]["score"] < 0.3 for i in range(46, 86))
    h.table(spark, tmp_path, [], LABELS, "labels")
    assert {r["score"] for r in h.collected(q.query(spark, folder)).values()} == {0.5}
    h.table(spark, tmp_path, [(i, 1, 0) for i in range(6, 46)], LABELS, "labels")
    assert len({r["score"] for r in h.collected(q.query(spark, folder)).values()}) == 1
    none = h.table(spark, tmp_path / "none", [])
    h.table(spark, tmp_path / "none", labels, LABELS, "labels")
    assert q.query(spark, none).collect() == []


def test_labels_of_the_held_out_fold_are_not_used(spark, tmp_path):
    texts = [f"good words here {i}" if i % 2 else f"BAD!! ###{i} $$$" for i in range(200)]
    scores = []
    for turned in (0, 1):
        folder = h.table(spark, tmp_path / str(turned), h.rows(texts))
        held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
        h.table(spark, tmp_path / str(turned), [(i, (i % 2) ^ (turned and held(i)), 0) for i in range(200)], LABELS, "labels")
        scores.append({d: r["score"] for d, r in h.collected(q.query(spark, folder)).items()})
    assert scores[0] == scores[1]


def test_scores_against_plain_arithmetic(spark, tmp_path):
    """All steps again, dense and without hashing: indicators, log-count ratios, the dual by plain coordinate steps, the curve."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}x" for i in range(30)]
    texts = []
    for i in range(120):
        low, high = ((0, 20), (10, 30))[i % 2]
        words = [vocabulary[int(k)] for k in rng.integers(low, high, 9)]
        texts.append(" ".join(words) + (" END" if rng.random() < 0.3 else " 4.5"))
    folder = h.table(spark, tmp_path, h.rows(texts))
    h.table(spark, tmp_path, [(i, i % 2, 0) for i in range(120)], LABELS, "labels")
    got = h.collected(q.query(spark, folder))

    def grams(text):
        words = text.lower().split()
        shapes = ["".join(c for k, c in enumerate(s) if k == 0 or s[k - 1] != c or c not in "aA0") for s in ("".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in w) for w in text.split())]
        out = {("word", w) for w in words} | {("pair", *p) for p in zip(words, words[1:])} | {("shape", s) for s in shapes} | {("shapes", *p) for p in zip(shapes, shapes[1:])}
        run = most = 0
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 0
            most = max(most, run)
        return out | {("again", n) for n in (1, 2, 4, 8, 16) if n <= most}

    sets = [grams(t) for t in texts]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((120, len(names)))
    for i, s in enumerate(sets):
        x[i, [names[g] for g in s]] = 1
    learned = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    x0, y0 = x[learned], np.array([i % 2 for i in learned])

    def weights(x, y):
        p, n = 1 + x[y == 1].sum(0), 1 + x[y == 0].sum(0)
        spare = q.BUCKETS - x.shape[1]
        r = np.log(p / (p.sum() + spare)) - np.log(n / (n.sum() + spare))
        z, s = np.hstack([x * r, np.ones((len(y), 1))]), np.where(y == 1, 1.0, -1.0)
        most = np.array([(len(y) / (2 * (y == v).sum())) ** 0.5 for v in y])
        alpha, w = np.zeros(len(y)), np.zeros(z.shape[1])
        for _ in range(400):
            for i in range(len(y)):
                new = min(max(alpha[i] - (s[i] * z[i] @ w - 1) / (z[i] @ z[i]), 0), most[i])
                w += (new - alpha[i]) * s[i] * z[i]
                alpha[i] = new
        used = x.any(0)
        mean = abs(w[:-1][used]).mean()
        return np.where(used, (0.75 * w[:-1] + 0.25 * mean) * r, 0), w[-1]

    part = np.random.default_rng(q.SEED).permutation(len(y0)) % 5
    margins = np.zeros(len(y0))
    for k in range(5):
        w, b = weights(x0[part != k], y0[part != k])
        margins[part == k] = x0[part == k] @ w + b
    w, b = weights(x0, y0)
    target = np.where(y0 == 1, ((y0 == 1).sum() + 1) / ((y0 == 1).sum() + 2), 1 / ((y0 == 0).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(20_000):
        e = target - 1 / (1 + np.exp(-(slope * margins + shift)))
        slope, shift = slope + 0.02 * (e * margins).mean(), shift + 0.02 * e.mean()
    want = 1 / (1 + np.exp(-(slope * (x @ w + b) + shift)))
    assert max(abs(got[i]["score"] - want[i]) for i in range(120)) < 0.05


def test_columns_of_any_name_and_repeated_ids(spark, tmp_path):
    names = ["score", "body", "Body_", "a`b", "__gw_text"]
    data = [(i % 40, f"good words {i}" if i % 2 else f"BAD ###{i}", *[f"{n}{i}" for n in names]) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    h.table(spark, tmp_path, [(i, i % 2, 0) for i in range(40)], LABELS, "labels")
    out = q.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(r for r in data if r[0] % 2)
