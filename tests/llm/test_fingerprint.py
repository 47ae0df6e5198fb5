import base64
import hashlib
import math
import re

import numpy as np
import pytest

from glossaweave.llm import fingerprint as fp

from . import helpers as h


def plain(text):
    """512 lanes: +1 or -1 by the bits of BLAKE2b of each paragraph and clause, in whole numbers."""
    total = [0] * 512
    for paragraph in text.split("\n"):
        for piece in ["\0" + paragraph, *(c.strip() for c in re.findall(r"[^.!?,;:|]+[.!?,;:|]*\s*", paragraph))]:
            bits = "".join(f"{byte:08b}" for byte in hashlib.blake2b(piece.encode(), digest_size=64).digest())
            total = [t + (1 if b == "1" else -1) for t, b in zip(total, bits)]
    return [t % 65536 for t in total]


def written(lanes):
    return base64.b64encode(b"".join(t.to_bytes(2, "little") for t in lanes)).decode()


def alike(a, b):
    if a == b:
        return 1.0
    x, y = ([t - 65536 if t > 32767 else t for t in v] for v in (a, b))
    norm = math.sqrt(sum(t * t for t in x) * sum(t * t for t in y))
    return max(0.0, min(1.0, sum(t * u for t, u in zip(x, y)) / norm)) if norm else 0.0


def brute(docs):
    docs = sorted(docs, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        own, changed, theirs = plain(text), plain(edited), plain(following)
        out[doc] = (n, hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), alike(own, changed), alike(own, theirs))
    return out


def check(got, docs):
    want = brute(docs)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:4]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][4:], abs=1e-12)


def test_query_against_brute_force(spark):
    got = fp.query(spark, "/root/testdata/sf0.001").collect()
    check(got, h.sf_documents(spark))
    assert np.mean([r.near_edited for r in got]) > 0.5 > 0.1 > np.mean([r.near_next for r in got])


def test_edges(spark, tmp_path):
    texts = ["", None, "a", "a\nb", "b\na", "é" * 9 + "\n" + "x. y, z", "word " * 50_000 + ".", "a", "a"]
    got = fp.query(spark, h.table(spark, tmp_path, h.rows(texts))).collect()
    check(got, list(enumerate(texts)))
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint and by[3].fingerprint == by[4].fingerprint != by[5].fingerprint
    one = fp.query(spark, h.table(spark, tmp_path / "one", h.rows(["abcdef"]))).collect()
    check(one, [(0, "abcdef")])
    assert fp.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []


def test_null_and_repeated_ids(spark, tmp_path):
    data = [(None, "x", None, None, None), (5, "five", None, None, 4), (5, "five", None, None, 4), (7, "seven", None, None, 5)]
    got = fp.query(spark, h.table(spark, tmp_path, data)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "7", "None"]


def test_homomorphic():
    a, b = ["one line", "two, lines."], ["three"]
    assert np.array_equal(fp.insert(fp.vector(a), b), fp.vector(b + a))
    assert np.array_equal(fp.delete(fp.vector(a + b), b), fp.vector(a))


def test_extra_columns_with_clashing_names(spark, tmp_path):
    data = [(i, f"t{i}", 1, 2, "x") for i in range(20)]
    folder = h.table(spark, tmp_path, data, "doc_id long, text string, part int, place int, fingerprint string")
    check(fp.query(spark, folder).collect(), [(i, f"t{i}") for i in range(20)])
