import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaweave.llm import packing, token_store, tokens
from glossaweave.llm.tokens import Encoder, encoder

from . import helpers as h

TEXTS = [None, "", " ", "a  b", "a \n b", "x\n  y", "The the THE cat's don't", "é́ ñ z", "100 000 0", "a,b. c,", "<|endoftext|> x", "　 wide", "Ä ß ſ K", "word " * 30_000, "dup dup", "dup dup"]


def plain(name, text, end):
    e = encoder(name)
    return [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_whole_encoding(name):
    parts = [" ", "  ", "\n", "\t", "the", "The", "dog,", "0", "10", "'s", "é", "́", "!!", "|", " ", "\x1c", "<|endoftext|>", "日本"]
    fresh = Encoder(name)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(parts), max_size=12).map("".join), max_size=4))
    def run(texts):
        for text, ids in zip(texts, fresh.encode(texts)):
            assert ids.tolist() == fresh.tokenizer.encode(text, add_special_tokens=False).ids

    run()
    # A stem learned behind a line break is no piece of its own.
    for texts in (["x\nThe"], [" \nThe"], ["\nThe \nThe"]):
        assert [i.tolist() for i in fresh.encode(texts)] == [fresh.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counted:
    """A tokenizer that keeps what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_keeps_what_is_met_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 8000)
    e = Encoder(name)
    plain, e.tokenizer = e.tokenizer, Counted(e.tokenizer)
    letters = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
    for batch in range(40):
        rare = [f"{letters[batch]}{letters[i]}rare" for i in range(60)]
        text = "start " + " ".join(f"{r} often{'' if i % 3 else ','}" for i, r in enumerate(rare)) + "\noften."
        assert e.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    given = " ".join(e.tokenizer.given)
    assert given.count("rare") == 40 * 60 and given.count("often") <= 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    ef = token_store.EliasFano.of(values)
    assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000))
    ef = token_store.EliasFano.of(values)
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.samples)) < 20_000 * (2.6 + np.log2(values[-1] / 20_000))


def check_store(spark, folder, docs):
    got = token_store.query(spark, folder).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    start = 0
    for doc, text in sorted(docs):
        ids = plain("byte_bpe_50k.json", text, 0)
        r = by[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_query(spark, tmp_path):
    check_store(spark, "/root/testdata/sf0.001", h.sf_documents(spark))
    check_store(spark, h.table(spark, tmp_path, h.rows(TEXTS)), list(enumerate(TEXTS)))
    assert token_store.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []


def test_store_repeated_and_missing_ids(spark, tmp_path):
    data = [(None, "x y", None, None, None), (3, "z", None, None, 4), (3, "z", None, None, 4)]
    got = token_store.query(spark, h.table(spark, tmp_path, data)).collect()
    assert sorted((r.start, r.doc_id) for r in got) == [(0, None), (3, 3), (5, 3)]


def check_packing(rows, docs):
    rows = [r for r in rows]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {d for d, _ in docs}
    for doc, text in docs:
        ids = np.array(plain("word_bpe_49k.json", text, 1), "<u4")
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048 and all(r.sequence_tokens == at for r in pieces)
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    return len(rows), len(sequences)


def test_packing_query(spark, tmp_path):
    check_packing(packing.query(spark, "/root/testdata/sf0.001").collect(), h.sf_documents(spark))
    check_packing(packing.query(spark, h.table(spark, tmp_path, h.rows(TEXTS))).collect(), list(enumerate(TEXTS)))
    assert packing.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []


def test_sum_of_squares_choice():
    p, rng = packing.Packer(20, 10**6), np.random.default_rng(3)
    for size in rng.integers(1, 20, 400):
        n = np.append(p.counts(), 0)

        def total(h):
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 20
            return (m[1:20] ** 2).sum()

        best = min(total(h) for h in range(0, 21 - size) if h == 0 or n[h])
        assert total(p.level_for(size)) == best
        list(p.add(("d", 0), np.zeros(size, "<u2")))


def test_sizes_that_never_fit_stay_bounded():
    p, out = packing.Packer(100, 16), 0
    for i in range(500):
        for w in p.add((i, 60), np.zeros(60, "<u2")):
            assert sum(len(x[2]) for x in w) == 100
            out += 100
        assert p.open <= 16
    out += sum(len(x[2]) for w in p.close() for x in w)
    assert out == 30_000


def test_at_the_bound_remainders_are_still_placed_by_sum_of_squares():
    """Uniform remainders and few open windows: every cut remainder fills a window, none is dropped, and no window is run together."""
    p, rng, sizes = packing.Packer(64, 12), np.random.default_rng(5), {}
    pieces = {}
    for i in range(5000):
        sizes[i] = int(rng.integers(1, 200))
        for w in p.add((i, sizes[i]), np.full(sizes[i], i % 60_000, "<u2")):
            assert sum(len(x[2]) for x in w) == 64
            for (doc, _), start, ids in w:
                pieces.setdefault(doc, []).append((start, len(ids)))
        assert p.open <= 12
    for w in p.close():
        n = sum(len(x[2]) for x in w)
        assert n == 64 or n & (n - 1) == 0
        for (doc, _), start, ids in w:
            pieces.setdefault(doc, []).append((start, len(ids)))
    for doc, found in pieces.items():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == sizes[doc]
    assert len(pieces) == 5000


def test_an_id_that_fills_several_ranges_is_dealt_by_its_hash(spark, tmp_path):
    data = [(None if i % 3 == 0 else i, f"text {i}", None, None, None) for i in range(3000)]
    got = token_store.query(spark, h.table(spark, tmp_path, data)).collect()
    assert sum(r.doc_id is None for r in got) == 1000
    placed = sorted(got, key=lambda r: r.start)
    at = 0
    for r in placed:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in placed]
    assert ids == sorted(ids)
    texts = {zlib.crc32(np.array(plain("byte_bpe_50k.json", t, 0), "<u4").tobytes()) for _, t, *_ in data}
    assert {r.ids_crc32 for r in got} == texts


def test_blocks_keep_ids_small():
    docs = list(range(10**12, 10**12 + 3 * 5000, 3))
    raw = token_store.pack_block(docs, [np.zeros(7, "<u2")] * 5000)
    first, ids, ends, flat = token_store.open_block(raw)
    assert [first + ids.select(i) for i in range(5000)] == docs and [ends.select(i) for i in (0, 4999)] == [7, 35_000]
    assert len(raw) - flat.nbytes < 5000 * 2
    first, ids, _, _ = token_store.open_block(token_store.pack_block([-(2**63), -(2**63), 5, 2**62], [np.zeros(1, "<u2")] * 4))
    assert [first + ids.select(i) for i in range(4)] == [-(2**63), -(2**63), 5, 2**62]
