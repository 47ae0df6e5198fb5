import random

from glossaweave.llm import line_dedup as d

from . import helpers as h


def plain_patience(a, b, lo=0, hi=0):
    """Pairs of places by the textbook recursion, its longest run by comparing all."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(lo, hi), *plain_patience(a[1:], b[1:], lo + 1, hi + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], lo, hi), (lo + len(a) - 1, hi + len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    best = []
    for k, (_, j) in enumerate(once):
        best.append(max(([*best[m], k] for m in range(k) if once[m][1] < j), key=len, default=[k]))
    anchors = [once[k] for k in max(best, key=len, default=[])]
    out, before = [], (-1, -1)
    for i, j in [*anchors, (len(a), len(b))] if anchors else []:
        out += plain_patience(a[before[0] + 1 : i], b[before[1] + 1 : j], lo + before[0] + 1, hi + before[1] + 1)
        if i < len(a):
            out.append((lo + i, hi + j))
        before = (i, j)
    return out


def brute(docs):
    """{doc: (lines, lines that go)}: every document aligned with every earlier one, whole texts."""
    rows, out = [], {}
    for doc, t in sorted(docs):
        lines = (t or "").split("\n")
        rows.append((doc, lines, [i for i, x in enumerate(lines) if x.encode().strip()]))
    for n, (doc, lines, full) in enumerate(rows):
        gone, mine = set(), [lines[i] for i in full]
        for _, other, theirs in rows[:n]:
            if not {x for x in mine} & {other[i] for i in theirs}:
                continue
            block = []
            for i, j in [*plain_patience(mine, [other[k] for k in theirs]), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if len(block) >= 3 or sum(len(mine[a].encode().strip()) for a, _ in block) >= 40 or len(block) == len(full):
                        gone.update(full[a] for a, _ in block)
                    block = []
                block.append((i, j))
        out[doc] = (lines, gone)
    return out


def compared(spark, folder, docs):
    """Lines that go in both, in the operator alone, in the brute-force version alone."""
    want = brute(docs)
    got = {r.doc_id: r for r in d.dedup(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert set(got) == set(want)
    both = ours = theirs = 0
    for doc, (lines, gone) in want.items():
        assert got[doc].n_lines == len(lines)
        rest, at, mine = got[doc].kept.split("\n"), 0, set()
        if got[doc].n_removed == len(lines):
            mine = set(range(len(lines)))
        else:
            assert len(rest) == len(lines) - got[doc].n_removed
            # Which of several equal lines went is told by what the brute-force version keeps.
            for i, x in enumerate(lines):
                if at < len(rest) and rest[at] == x and (i not in gone or len(lines) - i == len(rest) - at):
                    at += 1
                else:
                    mine.add(i)
        both, ours, theirs = both + len(mine & gone), ours + len(mine - gone), theirs + len(gone - mine)
    return both, ours, theirs


def test_query_against_all_pairs_aligned(spark):
    both, ours, theirs = compared(spark, "/root/testdata/sf0.001", h.sf_documents(spark))
    assert both > 100 and ours + theirs <= 0.05 * both, (both, ours, theirs)


def test_random_blocks_against_all_pairs_aligned(spark, tmp_path):
    """Few different lines, short and long, in blocks that are repeated, moved, cut and nested."""
    rng = random.Random(3)
    alphabet = ["a", "bb", "}", "a line of middling size", "a line that is long enough to count all by itself", "", "  ", "né", "twenty bytes of text"]
    made = [[rng.choice(alphabet) for _ in range(rng.randrange(1, 6))] for _ in range(12)]
    texts = [None, "", "\n\n", "  \n ", "a", "a", "a\n\nbb", "a\nbb", "bb\na"]
    for i in range(160):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(made) if rng.random() < 0.6 else [f"own line {rng.random()}"]
        texts.append("\n".join(lines))
    both, ours, theirs = compared(spark, h.table(spark, tmp_path, h.rows(texts)), list(enumerate(texts)))
    assert both > 200 and ours + theirs <= 0.2 * both, (both, ours, theirs)


def test_the_alignment_decides(spark, tmp_path, monkeypatch):
    """Blocks that cross: one is aligned, the other stays; and nothing goes where nothing is aligned."""
    one, two = ["alpha 1", "alpha 2", "alpha 3", "alpha 4"], ["beta 1", "beta 2", "beta 3"]
    shared = [(d.UNIT, [x.encode() for x in some], [7] * len(some), [here], [there]) for some, here, there in ((one[:3], 0, 3), (one[1:], 1, 4), (two, 4, 0))]
    assert d.common_places(shared) == {0, 1, 2, 3}
    folder = h.table(spark, tmp_path, h.rows(["\n".join(two + one), "\n".join(one + two)]))
    assert h.collected(d.query(spark, folder))[1]["n_removed"] == 4
    monkeypatch.setattr(d, "patience", lambda a, b: [])
    assert d.common_places(shared) == set()


def test_blocks_first_held_in_pieces(spark, tmp_path):
    """Six documents each hold one line of a block first; two later ones share it whole."""
    short = [f"part {k}" for k in range(6)]
    texts = [f"own {k} own\n{x}\nmore {k}" for k, x in enumerate(short)] + ["\n".join(["one", *short, "two"]), "\n".join(["three", *short, "four"])]
    texts += [f"filler {i}" for i in range(30)]
    got = h.collected(d.query(spark, h.table(spark, tmp_path, h.rows(texts))))
    assert got[6]["n_removed"] == 0 and got[7]["n_removed"] == 6


def test_copies_lose_all_their_lines_in_groups_of_any_size(spark, tmp_path):
    for n in (2, 10, 1000):
        for body in ("one short line", "x\n\ny", "a longer text\nof three lines\nin all"):
            texts = [body] * n + [f"other {i}" for i in range(3)]
            got = h.collected(d.query(spark, h.table(spark, tmp_path / f"{n}-{len(body)}", h.rows(texts))))
            full = sum(bool(x) for x in body.split("\n"))
            assert [got[i]["n_removed"] for i in range(n)] == [0] + [full] * (n - 1)
            assert all(got[n + i]["n_removed"] == 0 for i in range(3))


def test_patience():
    assert d.patience(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert d.patience(list("xaybz"), list("aqb")) == [(1, 0), (3, 2)]
    assert d.patience([], list("a")) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in "ab")
        got = d.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_edges(spark, tmp_path):
    assert d.query(spark, h.table(spark, tmp_path / "none", [])).collect() == []
    long = "\n".join(f"row {i}" for i in range(20_000))
    texts = [long, long + "\nend", *(f"filler {i}" for i in range(2000))]
    got = h.collected(d.query(spark, h.table(spark, tmp_path / "long", h.rows(texts))))
    assert got[1]["n_removed"] == 20_000 and got[0]["n_removed"] == 0
    assert got[2]["n_removed"] == 0
    data = [(None, "p\nq\nr", None, None, 1), (3, "p\nq\nr", None, None, 1), (3, "p\nq\nr", None, None, 1)] + [(i, f"z{i}", None, None, 1) for i in range(100, 400)]
    rows = d.query(spark, h.table(spark, tmp_path / "ids", data)).collect()
    assert {str(r.doc_id): r.n_removed for r in rows if r.n_lines == 3} == {"3": 0, "None": 3}


def test_most_copied_text_goes_whatever_the_size_of_the_table(spark, tmp_path):
    long, block = "one line of a license text that very many documents hold", "a b c\nd e f\ng h i"
    for n in (9, 900):
        texts = [f"own {i}\n{long}\nmid {i}\n{block}\nshort" if i % 3 == 0 else f"filler {i}" for i in range(n)]
        texts += [long, long]
        got = h.collected(d.query(spark, h.table(spark, tmp_path / str(n), h.rows(texts))))
        assert got[0]["n_removed"] == 0 and got[n]["n_removed"] == got[n + 1]["n_removed"] == 1
        # The holders of the block are a third of the rows.
        assert all(got[i]["n_removed"] == 5 for i in range(3, n, 3))
