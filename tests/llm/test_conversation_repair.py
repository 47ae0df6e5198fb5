"""Composed machines against a search over suffixes, for whole conversations and for those cut into segments."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaweave.llm import conversation_repair as cr

from . import helpers as h

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """One conversation's rows (turn, role, text) in order, by trying every edit from every place on."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, written, run):
        """(cost, labels, repaired rows) from row i on; written: 's', 'u', 'a' last, or ''."""
        found = [(0, "", ())] if i == len(rows) and written in ("", "a") else []
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[written]
        for x, name in (("u", "user"), ("a", "assistant")):
            if x in following and run < 4 and (rest := best(i, x, run + 1)):
                found.append((rest[0] + 5, "I" + rest[1], (f"{name}:", *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, written, 0):
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for label, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name and name[0] in following and (rest := best(i + 1, name[0], 0)):
                        found.append((rest[0] + price + more, label + rest[1], (f"{name}:{text}", *rest[2])))
        return min(found, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for written in ("", "s", "u", "a"):
            best(i, written, 0)
    cost, audit, out = best(0, "", 0)
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    assert LEGAL.fullmatch("".join(line[0] for line in out))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def brute(data):
    groups = {}
    for conv, turn, role, text in data:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups.setdefault(conv, [])
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = {"conv_id": conv} | plain(rows)
    return out


ROW = st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b", "", "c!", "d?"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=9))
def test_one_conversation(rows):
    assert cr.repair(rows) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=12), st.lists(st.integers(1, 12), max_size=3), st.booleans())
def test_segments_join_to_the_whole(rows, cuts, leading):
    """The steps on segments, without Spark, against the whole."""
    cuts = [0, *sorted({c for c in cuts if c < len(rows)}), len(rows)]
    seen, records = set(), []
    for segment, (a, b) in enumerate(zip(cuts, cuts[1:])):
        records += [{"c": "7", "conv_id": 7, "part": 0, "segment": segment, "place": 0, "turn": None, "role": " ", "text": "", "gone": True, "seen": False}] * leading
        for turn, role, text in rows[a:b]:
            records.append({"c": "7", "conv_id": 7, "part": 0, "segment": segment, "place": 1, "turn": turn, "role": role, "text": text, "gone": False, "seen": (role, text) in seen})
            seen.add((role, text))
    empty = {n.split()[0]: None for n in cr.SEGMENTS.split(", ")}
    segments = [empty | s for s in cr._segments(iter(records))]
    ways = list(cr._ways(iter(segments)))
    found = next(w for w in ways if w["whole"])
    by = {w["segment"]: w for w in ways}
    audit = "".join(s["labels"][by[s["segment"]]["start"] * 4 + by[s["segment"]]["stop"]] + by[s["segment"]]["tail"] for s in segments)
    texts = list(cr._texts(r | by[r["segment"]] for r in records))
    digest = list(cr._digests(iter(texts)))
    got = {n: found[n] for n in cr.COUNTS} | {"audit": audit, "repaired_sha256": digest[0]["repaired_sha256"] if digest else cr.digest([])}
    in_order = cr.repair(rows)
    turns = [t for t, _, _ in rows]
    if turns != sorted(turns, key=lambda t: (t is not None, t or 0)):
        got.pop("gaps"), in_order.pop("gaps")  # neighbours share turns only where rows are in order
    assert got == in_order


def conversations(spark, folder, data, parts=3):
    return h.table(spark, folder, data, SCHEMA, "conversations", parts)


def test_whole_small_table(spark):
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert h.collected(cr.query(spark, "/root/testdata/sf0.001"), "conv_id") == brute(data)


def awkward():
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "student", "User"], ["Yes.", "No", "", " \n", None, "Why?", "Why?", "x" * 40 + ".", "ends here.\t ", "a " * 5000 + "!"]
    data = [(i % 40, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for i in range(700)]
    data += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t // 3}.") for t in range(600)]
    data += [(None, t, "user", "null id.") for t in range(9)] + [(50, None, "user", "same.")] * 300
    return data + data[:50]


@pytest.mark.parametrize("segment,size", [(cr.SEGMENT, cr.BYTES), (7, 10**6), (1, 10**6), (50, 2000)])
def test_awkward_rows(spark, tmp_path, segment, size):
    data = awkward()
    folder = conversations(spark, tmp_path, data)
    rows = cr.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    assert h.collected(cr.repaired(rows, segment, size), "conv_id") == brute(data)


def test_segments_stay_whole_where_a_join_turns_to_a_broadcast(spark, tmp_path):
    """Rows that were shuffled by segment for the join are then read by map task, and those of one segment come from several."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16384", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    data = awkward()
    folder = conversations(spark, tmp_path, data)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = cr.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
        assert h.collected(cr.repaired(rows, 50, 2000), "conv_id") == brute(data)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_conversation_of_dropped_rows_stays(spark, tmp_path):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = cr.query(spark, conversations(spark, tmp_path, [(conv, 0, "user", "Gone.")])).collect()
    assert [r.asDict() for r in got] == [{"conv_id": conv} | cr.NOTHING]


def test_no_rows_and_extra_columns(spark, tmp_path):
    assert cr.query(spark, conversations(spark, tmp_path / "a", [])).collect() == []
    names = ["c", "head", "hash", "salt", "gone", "part", "segment", "place", "seen", "copy", "h", "labels", "cost", "audit"]
    data = awkward()[:300]
    folder = h.table(spark, tmp_path / "b", [r + tuple(names) for r in data], SCHEMA + "".join(f", {n} string" for n in names), "conversations")
    assert h.collected(cr.query(spark, folder), "conv_id") == brute(data)
