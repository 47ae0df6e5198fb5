"""Every query on a table with extra columns of names used inside, null and repeated doc_ids, ties, empty and blank texts."""

import pytest

from glossaweave.llm import registry

from . import helpers as h

NAMES = ["key", "tie", "fp", "digest", "copy", "size", "block", "words", "part", "place", "gone", "text_hash", "h1", "h2", "score", "body", "kept", "rows", "first", "node", "sig", "root", "good", "label_id", "target", "taken", "owner", "chunk", "shard", "spans", "n_lines", "range", "trie", "top", "unit"]
TEXTS = [None, "", " \n ", "one two three four five", "one two three four five", "One two three four five", "a\nb\nc\nd " * 20, "token = 'abcdefgh1234'", "x"]


def rows():
    out = [(i % 7 if i % 5 else None, t, "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(TEXTS * 3)]
    return out + [(3, "same", "en", "s1", 4)] * 3 + [(None, "same", "en", None, 4)] * 2


@pytest.mark.parametrize("name", registry.QUERIES)
def test_extra_columns_change_nothing(spark, tmp_path, name):
    found = []
    for folder, extra in (("plain", []), ("extra", NAMES)):
        data = [r + tuple(f"{n}{i}" for n in extra) for i, r in enumerate(rows())]
        h.table(spark, tmp_path / folder, data, h.SCHEMA + "".join(f", `{n}` string" for n in extra), parts=1)
        h.table(spark, tmp_path / folder, [(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int", "labels")
        talk = [(k, i % 4 or None, "user" if i % 2 else None, t, *(f"{n}{i}" for n in extra if n not in ("text",))) for i, (k, t, *_) in enumerate(rows())]
        h.table(spark, tmp_path / folder, talk, "conv_id long, turn long, role string, text string" + "".join(f", `{n}` string" for n in extra), "conversations")
        found.append(registry.QUERIES[name](spark, str(tmp_path / folder)))
    assert found[0].columns == found[1].columns
    plain, extra = ([r.asDict() for r in df.collect()] for df in found)
    if name == "op7_packing":  # which rows share a sequence follows the order in which they are read
        per = lambda got: sorted({(str(r["doc_id"]), r["doc_tokens"]) for r in got})
        assert per(plain) == per(extra) and sum(r["length"] for r in plain) == sum(r["length"] for r in extra)
    else:
        assert sorted(map(str, plain)) == sorted(map(str, extra))
        if name not in ("op11_conversation_repair", "op13_spelling"):  # a row a conversation, a row a word
            assert len(plain) == len(rows())
