"""Repair of conversations by composition of weighted finite-state machines.

Three machines are composed lazily, arc by arc: the input acceptor (a chain with one arc a row, its symbol the row's role
initial and fault), the edit transducer (Keep, Rerole, Delete, Insert) and the acceptor of the role grammar
(s?(ua)+)?. Weights are (cost, labels); the smaller cost is better, then the labels that are less in ASCII order.

The edit transducer counts the inserts since the last row, at most two: a longer run would come back to a grammar state
that it left, for a positive cost. So the composition has no cycle and a state's position and count are its place in a
topological order; one pass over the rows gives the shortest path. Paths are compared only where both have just read the
same row, or at the end. Labels that end by reading the same row are equal or differ before either ends, so the better
prefix stays better whatever follows: prefixes may be cut and joined anywhere.

That also splits a conversation. Rows are dealt by ranges of (conversation, turn, role, text), so a conversation that
holds a third of all rows lies in many tasks. A task repairs those that begin and end inside it. The rows of the others
(two a task, and those over SEGMENT rows or BYTES of text) are put out in segments; repeats among them are found by a
smallest place for each text, a segment becomes a matrix of weights from grammar state to grammar state with an order
among the labels, matrices are combined in order, and each segment's rows are read once more with the states where it
begins and ends. Only the last SHA-256 reads a long conversation's repaired text in one task, a segment at a time: a
digest has no other way.

Defined results: a null role or text is one space, as are a null conv_id and turn in the damage rule; null conv_ids are
one conversation. Rows of one turn go by role, then by the first 64 characters of the text, then by a hash of it. A role
other than s, u, a by its initial is kept nowhere. Repeated rows are duplicates after the first. An empty table gives an
empty result. Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = {"su", "ua", "au"}
#: By state of the role grammar (0 nothing, 1 system, 2 user, 3 assistant last): the state after an initial; where it may end.
GRAMMAR, FINAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Inserts in a row.
MOST = 2
#: Rows and bytes of text of one segment.
SEGMENT, BYTES = 2000, 16_000_000

#: (cost, labels)
Weight = tuple[int, str]
#: (role initial, fault: b, d, t or nothing)
Symbol = tuple[str, str]


def edits(symbol: Symbol) -> Iterator[tuple[str, int, str]]:
    """Arcs of the edit transducer that read the symbol: (label, cost, initial written or nothing)."""
    initial, fault = symbol
    yield "D", DELETE, ""
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        yield "K", extra, initial or "?"
        for role in ROLES:
            yield "R", REROLE + extra, role


@cache
def arcs(state: int, symbol: Symbol) -> tuple[tuple[str, int, int], ...]:
    """Arcs of edits and grammar composed, from a grammar state: (label, cost, next state)."""
    return tuple((label, cost, GRAMMAR[state][out] if out else state) for label, cost, out in edits(symbol) if not out or out in GRAMMAR[state])


def inserts(layer: dict[int, Weight]) -> list[dict[int, Weight]]:
    """The layers of composed states after 0, 1, ... inserts."""
    layers = [layer]
    for _ in range(MOST):
        after: dict[int, Weight] = {}
        for state, (cost, labels) in layers[-1].items():
            for out in GRAMMAR[state]:
                if out in ROLES:
                    _relax(after, GRAMMAR[state][out], (cost + INSERT, labels + "I"))
        layers.append(after)
    return layers


def _relax(layer: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in layer or weight < layer[state]:
        layer[state] = weight


def paths(start: int, symbols: Iterable[Symbol]) -> dict[int, Weight]:
    """By grammar state after the last symbol is read: the best weight from `start`."""
    layer = {start: (0, "")}
    for symbol in symbols:
        after: dict[int, Weight] = {}
        for states in inserts(layer):
            for state, (cost, labels) in states.items():
                for label, more, to in arcs(state, symbol):
                    _relax(after, to, (cost + more, labels + label))
        layer = after
    return layer


def ended(layer: dict[int, Weight]) -> Weight:
    """The best weight of a whole conversation from those after its last row."""
    return min(w for states in inserts(layer) for state, w in states.items() if state in FINAL)


def lines(labels: str, rows: Iterable[tuple[str, str]], state: int = 0) -> list[str]:
    """The repaired rows, role:text, of (role, text) under the labels. What a Rerole or an Insert writes follows from the state."""
    rows, out = iter(rows), []
    for label in labels:
        role, text = ("", "") if label == "I" else next(rows)
        if label == "D":
            continue
        if label != "K":
            role = next(ROLES[x] for x in GRAMMAR[state] if x in ROLES)
        state = GRAMMAR[state][role[:1]]
        out.append(f"{role}:{text}")
    return out


def fault(text: str, seen: bool) -> str:
    body = text.rstrip(SPACE)
    return "b" if not body else "d" if seen else "" if body[-1] in ENDS else "t"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def tally(turns: list[int | None], symbols: list[Symbol]) -> dict:
    """What is counted over rows in order, and what joins it to its neighbours."""
    known = [t for t in turns if t is not None]
    found = {name: sum(s[1] == letter for s in symbols) for letter, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))}
    initials = [s[0] for s in symbols]
    found["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    found |= {"lo": min(known, default=None), "hi": max(known, default=None), "turns": len(set(known))}
    return found | {"first": initials[0], "last": initials[-1], "begin": turns[0], "end": turns[-1]}


def totals(found: list[dict]) -> dict:
    """tally() of neighbours in order, added up."""
    out = {name: sum(x[name] for x in found) for name in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(found, found[1:]))
    distinct = sum(x["turns"] for x in found) - sum(a["end"] is not None and a["end"] == b["begin"] for a, b in zip(found, found[1:]))
    known = [x for x in found if x["lo"] is not None]
    out["gaps"] = max(x["hi"] for x in known) - min(x["lo"] for x in known) + 1 - distinct if known else 0
    return out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
NOTHING = dict.fromkeys(COUNTS, 0) | {"audit": "", "repaired_sha256": digest([])}


def repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """The result of one whole conversation from its rows (turn, role, text) in order."""
    if not rows:
        return NOTHING
    seen, symbols = set(), []
    for _, role, text in rows:
        symbols.append((role[:1], fault(text, (role, text) in seen)))
        seen.add((role, text))
    cost, audit = ended(paths(0, symbols))
    return totals([tally([r[0] for r in rows], symbols)]) | {"cost": cost, "audit": audit, "repaired_sha256": digest(lines(audit, (r[1:] for r in rows)))}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage rule; a dropped row stays, marked, so that its conversation does."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("h"),
    )
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Dealt and sorted by conversation and turn, a long conversation over many tasks; equal rows are dealt by a number too."""
    keyed = rows.withColumns({"c": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    keys = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("hash"), F.col("salt")]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "conv_id", "turn", "role", "text", "gone")


RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
FIRST = f"c string, conv_id long, done boolean, {RESULT}, part int, segment int, place int, turn long, role string, text string, gone boolean"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield from batch.slice(start, 1000).to_pylist()


def _grouped_out(rows: Iterator[dict], schema: pa.Schema, most: int = 500, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of few rows and bounded text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row.get("text") or "")
        if len(held) >= most or weight >= size:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _first_pass(segment: int, size: int):
    schema = _arrow(FIRST)

    def results(records: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        finished, inner = None, False  # the last conversation, held back until another follows; whether one came before it

        def rest(rows, number):
            for place, r in enumerate(rows):
                yield r | {"done": False, "part": part, "segment": number, "place": place}

        for c, rows in groupby(records, key=lambda r: r["c"]):
            if finished is not None:
                yield from done(*finished) if inner else rest(finished[1], 0)
                inner = True
            held, weight, number = [], 0, 0
            for r in rows:
                held.append(r)
                weight += len(r["text"])
                if len(held) >= segment or weight >= size:
                    yield from rest(held, number)
                    held, weight, number = [], 0, number + 1
            if number:
                yield from rest(held, number)
                finished, inner = None, True
            else:
                finished = (c, held)
        if finished is not None:
            yield from rest(finished[1], 0)

    def done(c, rows):
        yield {"c": c, "conv_id": rows[0]["conv_id"], "done": True} | repair([(r["turn"], r["role"], r["text"]) for r in rows if not r["gone"]])

    return lambda batches: _grouped_out(results(_records(batches)), schema)


SEGMENTS = (
    "c string, conv_id long, part int, segment int, blank long, duplicate long, truncated long, illegal long, lo long, hi long, turns long, first string, last string, "
    "begin long, end long, costs array<long>, orders array<long>, labels array<string>"
)


def _segments(records: Iterator[dict]) -> Iterator[dict]:
    """One row a segment: its counts, and by (from state, to state) the cost (null: no path), the order among those from the same state, labels."""
    for _, rows in groupby(records, key=lambda r: (r["c"], r["part"], r["segment"])):
        rows = list(rows)
        out = {k: rows[0][k] for k in ("c", "conv_id", "part", "segment")}
        rows = [r for r in rows if not r["gone"]]
        if rows:
            symbols = [(r["role"][:1], fault(r["text"], r["seen"])) for r in rows]
            found = [paths(state, symbols) for state in range(len(GRAMMAR))]
            out |= tally([r["turn"] for r in rows], symbols)
            every = [(layer, to) for layer in found for to in range(len(GRAMMAR))]
            out["costs"] = [layer[to][0] if to in layer else None for layer, to in every]
            out["labels"] = [layer[to][1] if to in layer else None for layer, to in every]
            out["orders"] = [sum(w[1] < layer[to][1] for w in layer.values()) if to in layer else None for layer, to in every]
        yield out


WAYS = f"c string, conv_id long, part int, segment int, start int, stop int, tail string, whole boolean, {', '.join(f'{n} long' for n in COUNTS)}"


def _ways(records: Iterator[dict]) -> Iterator[dict]:
    """One row a segment: the states where the best path enters and leaves it; the last one holds the conversation's counts and last inserts."""
    size = len(GRAMMAR)
    for c, rows in groupby(records, key=lambda r: r["c"]):
        rows = list(rows)
        some = [r for r in rows if r["costs"]]
        if not some:
            yield {"c": c, "conv_id": rows[0]["conv_id"], "whole": True, "tail": "", **{n: 0 for n in COUNTS}}
            continue
        layer, back = {0: (0, 0)}, []  # state: (cost, order of its labels among all)
        for r in some:
            best: dict[int, tuple] = {}
            for state, (cost, order) in layer.items():
                for to in range(size):
                    at = state * size + to
                    if r["costs"][at] is not None:
                        weight = (cost + r["costs"][at], order, r["orders"][at], state)
                        if to not in best or weight < best[to]:
                            best[to] = weight
            places = sorted((w[1:3] for w in best.values()))
            layer = {to: (w[0], places.index(w[1:3])) for to, w in best.items()}
            back.append({to: w[3] for to, w in best.items()})
        ends = []
        for to, (cost, order) in layer.items():
            for n, states in enumerate(inserts({to: (cost, "")})):
                ends += [(w[0], order, n, to) for state, w in states.items() if state in FINAL]
        cost, _, n, stop = min(ends)
        counts, out = totals(some) | {"cost": cost}, []
        for r, before in zip(reversed(some), reversed(back)):
            start = before[stop]
            row = {"c": c, "conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "start": start, "stop": stop, "tail": "", "whole": False}
            out.append(row if out else row | counts | {"tail": "I" * n, "whole": True})
            stop = start
        yield from reversed(out)


def _texts(records: Iterator[dict]) -> Iterator[dict]:
    """One row a segment that keeps anything: its repaired rows, joined."""
    for _, rows in groupby(records, key=lambda r: (r["c"], r["part"], r["segment"])):
        rows = list(rows)
        live = [r for r in rows if not r["gone"]]
        if live:
            one = rows[0]
            labels = paths(one["start"], [(r["role"][:1], fault(r["text"], r["seen"])) for r in live])[one["stop"]][1] + one["tail"]
            found = lines(labels, ((r["role"], r["text"]) for r in live), one["start"])
            if found:
                yield {"c": one["c"], "part": one["part"], "segment": one["segment"], "text": "\n".join(found)}


def _digests(records: Iterator[dict]) -> Iterator[dict]:
    for c, rows in groupby(records, key=lambda r: r["c"]):
        state = hashlib.sha256()
        for i, r in enumerate(rows):
            state.update(b"\n" * bool(i) + r["text"].encode("utf-8", "surrogatepass"))
        yield {"c": c, "repaired_sha256": state.hexdigest()}


def _mapped(df: DataFrame, step, schema: str) -> DataFrame:
    arrow = _arrow(schema)
    return df.mapInArrow(lambda batches: _grouped_out(step(_records(batches)), arrow), schema)


def _by_segment(df: DataFrame, step, schema: str) -> DataFrame:
    """step over each segment's rows by place. Grouped, not only dealt: Spark leaves out a repartition by what a join has dealt by, and reads the
    join's shuffle by map task, or a part at a time, where that suits the join."""
    arrow = _arrow(schema)

    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(step(iter(sorted(rows.to_pylist(), key=lambda r: r["place"])))), schema=arrow)

    return df.groupBy("c", "part", "segment").applyInArrow(run, schema)


def _joined(rest: DataFrame) -> DataFrame:
    """Results of the conversations whose rows are in segments."""
    keyed = rest.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct("part", "segment", "place")
    # A prefix keeps the columns of both sides apart.
    least = keyed.filter("NOT gone").groupBy(F.col("c").alias("c_"), F.col("role").alias("role_"), F.col("text_hash").alias("hash_")).agg(F.min(place).alias("least"))
    on = [keyed["c"] == least["c_"], keyed["role"] == least["role_"], keyed["text_hash"] == least["hash_"]]
    marked = keyed.join(least, on, "left").select(*rest.columns, F.coalesce(place > F.col("least"), F.lit(False)).alias("seen"))
    rows = written(marked.select("c", "conv_id", "part", "segment", "place", "turn", "role", "text", "gone", "seen"), "repair-rows")
    segments = written(_by_segment(rows, _segments, SEGMENTS), "repair-segments")
    ways = written(_mapped(segments.drop("labels").repartition("c").sortWithinPartitions("c", "part", "segment"), _ways, WAYS), "repair-ways")
    at = ["c", "part", "segment"]
    label = F.coalesce(F.col("labels")[F.col("start") * len(GRAMMAR) + F.col("stop")], F.lit(""))
    parts = segments.select(*at, "labels").join(ways.select(*at, "start", "stop", "tail"), at).select("c", F.struct("part", "segment", F.concat(label, "tail").alias("l")).alias("x"))
    audits = parts.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list("x"))["l"], "").alias("audit"))
    texts = _by_segment(rows.join(ways.select(*at, "start", "stop", "tail"), at), _texts, "c string, part int, segment int, text string")
    digests = _mapped(texts.repartition("c").sortWithinPartitions(*at), _digests, "c string, repaired_sha256 string")
    found = ways.filter("whole").select("c", "conv_id", *COUNTS).join(audits, "c", "left").join(digests, "c", "left")
    return found.select("conv_id", *COUNTS, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING["repaired_sha256"])).alias("repaired_sha256"))


def repaired(rows: DataFrame, segment: int = SEGMENT, size: int = BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) -> one row a conversation."""
    first = written(ordered(rows).mapInArrow(_first_pass(segment, size), FIRST), "repair-first")
    whole = first.filter("done").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    return whole.union(_joined(first.filter("NOT done").drop("done", *COUNTS, "audit", "repaired_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all conversations, damaged and repaired."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
