"""Quality classifier: a linear support vector machine on naive Bayes features, trained by dual coordinate descent.

Features are indicators of n-grams, hashed into BUCKETS: words in lower case, alone and in pairs; shapes of words (runs of
small letters, capitals and digits as one sign each, all else as it is), alone and in pairs; and runs of one word, 2 to 17
of it, whichever it is.
An indicator counts as r = log of the ratio of its smoothed frequencies in the two classes. On these the hinge loss is
minimised in the dual, one coordinate (one document) at a time in random order, the bias being a constant feature. As in
the published method, weights are then drawn towards their mean size by INTERPOLATE. A margin becomes a score by a
logistic curve fitted to margins of rows that the fit did not see.

The fit uses at most SAMPLE labelled rows, those with the smallest hashes of their doc_id: a bounded, documented
sample (its ids are broadcast, at most SAMPLE of them). Scoring reads every whole text, without a shuffle.

Only rows with crc32(doc_id as text) % 5 <> 0 are learned from. Labels, lang, source and doc_id are never inputs.

Defined results: a null text counts as empty; an empty text has no indicators and the score of the bias. Very long texts are
read whole, few at a time. A doc_id with several labels counts by their largest; null labels and labels without a document are not used. With
labels of one class or none, every score is the smoothed share of good labels. Repeated rows are scored alike. An empty
table gives an empty result. Extra columns, whatever their names, are ignored (or kept, where rows are filtered).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, text_of

BUCKETS = 1 << 18
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
#: Smoothing of counts, cost of the hinge loss, passes, share of the fitted weights against their mean size.
SMOOTH, COST, PASSES, INTERPOLATE = 1.0, 1.0, 12, 0.75
SEED = 7
_SHAPE = bytes(ord("a") if 97 <= b < 123 or b > 127 else ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else b for b in range(256))


def features(text: str) -> np.ndarray:
    """The buckets of a text's indicators, ascending, each once."""
    raw = text.encode("utf-8", "surrogatepass")
    shape = raw.translate(_SHAPE)
    for double, single in ((b"aa", b"a"), (b"AA", b"A"), (b"00", b"0")):
        while double in shape:
            shape = shape.replace(double, single)
    words, shapes, crc = raw.lower().split(), shape.split(), zlib.crc32
    pairs = set(zip(words, words[1:]))
    found = [crc(w) for w in set(words)]
    found += [crc(a + b" " + b, 1) for a, b in pairs]
    found += [crc(s, 2) for s in set(shapes)]
    found += [crc(a + b" " + b, 3) for a, b in set(zip(shapes, shapes[1:]))]
    if any(a == b for a, b in pairs):
        again = bytes(map(bytes.__eq__, words, words[1:]))
        found += [crc(b"%d" % n, 4) for n in (1, 2, 4, 8, 16) if b"\x01" * n in again]
    return np.unique(np.array(found, np.uint32) % BUCKETS).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35))))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of the ratio of smoothed, normalised counts of each bucket."""
    counts = np.full((2, BUCKETS), SMOOTH)
    for x, g in zip(rows, good):
        counts[0 if g == 1 else 1, x] += 1
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def coordinate_descent(rows: list[np.ndarray], good: np.ndarray, r: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights on r-scaled indicators and bias of min |w|^2 / 2 + cost * sum of hinge losses, in the dual; classes weigh alike in sum."""
    y = np.where(good == 1, 1.0, -1.0)
    squares = r * r
    norm = np.array([squares[x].sum() + 1 for x in rows])
    most = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) ** 0.5
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(SEED)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            own = rows[i]
            values = r[own]  # made anew each time, so that the sample is held once
            gradient = y[i] * (w[own] @ values + b) - 1
            step = min(max(alpha[i] - gradient / norm[i], 0), most[i]) - alpha[i]
            if abs(step) > 1e-10:
                alpha[i] += step
                w[own] += step * y[i] * values  # a row's buckets differ, so each is added to once
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = (good == 1).sum(), (good == 0).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margins.std() or 1.0
    design = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(beta[0] / scale), 1e-6), float(beta[1])


def _weights(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    r = ratios(rows, good)
    w, b = coordinate_descent(rows, good, r)
    used = np.zeros(BUCKETS, bool)
    for x in rows:
        used[x] = True
    mean = np.abs(w[used]).mean()
    mixed = np.zeros(BUCKETS)
    mixed[used] = INTERPOLATE * w[used] + (1 - INTERPOLATE) * mean
    return mixed * r, b


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    if len(set(good.tolist())) < 2 or min((good == 1).sum(), (good == 0).sum()) < 5:
        share = ((good == 1).sum() + 1) / (len(good) + 2)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    # Margins for the curve come from rows that four fifths of the fit left out, in turn.
    part = np.random.default_rng(SEED).permutation(len(rows)) % 5
    margins = np.zeros(len(rows))
    for k in range(5):
        own = np.flatnonzero(part != k)
        if len(set(good[own].tolist())) == 2:
            w, b = _weights([rows[i] for i in own], good[own])
            for i in np.flatnonzero(part == k):
                margins[i] = w[rows[i]].sum() + b
    w, b = _weights(rows, good)
    return Model(w.astype(np.float32), b, *_logistic(margins, good))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").cast("int").alias("good"))
    some = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(some, F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "good", "x"])

    # One row a sampled doc_id, at most `sample` of them, before anything comes to the driver.
    first = rows.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, x binary").groupBy("doc_id").agg(F.min(F.struct("good", "x")).alias("first"))
    got = first.select("doc_id", "first.good", "first.x").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    x = [np.frombuffer(v.as_buffer(), np.int32) for v in got.column("x")]  # in the buffers that came, not copied
    return fit([x[i] for i in order], got.column("good").to_numpy()[order].astype(np.int64))


def free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and the score, under a name that is free in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches, "body"):
            scores = [fitted.score(features(t)) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*docs_names, name])

    docs_names = docs.columns
    # Columns go by place on the way, so that their names may be any.
    placed = docs.select("*", text_of()).toDF(*[f"c{i}" for i in range(len(docs_names))], "body")
    return placed.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels, does not reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "score")
    return score(docs, model, name).filter(F.col(name) >= THRESHOLD).drop(name)
