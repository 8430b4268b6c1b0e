"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct 64-bit hashes of its words, word pairs and pairs that skip one or two words. The
model is fitted on the driver, on at most SAMPLE_ROWS labelled rows (those with the least hash of the id); features that
fewer than MIN_ROWS of these have are left out in Spark, where they travel packed by ranges of their hashes and then by
row, never as rows of their own; of what is left at most SAMPLE_FEATURES in all come to the
driver: a row that would exceed them is passed over and later ones may still fit. Both bounds are parameters.
Per-coordinate rates and L1 leave few weights, which go to the executors as two arrays: at most SAMPLE_FEATURES /
MIN_ROWS entries of 12 bytes, in practice some hundred. Scoring is one pass without a shuffle.

Scores depend on the text alone. Defined results: null and empty texts have the model's bias alone; repeated rows are
scored one by one; of several labels of an id the largest counts, null ids and null labels are left out, and of several
texts of an id the least is learnt from; rows tied in hash go by id. With no labelled rows every score is 0; where no row
fits the bound, every score is the sample's share of label 1. A null id is in no held-out fold. Very long texts are
scored whole. Other columns stay (those named score and predicted are replaced). An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm._shared import Scratch, alnum_words, hashes, lean, mixed, table

SAMPLE_ROWS = 6_000
#: Of 8 bytes each; the driver holds them about three times while it fits.
SAMPLE_FEATURES = 12_000_000
MIN_ROWS = 5
#: Features that are counted at once, about, and that a task packs at once.
COUNTED, PACKED_AT_ONCE = 50_000, 200_000
#: A fold of five that no model sees.
HELD_OUT = "coalesce(crc32(CAST({} AS STRING)) % 5 = 0, false)"

_SKIPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None) -> np.ndarray:
    """Distinct hashes of words, word pairs, and pairs that skip one or two words."""
    h = hashes(alnum_words(text))
    pairs = [mixed(h[:-d] * _SKIPS[d - 1] + h[d:]) for d in (1, 2, 3) if len(h) > d]
    return np.unique(np.concatenate([h, *pairs]))


@dataclass
class Model:
    """Ordered features, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        total = self.bias
        if len(self.keys) and len(found):
            # few keys: look for each of them among the text's features
            places = np.minimum(np.searchsorted(found, self.keys), len(found) - 1)
            total += float(self.weights[found[places] == self.keys].sum())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 8, min_rows: int = MIN_ROWS) -> Model:
    """FTRL-proximal over rows of (features, 0 or 1), in the order given."""
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -500.0)
    keys, counts = np.unique(np.concatenate([x for x, _ in rows]), return_counts=True)
    keys = keys[counts >= min_rows]
    coded = []
    for found, y in rows:
        places = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
        coded.append((places[keys[places] == found] if len(keys) else places[:0], y))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    share = min(max(sum(y for _, y in rows) / len(rows), 1e-4), 1 - 1e-4)
    bias, bias_n = math.log(share / (1 - share)), 0.0
    for _ in range(epochs):
        for at, y in coded:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(wi.sum())))))
            g = p - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * wi
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.1 / (1 + math.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = w != 0
    return Model(keys[kept], w[kept], bias)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(x.as_py()).view(np.int64) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int64())), batch.column(1), batch.column(2)], names=["features", "y", "rank"])


_PACKED = "at long, ranks binary, found binary"


def _packed(to: np.ndarray, ranks: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """A row for each place in to, with the features that go there and the ranks of their rows."""
    order = np.argsort(to, kind="stable")
    to, ranks, found = to[order], ranks[order], found[order]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(to), 1), bool), to[1:] != to[:-1]]))
    spans = list(zip(cuts, [*cuts[1:], len(to)]))
    columns = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (ranks, found)]
    return pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int64)), *columns], names=["at", "ranks", "found"])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ranks, found = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("ranks", np.int64), ("found", np.uint64)))
    return ranks, found


def _ranged(bits: int):
    """Of rank and features: the features by 2 ** bits ranges of their hashes."""

    def made(ranks: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(found)
        return _packed(flat >> np.uint64(64 - bits), np.repeat(np.array(ranks, np.int64), [len(x) for x in found]), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, found, size = [], [], 0
            for rank, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ranks.append(rank)
                found.append(x.values.to_numpy().view(np.uint64))
                size += len(found[-1])
                if size > PACKED_AT_ONCE:
                    yield made(ranks, found)
                    ranks, found, size = [], [], 0
            if size:
                yield made(ranks, found)

    return run


def _common(bits: int):
    """Of a range of hashes: the features that MIN_ROWS rows have, by 2 ** bits lots of rows."""

    def run(rows: pa.Table) -> pa.Table:
        ranks, found = _unpacked(rows)
        _, at, n = np.unique(found, return_inverse=True, return_counts=True)
        kept = n[at] >= MIN_ROWS
        return pa.Table.from_batches([_packed(ranks[kept].view(np.uint64) & np.uint64(2**bits - 1), ranks[kept], found[kept])])

    return run


def _by_rank(rows: pa.Table) -> pa.Table:
    """Of a lot of rows: the number of each one's features, and these in order."""
    ranks, found = _unpacked(rows)
    order = np.lexsort((found, ranks))
    made = _packed(ranks[order], ranks[order], found[order])
    sizes = pa.array([len(x) // 8 for x in made.column("found").to_pylist()], pa.int32())
    return pa.table([made.column("at"), sizes, made.column("found")], names=["rank", "n", "features"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Fits to labelled rows outside the held-out fold. docs: doc_id, text; labels: doc_id and label."""
    usable = labels.where(F.expr(f"doc_id IS NOT NULL AND {label} IS NOT NULL AND NOT ({HELD_OUT.format('doc_id')})"))
    sample = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample_rows)
    # the sample has at most sample_rows rows of three numbers
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "rank").agg(F.min("text").alias("text")).select("text", "y", "rank").mapInArrow(lean(_featured), "features array<long>, y int, rank long")
    scratch = Scratch(docs.sparkSession, "toxicity")
    kept = scratch.keep(found, "sample")
    # features that few rows have are left out before anything comes to the driver
    bits = max(8, ((kept.agg(F.sum(F.size("features"))).first()[0] or 0) // COUNTED).bit_length())
    ranged = kept.select("rank", "features").mapInArrow(lean(_ranged(bits)), _PACKED)
    shared = ranged.groupBy("at").applyInArrow(_common(bits), _PACKED)
    made = scratch.keep(shared.groupBy("at").applyInArrow(_by_rank, "rank long, n int, features binary"), "shared")
    # numbers of at most sample_rows rows, then the rows that fit, the least ranks first
    of, size = {}, 0
    for rank, y, n in sorted(kept.select("rank", "y").join(made.select("rank", "n"), "rank", "left").fillna(0, ["n"]).collect()):
        if size + n <= sample_features:
            size += n
            of[rank] = y, np.zeros(0, np.uint64)
    if not of and not kept.isEmpty():
        share = kept.agg(F.avg("y")).first()[0]
        scratch.drop("sample", "shared")
        return Model(np.zeros(0, np.uint64), np.zeros(0), math.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    fitting = docs.sparkSession.createDataFrame([(x,) for x in of], "rank long")
    rows = made.join(F.broadcast(fitting), "rank").select("rank", "features").toArrow()
    for rank, x in zip(rows.column("rank").to_pylist(), rows.column("features")):
        of[rank] = of[rank][0], np.frombuffer(x.as_buffer(), np.uint64)
    scratch.drop("sample", "shared")
    return fit([(x, y) for y, x in of.values()])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted to docs."""
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index(text), [*docs.columns, "score", "predicted"]
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [known.value.score(features(x.as_py())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=names)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op10_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.expr(HELD_OUT.format("doc_id")).alias("held_out"), "score", "predicted")
