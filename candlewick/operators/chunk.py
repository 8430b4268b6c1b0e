"""Text blocks into chunks of neighbouring sentences on one topic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.text import is_blank, split_sentences
from candlewick.functions.vectors import Embedder, dot, percentile
from candlewick.memory import give_back
from candlewick.storage import Scratch, free_name

#: Sentences that are embedded at once; bytes of text that a task works on at once (a longer block alone), and chunks
#: that it passes on at once.
SENTENCES = 4096
BYTES = 1 << 20
CHUNKS = 1000


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts with at most BYTES of text in column at, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype="int64")
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def similarities(vectors: Column) -> Column:
    """Of each vector with the next; rounded, so that equal sentences give equal values in any engine."""
    pairs = F.sequence(F.lit(0), F.size(vectors) - 2)
    return F.when(F.size(vectors) < 2, F.array().cast("array<double>")).otherwise(
        F.transform(pairs, lambda i: F.round(dot(F.get(vectors, i), F.get(vectors, i + 1)), 9))
    )


def threshold(sims: Column, breakpoint_percentile: float) -> Column:
    """Below it neighbours may part; null without similarities."""
    return F.round(percentile(F.array_sort(sims), (100 - breakpoint_percentile) / 100), 11)


@dataclass(frozen=True)
class Chunker:
    """Cuts before a sentence if it differs from the one before and the chunk is long enough, or else grows too long.

    Lengths are sums over sentences, without the spaces that join them. One Arrow pass over the blocks: no exchange, so
    a block's cost is its own and blocks are as parallel as their files' partitions. As a fold in column functions the
    same took more than twice the time: a cut is decided sentence by sentence, from the chunk so far.
    """

    embedder: Embedder
    min_chars: int = 200
    max_chars: int = 1200
    breakpoint_percentile: float = 75.0

    def __post_init__(self):
        if self.max_chars <= self.min_chars:
            raise ValueError("max_chars doesn't exceed min_chars")

    def limit(self, sims: list[float]) -> float:
        """threshold() of some similarities, one at least."""
        ordered, at = sorted(sims), (100 - self.breakpoint_percentile) / 100 * (len(sims) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(sims) - 1)]
        return round(low + (high - low) * (at - int(at)), 11)

    def cut(self, parts: list[str], sims: list[float]) -> list[str]:
        """Chunks of two sentences or more and the similarities between neighbours."""
        limit, out, own, chars = self.limit(sims), [], [parts[0]], len(parts[0])
        for part, sim in zip(parts[1:], sims):
            if (sim < limit and chars >= self.min_chars) or chars + len(part) > self.max_chars:
                out.append(" ".join(own))
                own, chars = [], 0
            own.append(part)
            chars += len(part)
        return [*out, " ".join(own)]

    def _neighbours(self, flat: list[str]) -> list[float]:
        """Similarities of each sentence with the next, a bounded number of vectors at a time."""
        out, last = [], None
        for k in range(0, len(flat), SENTENCES):
            v = self.embedder.encode(flat[k : k + SENTENCES])
            joined = v if last is None else np.concatenate([last, v])
            out += [round(x, 9) for x in (joined[:-1] * joined[1:]).sum(axis=1).tolist()]
            last = v[-1:]
        return out

    def texts(self, blocks: list[str]) -> list[list[str]]:
        """The chunks of each block; a block of one sentence is its own chunk, as it is."""
        parts = [split_sentences(x) for x in blocks]
        flat = [s for p in parts if len(p) > 1 for s in p]
        sims, at, out = self._neighbours(flat) if flat else [], 0, []
        for text, p in zip(blocks, parts):
            if len(p) <= 1:
                out.append([text])
            else:
                out.append(self.cut(p, sims[at : at + len(p) - 1]))
                at += len(p)
        return out

    def _rows(self, batch: pa.RecordBatch, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk of the texts in column at. A whole text is never repeated for its chunks."""
        found = self.texts(batch.column(at).to_pylist())
        sizes = [len(x) for x in found]
        rows, places = np.repeat(np.arange(len(found)), sizes), np.concatenate([np.arange(n) for n in sizes])
        flat = [x for chunks in found for x in chunks]
        for k in range(0, len(flat), CHUNKS):
            own, part = pa.array(rows[k : k + CHUNKS]), pa.array(flat[k : k + CHUNKS], pa.string())
            columns = [part if j == at else c.take(own) for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places[k : k + CHUNKS], pa.int32())], names=names)

    def chunk(self, blocks: DataFrame, text: str = "text") -> DataFrame:
        """A row for each chunk of blocks: its columns, with the chunk for text, and chunk_pos (from 0 in its block)."""
        kept = blocks.where(~is_blank(F.col(text)))
        at, names = blocks.columns.index(text), [*blocks.columns, "chunk_pos"]
        fields = [T.StructField(text, T.StringType()) if f.name == text else f for f in blocks.schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, at):
                    yield from self._rows(batch, at, names)
            give_back()  # workers outlive tasks

        return kept.mapInArrow(run, T.StructType([*fields, T.StructField("chunk_pos", T.IntegerType())]))


def number(df: DataFrame, order: list[str], name: str = "chunk_id", first: int = 0) -> DataFrame:
    """Adds consecutive numbers in the given order.

    df is written once, as dealing it by range reads it twice. Rows are dealt by range and numbered in their partitions;
    only the partitions' counts meet, so no task sees all.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1
    scratch = Scratch(spark, "numbered")
    row, part_name, start = (free_name(df.columns, x) for x in ("row", "part", "start"))
    plain = scratch.keep(df, "plain")
    kept = scratch.keep(plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "rows")
    scratch.drop("plain")
    part = F.shiftright(row, 33)
    starts, at = [], first
    for p, n in sorted(kept.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        starts.append((p, at))
        at += n
    known = F.broadcast(spark.createDataFrame(starts, f"{part_name} long, {start} long"))
    placed = kept.join(known, part == F.col(part_name), "left")
    return placed.withColumn(name, F.col(start) + F.col(row).bitwiseAND(F.lit(low))).drop(row, part_name, start)
