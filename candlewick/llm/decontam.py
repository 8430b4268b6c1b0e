r"""Benchmark decontamination by winnowing.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased. A window is 10 consecutive words of an item. Of
every 6 consecutive 5-word hashes (10 words) the first least one is kept as a fingerprint with its place, on both sides
alike, so any shared span of 10 words shares a fingerprint. Fingerprints of a document are joined with the benchmark's
by hash; each pair of places is extended to both sides as far as words are equal, and a span of 10 words or more is a
hit, once its text has been compared. An item of fewer words, but not none, is one window: runs of its length are joined
by their hashes and compared alike.

The benchmark goes to the executors in blocks of at most about BLOCK_CHARS characters, as arrays of some 26 bytes a word
(measured: 4.2 bytes a character, so 67 MB in a worker). Long items are cut into pieces that overlap by a window less a
word. A block is a pass over the documents without a shuffle. Several blocks each give the hits alone, which are
gathered by row; the result is the same.

Defined results: null texts have no words; an item without an id makes hits like any other and counts as one item, with
null for its id; items or documents that come twice count as often as they come, an id once in a document's list.
Either table may be empty. Very long texts are read whole. Extra columns stay with detect().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm._shared import Scratch, alnum_words, free_name, grams, hashes, lean, table

WINDOW = 10
GRAM = 5
BLOCK_CHARS = 16_000_000
#: Words of an item's piece.
PIECE = 100_000


def _places(g: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the hashes of GRAM words: in each window the first of the least."""
    n = len(g) - (WINDOW - GRAM)
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1)
    return np.unique(np.arange(n) + rows.argmin(axis=1))


class _Table:
    """Places by hash."""

    def __init__(self, keys: list[np.ndarray], places: list[np.ndarray]):
        flat, at = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *places])
        order = np.argsort(flat, kind="stable")
        self.places = at[order].astype(np.int32)
        self.keys, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat)).astype(np.int32)

    def pairs(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (index of a value, place of that hash)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == values)
        starts, counts = self.starts[at[hit]].astype(np.int64), np.diff(self.starts)[at[hit]].astype(np.int64)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(hit, counts), self.places[np.repeat(starts, counts) + step].astype(np.int64)


class Index:
    """The words of some items in a row, with their fingerprints."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.names = sorted({item for item, _ in items if item is not None})
        number = {x: k for k, x in enumerate(self.names)} | {None: -1}
        words, first, piece, keys, places, short = [], 0, [], [], [], {}
        all_hashes, self.of = [], []
        for item, text in items:
            own = alnum_words(text)
            if not own:
                continue
            h = hashes(own)
            if len(own) >= WINDOW:
                g = grams(h, GRAM)
                at = _places(g)
                keys.append(g[at])
                places.append(at + first)
            else:
                short.setdefault(len(own), ([], []))
                short[len(own)][0].append(grams(h, len(own)))
                short[len(own)][1].append(np.array([first]))
            words.append(b" ".join(own))
            all_hashes.append(h)
            piece.append(np.full(len(own), len(self.of), np.int32))
            self.of.append(number[item])
            first += len(own)
        self.prints, self.short = _Table(keys, places), {n: _Table(*x) for n, x in short.items()}
        self.hashes, self.piece = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((all_hashes, np.uint64), (piece, np.int32)))
        self.text = np.frombuffer(b" ".join(words), np.uint8)
        # where each word starts, and one place past the end
        self.at = np.concatenate([[0], np.flatnonzero(self.text == 32) + 1, [len(self.text) + 1]]).astype(np.uint32) if first else np.zeros(1, np.uint32)

    def _extended(self, h: np.ndarray, i: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How many words to the left and to the right of a shared run of size words are equal too, up to a window."""
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for step, out in ((-1, left), (1, right)):
            edge = 0 if step < 0 else size - 1
            on = np.arange(len(i))
            for k in range(1, WINDOW - size + 1):
                a, b = i[on] + edge + step * k, q[on] + edge + step * k
                inside = (a >= 0) & (a < len(h)) & (b >= 0) & (b < len(self.hashes))
                on, a, b = on[inside], a[inside], b[inside]
                equal = (h[a] == self.hashes[b]) & (self.piece[b] == self.piece[q[on]])
                on = on[equal]
                out[on] = k
                if not len(on):
                    break
        return left, right

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Start and end of the hit spans, in order and apart, and the items."""
        h, found, items = hashes(words), [], set()
        if len(words) >= WINDOW and len(self.prints.keys):
            g = grams(h, GRAM)
            at = _places(g)
            k, q = self.prints.pairs(g[at])
            if len(k):
                i = at[k]
                left, right = self._extended(h, i, q, GRAM)
                for a, b, n in zip((i - left).tolist(), (q - left).tolist(), (left + right + GRAM).tolist()):
                    if n >= WINDOW and self._same(words, a, b, n):
                        found.append((a, a + n))
                        items.add(self.of[self.piece[b]])
        for n, known in self.short.items():
            if len(words) >= n:
                k, q = known.pairs(grams(h, n))
                for a, b in zip(k.tolist(), q.tolist()):
                    if self._same(words, a, b, n):
                        found.append((a, a + n))
                        items.add(self.of[self.piece[b]])
        return _joined(found), {None if x < 0 else self.names[x] for x in items}

    def _same(self, words: list[bytes], a: int, b: int, n: int) -> bool:
        return self.text[int(self.at[b]) : int(self.at[b + n]) - 1].tobytes() == b" ".join(words[a : a + n])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _listed(items: set[str | None]) -> list[str | None]:
    return sorted(items - {None}) + [None] * (None in items)


_SPANS, _ITEMS = pa.list_(pa.int32()), pa.list_(pa.string())


def _pass(index, at: int, names: list[str], only_hits: bool):
    """Adds hit_spans, hit_items and n_words; of the rows with hits alone if those are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(at):
                words = alnum_words(text.as_py())
                found, of = index.value.hits(words) if words else ([], set())
                counts.append(len(words))
                spans.append([x for span in found for x in span])
                items.append(_listed(of))
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS), pa.array(items, _ITEMS), pa.array(counts, pa.int64())], names=names)
            yield made.filter(pa.array([bool(x) for x in spans])) if only_hits else made

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, lists of spans and of items by block: joined."""
    for batch in batches:
        spans = [[x for span in _joined([s for one in many for s in zip(one[::2], one[1::2])]) for x in span] for many in batch.column(1).to_pylist()]
        items = [_listed({x for one in many for x in one}) for many in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=["key", "hit_spans", "hit_items"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items, the long ones in pieces; every window is in one of them."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = alnum_words(text.as_py())
            out += [(item, b" ".join(words[k : k + PIECE + WINDOW - 1])) for k in range(0, max(1, len(words) - WINDOW + 1), PIECE)] if words else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1].decode("utf-8", "surrogatepass") for x in out], pa.string())], names=["item", "text"])


_ADDED = [T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]


def detect(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds hit_spans (array of first word and word after the last, in turn), hit_items and n_words to docs.

    A column of docs by one of these names is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    pieces = items.mapInArrow(lean(_pieces), "item string, text string")
    blocks = max(1, -(-(pieces.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    scratch = Scratch(spark, "decontam")
    if blocks > 1:
        pieces = scratch.keep(pieces.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {blocks})")), "pieces")

    def searched(rows: DataFrame, some: DataFrame, only_hits: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in some.collect()]))
        names = [*rows.columns, *(f.name for f in _ADDED)]
        return rows.mapInArrow(lean(_pass(index, rows.columns.index(text), names, only_hits)), T.StructType([*rows.schema.fields, *_ADDED]))

    if blocks == 1:
        return searched(docs, pieces, False)
    key, all_spans, all_items = (free_name(docs.columns, x) for x in ("row", "all_spans", "all_items"))
    keyed = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    hits = None
    for k in range(blocks):
        own = scratch.keep(searched(keyed.select(key, text), pieces.where(F.col("block") == k), True).select(F.col(key).alias("key"), "hit_spans", "hit_items"), f"hits{k}")
        hits = own if hits is None else hits.unionByName(own)
    gathered = hits.groupBy("key").agg(F.collect_list("hit_spans").alias("s"), F.collect_list("hit_items").alias("i")).mapInArrow(_merged, "key long, hit_spans array<int>, hit_items array<string>")
    joined = keyed.join(gathered.withColumnRenamed("key", key), key, "left").drop(key)
    counted = searched(joined.select(*docs.columns, F.col("hit_spans").alias(all_spans), F.col("hit_items").alias(all_items)), pieces.limit(0), False)
    return counted.withColumns({"hit_spans": F.coalesce(all_spans, "hit_spans"), "hit_items": F.coalesce(all_items, "hit_items")}).drop(all_spans, all_items)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(transform(hit_spans, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"),
    )


#: Every window of every item against every run of as many words of every document.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT k, i, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT k, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT k, i, n, item_id FROM g JOIN v USING (n, g)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
