"""The vector index as a DataFrame, exact top-k search, and sentence highlights."""

from __future__ import annotations

import json
import logging
import math
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.errors import EmptyIndexError, IndexNotBuiltError
from candlewick.functions.text import let, required, sentences
from candlewick.functions.vectors import Embedder, checked, dot
from candlewick.storage import Scratch, exists, hadoop_path

log = logging.getLogger(__name__)

CHUNK = "pos long, chunk_id long, source_file string, heading string, page_number int, text string, vector array<double>"
VERSION = 2
#: Names in an index folder: versions of the rows, and batches that were streamed in.
CHUNKS, ARRIVED = "chunks", "arrived"
#: Bytes of question vectors that are broadcast together: 64 MB are 131,000 questions of 64 numbers, and one scan of the rows.
BLOCK_BYTES = 64_000_000
#: Questions and rows that are multiplied at once in a task.
SUB, ROWS = 1024, 4096
#: Results (24 bytes each) that may be broadcast to fetch their chunks; beyond, both sides are shuffled.
MOST_BROADCAST = 200_000


def wanted(top_k: int, available: int) -> int:
    return max(1, min(top_k, available))


def nearest(rows: DataFrame, vector: list[float], k: int, by: str = "vector", tie: str = "pos") -> DataFrame:
    """The k rows with the largest inner product, as score; ties go to the least tie. Plans as a top-k, never a full sort.

    Rows without a vector are passed over; a score that is no number raises.
    """
    score = dot(F.col(by), F.lit([float(x) for x in vector]))
    # NaN sorts above all numbers, so it is among the k if it is there
    return rows.where(F.col(by).isNotNull()).withColumn("score", score).orderBy(F.round("score", 12).desc(), tie).limit(k).withColumn("score", checked(F.col("score")))


def _best(known, k: int, names: list[str]):
    """Of the rows (tie, vector) of a partition the k nearest to each question."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, m = known.value
        best = [(np.zeros(0), np.zeros(0), np.zeros(0, "int64"))] * len(ids)
        least = np.full(len(ids), -np.inf)  # the worst rounded score that still counts
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ties, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for a in range(0, len(ids), SUB):
                    scores = m[a : a + SUB] @ v.T
                    if np.isnan(scores).any():
                        raise ValueError("a score isn't a number")
                    rounded, floor = np.round(scores, 12), least[a : a + SUB]
                    if len(ties) > k:
                        floor = np.maximum(floor, np.partition(rounded, -k, axis=1)[:, -k])
                    for i in np.flatnonzero((rounded >= floor[:, None]).any(axis=1)):
                        new = np.flatnonzero(rounded[i] >= floor[i])
                        r, s, t = (np.concatenate(x) for x in zip(best[a + i], (rounded[i, new], scores[i, new], ties[new])))
                        order = np.lexsort((t, -r))[:k]
                        best[a + i] = r[order], s[order], t[order]
                        if len(order) == k:
                            least[a + i] = r[order[-1]]
        columns = [np.repeat(ids, [len(x) for x, _, _ in best]), *(np.concatenate([x[j] for x in best]) if len(ids) else np.zeros(0) for j in (2, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=names)

    return run


def nearest_many(rows: DataFrame, questions: DataFrame, k: int, by: str = "vector", tie: str = "pos") -> DataFrame:
    """query_id, rank, score and tie of the k nearest rows of each of questions (query_id, vector).

    Vectors of questions go to the executors, BLOCK_BYTES at once, a scan of the rows for each such block. A partition
    multiplies its rows with them and passes on k rows for each question, so what is shuffled doesn't grow with the rows;
    a rank over these gives the result. Rows without a vector are passed over; a score that is no number raises.
    """
    spark, out, block, size = rows.sparkSession, None, [], 0
    vectors = rows.select(F.col(tie).cast("long").alias(tie), F.col(by).cast("array<double>").alias(by)).where(F.col(by).isNotNull())
    names = ["query_id", tie, "score"]

    def searched(block: list) -> DataFrame:
        import numpy as np

        known = spark.sparkContext.broadcast((np.array([q.query_id for q in block], "int64"), np.array([q.vector for q in block], "float64")))
        return vectors.mapInArrow(_best(known, k, names), f"query_id long, {tie} long, score double")

    for q in questions.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).where("vector IS NOT NULL").toLocalIterator():
        block.append(q)
        size += 8 * len(q.vector)
        if size >= BLOCK_BYTES:
            out, block, size = searched(block) if out is None else out.unionByName(searched(block)), [], 0
    if block or out is None:
        out = searched(block) if out is None else out.unionByName(searched(block))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), tie)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", checked(F.col("score")))


def highlight(text: Column, parts: Column, vectors: Column, query: Column, n: int) -> Column:
    """The n sentences of the text most like the query, in reading order; of ties the later; the text itself if it has no more."""

    def chosen(parts: Column) -> Column:
        ranked = F.transform(vectors, lambda v, i: F.struct(F.round(dot(v, query), 9).alias("s"), i.alias("i")))
        best = F.array_sort(F.transform(F.slice(F.sort_array(ranked, False), 1, n), lambda x: x.i))
        return F.array_join(F.transform(best, lambda i: F.get(parts, i)), " ")

    return let(parts, lambda parts: F.when(F.size(parts) <= n, text).otherwise(chosen(parts)))


class VectorIndex:
    """Chunks and their vectors in one DataFrame, so neither can drift from the other. pos is the key, in order of arrival."""

    def __init__(self, spark: SparkSession, embedder: Embedder):
        self.spark, self.embedder = spark, embedder
        self.rows: DataFrame | None = None
        self.count = 0
        #: The folder that the rows come from, and the last streamed batch in them.
        self.loaded: tuple[str, int] | None = None

    @property
    def is_built(self) -> bool:
        return self.rows is not None

    def _vectors(self, chunks: DataFrame, first: int, numbered: bool) -> DataFrame:
        from candlewick.operators.chunk import number

        chunks = chunks.drop("pos", "vector")
        if numbered:
            placed = chunks.withColumn("pos", F.col("chunk_id") + first)
        else:
            placed = number(chunks, ["chunk_id"] if "chunk_id" in chunks.columns else chunks.columns, "pos", first)
        for name, kind in (("chunk_id", "long"), ("heading", "string"), ("page_number", "int")):
            if name not in placed.columns:
                placed = placed.withColumn(name, (F.lit("") if name == "heading" else F.col("pos") if name == "chunk_id" else F.lit(None)).cast(kind))
        made = placed.withColumn("text", required(F.col("text"))).withColumn("vector", self.embedder.vector(F.col("text")))
        return made.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in CHUNK.split(", ")])

    def build(self, chunks: DataFrame, numbered: bool = False) -> None:
        """Takes chunks (text, source_file; heading, page_number, chunk_id if there are) and replaces what was there.

        numbered: chunk_id already counts them from 0, as number() does, and needn't be found again. A blank text raises.
        """
        rows = Scratch(self.spark, "index").keep(self._vectors(chunks, 0, numbered), "rows")
        if not (count := rows.count()):
            raise EmptyIndexError("there are no chunks to build an index from")
        self.rows, self.count = rows, count

    def add(self, chunks: DataFrame, numbered: bool = False) -> None:
        """Appends chunks, positions going on; no chunks change nothing, and the first build the index."""
        if chunks.isEmpty():
            return
        if not self.is_built:
            return self.build(chunks, numbered)
        more = Scratch(self.spark, "index").keep(self._vectors(chunks, self.count, numbered), "rows")
        self.rows, self.count = self.rows.unionByName(more), self.count + more.count()

    def _built(self) -> DataFrame:
        if self.rows is None:
            raise IndexNotBuiltError("build or load the index first")
        return self.rows

    def embedded(self, query: str) -> list[float]:
        return self.spark.range(1).select(self.embedder.vector(F.lit(query)).alias("v")).first().v

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        """The chunks nearest to the query with their scores, the best first; none for a blank query."""
        rows = self._built()
        if not query.strip():
            return rows.limit(0).withColumn("score", F.lit(0.0))
        vector = self.embedded(query)
        if any(map(math.isnan, vector)):
            raise ValueError("the query's vector isn't a number")
        return nearest(rows, vector, wanted(top_k, self.count))

    def search_many(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        """query_id, rank, score and the chunk's columns for each of questions (query_id, question); blank ones give none."""
        rows = self._built()
        asked = questions.where("trim(question) <> ''").select("query_id", self.embedder.vector(F.col("question")).alias("vector"))
        k = wanted(top_k, self.count)
        found = nearest_many(rows, asked, k)
        # k rows a question: few enough to go to the chunks, rather than the chunks' texts to them
        if asked.count() * k <= MOST_BROADCAST:
            found = F.broadcast(found)
        return rows.drop("vector").join(found, "pos")

    def stats(self) -> DataFrame:
        """One row: chunks, files, and their names in order; zeros before the index is built. Reads no vectors."""
        rows = self.rows if self.is_built else self.spark.createDataFrame([], CHUNK)
        return rows.agg(F.count("*").alias("total_chunks"), F.countDistinct("source_file").alias("total_source_files"), F.array_sort(F.collect_set("source_file")).alias("source_files"))

    def save(self, folder: str) -> None:
        """Writes the rows as Parquet, as a new version in the folder, then a line of JSON that names it.

        Until that line is written the folder holds what it held before, so an index may be saved where it was loaded from.
        The version before stays for those who have loaded it; older ones go.
        """
        rows = self._built()
        before = self._versions(folder)
        name = f"{CHUNKS}-{before[-1][0] + 1 if before else 1:06d}"
        rows.write.parquet(f"{folder}/{name}")
        meta = {"version": VERSION, "embedding_model": self.embedder.name, "total_chunks": self.count, "chunks": name, "arrived": self._last_arrived(folder)}
        path, fs = hadoop_path(self.spark, f"{folder}/meta.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(meta, indent=2).encode()))
        out.close()
        self.rows, self.loaded = self.spark.read.schema(CHUNK).parquet(f"{folder}/{name}"), (folder, meta["arrived"])
        for _, old in before[:-1]:
            p, fs = hadoop_path(self.spark, f"{folder}/{old}")
            fs.delete(p, True)

    def _versions(self, folder: str) -> list[tuple[int, str]]:
        """Number and name of the complete versions in a folder, in order."""
        path, fs = hadoop_path(self.spark, folder)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        found = sorted((int(x[len(CHUNKS) + 1 :] or 0), x) for x in names if re.fullmatch(rf"{CHUNKS}(-\d+)?", x))
        return [x for x in found if exists(self.spark, f"{folder}/{x[1]}/_SUCCESS")]

    def _last_arrived(self, folder: str) -> int:
        """The last streamed batch that the rows hold, if they were loaded from this folder; -1 is none."""
        return self.loaded[1] if self.loaded and self.loaded[0] == folder else -1

    def load(self, folder: str) -> None:
        """Reads what save() wrote, and after it what has been streamed into the folder since. An index of another
        embedder is loaded with a warning."""
        versions, meta = self._versions(folder), {}
        streamed = exists(self.spark, f"{folder}/{ARRIVED}")
        if not versions and not streamed:
            raise FileNotFoundError(f"no index in {folder}")
        if exists(self.spark, f"{folder}/meta.json"):
            try:
                meta = json.loads("\n".join(r.value for r in self.spark.read.text(f"{folder}/meta.json").collect()))
            except (json.JSONDecodeError, Py4JJavaError, PySparkException):  # cut off while it was written
                log.warning("%s/meta.json can't be read, the last version is taken", folder)
            if meta.get("embedding_model", self.embedder.name) != self.embedder.name:
                log.warning("the index was built with %s, the embedder is %s", meta.get("embedding_model"), self.embedder.name)
        names = [x for _, x in versions]
        name = meta.get("chunks") if meta.get("chunks") in names else names[-1] if names else None
        rows = self.spark.read.schema(CHUNK).parquet(f"{folder}/{name}") if name else self.spark.createDataFrame([], CHUNK)
        count, last = rows.count(), int(meta.get("arrived", -1))
        if streamed:
            new = self.spark.read.parquet(f"{folder}/{ARRIVED}").where(F.col("batch") > last)
            newest = new.agg(F.max("batch")).first()[0]
            if newest is not None:
                from candlewick.operators.chunk import number

                placed = number(new, ["batch", "file_pos", "block_pos", "chunk_pos"], "pos", count).withColumn("chunk_id", F.col("pos") - count)
                more = Scratch(self.spark, "index").keep(placed.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in CHUNK.split(", ")]), "rows")
                rows, count, last = rows.unionByName(more), count + more.count(), int(newest)
        self.rows, self.count, self.loaded = rows, count, (folder, last)


class Retriever:
    """Search with a default k, and a highlight for each result."""

    def __init__(self, index: VectorIndex, embedder: Embedder | None = None, default_top_k: int = 5, highlight_sentences: int = 2):
        self.index, self.embedder = index, embedder or index.embedder
        self.default_top_k, self.highlight_sentences = default_top_k, max(1, highlight_sentences)

    def retrieve(self, query: str, top_k: int | None = None) -> DataFrame:
        found = self.index.search(query, self.default_top_k if top_k is None else top_k)
        if not query.strip():
            return found.withColumn("highlight", F.lit(""))
        vector = self.embedder.vector(F.lit(query))
        return self._highlighted(found.withColumn("__query", vector)).orderBy(F.round("score", 12).desc(), "pos")

    def retrieve_many(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        found = self.index.search_many(questions, self.default_top_k if top_k is None else top_k)
        asked = questions.select("query_id", self.embedder.vector(F.col("question")).alias("__query"))
        return self._highlighted(found.join(asked, "query_id"))

    def _highlighted(self, found: DataFrame) -> DataFrame:
        """Sentences of the winners alone are embedded."""
        parts, query, n = sentences(F.col("text")), F.col("__query"), self.highlight_sentences
        if self.embedder.native:
            mark = let(parts, lambda p: let(self.embedder.vectors(p), lambda v: highlight(F.col("text"), p, v, query, n)))
            return found.withColumn("highlight", mark).drop("__query")
        found = found.withColumn("__parts", parts).withColumn("__vectors", self.embedder.vectors(F.col("__parts")))
        return found.withColumn("highlight", highlight(F.col("text"), F.col("__parts"), F.col("__vectors"), query, n)).drop("__query", "__parts", "__vectors")
