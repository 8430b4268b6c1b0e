"""From files to answers: ingest, chunk, index, retrieve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.config import Settings
from candlewick.errors import EmptyDocumentError
from candlewick.functions.vectors import Embedder, sentence_model
from candlewick.operators.chunk import Chunker, number
from candlewick.operators.retrieve import Retriever, VectorIndex
from candlewick.sources.documents import ingest


class RetrievalPipeline:
    """Pure retrieval: query() gives the chunks most like the question, with labels, scores and highlights."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.settings.validate()
        s = self.settings
        self.embedder = embedder or sentence_model(s.embedding_model_name)
        self.chunker = Chunker(self.embedder, s.min_chunk_chars, s.max_chunk_chars, s.breakpoint_percentile)
        self.index = VectorIndex(spark, self.embedder)
        self.retriever = Retriever(self.index, self.embedder, s.default_top_k, s.highlight_sentences)

    def ingest_files(self, paths: list[str]) -> DataFrame:
        return ingest(self.spark, paths)

    def chunk(self, blocks: DataFrame) -> DataFrame:
        """Chunks of blocks (file_pos, block_pos, source_file, page_number, heading, text), numbered in order from 0."""
        return number(self.chunker.chunk(blocks), ["file_pos", "block_pos", "chunk_pos"])

    def build_index(self, blocks: DataFrame) -> DataFrame:
        self.index.build(self.chunk(blocks), numbered=True)
        return self.stats()

    def build_index_from_files(self, paths: list[str]) -> DataFrame:
        blocks = self.ingest_files(paths)
        if blocks.isEmpty():
            raise EmptyDocumentError("none of the files has text")
        return self.build_index(blocks)

    def save_index(self, folder: str) -> None:
        self.index.save(folder)

    def load_index(self, folder: str) -> None:
        self.index.load(folder)

    def stats(self) -> DataFrame:
        return self.index.stats()

    def query(self, question: str, top_k: int | None = None) -> DataFrame:
        return self.retriever.retrieve(question, top_k)

    def query_many(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """For questions (query_id, question) all at once."""
        return self.retriever.retrieve_many(questions, top_k)
