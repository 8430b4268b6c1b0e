"""A corpus pipeline: toxic documents go, one near-duplicate of each class stays, documents with benchmark passages go,
personal data is masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs, further columns of any name with
their own values. Null texts count as empty: they aren't toxic, resemble nothing, hold no passage, stay null when data
is masked, and are packed as a separator alone. Rows whose doc_id is null or comes again are documents of their own;
equal texts among them are copies, of which the first stays. Very long texts are read whole by every stage. Empty tables
pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import decontam, jaccard_join, packing, pii, toxicity
from candlewick.llm._shared import Scratch, alnum_words, free_name, table

#: Near-duplicates share at least 80 of 100 of their five-word shingles.
NEAR = jaccard_join.Measure(5, 80, 100, alnum_words)


def _aside(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stage keeps of docs, with the columns of docs; those by names that the stage takes stand aside meanwhile."""
    moved: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = free_name([*docs.columns, *names, *moved.values()], f"own_{c}")
    return stage(docs.withColumnsRenamed(moved)).select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _aside(docs, {"score", "predicted"}, lambda d: toxicity.score(d, model).where("predicted = 0"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _aside(docs, {"n_words", "hit_spans", "hit_items"}, lambda d: decontam.detect(d, benchmark).where(F.size("hit_items") == 0))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal),
    ("packing", pack),
]

#: A fitted model, components of links and byte-pair encoding aren't SQL; tests/llm/test_pipeline.py has them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each over what its predecessor kept. The last one's table stays until the application ends."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
