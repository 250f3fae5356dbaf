"""Corpus preparation: five stages from raw documents to token files.

Each stage works on all rows its predecessor kept and returns the columns of ``documents``; the last one
describes the token files. ``run`` writes every result to the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import decontaminate, jaccard, langid, mixing, token_store
from trialweave.llm.queries import remainder, tokenizer_path
from trialweave.llm.store import stored


#: Documents in an Arrow batch: whole texts pass through Python workers, so this bounds their memory.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _stage(function):
    """A stage whose session hands documents to Python workers in batches of ``BATCH_ROWS``.

    The result is evaluated after the stage returns, so the setting outlasts it; ``run`` puts the caller's back.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Documents without a language (null or letterless text) are rejected."""
    model = langid.fit(docs, remainder(4) != 2)
    judged = langid.identify(docs, model, ("__lang", "__score"))
    return judged.filter(F.col("__lang") != "und").select(docs.columns)


@_stage
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join. Of a group of linked documents the one with the least doc_id stays.

    Rows that repeat a doc_id with equal text are one document; different texts under one doc_id all stay if any of them
    does, so no text is lost to a clash of ids. Rows without doc_id link with nothing and stay.
    """
    joined = jaccard.join(docs)
    ids = stored(joined.filter(F.col("doc_id") == F.col("component_id")).select("doc_id"), "kept")
    kept = docs.join(jaccard.small_side(ids.distinct()), "doc_id", "left_semi")
    if ids.count() > ids.distinct().count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing. Documents that hold a benchmark window and have a twentieth of their words in such windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.score(docs, benchmark).filter(~decontaminate.contaminated()).select(docs.columns)


_MIX_ORDER = ("mix_slot", "mix_place", "doc_id")


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pfair mixing. All documents stay; the rows of the result stand in mixed order, file by file."""
    placed = mixing.mix(docs, mixing.tempered_weights(docs))
    return placed.repartitionByRange(*_MIX_ORDER).sortWithinPartitions(*_MIX_ORDER).select(docs.columns)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in mixed order. The order is a function of the rows, so it is the one ``mixed`` gave them."""
    placed = mixing.mix(docs, mixing.tempered_weights(docs))
    return token_store.encode_corpus(placed, tokenizer_path(), list(_MIX_ORDER))


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", encoded),
]

#: Language ID, mixing and tokens have no SQL form; the tests hold every stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(_BATCH, before)
    return docs
