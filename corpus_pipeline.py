"""A training-corpus pipeline of five stages: language ID, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
All but the last keep the columns of documents. Each works on every row that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinotable.llm import _text, decontaminate, langid, packing, pii, simhash


def _ready(spark: SparkSession) -> None:
    """Python workers get short batches, and the driver's Python keeps nothing of the stages before."""
    _text.short_batches(spark)
    _text.trimmed()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts whose main language holds too few of their letters; fills in a missing lang."""
    _ready(spark)
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: fingerprints within 4 bits (unverified, as in op2), or shingle sets 0.8 similar."""
    _ready(spark)
    return simhash.distinct(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts and drops texts that are mostly such passages."""
    _ready(spark)
    return decontaminate.clean(docs, _text.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder; what a stage read, and what it settled on its way, is removed once its rows are written. The last stage's rows stay."""
    docs = _text.table(spark, sf_dir, "documents")
    folder = f"{_text.shared_folder(spark)}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with _text.passing(spark), _text.restored(spark, _text._BATCH):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            _text.removed(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Fingerprints and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
