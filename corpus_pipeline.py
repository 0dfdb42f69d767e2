"""A training corpus from documents: toxic texts go, repeated lines go, one document of each
group of near duplicates stays, personal data is replaced, and what is left is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, packing, pii, shingle_sets, toxicity
from quillspark.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the whole table's labels."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), threshold=0.3).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that another one keeps; n_chars is that of the new text."""
    return _measured(line_dedup.dedup_lines(docs, max_bits=3, least=0.8))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have Jaccard 0.8 or more, the one with the smallest doc_id."""
    return shingle_sets.keep_one(docs, least=0.8, width=5).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of sequences of 2048 tokens."""
    import public_tokenizers

    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=0)
    return out.withColumnRenamed("id", "doc_id")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained classifier, fuzzy groups and packing; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
