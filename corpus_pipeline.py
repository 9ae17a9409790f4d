"""From raw documents to packed token sequences, stage by stage, over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, whatever they are called.

In every stage a null text counts as an empty one, no rows give none, and texts are used whole. Null and repeated
doc_ids are allowed; each stage says below what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm import mixing, packing, pii, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: a score at the threshold or above. Each row is judged by its text alone, so
    that repeated rows share a fate; without labels of both kinds none goes."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a similarity of 0.8 over five-word shingles, the smallest doc_id stays (null is larger than
    any); rows that share text and doc_id become one, and texts without words are one text."""
    return simhash.drop_similar(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to a mark of its kind, row by row; n_chars follows the text, and a null text stays null."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source (null is one, too) comes to its target; a document may stand twice, or not at all. Rows that share doc_id
    and source share their number of copies; a source without words has none."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 1024 tokens. Each row is a document of its own, whatever
    its doc_id; one without text is its end id alone."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cluster.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        cluster.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and field, fingerprints and a genetic algorithm are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
