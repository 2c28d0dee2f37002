"""A corpus pipeline over ``documents``: five stages, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, the sources are mixed to their target weights,
and what is left is sharded along a Hilbert curve. Every stage but the last
returns the columns of its input, whatever their names; rows are told apart by
number, so rows without an id or with a common one are kept on their own.
Null texts count as empty, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crystalspark.llm import decontaminate, hilbert_shards, mixing, near_copies, registry, toxicity
from crystalspark.llm.common import free_name, materialise, table

#: Share of the tokens that the mix asks for; a document is taken once at most.
MIX_FRACTION, MIX_EPOCHS, SHARDS = 0.9, 1, 40


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, and that column's name."""
    row = free_name(docs.columns, "_row_number")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from this stage's input. Empty texts score by the bias alone."""
    classifier = registry.toxicity_classifier(spark, sf_dir, docs.select("doc_id", "text"))
    name = free_name(docs.columns, "score")
    return toxicity.score(docs, classifier, name=name).where(F.col(name) < registry.TOXIC).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word similarity 0.8 or more, the row with the smallest doc_id (nulls last, then by place).

    Repeated rows and texts without words are groups too.
    """
    rows, row = _numbered(docs)
    found = near_copies.groups(rows.select(row, "text"), row).join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item; texts without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents", n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's choice, row by row; rows without language or source are leaves of their own."""
    rows, row = _numbered(docs)
    chosen = mixing.mix(mixing.with_domain(rows), fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS, row=row).select(row)
    return rows.join(chosen, row, "left_semi").select(*_own(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, curve, shard and slot of every row; other columns are dropped."""
    return hilbert_shards.assign(docs, shards=SHARDS, law="rows").select("doc_id", "lang", "source", "size", "text_crc32", "curve", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: the first stages train a model and follow links of fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
