"""Documents to training tokens: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes the documents that the one before it kept, and all but the last return the columns of ``documents``.  Between stages
the documents are written and read again.  Rows without an id pass the stages that compare documents by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm import byte_bpe, decontamination, line_dedup, quality_model, queries, simhash
from gridweft.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    trees = queries.quality_trees(docs, queries.table(spark, sf_dir, "labels"))
    scored = docs.withColumn("score", quality_model.score(queries.text_of(docs), trees))
    return scored.filter(F.col("score") >= quality_model.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines that stand earlier too."""
    edited = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return edited.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that the SimHash operator connects (3-word shingles, at most 3 bits apart)."""
    docs = docs.select(*COLUMNS)
    copies = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontamination.contamination(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and a hash of what they decode to."""
    vocabulary = public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.PATTERN
    both = docs.select("doc_id", byte_bpe.round_trip(queries.text_of(docs), *vocabulary).alias("r")).select("doc_id", "r.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
