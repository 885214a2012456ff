"""A training-corpus pipeline over the ``documents`` table: five stages, each
an operator of ``quarry.llm``, each written as Parquet and read again as the
next one's input.

1. ``quality``: the quality classifier; documents it rejects go.
2. ``near_duplicates``: the n-gram Jaccard join; of each group of linked
   documents that with the smallest doc_id stays (one row of it).
3. ``decontaminate``: documents that hold a passage of ``benchmark`` go.
4. ``pii``: personal data in texts is masked; ``n_chars`` follows the text.
5. ``pack``: documents become pieces of packed token sequences.

The first four return the columns of ``documents``; the last returns the
columns of ``pack`` (doc_id, piece, start, length, ids_crc32, sequence_id,
offset) and the piece's token ids. Null ids and texts, repeated rows, clashing extra columns and empty
tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate as decontamination
from quarry.llm import jaccard_join, packing, pii, quality as quality_classifier
from quarry.llm.common import new_folder, table
from quarry.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; Python workers see this repository (on a
    cluster the package comes with ``--py-files``)."""
    root, env = os.path.dirname(os.path.abspath(__file__)), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.kept(_ready(spark, docs), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(_ready(spark, docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(_ready(spark, docs), table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _ready(spark, docs)
    masked = pii.redact(docs, pii.Model(pii.fit(docs)))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_ready(spark, docs), tokenizer_path(), keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("pii", mask_pii), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Classifier, message passing and tokenizer cannot be told in SQL; the stages
#: are tested against brute-force versions.
ORACLE_SQL = None
