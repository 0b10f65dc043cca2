"""A corpus pipeline in five stages, each written and read again by the next.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. ``run`` applies them to the documents table and cuts the lineage
between stages with tables in the shared checkpoint folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrack.llm.bpe import encode_and_decode, token_digests
from veritrack.llm.language import UNDETERMINED, fit_languages, identify_languages
from veritrack.llm.mixing import mix_sources
from veritrack.llm.near_dup import minhash_near_duplicates
from veritrack.llm.quality_knn import fit_quality, score_quality
from veritrack.plans.lineage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Moves and pieces that the last stage's workers remember: they hold the models of the stages before it too.
MOST_MOVES, MOST_PIECES = 400_000, 400_000
#: Documents whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: with whole texts of any length, a batch's bytes are what bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language; ``lang`` becomes the predicted one.

    Every row is judged by itself, one with a null or repeated id too. Null and
    empty texts have no language and go; other nulls stay. Columns beyond those of
    documents are left out. An empty table stays empty.
    """
    _small_batches(spark)
    found = identify_languages(docs.select(*COLUMNS), fit_languages(docs), carry=True)
    sure = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the neighbours' votes find good.

    Every row is judged by itself, one with a null or repeated id too; null and
    empty texts get the undecided score and stay. An empty table stays empty.
    """
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs.select(*COLUMNS), fit_quality(docs, labels), carry=True).where("predicted = 1").select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    Of rows that repeat an id one stays. Rows with a null id can't be named in
    a group and stay. Texts without words link with nothing and stay.
    """
    _small_batches(spark)
    kept = minhash_near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)
    return named.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights.

    Null sources and languages are in the cell of other values; a null id is
    never sampled, as no chance can be drawn for it. An empty table stays empty.
    """
    return mix_sources(docs).where("sampled").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes; a null text has none."""
    _small_batches(spark)
    encoded = encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, MOST_MOVES, MOST_PIECES)
    return token_digests(encoded)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can express neither the trained stages nor the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
