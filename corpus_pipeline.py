"""From raw documents to token files: five stages, each an operator of lodestrata.llm.

Each stage is called with what its predecessor left, as read again from Parquet, and keeps whole rows of it; the last one
returns the digests of the token files. Rows with one identifier and one text are copies of each other, of which the second
stage leaves one. Columns of the table may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate as benchmark_words
from lodestrata.llm import quality as classifier
from lodestrata.llm.common import save, shuffle_partitions
from lodestrata.llm.mix import mix_sources
from lodestrata.llm.ngram_join import ngram_join
from lodestrata.llm.token_files import token_digests, write_tokens
from lodestrata.llm.windows import document_number

#: Documents scored lower go.
LEAST_SCORE = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table hasn't got."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = _free(docs, "quality_score")
    return classifier.score(docs, model, out=out).where(F.col(out) >= LEAST_SCORE).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that with the smallest identifier; of repeated rows any one."""
    number, mark = _free(docs, "number"), _free(docs, "mark")
    stay = ngram_join(docs).where("kept").select(F.col("number").alias(number), F.col("mark").alias(mark)).distinct()
    told = docs.withColumns({number: document_number("doc_id", "text"), mark: F.xxhash64(F.col("text").cast("string"))})
    return told.join(stay, [number, mark], "left_semi").dropDuplicates([number, mark]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are contaminated by benchmark items."""
    key = _free(docs, "key")
    found = benchmark_words.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = save(found.where("contaminated").select(F.col("row").alias(key)), "contaminated")
    return docs.withColumn(key, benchmark_words.text_key("doc_id", "text")).join(gone, key, "left_anti").drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents into the order that mixes the sources by their target weights; the files keep that order."""
    number, position = _free(docs, "number"), _free(docs, "position")
    numbered = docs.withColumn(number, document_number("doc_id", "text"))
    place = mix_sources(numbered, id_col=number).groupBy(F.col("doc_id").alias(number)).agg(F.min("position").alias(position))
    placed = numbered.join(place, number).repartitionByRange(shuffle_partitions(spark), position)
    return placed.sortWithinPartitions(position).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in the order of the files read (documents from elsewhere: of doc_id) and return what they hold."""
    try:
        order = [_free(docs, "file"), _free(docs, "index")]
        docs = docs.select("*", F.col("_metadata.file_name").alias(order[0]), F.col("_metadata.row_index").alias(order[1]))
    except AnalysisException:
        order = ["doc_id"]
    return token_digests(spark, write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), order=order))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing to weights", mix), ("token files", tokens)]

#: A classifier, a probabilistic pruning, a scheduler and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, "stage")
    return docs
