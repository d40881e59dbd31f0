"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from lakeweave.llm.common import scratch_dir
from lakeweave.sources.io import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows of ``docs``, rejects go; clean ones stay as they are.

    Each row is judged by its text alone: null, empty and blank texts stay, null and repeated ids
    play no part, and without labels of both kinds nothing goes. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null id only where no other row has the text.

    Null text counts as empty. Different texts under one id, or none, all stay; of rows with one
    id and text one stays. Columns of any name stay as they are. An empty table gives no rows.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8) the row with the smallest doc_id stays; a null id only where no row of the component has another.

    Null, empty and blank texts are like nothing and stay. Different texts under one id, or none,
    are told apart; of rows with one id and text one stays. Columns of any name stay as they are.
    An empty table gives no rows.
    """
    return ngram_join.drop_near_copies(docs, n=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 200 bytes or more that occur elsewhere too are cut out of the texts, in whole characters; all rows stay, n_chars is of the new text.

    A null text becomes empty. Null and repeated ids play no part; repeated rows are each other's
    copies. Columns of any name stay. An empty table gives no rows.
    """
    from pyspark.sql import functions as F

    cut = suffix_dedup.cut_repeats(docs, window=200)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are the single last id; repeated rows and null ids are packed each. An
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack)]

#: Models, suffix structures and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each one's result is written and read again.

    What stages write below ``spark.checkpoint.dir`` stays there, as the result is read from it;
    call ``lakeweave.scratch.clear_scratch`` once that is written elsewhere.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
