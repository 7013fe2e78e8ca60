"""A corpus through quality, near duplicates, benchmark passages, personal data and tokens, each step on all that the one
before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents:

- quality: documents that the classifier scores under 0.3 go;
- near_duplicates: one document of each group of near copies stays, the one of the smallest doc_id;
- decontamination: the words inside benchmark passages are cut out of a text;
- personal_data: every span found is replaced by its kind in brackets;
- tokens: ids of the text, their number, and whether they decode to it.

n_chars follows the text. No stage is expressible in SQL as a whole, so ORACLE_SQL is None; tests hold each stage against
a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, pii, quality, sentencepiece_fst, simhash
from quarryline.llm.common import delete, shared_folder


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate.remove_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(pii.redact(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_checked(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", cut_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("tokens", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written in the shared folder and read again, and go when the next one's
    are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
