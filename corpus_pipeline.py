"""A corpus from documents: languages, near-duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as
Parquet in the folder that driver and executors share, and read again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domframe.llm import langid, minhash, mixing, pieces
from domframe.llm.common import cut, remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language has been found in it, or none that half stands out among the learned ones.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the byte network finds one of the languages it has learned; und and lower scores go."""
    found = langid.predict(docs.select(*COLUMNS), langid.learn(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    A row without doc_id gets one from its text for this stage.  Of rows that repeat both id and text one stays.
    """
    own = F.coalesce("doc_id", -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    rows = docs.select(*COLUMNS).withColumn("_id", own)
    found = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), words=5, percent=80)
    stay = cut(found.where("kept").groupBy(F.col("doc_id").alias("_id")).count())
    kept = rows.join(stay, "_id")
    if not stay.where("count > 1").isEmpty():
        turn = Window.partitionBy("_id", F.xxhash64("text")).orderBy(*(F.col(c).asc_nulls_last() for c in COLUMNS))
        again = kept.where("count > 1").withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")
        kept = kept.where("count = 1").unionByName(again)
    return kept.select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, a hash of the ids, and whether decoding them gives the text back."""
    done = pieces.encode_and_decode(docs.select("doc_id", "source", "text"))
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language ID", language_stage), ("MinHash near-dedup", near_duplicate_stage), ("mixing sources", mixing_stage), ("SentencePiece", token_stage)]

#: Language and tokens come from models, which SQL can't express; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents; a stage's files go once the next one has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
