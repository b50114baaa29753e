"""From raw documents to packed training sequences: quality, near-duplicates, personal data, mix, packs.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.

In all stages rows are told apart as rows, so ids may be null or repeat, and docs may have any other columns, also ones named like
those that the operators add: they come back as they were. Repeated rows are rows like others (the
near-duplicate stage keeps one of them). A stage over an empty table gives an empty table. Texts are taken as a whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import minhash, mixing, packing, pii, quality
from linkloom.llm.runtime import Scratch, scope, small, unused


def _lengths(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage changes it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of 0.7 or more, learned from labels that aren't held out.

    Null and empty texts have the score of the labels' prior, and so stay or go with it. Without labels all scores are 0.5 and
    no document stays. Equal texts have equal scores.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    score = unused(docs, "_score")
    scored = quality.score(docs, quality.fit(docs, labels), column=score)
    return scored.where(F.col(score) >= 0.7).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a similarity of 0.8 or more of five-word shingles: the one with the smallest
    id (null ids last), of rows that share it any one.

    Texts without words, null ones too, are in no group and stay. Groups are of rows, told apart by a key that is written
    with them, so rows that share an id but not a text are judged by their texts.
    """
    scratch, key = Scratch(spark, "once"), unused(docs, "_row_key")
    keyed = scratch.table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = minhash.near_duplicate_groups(keyed.select(key, "text"), k=5, percent=80, id_col=key)
    groups = scratch.table(groups.select(F.col(key).alias("k"), F.col("component_id").alias("c")), "groups")
    members = groups.join(groups.where("k <> c").select("c").distinct(), "c")  # groups of one have no more rows
    members = members.join(keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")), "k")
    first = members.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "k"))["k"].alias("first"))
    dropped = members.join(first, "c").where("k <> first").select(F.col("k").alias(key))
    return keyed.join(small(scratch.table(dropped, "dropped")), key, "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that would reveal it, in all texts; keeps all rows. Null and empty texts stay."""
    return _lengths(pii.sanitise(docs)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150% of all words, sources weighing as their size to the power 0.8, each at most twice; a row for each repetition.

    Texts without words, null ones too, have no repetition. A null source is one of its own. Which documents are in a
    fractional repetition is told by a seeded hash of the id, so reruns agree.
    """
    prefix = unused(docs, "_mixed_")
    mixed = mixing.mix(docs, lambda names, sizes: [float(n) ** 0.8 for n in sizes], share=1.5, cap=2.0, prefix=prefix)
    return _lengths(mixing.repeat_texts(mixed, prefix=prefix)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in sequences of at most 2048: a row for each piece. Null and empty texts are the end id only."""

    def tokenizer():
        import public_tokenizers

        return packing.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"), end_id=1)

    return packing.pack(docs, tokenizer, length=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, signatures and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scope():  # what a stage has written for itself goes with it
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
