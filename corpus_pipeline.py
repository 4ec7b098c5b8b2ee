"""A corpus from documents to a mix: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last adds ``copy``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, jaccard_join, langid, line_dedup, mixing
from strandline.llm.common import shared_dir, table

#: A document is rejected if no language has this part of its n-grams.
LEAST_COVER = 0.2
#: Near duplicates share this part, in hundredths, of their shingles of so many words.
NEAR_WORDS = 5
NEAR_HUNDREDTHS = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the others (no letter, or n-grams of no known language) go."""
    judged = langid.predict(docs, langid.learn(docs))
    return judged.where((F.col("lang_pred") != langid.UND) & (F.col("lang_cover") >= LEAST_COVER)).select(docs.columns)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that occurred earlier; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("lines_removed") == 0) | (F.col("text") != ""))
    changed = F.col("lines_removed") > 0
    return left.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that with the smallest
    id. Rows without an id stay; of rows with the same id and text one stays."""
    judged = jaccard_join.jaccard_components(docs, n=NEAR_WORDS, hundredths=NEAR_HUNDREDTHS).where("doc_id is not null")
    kept = judged.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).alias("kept")
    out = docs.alias("own").join(kept, F.col("own.doc_id") == F.col("kept.doc_id"))
    own = [F.col(f"own.`{c}`") for c in docs.columns]
    once = out.where("kept.n = 1").select(own)
    again = out.where("kept.n > 1").select(own).dropDuplicates(["doc_id", "text"])
    return once.union(again).union(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy`` from 1."""
    out = mixing.systematic_mix(docs)
    numbered = out.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))))
    return numbered.select(*docs.columns, "copy")


STAGES = [("language_id", language_id), ("line_dedup", line_copies), ("jaccard_join", near_duplicates), ("decontaminate", decontaminated), ("mix", mixed)]

#: Language ID can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
