"""A training corpus from raw documents: toxicity filter, near-dedup, substring dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm._store import Store, small
from cantus.llm.minhash import near_duplicates
from cantus.llm.ordinal import fit, grades_from_labels, severity
from cantus.llm.packing import pack
from cantus.llm.superkmer import drop_repeated_windows
from cantus.llm.tiling import contamination

#: Words of a repeated window, and tokens of a packed sequence.
WINDOW, CAPACITY = 20, 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model calls toxic; it is fitted on labelled documents."""
    model = fit(docs, grades_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return severity(docs, model).where("not toxic").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies (five-word shingles, similarity 0.8).

    Different texts of one id are documents of their own, which have negative keys here; of rows that repeat an id and a
    text one stays. Rows with a null id are in no group and stay.
    """
    store = Store(spark)
    content = F.xxhash64("text")
    several = store.save(docs.groupBy("doc_id").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b and doc_id is not null").select("doc_id", F.lit(True).alias("_again")))
    own = -1 - F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1)
    keyed = docs.join(small(several, several.count(), 16), "doc_id", "left").withColumn("_key", F.when(F.col("_again"), own).otherwise(F.col("doc_id")))
    judged = store.save(near_duplicates(keyed.select("_key", "text"), threshold=0.8, id_col="_key"))
    gone = store.save(judged.where("not kept").select(F.col("doc_id").alias("_key")).distinct())
    out = keyed.join(small(gone, gone.count(), 40), "_key", "left_anti")
    again = store.save(judged.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_key")))
    n = again.count()
    if n:
        again = small(again, n, 40)
        out = out.join(again, "_key", "left_anti").unionByName(out.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return out.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out words of windows that also start earlier in the corpus; n_chars follows. Rows with a null id stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = drop_repeated_windows(docs, window=WINDOW, carry=others)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover most of a benchmark item."""
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece of a document, those with a null id included."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=CAPACITY, null_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Not expressible in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, store.save(stage(spark, docs, sf_dir))
        if k:
            store.drop(before)
    return docs
