"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .hosts import TWO_LABEL_SUFFIXES, WORSE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .descent import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.95).select("vec_id", "n_links", "component_id", "kept")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score

    return score(table(spark, sf_dir, "documents"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op4_lpf_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import drop_repeated_bytes

    out = drop_repeated_bytes(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse

    return collapse(table(spark, sf_dir, "conversations"))


def op6_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal import fit, grades_from_labels, severity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades_from_labels(table(spark, sf_dir, "labels")))
    return severity(docs, model).select("doc_id", "severity", "p_toxic", "toxic")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import contamination

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "contaminated")


#: (action, host and beginning of the path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hosts import judge

    # The tables hold no outcomes of pages: the label with the page's number stands for them.
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    return judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)


def op10_superkmer_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import drop_repeated_windows

    out = drop_repeated_windows(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restore

    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{to}_sha256") for c, to in (("output", "output"), ("restored", "restored"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lengths import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dualtree import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_minmax_near_dedup": op3_minmax_near_dedup,
    "op4_lpf_substring_dedup": op4_lpf_substring_dedup,
    "op5_snapshot_collapse": op5_snapshot_collapse,
    "op6_swap_packing": op6_swap_packing,
    "op7_ordinal_toxicity": op7_ordinal_toxicity,
    "op8_string_tiling": op8_string_tiling,
    "op9_host_reputation": op9_host_reputation,
    "op10_superkmer_substring_dedup": op10_superkmer_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_dual_tree_search": op13_dual_tree_search,
}
ORACLE: dict[str, str] = {
    "op1_nn_descent": oracles.LINKS,
    "op4_lpf_substring_dedup": oracles.REPEATS,
    "op3_minmax_near_dedup": oracles.MINHASH,
    "op5_snapshot_collapse": oracles.COLLAPSE,
    "op9_host_reputation": oracles.hosts(RULES, TWO_LABEL_SUFFIXES, WORSE),
    "op10_superkmer_substring_dedup": oracles.SUPERKMER,
    "op11_fill_in_middle": oracles.MIDDLE,
    "op13_dual_tree_search": oracles.SEARCH,
}
