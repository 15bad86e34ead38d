"""The thin opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, neighbours, packing, quality, secrets, simhash, substrings, toxicity, urls
from .common import table
from .labelled import fold


URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def tokenizer() -> dict[str, str]:
    """The public tokenizer files that the queries use."""
    import public_tokenizers as files

    return {"tokenizer_path": files.path("byte_bpe_50k.json"), "ranks_path": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer()).drop("ids")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document, as a digest."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every vector whose id is divisible by 50."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds within the error budget."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secret spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.sha2(secrets.joined(secrets.KINDS[:3]), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined().alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the fold of remainder 0 takes no part in the fit."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held_out = fold("doc_id", quality.FOLDS) == quality.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the fold of remainder 2 takes no part in the fit."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": urls.oracle_sql(URL_RULES),
    "op3_substring_dedup": substrings.oracle_sql(),
}
