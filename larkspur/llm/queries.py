"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import mixing
from larkspur.llm.oracles import ORACLE_SQL
from larkspur.sources.tables import table

#: Fixed values of the url filter's contract: (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.url_templates import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches the index for every row whose vec_id is divisible by 100."""
    from larkspur.llm.nearest import build, search

    indexed, index = build(table(spark, sf_dir, "embeddings"))
    return search(indexed, index, F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.simhash import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fingerprints within three bits of those of the documents whose doc_id is divisible by 20."""
    from larkspur.llm.simhash import as_hex, fingerprints, neighbouring_prints
    from larkspur.sources.tables import materialise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    prints = materialise(fingerprints(docs, ["doc_id", "_row"], "text").select("doc_id", "fingerprint"))
    found = neighbouring_prints(prints, prints.where("doc_id % 20 = 0"))
    return found.select(as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("near")).alias("near"), "distance", "n_asked", "n_docs", "least_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.kd_clusters import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.quality import judge_quality

    scored = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op1_url_filter SQL can express: hosts, paths and the rules' own verdicts."""
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7_simhash SQL can express: sizes and edited texts."""
    return op7_simhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_near_duplicates, op3_repeats, op4_token_counts, op5_nearest, op6_toxicity, op7_simhash, op8_mixing, op9_language_id, op10_packing, op11_kd_clusters, op12_vector_codes, op13_quality, simhash_neighbours, url_rules, edited_texts)}
