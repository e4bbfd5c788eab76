"""The registered queries of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltrail.llm.base import read
from calltrail.llm.filter_audit import SQL as SQL12
from calltrail.llm.suffix_match import SQL as SQL11


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import near_dup
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import quality_net
    docs = read(spark, sf_dir, "documents")
    return quality_net.classify(docs, quality_net.train(docs, read(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import quality_gbt
    docs = read(spark, sf_dir, "documents")
    return quality_gbt.judge(docs, quality_gbt.train(docs, read(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import secrets
    docs = read(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(docs))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import topk
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import spans
    return spans.deduplicated(read(spark, sf_dir, "documents"))


def op7_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import ppm
    return ppm.score(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm.packing import pack_documents
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
                          with_ids=False)


def op9_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import pieces
    return pieces.encode_n_best(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import toxicity
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import suffix_match
    found = suffix_match.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("longest_words", "longest_at", "longest_item")  # the oracle's columns


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import filter_audit
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calltrail.llm import spelling
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_quality_net": op2_quality_net,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_top_k": op5_top_k,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_ppm_score": op7_ppm_score,
    "op8_packing": op8_packing,
    "op9_n_best_pieces": op9_n_best_pieces,
    "op10_toxicity": op10_toxicity,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE: dict[str, str] = {"op11_decontamination": SQL11, "op12_filter_audit": SQL12}
