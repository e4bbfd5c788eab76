"""A training-corpus pipeline over `documents`, one operator a stage.

STAGES: (name, function), each function (spark, docs, sf_dir) -> DataFrame.
A stage's result is written as Parquet and read again as the next one's docs,
so a lost executor repeats one stage at most.  All but the last return the
columns of their input; rows with a null text are empty documents, which
the first stage rejects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from calltrail.llm import near_dup, packing, quality_gbt, secrets, spans
from calltrail.llm.base import read
from calltrail.llm.queries import tokenizer_path
from calltrail.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  Documents that the base rules or the trees reject go."""
    model = quality_gbt.train(docs, read(spark, sf_dir, "labels"))
    return quality_gbt.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1.  Of each class the document with the least doc_id stays, as
    one row; rows without an id are classes of their own."""
    judged = near_dup.near_duplicates(docs).where("kept").where("doc_id is not null")
    judged = judged.groupBy("doc_id").agg(F.count("*").alias("__rows"))
    # the list grows with the corpus: a merge join at every size, never a broadcast
    found = docs.join(judged.hint("merge"), "doc_id").select(*docs.columns, "__rows")
    single = found.where("__rows = 1").drop("__rows")
    repeated = found.where("__rows > 1").drop("__rows").dropDuplicates(["doc_id"])
    return single.union(repeated).union(docs.where("doc_id is null"))


def sentence_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6.  Repeated sentence runs are cut out of the texts; a document
    of which nothing is left goes."""
    cut = spans.remove_repeats(docs)
    return cut.where("__removed < __sentences or __sentences = 0").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4.  Every span is replaced by [SECRET]."""
    return secrets.redacted(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8.  The pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("sentence_spans", sentence_spans),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Trained trees, signatures and token packing cannot be said in SQL; the tests
#: hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
