"""A training-data pipeline over ``documents``: quality rules, near duplicates, repeated passages, source mixing, token ids.

``run`` applies ``STAGES`` in turn; each stage's result is written to the shared folder and read again as the next stage's input,
so a lost executor repeats one stage at most.  What a stage wrote on its way goes once its result is written.

Defined cases of all stages: null, empty and repeated rows are decided as the operators' docstrings say (a null or empty text is rejected
by the first stage); texts of any length are used whole; an empty table gives an empty table; other columns than the stage needs
are carried through whatever their names, and rows of one ``doc_id`` with different texts are documents of their own.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, mixing, near_dup, quality_rules, scratch, substring_dedup
from skarn.llm.registry import WEIGHTS

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: Bytes of an Arrow batch that goes to a Python worker; the default lets two tasks of an executor hold several hundred MB in batches of texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def small_batches(stage):
    """A stage whose texts travel in small Arrow batches; a session that asks for smaller ones keeps its setting."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark.conf.get(BATCH).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a rule rejects, those with null or empty texts among them; repeated rows share their verdict."""
    return quality_rules.keep_good(docs)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of near duplicates; a repeated row stays with its twin, rows without id come last."""
    return near_dup.keep_first(docs)


@small_batches
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that occur earlier; documents that lose all their words go.  ``n_chars``, where there is one, follows the new text."""
    cut = substring_dedup.cut(docs).where("n_removed = 0 OR n_removed < n_words")

    def column(name: str):
        old = F.col("skarn_row").getField(name)
        if name == "n_chars":
            old = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(old)
        return F.col("text") if name == "text" else old.alias(name)

    return cut.select(*map(column, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents towards the target weights of their sources, and shuffles them; null is a source of its own."""
    return mixing.replicated(docs, WEIGHTS).select("skarn_row.*")


@small_batches
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit integers; none for a null one), and digests of them and of the decoded bytes."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("doc_id", "source"), decode=True)
    return coded.select("doc_id", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("source mixing", mixture),
    ("token ids", token_ids),
]

#: Near duplicates and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = scratch.Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch.cleared():
            docs = tables.write(stage(spark, docs, sf_dir), str(k))
        if k:
            tables.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
