"""From raw documents to token ids: five stages, each over all that the one before has kept.

language ID (rejected documents go) -> line dedup -> n-gram Jaccard join (one document of each group stays) -> benchmark
decontamination -> byte-level BPE. Every stage is written as Parquet in the shared folder and read again. Stages that change
texts set n_chars, if the table has it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join
from auditloom.llm.common import recorded, swept, table, written

#: Folders of tables that earlier stages have written. What a stage's docs don't read goes as it begins: they are written and read again.
_LEFT: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = swept(docs, _LEFT)
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return run_stage


#: Columns that the operators add on their way; a table's own columns of these names are set aside meanwhile.
_ADDED = ("lang_pred", "score", "rejected", "n_lines", "n_removed", "n_words", "n_hit", "items", "clean_text")


def _set_aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    own = {c: f"__own_{c}" for c in docs.columns if c in _ADDED}
    return stage(docs.withColumnsRenamed(own)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


@_tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject: null texts and texts without a letter go. Rows and columns stay as they are."""
    return _set_aside(docs, lambda d: language_id.identify(d, language_id.corpus_model(d)).where(~F.col("rejected")))


@_tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages and chunks of lines that stand earlier; documents that lose every line go. Null texts and rows with a null doc_id lose nothing."""
    return _counted(_set_aside(docs, lambda d: line_dedup.without_repeated_lines(written(line_dedup.without_repeated_passages(d)))))


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id. Empty and null texts link with nothing; of rows that share an id one stays; rows with a null id stay."""
    return ngram_join.near_duplicates_removed(docs)


@_tidy
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go. Null and empty texts stay."""
    return _counted(_set_aside(docs, lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark"))))


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its text and their digests. Null and empty texts have no ids."""
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_bpe.round_trip(docs.select("doc_id", "text"), *args)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("byte_bpe", encode),
]

#: No SQL for language ID and BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with recorded() as paths:
                docs = written(docs)
            _LEFT.extend(paths)
    return docs
