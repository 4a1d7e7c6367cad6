"""A training corpus from ``documents``: identify the language, drop repeated lines, keep
one of each group of near-duplicates, drop documents that hold benchmark items, and pack
what is left into sequences.

All stages but the last return the columns they got. Rows without doc_id, or that share one,
are documents of their own; rows that repeat doc_id and text stay or go together. Null and
empty texts have no language, so the first stage drops them; a stage that is called alone
keeps them (``one_of_each`` one of them) unless its own docstring says otherwise. Empty tables
give empty results.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, language, line_dedup, near_dedup, packing
from keyloom.llm.common import collected, release, shared_dir, table

#: Scratch tables of the stage before (of this thread), whose result has been written when
#: the next one begins.
_before: ContextVar[tuple[str, ...]] = ContextVar("keyloom_stage", default=())


@contextmanager
def _stage(spark: SparkSession):
    release(spark, _before.get())
    _before.set(())
    with collected() as paths:
        yield
    _before.set(tuple(paths))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without ambiguity; those without letters go, null
    texts included. The ``lang`` of a row is never looked at, but to learn."""
    with _stage(spark):
        model = language.train(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
        out, name = language.identify(docs, model)
    return out.where((F.col(name).lang != language.UNKNOWN) & ~F.col(name).ambiguous).drop(name)


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; those left without a word go, null
    texts included. n_chars is counted anew."""
    with _stage(spark):
        out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.coalesce(F.btrim("text", F.lit(" \t\r\n\u000b\f")), F.lit("")) != "")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near-duplicates; null texts are one
    class with the empty ones."""
    with _stage(spark):
        out = near_dedup.dedup(docs)
    return out


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none."""
    with _stage(spark):
        out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; a null text is a
    document of the end id alone."""
    import public_tokenizers

    with _stage(spark):
        out = packing.packed(docs, public_tokenizers.path(packing.TOKENIZER))
    return out


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fewer_lines),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", sequences),
]

#: Codewords, signatures, fingerprints and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read
    again as the next one's input, and removed once that is written in turn."""
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES:
        path = os.path.join(shared_dir(spark), f"keyloom-stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if held:
            release(spark, [held])
        held = path
    release(spark, _before.get())
    _before.set(())
    return docs
