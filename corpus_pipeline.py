"""Documents to token ids: language, repeated lines, near duplicates, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilith.llm import bpe, langid, linededup, minhash, mixing
from verilith.llm.common import fresh, kept, quoted, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language that was found in ``lang``; those without one go.

    Null texts, texts without a letter and those with too narrow a margin have
    none.  All other columns stay as they are, whatever they are called.
    """
    name = fresh(docs.columns, "language")
    found = langid.identify(docs, langid.dictionaries(docs), output=name).where(quoted(name).isNotNull())
    return found.select(*[quoted(name).alias(c) if c == "lang" else quoted(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines go, and documents of which nothing is left.

    Lines are compared whole here: by clauses, near copies would be cut to
    scraps, in which the next stage finds no copies.  Texts that were empty
    before stay; ``n_chars`` is the new length, null for null texts.
    """
    name = fresh(docs.columns, "removed")
    short = linededup.dedup_lines(docs, count=name).where((quoted(name) == 0) | (F.col("text") != ""))
    return short.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id, null ids last; null texts all stay."""
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as there were, sources weighted by the root of their characters; null sources are one of their own, null texts go."""
    return mixing.mix_sources(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding; null where the text is."""
    return bpe.encode_documents(docs).select("doc_id", "lang", "source", "n_chars", "token_ids")


STAGES = [
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Compression, signatures and byte-pair merges can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` of a folder; each stage's result is kept as Parquet.

    Nulls may be in any column; texts may be empty or of any length; equal
    rows count as one document until the mixture, which may take a document
    more than once; an empty table gives an empty one; further columns go
    through all stages but the last and may have any name.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, name.replace(" ", "-"))
    return docs
