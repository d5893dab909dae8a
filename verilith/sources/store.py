"""Containers as folders of Parquet tables, and tables as source documents."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T
from verilith.operators import containers as C
from verilith.options import ChunkOptions

TABLES = ("lines", "chunks", "documents", "containers")


def source(df: DataFrame, text: str = "text", doc_id: str = "doc_id", container: Column | None = None, seq: Column | None = None) -> DataFrame:
    """(container_id, doc_seq, doc_id, text); by default every document is its own container."""
    own = F.col(doc_id).cast("string")
    return df.select((own if container is None else container.cast("string")).alias("container_id"), (F.col(doc_id) if seq is None else seq).cast("bigint").alias("doc_seq"), own.alias("doc_id"), F.col(text).alias("text"))


def text_files(spark: SparkSession, path: str, container_id: str, prefix: str = "") -> DataFrame:
    """Whole files in the order of their names, one container; ids are prefix and name."""
    files = spark.read.format("binaryFile").load(path)
    bad = files.where(~F.is_valid_utf8(F.col("content").cast("string")))
    if not bad.isEmpty():
        raise EvidenceError("invalid_utf8")
    rows = files.select(F.lit(container_id).alias("container_id"), F.concat(F.lit(prefix), F.element_at(F.split("path", "/"), -1)).alias("doc_id"), F.col("content").cast("string").alias("text"))
    names = rows.select("doc_id").withColumn("doc_seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("doc_id")).cast("bigint") - 1)  # names alone, not texts
    return rows.join(names, "doc_id").select("container_id", "doc_id", "text", "doc_seq")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share, ``spark.checkpoint.dir``; only on one machine a temporary one will do."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise EvidenceError("no_shared_folder", "set spark.checkpoint.dir")
        place = tempfile.mkdtemp(prefix="shared-")
    return f"{place}/{name}-{uuid.uuid4().hex}"


@dataclass
class Tables:
    lines: DataFrame
    chunks: DataFrame
    documents: DataFrame
    containers: DataFrame


def pack(src: DataFrame, options: ChunkOptions = ChunkOptions(), level: int = 3, payload: bool = True) -> Tables:
    """The four tables of all containers of a source."""
    if not C.duplicate_ids(src).isEmpty():
        raise EvidenceError("duplicate_document_id")
    docs = C.placed(src)
    lines = C.lines(docs)
    plan = chunks = C.chunk_plan(lines, options)
    step = options.maximum
    if payload:
        content = C.chunk_bytes(lines, plan, step)
        chunks = C.joined(plan, C.compressed(content, level), ["container_id", "chunk_id"])
    documents = C.document_index(docs, plan, step)
    return Tables(lines, chunks, documents, summary(docs, documents))


def summary(docs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row for each container, of placed documents.

    A CR that ends one document and a LF that begins the next are one CRLF.
    content_checksum is the checksum of the checksums of groups of documents
    (by ranges of doc_seq), each the checksum of its documents' checksums in
    order; so neither a container's text nor its list of checksums ever has to
    come together in one place.
    """
    size = F.col("byte_length")
    rows = C.carried(docs.select("container_id", "doc_seq", "byte_length", "feeds", "crlf", F.col("starts_with_feed").alias("starts"), F.col("last_char").alias("ends"), F.col("checksum").alias("c")), ["container_id"], "doc_seq", F.col("ends"), "before")
    both = F.col("crlf") + F.when(F.col("starts") & (F.col("before") == "\r"), 1).otherwise(0)
    parts = F.sort_array(F.collect_list(F.struct("doc_seq", "c")))
    group = F.floor(F.col("doc_seq") / C.GROUP)
    some = rows.groupBy("container_id", group.alias("g")).agg(F.sum("byte_length").alias("size"), F.count("*").alias("n"), F.sum("feeds").alias("feeds"), F.sum(both).alias("crlf"), F.max(F.when(size > 0, F.struct("doc_seq", "ends"))).alias("last"), F.sha2(F.array_join(parts["c"], ""), 256).alias("c"))
    digests = F.sort_array(F.collect_list(F.struct("g", "c")))
    feeds, total = F.sum("feeds"), F.sum("size")
    return some.groupBy("container_id").agg(total.alias("original_size"), F.sum("n").alias("document_count"), (feeds + F.when((total > 0) & (F.max("last")["ends"] != "\n"), 1).otherwise(0)).alias("line_count"), T.newline_mode(feeds, F.sum("crlf")).alias("newline_mode"), F.sha2(F.array_join(digests["c"], ""), 256).alias("content_checksum"))


def store(src: DataFrame, folder: str, options: ChunkOptions = ChunkOptions(), level: int = 3) -> None:
    """``save(pack(src, options, level), folder)``, each table from those that are written already, so a text is placed and cut once.

    Lines lie in the order of their places within files, but not by ranges of
    places over files, which would move all text once more.
    """
    spark = src.sparkSession
    if not C.duplicate_ids(src).isEmpty():
        raise EvidenceError("duplicate_document_id")
    docs = C.placed(src)
    C.lines(docs).sortWithinPartitions("container_id", "line_no").write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    C.chunk_plan(lines, options).write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    packed = C.compressed(C.chunk_bytes(lines, plan, options.maximum), level)
    chunks = C.joined(plan, packed, ["container_id", "chunk_id"])
    chunks.sortWithinPartitions("container_id", "logical_offset").write.parquet(f"{folder}/chunks")
    documents = C.document_index(docs, plan, options.maximum)
    _write(documents, folder, "documents", ["doc_id"])
    _write(summary(docs, documents), folder, "containers", ["container_id"])


def _write(rows: DataFrame, folder: str, name: str, order: list[str]) -> None:
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{name}")


def save(tables: Tables, folder: str) -> None:
    """Write the tables, each sorted by what it is looked up by."""
    for name, order in zip(TABLES, (["container_id", "line_no"], ["container_id", "logical_offset"], ["doc_id"], ["container_id"])):
        _write(getattr(tables, name), folder, name, order)


def load(spark: SparkSession, folder: str) -> Tables:
    return Tables(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))
