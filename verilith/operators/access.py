"""Exact reads of byte ranges, lines and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T


def cut_bytes(content: Column, low: int | Column, length: int | Column) -> Column:
    """Bytes [low, low + length) of binary content."""
    low = F.lit(low) if isinstance(low, int) else low
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(content, (low + 1).cast("int"), length.cast("int"))


def checked(size: int, low: int, length: int) -> None:
    if low < 0 or length < 0 or low + length > size:
        raise EvidenceError("logical_range_out_of_bounds", f"{low} + {length} of {size}")


def read_range(chunks: DataFrame, container_id: str, low: int, length: int) -> bytes:
    """Bytes of a container whose chunk table has ``bytes``; just the chunks in range are read."""
    own = chunks.where(F.col("container_id") == container_id)
    size = own.agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0))).first()[0]
    checked(size, low, length)
    if not length:
        return b""
    hit = own.where((F.col("logical_offset") < low + length) & (F.col("logical_offset") + F.col("uncompressed_size") > low))
    parts = hit.select("logical_offset", "bytes").orderBy("logical_offset").collect()
    whole = b"".join(bytes(p["bytes"]) for p in parts)
    start = low - parts[0]["logical_offset"]
    return whole[start : start + length]


def range_metrics(chunks: DataFrame, low: int, length: int) -> DataFrame:
    """For each container, what reading [low, low + length) takes: chunks and bytes decoded."""
    hit = (F.col("logical_offset") < low + length) & (F.col("logical_offset") + F.col("uncompressed_size") > low) & F.lit(length > 0)
    return chunks.groupBy("container_id").agg(F.sum("uncompressed_size").alias("size"), F.sum(hit.cast("bigint")).alias("decoded_chunks"), F.sum(F.when(hit, F.col("uncompressed_size")).otherwise(0)).alias("decoded_bytes")).where(F.col("size") >= low + length).drop("size")


def read_text_range(chunks: DataFrame, container_id: str, low: int, length: int) -> str:
    try:
        return read_range(chunks, container_id, low, length).decode()
    except UnicodeDecodeError:
        raise EvidenceError("invalid_utf8_boundary") from None


def read_range_verified(chunks: DataFrame, container_id: str, low: int, length: int, sha256: str) -> bytes:
    import hashlib

    found = read_range(chunks, container_id, low, length)
    if hashlib.sha256(found).hexdigest() != sha256:
        raise EvidenceError("verified_checksum_mismatch")
    return found


def read_lines(lines: DataFrame, container_id: str, first: int, last: int) -> list[str]:
    """Lines first to last, both counted from 0 and within; a missing one is an error."""
    found = lines.where((F.col("container_id") == container_id) & F.col("line_no").between(first, last)).orderBy("line_no").select("line").collect()
    if len(found) != last - first + 1:
        raise EvidenceError("line_out_of_range", f"{first} to {last}")
    return [r["line"] for r in found]


def read_document(documents: DataFrame, doc_id, verify: bool = True) -> str:
    """A document of a table with (doc_id, text, checksum)."""
    found = documents.where(F.col("doc_id") == doc_id).select("text", (T.checksum(F.col("text")) == F.col("checksum")).alias("ok")).limit(1).collect()
    if not found:
        raise EvidenceError("document_not_found", str(doc_id))
    if verify and not found[0]["ok"]:
        raise EvidenceError("verified_checksum_mismatch", str(doc_id))
    return found[0]["text"]


def export(chunks: DataFrame, container_id: str):
    """The container's bytes chunk by chunk; the driver holds one partition at a time."""
    for row in chunks.where(F.col("container_id") == container_id).orderBy("chunk_id").select("bytes").toLocalIterator():
        yield bytes(row["bytes"])
