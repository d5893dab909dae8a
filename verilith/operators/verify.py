"""Integrity in three levels, and a canonical record of it.

Findings are rows (container_id, rank, violation); the one of least rank is
the first error.  Ranks follow the order of checks: the chunk table, payloads,
then of each chunk its flag, decoding, size, checksum, UTF-8 and lines, then
the container's totals, then the document index.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T
from verilith.operators.access import cut_bytes
from verilith.operators.containers import chunk_violations, decompressed, joined, overlaps

LEVELS = ("quick", "normal", "deep")


def violations(chunks: DataFrame, documents: DataFrame | None = None, level: str = "deep", containers: DataFrame | None = None, step: int = 16 << 20) -> DataFrame:
    """Of stored chunks, with the columns of the plan and, from level normal on, of ``compressed``.

    quick checks the chunk table, normal also the payloads' checksums, deep
    also decoded bytes and their lines; with ``containers`` (the store's
    table) its totals, with ``documents`` (the document index) its bounds,
    chunk ranges, lines and checksums.  Chunks are decoded once for their own
    checks and once more for those of documents, which cut them.
    """
    if level not in LEVELS:
        raise EvidenceError("unknown_level", level)
    found = chunk_violations(chunks).select("container_id", F.lit(0).alias("rank"), "violation")
    if level == "quick":
        return found
    payload = (1, "compressed_chunk_checksum_mismatch", T.checksum(F.col("payload")) != F.col("compressed_checksum"))
    if level == "normal":
        return found.union(_listed(chunks, [payload]))
    text = F.col("bytes").cast("string")
    raw = decompressed(chunks).withColumn("feeds", T.feeds(text)).withColumn("crlf", T.crlf(text)).withColumn("closed", F.when(F.length("bytes") > 0, text.endswith("\n")))
    rules = [
        payload,
        (3, "chunk_decode_failed", F.col("bytes").isNull()),
        (4, "uncompressed_size_mismatch", F.octet_length("bytes") != F.col("uncompressed_size")),
        (5, "chunk_checksum_mismatch", T.checksum(F.col("bytes")) != F.col("uncompressed_checksum")),
        (6, "invalid_utf8", ~F.is_valid_utf8(text)),
        (7, "line_count_mismatch", T.line_count(text) - F.col("flags") != F.col("line_count")),
    ]
    slim = raw.select("container_id", "chunk_id", "uncompressed_size", "line_count", "flags", "feeds", "crlf", "closed", *[F.coalesce(c, F.lit(False)).alias(f"_{k}") for k, (_, _, c) in enumerate(rules)])
    # flags tell whether the chunk before ended within a line
    w = Window.partitionBy("container_id").orderBy("chunk_id")
    flag = (2, "flag_mismatch", F.col("flags") != F.when(F.lag("closed").over(w), 0).when(F.lag("chunk_id").over(w).isNull(), 0).otherwise(1))
    slim = slim.withColumn("_flag", F.coalesce(flag[2], F.lit(False)))
    found = found.union(_listed(slim, [(r, v, F.col(f"_{k}")) for k, (r, v, _) in enumerate(rules)] + [(2, "flag_mismatch", F.col("_flag"))]))
    if containers is not None:
        sums = slim.groupBy("container_id").agg(F.sum("uncompressed_size").alias("s"), F.sum("line_count").alias("l"), F.sum("feeds").alias("f"), F.sum("crlf").alias("c"))
        both = joined(containers, sums, ["container_id"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        totals = [(8, "total_size_mismatch", zero("s") != F.col("original_size")), (9, "total_line_count_mismatch", zero("l") != F.col("line_count")), (10, "newline_mode_mismatch", T.newline_mode(zero("f"), zero("c")) != F.col("newline_mode"))]
        if documents is not None:
            many = documents.groupBy("container_id").agg(F.count("*").alias("d"))
            both = joined(both, many, ["container_id"], "left")
            totals.append((11, "document_count_mismatch", zero("d") != F.col("document_count")))
        found = found.union(_listed(both, totals))
    if documents is not None:
        found = found.union(document_violations(chunks, documents, step))
    return found


def _listed(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rank"), F.lit(v).alias("violation"))) for r, v, c in rules]))
    return rows.select("container_id", F.explode(each).alias("x")).select("container_id", "x.rank", "x.violation")


def document_violations(chunks: DataFrame, documents: DataFrame, step: int) -> DataFrame:
    """Findings about the document index: its entries against what the chunks hold; just those within bounds are looked up."""
    keys = ["container_id", "doc_id", "logical_offset", "byte_length"]
    sizes = chunks.groupBy("container_id").agg(F.sum("uncompressed_size").alias("_total"))
    placed = joined(documents, sizes, ["container_id"], "left")
    outside = F.coalesce((F.col("logical_offset") < 0) | (F.col("byte_length") < 0) | (F.col("logical_offset") + F.col("byte_length") > F.coalesce("_total", F.lit(0))), F.lit(True))
    # each chunk is decoded once, with the list of what lies in it; entries of one chunk are checked where it lies, without moving their bytes
    hits = overlaps(chunks, placed.where(~outside).select(*keys), step)
    hits = hits.withColumn("_times", F.count("*").over(Window.partitionBy("container_id", "doc_id")))
    listed = hits.groupBy("container_id", "chunk_id").agg(F.collect_list(F.struct("doc_id", "logical_offset", "byte_length", "c_low", "c_high", "_times")).alias("_in"))
    held = decompressed(joined(chunks.select("container_id", "chunk_id", "uncompressed_size", "payload"), listed, ["container_id", "chunk_id"])).select("container_id", "chunk_id", "bytes", F.explode("_in").alias("x"))
    low = F.greatest("x.c_low", "x.logical_offset")
    cuts = held.select("container_id", "chunk_id", "x.doc_id", "x._times", low.alias("at"), cut_bytes(F.col("bytes"), low - F.col("x.c_low"), F.least(F.col("x.c_high"), F.col("x.logical_offset") + F.col("x.byte_length")) - low).alias("b"))
    result = lambda c: (T.line_count(c.cast("string")).alias("_lines"), T.checksum(c).alias("_checksum"))
    none = F.lit(b"")
    single = cuts.where("_times = 1").select("container_id", "doc_id", F.col("chunk_id").alias("_low"), (F.col("chunk_id") + 1).alias("_high"), *result(F.coalesce("b", none)))
    several = cuts.where("_times > 1").groupBy("container_id", "doc_id").agg(F.min("chunk_id").alias("_low"), (F.max("chunk_id") + 1).alias("_high"), F.aggregate(F.sort_array(F.collect_list(F.struct("at", "b"))), none, lambda a, x: F.concat(a, x["b"])).alias("_bytes"))
    several = several.select("container_id", "doc_id", "_low", "_high", *result(F.coalesce("_bytes", none)))
    both = joined(placed, single.union(several), ["container_id", "doc_id"], "left")
    rules = [
        (12, "document_out_of_bounds", outside),
        (13, "document_chunk_range_mismatch", (F.coalesce("_low", F.lit(0)) != F.col("chunk_start")) | (F.coalesce("_high", F.lit(0)) != F.col("chunk_end"))),
        (14, "document_line_count_mismatch", F.coalesce("_lines", F.lit(0)) != F.col("line_count")),
        (15, "document_checksum_mismatch", F.coalesce("_checksum", T.checksum(none)) != F.col("checksum")),
    ]
    return _listed(both, rules)


def report(chunks: DataFrame, found: DataFrame, level: str = "deep") -> DataFrame:
    """(container_id, level, checked_chunks, decoded_bytes, ok, first_error) of each container."""
    decoded = F.sum("uncompressed_size") if level == "deep" else F.lit(0).cast("bigint")
    base = chunks.groupBy("container_id").agg(F.count("*").alias("checked_chunks"), decoded.alias("decoded_bytes"))
    first = found.groupBy("container_id").agg(F.min(F.struct("rank", "violation"))["violation"].alias("first_error"))
    return base.join(first, "container_id", "left").select("container_id", F.lit(level).alias("level"), "checked_chunks", "decoded_bytes", F.col("first_error").isNull().alias("ok"), "first_error")


def attested(rows: DataFrame) -> DataFrame:
    """``rows`` with ``record``: one JSON object each, keys in alphabetical order, with a final LF."""
    return rows.withColumn("record", F.concat(F.to_json(F.struct(*sorted(rows.columns))), F.lit("\n")))


def attest_all(containers: DataFrame, found: DataFrame, level: str = "deep") -> DataFrame:
    """(container_id, record) of the containers that pass: those with findings get none."""
    passed = containers.join(found.select(F.col("container_id").alias("_bad")).distinct(), F.col("container_id").eqNullSafe(F.col("_bad")), "left_anti")
    rows = passed.withColumn("level", F.lit(level)).withColumn("verified", F.lit(True))
    return attested(rows).select("container_id", "record")


def attest(chunks: DataFrame, summary: dict, level: str = "deep") -> str:
    """The record of a container that passes; an error where it doesn't."""
    first = violations(chunks, None, level).orderBy("rank").limit(1).collect()
    if first:
        raise EvidenceError(first[0]["violation"], str(first[0]["container_id"]))
    return json.dumps(summary | {"level": level, "verified": True}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
