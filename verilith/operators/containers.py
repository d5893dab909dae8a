"""Containers: documents one behind the other, with offsets, lines and chunks.

A source table has (container_id, doc_seq, doc_id, text).  Nothing is put
between documents, so a document that doesn't end with LF shares a line with
the next.  Positions are prefix sums over small rows (one for each document),
in two levels, so that not even these lie in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T
from verilith.options import ChunkOptions

#: Documents of a container whose checksums are summed up together.
GROUP = 1 << 16

#: Chunks that Python packs or unpacks at once.
SLICE = 128

#: Rows that lie together where positions are summed up.
SUMMED = 1 << 11


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which nulls equal each other; the keys come once, from ``left``."""
    own = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(own, on, how).drop(*[f"_r_{k}" for k in keys])


def _grouped(df: DataFrame, parts: list[str], order: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns without nulls for its parts and for the ranges of ``order``; windows and joins on these agree in how rows are moved."""
    own = {"_group": F.coalesce(F.floor(F.col(order) / SUMMED), F.lit(-(1 << 62)))}
    for k, p in enumerate(parts):
        own |= {f"_p{k}": F.coalesce(F.col(p).cast("string"), F.lit("")), f"_n{k}": F.col(p).isNull()}
    return df.withColumns(own), [c for c in own if c != "_group"]


def before(df: DataFrame, parts: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name, the sum of an expression over all earlier rows of its part.

    Rows are grouped by ranges of ``order`` (a whole number, its own for each
    row of a part); the groups' sums are few, and within a group a window adds
    up.  A null part is a part like any other; nulls come first in an order.
    Whole rows are moved once.
    """
    base = [f"_base_{k}" for k in sums]
    with_, keys = _grouped(df, parts, order)
    totals = with_.groupBy(*keys, "_group").agg(*[F.sum(e).alias(b) for e, b in zip(sums.values(), base)])
    earlier = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_group", *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in base])
    own = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = with_.select("*", *[F.coalesce(F.sum(e).over(own), F.lit(0)).alias(k) for k, e in sums.items()])
    return out.join(totals, [*keys, "_group"]).select(*df.columns, *[T.big(F.col(k) + F.col(b)).alias(k) for k, b in zip(sums, base)])


def carried(df: DataFrame, parts: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``df`` with, as ``name``, the last ``value`` that isn't null of all earlier rows of its part; in two levels, as in ``before``."""
    with_, keys = _grouped(df.withColumn("_value", value), parts, order)
    last = with_.groupBy(*keys, "_group").agg(F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(*keys, "_group", F.last("_last", ignorenulls=True).over(earlier).alias("_base"))
    own = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = with_.withColumn("_own", F.last("_value", ignorenulls=True).over(own))
    return out.join(base, [*keys, "_group"]).select(*df.columns, F.coalesce("_own", "_base").alias(name))


def placed(source: DataFrame) -> DataFrame:
    """Documents with byte_length, feeds, logical_offset, first_line, line_count, crlf, starts_with_feed, last_char and checksum.

    A null text is an empty one; a null container_id or doc_id is one like any
    other; a null doc_seq has no place and is an error.
    """
    text = F.col("text")
    source = source.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("doc_seq", F.coalesce("doc_seq", F.raise_error(F.lit("null_doc_seq")).cast("bigint")))
    # what is known of a text alone is made before rows are moved: where no more is asked for, the text isn't moved
    rows = source.withColumns({"byte_length": T.size(text), "feeds": T.feeds(text), "line_count": T.line_count(text), "crlf": T.crlf(text), "starts_with_feed": text.startswith("\n"), "last_char": F.when(F.length(text) > 0, F.right(text, F.lit(1))), "checksum": T.checksum(text)})
    return before(rows, ["container_id"], "doc_seq", {"logical_offset": F.col("byte_length"), "first_line": F.col("feeds")})


def duplicate_ids(source: DataFrame) -> DataFrame:
    return source.groupBy("container_id", "doc_id").agg(F.count("*").alias("times")).where("times > 1")


def pieces(docs: DataFrame) -> DataFrame:
    """(container_id, line_no, logical_offset, byte_length, piece, whole): the parts of lines that lie in one document; no shuffle.

    ``whole`` ones are lines of their own for certain: neither the first of a
    document nor open at its end.
    """
    rows = docs.where("byte_length > 0").select("container_id", "logical_offset", "first_line", T.lines(F.col("text")).alias("l")).withColumn("s", F.transform("l", T.size))
    each = F.posexplode(F.arrays_zip(F.col("l").alias("piece"), T.running(F.col("s")).alias("at"), F.col("s").alias("size"))).alias("k", "x")
    cut = rows.select("container_id", "logical_offset", "first_line", each)
    return cut.select("container_id", (F.col("first_line") + F.col("k")).alias("line_no"), (F.col("logical_offset") + F.col("x.at")).alias("logical_offset"), F.col("x.size").alias("byte_length"), F.col("x.piece").alias("piece"), ((F.col("k") > 0) & F.col("x.piece").endswith("\n")).alias("whole"))


def lines(docs: DataFrame) -> DataFrame:
    """(container_id, line_no, logical_offset, byte_length, line) of placed documents; just pieces at documents' ends are moved to meet."""
    each = pieces(docs)
    parts = F.sort_array(F.collect_list(F.struct("logical_offset", "piece")))
    met = each.where(~F.col("whole")).groupBy("container_id", "line_no").agg(F.min("logical_offset").alias("logical_offset"), F.sum("byte_length").alias("byte_length"), F.array_join(parts["piece"], "").alias("line"))
    return each.where("whole").select("container_id", "line_no", "logical_offset", "byte_length", F.col("piece").alias("line")).union(met)


def document_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines where each document is its own container: no shuffle at all."""
    rows = docs.select(F.col(key), T.lines(F.col("text")).alias("l")).withColumn("s", F.transform("l", T.size))
    each = F.posexplode(F.arrays_zip(F.col("l").alias("line"), T.running(F.col("s")).alias("at"), F.col("s").alias("size"))).alias("line_no", "x")
    return rows.select(key, each).select(key, T.big(F.col("line_no")).alias("line_no"), F.col("x.at").alias("logical_offset"), F.col("x.size").alias("byte_length"), F.col("x.line").alias("line"))


PLANNED = "array<struct<chunk_start:bigint,chunk_end:bigint,chunk_sizes:array<bigint>>>"


def planned_lines(docs: DataFrame, options: ChunkOptions, key: str = "doc_id") -> DataFrame:
    """``document_lines`` with each line's chunk_start, chunk_end and the sizes of these chunks, other columns kept; no shuffle.

    A document within the target is one chunk; of a larger one just the sizes
    of its lines go to Python, and lines longer than the maximum.
    """
    import pyarrow as pa

    def plan(sizes: pa.Array, closed: pa.Array, longer: pa.Array) -> pa.Array:
        counts, first, last, held = [0], [], [], []
        for own, end, texts in zip(sizes, closed, longer):
            if not own.is_valid:
                counts.append(0)
                continue
            width = own.values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(width)
            starts = ends - width
            long = {int(a): x.encode() for a, x in zip(starts[width > options.maximum], texts.as_py())}
            stops = np.array(plan_ends(ends if end.as_py() else ends[:-1], int(ends[-1]), options, long), np.int64)
            counts.append(len(width))
            first.append(np.searchsorted(stops, starts, side="right"))
            last.append(np.searchsorted(stops, ends - 1, side="right") + 1)
            many = last[-1] - first[-1]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[-1], many)
            held.append(np.diff(np.r_[0, stops])[at])
        flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (first, last, held)]
        many = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat[1] - flat[0])].astype(np.int32)), pa.array(flat[2]))
        rows = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1]), many], names=["chunk_start", "chunk_end", "chunk_sizes"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), rows)

    plan.__annotations__ = dict.fromkeys(("sizes", "closed", "longer", "return"), pa.Array)
    rest = [c for c in docs.columns if c not in (key, "text")]
    rows = docs.select(key, *rest, T.lines(F.col("text")).alias("l"), T.size(F.col("text")).alias("_size"), F.col("text").endswith("\n").alias("_closed")).withColumn("s", F.transform("l", T.size))
    large, one = F.col("_size") > options.target, F.lit(1).cast("bigint")
    given = [F.when(large, c) for c in (F.col("s"), F.col("_closed"), F.filter("l", lambda x: T.size(x) > options.maximum))]
    chunks = F.when(large, F.arrow_udf(plan, PLANNED)(*given)).otherwise(F.transform("s", lambda x: F.struct((one - 1).alias("chunk_start"), one.alias("chunk_end"), F.array("_size").alias("chunk_sizes"))))
    each = rows.select(key, *rest, F.posexplode(F.arrays_zip(F.col("l").alias("line"), F.col("s").alias("size"), T.running(F.col("s")).alias("at"), chunks.alias("c"))).alias("line_no", "x"))
    return each.select(key, *rest, T.big(F.col("line_no")).alias("line_no"), F.col("x.at").alias("logical_offset"), F.col("x.size").alias("byte_length"), F.col("x.line").alias("line"), "x.c.chunk_start", "x.c.chunk_end", "x.c.chunk_sizes")


def forced_end(data: bytes, start: int, maximum: int) -> int:
    """The last place up to ``maximum`` that splits neither a character nor CR LF."""
    for end in range(min(start + maximum, len(data)), start, -1):
        if end == len(data) or (data[end] & 0xC0 != 0x80 and not (data[end - 1] == 13 and data[end] == 10)):
            return end
    raise EvidenceError("resource_limit_exceeded", "no place to split")


def plan_ends(feeds: np.ndarray, total: int, options: ChunkOptions, long: dict[int, bytes]) -> list[int]:
    """Where chunks end.  ``feeds``: ends of the lines that LF ends; ``long``: by offset, lines longer than the maximum.

    The rest if it is within the target; else behind the last LF within the
    target; else behind the last one within the maximum; else a forced split.
    """
    start, out = 0, []
    while start < total:
        end = total if total - start <= options.target else 0
        for reach in (options.target, options.maximum):
            k = int(np.searchsorted(feeds, min(start + reach, total), side="right")) - 1
            if not end and k >= 0 and feeds[k] > start:
                end = int(feeds[k])
        if not end and total - start <= options.maximum:
            end = total
        if not end:
            at = max(a for a in long if a <= start)
            end = at + forced_end(long[at], start - at, options.maximum)
        out.append(end)
        start = end
    return out


CHUNKS = "container_id string, chunk_id bigint, logical_offset bigint, uncompressed_size bigint, first_line bigint, line_count bigint, flags int"


def chunk_plan(all_lines: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """The chunks of each container.

    A container's plan is a fold over its line ends and is made in one task;
    of the text just lines longer than the maximum come along.
    """
    slim = all_lines.select(F.col("container_id").cast("string").alias("container_id"), "logical_offset", "byte_length", F.col("line").endswith("\n").alias("ended"), F.when(F.col("byte_length") > options.maximum, F.encode("line", "utf-8")).alias("long"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("logical_offset")
        starts = rows["logical_offset"].to_numpy()
        ends = starts + rows["byte_length"].to_numpy()
        long = {int(a): bytes(b) for a, b in zip(starts, rows["long"]) if b is not None}
        stop = np.array(plan_ends(ends[rows["ended"].to_numpy()], int(ends[-1]), options, long), np.int64)
        begin = np.r_[0, stop[:-1]]
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
        return pd.DataFrame({"container_id": rows["container_id"].iloc[0], "chunk_id": np.arange(len(stop)), "logical_offset": begin, "uncompressed_size": stop - begin, "first_line": first, "line_count": last - first, "flags": ((begin > 0) & ~np.isin(begin, ends[rows["ended"].to_numpy()])).astype(np.int32)})

    return slim.groupBy("container_id").applyInPandas(plan, CHUNKS)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(container_id, chunk_id, violation) of chunk tables that don't fit together."""
    w = Window.partitionBy("container_id").orderBy("chunk_id")
    row = chunks.select("*", F.lag("chunk_id").over(w).alias("b"), (F.lag("logical_offset").over(w) + F.lag("uncompressed_size").over(w)).alias("at"), (F.lag("first_line").over(w) + F.lag("line_count").over(w)).alias("line"))
    rules = {
        "chunk_id_sequence": F.col("chunk_id") != F.coalesce(F.col("b") + 1, F.lit(0)),
        "logical_gap": F.col("logical_offset") != F.coalesce("at", F.lit(0)),
        "first_line_gap": F.col("first_line") != F.coalesce("line", F.lit(0)),
        "empty_chunk": F.col("uncompressed_size") <= 0,
        "unknown_flag": ~F.col("flags").isin(0, 1),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return row.select("container_id", "chunk_id", F.explode(found).alias("violation"))


def overlaps(chunks: DataFrame, spans: DataFrame, step: int) -> DataFrame:
    """Chunks and spans (container_id, logical_offset, byte_length) of the same container that share bytes.

    Both are listed under the ranges of ``step`` bytes they touch, so it is
    an equi-join; a pair is taken in the first range that both touch.
    """
    c = chunks.select("container_id", F.col("chunk_id"), F.col("logical_offset").alias("c_low"), (F.col("logical_offset") + F.col("uncompressed_size")).alias("c_high"))
    c = c.withColumn("range", F.explode(F.sequence(F.floor(F.col("c_low") / step), F.floor((F.col("c_high") - 1) / step))))
    s = spans.where("byte_length > 0").withColumn("s_high", F.col("logical_offset") + F.col("byte_length"))
    s = s.withColumn("range", F.explode(F.sequence(F.floor(F.col("logical_offset") / step), F.floor((F.col("s_high") - 1) / step))))
    both = joined(s, c, ["container_id", "range"]).where("c_low < s_high and c_high > logical_offset")
    return both.where(F.col("range") == F.floor(F.greatest("c_low", "logical_offset") / step)).drop("range", "s_high")


def document_index(docs: DataFrame, chunks: DataFrame, step: int) -> DataFrame:
    """(container_id, doc_id, logical_offset, byte_length, first_line, line_count, chunk_start, chunk_end, checksum)."""
    spans = docs.select("container_id", "doc_id", "logical_offset", "byte_length")
    ranges = overlaps(chunks, spans, step).groupBy("container_id", "doc_id").agg(F.min("chunk_id").alias("chunk_start"), (F.max("chunk_id") + 1).alias("chunk_end"))
    entries = docs.select("container_id", "doc_id", "logical_offset", "byte_length", "first_line", "line_count", "checksum")
    zero = F.lit(0).cast("bigint")
    return joined(entries, ranges, ["container_id", "doc_id"], "left").withColumn("chunk_start", F.coalesce("chunk_start", zero)).withColumn("chunk_end", F.coalesce("chunk_end", zero))


def spans_index(text_lines: DataFrame, spans: DataFrame, chunks: DataFrame, step: int) -> DataFrame:
    """Entries of given spans (container_id, doc_id, logical_offset, byte_length): where they lie, and their text.

    A span meets just the lines it shares bytes with; how many lines end
    before it is the number of the first of these, or, for an empty span, of
    the line it lies in front of.
    """
    keys = ["container_id", "doc_id", "logical_offset", "byte_length"]
    end = F.col("logical_offset") + F.col("byte_length")
    as_chunks = text_lines.select("container_id", F.col("line_no").alias("chunk_id"), "logical_offset", F.col("byte_length").alias("uncompressed_size"))
    hit = joined(overlaps(as_chunks, spans, step), text_lines.select("container_id", F.col("line_no").alias("chunk_id"), "line"), ["container_id", "chunk_id"])
    ended = F.col("line").endswith("\n")
    low = F.greatest("c_low", "logical_offset")
    part = F.struct("c_low", F.substring(F.encode("line", "utf-8"), (low - F.col("c_low") + 1).cast("int"), (F.least(end, F.col("c_high")) - low).cast("int")).alias("b"))
    full = hit.groupBy(*keys).agg(F.min("chunk_id").alias("first_line"), F.coalesce(F.sum((ended & (F.col("c_high") <= end)).cast("bigint")), F.lit(0)).alias("feeds"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: F.decode(x["b"], "utf-8")), "").alias("text"))
    # an empty span lies behind all lines that end at its place or before: the line of the byte before it, if any
    empty = spans.where("byte_length = 0").withColumn("_at", F.col("logical_offset"))
    one = empty.where("_at > 0").withColumn("logical_offset", F.col("_at") - 1).withColumn("byte_length", F.lit(1).cast("bigint"))
    inside = joined(overlaps(as_chunks, one, step), text_lines.select("container_id", F.col("line_no").alias("chunk_id"), "line"), ["container_id", "chunk_id"])
    behind = inside.select("container_id", "doc_id", "_at", (F.col("chunk_id") + (ended & (F.col("c_high") <= F.col("_at"))).cast("bigint")).alias("first_line"))
    zero = F.lit(0).cast("bigint")
    none = joined(empty, behind, ["container_id", "doc_id", "_at"], "left").select(*keys, F.coalesce("first_line", zero).alias("first_line"), zero.alias("feeds"), F.lit("").alias("text"))
    rows = full.union(none)
    rows = rows.withColumn("line_count", F.col("feeds") + F.when((F.col("byte_length") > 0) & ~F.col("text").endswith("\n"), 1).otherwise(0)).drop("feeds")
    ranges = overlaps(chunks, spans, step).groupBy("container_id", "doc_id").agg(F.min("chunk_id").alias("chunk_start"), (F.max("chunk_id") + 1).alias("chunk_end"))
    return joined(rows, ranges, ["container_id", "doc_id"], "left").withColumn("chunk_start", F.coalesce("chunk_start", zero)).withColumn("chunk_end", F.coalesce("chunk_end", zero))


def sliced(batches: Iterator) -> Iterator:
    """The batches in parts of SLICE rows, so that few chunks are decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def compressed(chunks_text: DataFrame, level: int = 3) -> DataFrame:
    """Chunks (container_id, chunk_id, bytes) with payload, its size and the checksums of both sides."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import zstandard

        own = zstandard.ZstdCompressor(level=level)
        for batch in sliced(batches):
            payload = [own.compress(x.as_py()) for x in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("container_id"), batch.column("chunk_id"), batch.column("bytes"), pa.array(payload, pa.binary())], names=["container_id", "chunk_id", "bytes", "payload"])

    rows = chunks_text.select("container_id", "chunk_id", "bytes").mapInArrow(run, "container_id string, chunk_id bigint, bytes binary, payload binary")
    return rows.select("container_id", "chunk_id", "payload", T.big(F.octet_length("payload")).alias("compressed_size"), T.checksum(F.col("payload")).alias("compressed_checksum"), T.checksum(F.col("bytes")).alias("uncompressed_checksum"))


def decompressed(chunks: DataFrame) -> DataFrame:
    """Stored chunks with ``bytes``; more than uncompressed_size is never decoded, damaged ones give null."""
    import pyarrow as pa

    kept = [f for f in chunks.schema.fields]

    def run(batches: Iterator) -> Iterator:
        import zstandard

        own = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            out = []
            for payload, limit in zip(batch.column("payload").to_pylist(), batch.column("uncompressed_size").to_pylist()):
                try:
                    with own.stream_reader(payload) as reader:
                        found = reader.read(limit + 1)
                    out.append(found if len(found) <= limit else None)
                except zstandard.ZstdError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*[f.name for f in kept], "bytes"])

    return chunks.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", bytes binary")


def exported(chunks: DataFrame) -> DataFrame:
    """(container_id, exported_bytes, checksum) of stored chunks, decoded one by one in their order; a damaged one is an error.

    A container's checksum is a chain over all its bytes, so one task takes
    its payloads, but it never holds more than one batch of them.
    """
    import pyarrow as pa

    names = ["container_id", "exported_bytes", "checksum"]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import zstandard

        own, at, size, digest = zstandard.ZstdDecompressor(), None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=names)
        for batch in batches:
            for container, limit, payload in zip(*(batch.column(c) for c in ("container_id", "uncompressed_size", "payload"))):
                if digest is None or container.as_py() != at:
                    if digest is not None:
                        yield row()
                    at, size, digest = container.as_py(), 0, hashlib.sha256()
                with own.stream_reader(payload.as_py()) as reader:
                    found = reader.read(limit.as_py() + 1)
                if len(found) != limit.as_py():
                    raise EvidenceError("uncompressed_size_mismatch", str(at))
                size += len(found)
                digest.update(found)
        if digest is not None:
            yield row()

    rows = chunks.select("container_id", "chunk_id", "uncompressed_size", "payload").repartition("container_id").sortWithinPartitions("container_id", "chunk_id")
    return rows.mapInArrow(run, "container_id string, exported_bytes bigint, checksum string")


def chunk_bytes(all_lines: DataFrame, chunks: DataFrame, step: int) -> DataFrame:
    """(container_id, chunk_id, bytes): the text of each chunk, put together from the lines it overlaps.

    ``step`` is the size of the largest chunk at least.  Lines go to the range
    of bytes in which a chunk that they overlap may begin, and chunks are put
    together where they met their lines, so text is moved once.
    """
    wide = 8 * step
    low, high = F.floor(F.greatest(F.col("logical_offset") - step + 1, F.lit(0)) / wide), F.floor((F.col("logical_offset") + F.col("byte_length") - 1) / wide)
    parts = [F.coalesce(F.col("container_id").cast("string"), F.lit("")).alias("_p"), F.col("container_id").isNull().alias("_n")]
    own = all_lines.where("byte_length > 0").select(*parts, F.explode(F.sequence(low, high)).alias("_home"), "logical_offset", "byte_length", F.encode("line", "utf-8").alias("raw"))
    to = chunks.select(*parts, F.floor(F.col("logical_offset") / wide).alias("_home"), "chunk_id", F.col("logical_offset").alias("c_low"), (F.col("logical_offset") + F.col("uncompressed_size")).alias("c_high"))
    end = F.col("logical_offset") + F.col("byte_length")
    hits = own.join(to, ["_p", "_n", "_home"]).where((F.col("c_low") < end) & (F.col("c_high") > F.col("logical_offset")))
    at = F.greatest("logical_offset", "c_low")
    part = F.struct(at.alias("at"), F.substring(F.col("raw"), (at - F.col("logical_offset") + 1).cast("int"), (F.least(end, F.col("c_high")) - at).cast("int")).alias("b"))
    met = hits.groupBy("_p", "_n", "_home", "chunk_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return met.select(F.when(~F.col("_n"), F.col("_p")).alias("container_id"), "chunk_id", T.joined_bytes(F.col("p.b")).alias("bytes"))
