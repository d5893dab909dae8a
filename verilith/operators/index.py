"""Inverted indexes of lines by token or n-gram.

A granule is a line: (granule_id, container_id, logical_offset, byte_length,
chunk_start, chunk_end, line).  Postings are one row each to all that reads
them; stored are lists by key and block, a block being up to RANGE granules
that follow each other, so no frequent key becomes one value and no posting is
moved to be stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T
from verilith.operators.containers import before, planned_lines
from verilith.options import HIGH_DF, ChunkOptions


#: Granules whose postings are worked on together, and characters of these.
RANGE, BLOCK_CHARS = 1 << 14, 1 << 21


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, first) of documents: ``first`` is the number of the first line."""
    counted = docs.select(key, "text", F.lit(0).alias("_all"), F.coalesce(T.line_count(F.col("text")), F.lit(0)).alias("n"))
    return before(counted, ["_all"], key, {"first": F.col("n")}).select(key, "text", "first")


def granules(docs: DataFrame, key: str = "doc_id", options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Lines of documents that are containers of their own, numbered through in the order of ``key``.

    ``key`` is a whole number, each once; a null one (one at most) comes
    first.  chunk_start and chunk_end are the chunks of the document's plan
    that a line lies in.  A null text has no lines.
    """
    each = planned_lines(numbered(docs, key), options, key)
    return each.select((F.col("first") + F.col("line_no")).alias("granule_id"), F.col(key).alias("container_id"), "line_no", "logical_offset", "byte_length", "line", "chunk_start", "chunk_end", "chunk_sizes")


def bare_granules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(granule_id, line) of ``granules``, without chunks."""
    rows = numbered(docs, key).select("first", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    return rows.select((F.col("first") + F.col("k")).alias("granule_id"), "line")


def loose_lines(docs: DataFrame) -> DataFrame:
    """The lines of documents without numbers, for what only counts them; nothing is moved."""
    return docs.select(F.explode(T.lines(F.col("text"))).alias("line"))


def granule_count(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(T.line_count(F.col("text"))), F.lit(0)).alias("n")).first()["n"]


def postings(lines: DataFrame, kind: str = "token", n: int = 3, keys: list[str] | None = None) -> DataFrame:
    """(key, granule_id), each once; just of ``keys`` if given."""
    if keys is not None and kind == "ngram":  # a key of n characters is among the n-grams of what contains it
        found = F.filter(F.array(*map(F.lit, keys)).cast("array<string>"), lambda k: F.contains(F.col("line"), k) & (F.length(k) == n))
    elif keys is not None:
        found = F.array_intersect(T.keys_of(F.col("line"), kind, n), F.array(*map(F.lit, keys)).cast("array<string>"))
    else:
        found = T.keys_of(F.col("line"), kind, n)
    return lines.select(F.explode(found).alias("key"), "granule_id")


def _with_sizes(parts: DataFrame) -> DataFrame:
    """Terms from (key, n, size, low, high) of blocks of granules that don't overlap: of each the postings, the bytes of all but the first, the first and the last."""
    w = Window.partitionBy("key").orderBy("low")  # a row for each block
    first = T.varuint_size(F.col("low") - F.coalesce(F.lag("high").over(w), F.lit(0)))
    out = parts.select("key", "n", (F.col("size") + first).alias("size")).groupBy("key").agg(F.sum("n").alias("granule_frequency"), F.sum("size").alias("posting_size"))
    return out.withColumn("skip_points", F.when(F.col("granule_frequency") >= 1024, F.expr("(granule_frequency - 1) div 128")).otherwise(0))


def terms(posted: DataFrame) -> DataFrame:
    """(key, granule_frequency, posting_size, skip_points) of all keys of postings.

    posting_size is what a list would take as differences in seven-bit groups.
    No window goes over all postings of a key.
    """
    w = Window.partitionBy("key", "range").orderBy("granule_id")
    ranged = posted.withColumn("range", F.floor(F.col("granule_id") / RANGE))
    inner = ranged.select("key", "range", "granule_id", T.varuint_size(F.col("granule_id") - F.lag("granule_id").over(w)).alias("size"))
    inner = inner.withColumn("size", F.when(F.col("granule_id") == F.min("granule_id").over(Window.partitionBy("key", "range")), 0).otherwise(F.col("size")))
    return _with_sizes(inner.groupBy("key", "range").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("granule_id").alias("low"), F.max("granule_id").alias("high")))


PACKED = "key string, n bigint, size bigint, low bigint, high bigint, steps binary"


def _found_tokens(lines: list[str]):
    """The tokens of lines, sorted and each once, and pairs (number of token, number of line) of their occurrences."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    own = bytes(c if re.fullmatch(T.TOKEN.encode(), bytes([c])) else 32 for c in range(256))
    raw = [x.encode() for x in lines]
    kept = b"\n".join(raw).translate(own)
    here = np.frombuffer(kept, np.uint8) != 32
    starts = np.flatnonzero(here & ~np.r_[False, here[:-1]])
    if not len(starts):
        return [], starts, starts
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    found = pa.array(kept.lower().split(), pa.binary()).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)).cast(pa.string()), rank[found.indices.to_numpy()], np.searchsorted(ends, starts, side="right")


def _found_ngrams(lines: list[str], n: int):
    """As ``_found_tokens``, of windows of n code points; places are found by numbers of characters."""
    import numpy as np
    import pyarrow as pa

    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
    many = len(codes) - n + 1
    if many <= 0:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    small, inside = number[codes], owner[:many] == owner[n - 1 :]
    base = max(2, len(alphabet))
    if base**n <= 1 << 23:  # a place for each that could be
        key = sum(small[k : many + k][inside] * base ** (n - 1 - k) for k in range(n))
        there = np.zeros(base**n, bool)
        there[key] = True
        found = np.flatnonzero(there)
        at = np.zeros(base**n, np.int32)
        at[found] = np.arange(len(found))
        texts = alphabet[np.stack([found // base ** (n - 1 - k) % base for k in range(n)], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
        return pa.array([texts[k : k + n] for k in range(0, len(texts), n)], pa.string()), at[key], owner[:many][inside]
    key = small[:many][inside]
    for k in range(1, n):
        if k * base.bit_length() + base.bit_length() > 62:  # too many for one number: numbers of those that occur
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + small[k : many + k][inside]
    place = np.flatnonzero(inside)
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    texts = codes[place[first][:, None] + np.arange(n)].astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([texts[k : k + n] for k in range(0, len(texts), n)], pa.string()), at, owner[:many][inside]


def packed(lines: DataFrame, kind: str = "token", n: int = 3) -> DataFrame:
    """Postings of lines as PACKED rows, one for each key of a block of granules; nothing is moved.

    A block ends where the next line's number isn't the next one.  steps are
    the differences of granules in seven-bit groups, the first from low.
    """
    limit, chars = min(RANGE, 1 << 14), BLOCK_CHARS

    def rows(first: int, held: list[str]):
        import numpy as np
        import pyarrow as pa

        keys, key, line = _found_tokens(held) if kind == "token" else _found_ngrams(held, n)
        if not len(keys):
            return
        pair = np.unique(key.astype(np.int64) << 14 | line)
        key, line = pair >> 14, pair & 0x3FFF
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[starts, len(key)])
        step = np.diff(line, prepend=0)
        step[starts] = 0
        width = 1 + (step >= 128)
        place = np.cumsum(width) - width
        out = np.zeros(int(width.sum()), np.uint8)
        out[place] = (step & 127) | np.where(width == 2, 128, 0)
        out[(place + 1)[width == 2]] = step[width == 2] >> 7
        size = np.add.reduceat(width, starts)
        steps = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[place[starts], len(out)].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
        columns = [pa.array(x.astype(np.int64)) for x in (count, size - 1, first + line[starts], first + line[starts + count - 1])]
        yield pa.RecordBatch.from_arrays([keys, *columns, steps], names=["key", "n", "size", "low", "high", "steps"])

    def run(batches):
        first, held, size = 0, [], 0
        for batch in batches:
            for granule, line in zip(batch.column("granule_id").to_pylist(), batch.column("line").to_pylist()):
                if held and (granule != first + len(held) or len(held) == limit or size >= chars):
                    yield from rows(first, held)
                    held, size = [], 0
                if not held:
                    first = granule
                held.append(line)
                size += len(line)
        if held:
            yield from rows(first, held)

    return lines.select("granule_id", "line").mapInArrow(run, PACKED)


def terms_of(lines: DataFrame, kind: str = "token", n: int = 3) -> DataFrame:
    """``terms(postings(lines, kind, n))`` without postings: each block's terms are summed up where its lines lie."""
    return _with_sizes(packed(lines, kind, n).drop("steps"))


def unpacked(lists: DataFrame) -> DataFrame:
    """(key, granule_id) of PACKED rows."""
    import numpy as np
    import pyarrow as pa

    def places(low: pa.Array, steps: pa.Array) -> pa.Array:
        raw = np.frombuffer(b"".join(steps.to_pylist()), np.uint8).astype(np.int64)
        more = raw >= 128
        second = np.r_[False, more[:-1]]
        value = (raw & 127) + np.where(more, np.r_[raw[1:], 0] << 7, 0)
        ends = np.cumsum(np.fromiter(map(len, steps.to_pylist()), np.int64, len(steps)))
        real = np.cumsum(~second)
        offsets = np.r_[0, real[ends - 1]] if len(ends) else np.zeros(1, np.int64)
        sums = np.cumsum(value[~second])
        counts = np.diff(offsets)
        begin = sums[offsets[:-1]] if len(ends) else sums
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sums - np.repeat(begin - low.to_numpy(), counts)))

    places.__annotations__ = dict.fromkeys(("low", "steps", "return"), pa.Array)
    return lists.select("key", F.explode(F.arrow_udf(places, "array<bigint>")("low", "steps")).alias("granule_id"))


def index_size(all_terms: DataFrame, granule_count: int) -> DataFrame:
    """One row: term_count, postings_size, index_size_bytes."""
    key = T.size(F.col("key"))
    entry = key + T.varuint_size(key) + T.varuint_size(F.col("granule_frequency")) + T.varuint_size(F.col("posting_size"))
    sums = all_terms.agg(F.count("*").alias("term_count"), F.coalesce(F.sum("posting_size"), F.lit(0)).alias("postings_size"), F.coalesce(F.sum(entry), F.lit(0)).alias("entries"))
    return sums.select(F.lit(granule_count).cast("bigint").alias("granule_count"), "term_count", "postings_size", (F.lit(8 + 20 * granule_count + 8) + F.col("entries") + F.col("postings_size")).alias("index_size_bytes"))


def is_frequent(frequency, all_granules, per_million: int = HIGH_DF):
    return F.floor(frequency * 1_000_000 / F.greatest(all_granules, F.lit(1))) >= per_million


@dataclass
class Index:
    """An index that was built, in memory or read from a folder."""

    kind: str
    n: int
    complete: bool
    per_million: int
    source_checksum: str
    granule_count: int
    granules: DataFrame
    terms: DataFrame
    postings: DataFrame


def source_checksum(lines: DataFrame) -> str:
    """Order-free over containers, exact over each one's lines."""
    row = lines.agg(F.count("*").alias("n"), F.sum(F.xxhash64("granule_id", "line").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def build(lines: DataFrame, kind: str = "token", n: int = 3, complete: bool = True, per_million: int = HIGH_DF) -> Index:
    if kind not in ("token", "ngram"):
        raise EvidenceError("unsupported_index_mode", kind)
    posted = postings(lines, kind, n)
    return Index(kind, n, complete, per_million, source_checksum(lines), lines.count(), lines, terms_of(lines, kind, n), posted)


def save(index: Index, folder: str, partitions: int = 8) -> None:
    """Write the index: terms and lists of postings are sorted by key in each file."""
    _save_granules(index.granules, folder)
    ids = F.sort_array(F.collect_list("granule_id"))
    steps = index.postings.groupBy("key", F.floor(F.col("granule_id") / RANGE).alias("range")).agg(ids.alias("ids"))
    lists = steps.select("key", F.size("ids").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size"), F.element_at("ids", 1).alias("low"), F.element_at("ids", -1).alias("high"), T.steps(F.col("ids")).alias("steps"))
    lists.repartition(partitions, F.xxhash64("key"), F.floor(F.col("low") / RANGE)).sortWithinPartitions("key", "low").write.mode("overwrite").parquet(f"{folder}/postings")
    index.terms.repartition(partitions, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/terms")
    _manifest(index, folder)


def store(lines: DataFrame, folder: str, kind: str = "token", n: int = 3, complete: bool = True, per_million: int = HIGH_DF) -> None:
    """``save(build(lines, kind, ...), folder)``, each table from those that are written already, so lines are made once."""
    spark = lines.sparkSession
    _save_granules(lines, folder)
    own = build(spark.read.parquet(f"{folder}/granules"), kind, n, complete, per_million)
    packed(own.granules, kind, n).write.mode("overwrite").parquet(f"{folder}/postings")
    _with_sizes(spark.read.parquet(f"{folder}/postings").drop("steps")).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/terms")
    _manifest(own, folder)


def _save_granules(lines: DataFrame, folder: str) -> None:
    lines.write.mode("overwrite").parquet(f"{folder}/granules")


def _manifest(index: Index, folder: str) -> None:
    spark = index.granules.sparkSession
    spark.createDataFrame([(2, index.kind, index.n, index.complete, index.per_million, index.source_checksum, index.granule_count)], "version int, kind string, n int, complete boolean, high_df_per_million int, source_checksum string, granule_count bigint").write.mode("overwrite").parquet(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> Index:
    """Open an index; with ``lines`` it has to be the index of just these."""
    m = spark.read.parquet(f"{folder}/manifest").first()
    if m["version"] != 2 or m["kind"] not in ("token", "ngram"):
        raise EvidenceError("unsupported_index_mode", str(m["kind"]))
    if lines is not None and source_checksum(lines) != m["source_checksum"]:
        raise EvidenceError("sidecar_binding_mismatch")
    return Index(m["kind"], m["n"], m["complete"], m["high_df_per_million"], m["source_checksum"], m["granule_count"], spark.read.parquet(f"{folder}/granules"), spark.read.parquet(f"{folder}/terms"), unpacked(spark.read.parquet(f"{folder}/postings")))


def violations(index: Index) -> DataFrame:
    """(key, violation) of terms and postings that don't fit together; empty if all is well."""
    counted = index.postings.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("granule_id").alias("d"), F.max("granule_id").alias("high"), F.min("granule_id").alias("low"))
    both = index.terms.join(counted, "key", "full")
    rules = {
        "posting_without_term": F.col("granule_frequency").isNull(),
        "term_without_posting": F.col("n").isNull(),
        "frequency_mismatch": F.col("n") != F.col("granule_frequency"),
        "repeated_posting": F.col("n") != F.col("d"),
        "granule_out_of_range": (F.col("high") >= index.granule_count) | (F.col("low") < 0),
    }
    return both.select("key", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("violation"))
