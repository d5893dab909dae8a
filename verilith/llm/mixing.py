"""Mixing of sources to target weights by Pareto order sampling.

Each source gets its share of the total number of documents by its weight,
rounded by largest remainder.  A document's expected copies are its source's
share times its size over the source's size: the whole part is certain; for
the fraction p, all documents of the source are ranked by

    (u / (1 - u)) / (p / (1 - p))

with a random u that follows from id and text, and the least are taken, as
many as make the share exactly.  Shares and fractions are kept as integers, so
nothing hangs on the order of sums.

The least of a source are found by counting buckets of ranks; just the bucket
in which the last one falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilith.llm.common import BROADCAST_ROWS, cut, fresh, one_of_each, quoted, text_hash

BUCKETS = 4096


def log_size(text: Column) -> Column:
    """Binary digits of the length in characters: longer documents are a little more likely."""
    return F.length(F.bin(F.length(text).cast("bigint"))).cast("bigint")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on seed, id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def lowest(df: DataFrame, group: str, rank: str, quota: str, order: list[Column]) -> DataFrame:
    """Per group, just the ``quota`` rows with the lowest positive ``rank``, ties by ``order``.

    No group is sorted in one task: ranks are counted in buckets, and only the
    bucket that the quota cuts is.  Groups are compared null-safe.
    """
    bucket = F.floor(F.lit(float(BUCKETS)) * (F.col(rank) / (F.col(rank) + 1))).cast("int")
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("n"), F.max(quota).alias("q"))
    so_far = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("to", F.sum("n").over(so_far))
    edge = cut(counts.where("to - n < q and to >= q").select(F.col(group).alias("_g"), F.col("_bucket").alias("_edge"), (F.col("q") - F.col("to") + F.col("n")).alias("_room")))
    side = F.broadcast(edge) if edge.count() <= BROADCAST_ROWS else edge
    both = rows.join(side, F.col(group).eqNullSafe(F.col("_g")), "left")
    inside = both.where("_edge is null or _bucket < _edge")  # without an edge the quota is all of the group's rows, or none
    cutting = both.where("_bucket = _edge").withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.col(rank), *order))).where("_n <= _room").drop("_n")
    return inside.where(f"`{quota}` > 0").union(cutting).drop("_bucket", "_g", "_edge", "_room")


def source_shares(units: DataFrame, total: int, weights: dict | None) -> DataFrame:
    """(source, all, share) of units (source, chars, size, n).

    The table of sources is small against the documents; it is ordered in one task.
    """
    known = units.groupBy("source").agg(F.sum("chars").alias("chars"), F.sum(F.col("size") * F.col("n")).cast("bigint").alias("all"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("chars").cast("double"))).cast("bigint")
    else:
        weight = F.lit(0).cast("bigint")
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source).cast("string")), F.lit(int(w)).cast("bigint")).otherwise(weight)
    known = known.withColumn("w", F.when(F.col("all") > 0, weight).otherwise(0)).where("w > 0")
    everything = Window.partitionBy(F.lit(0))
    known = known.withColumn("sum_w", F.sum("w").over(everything)).withColumn("base", F.expr(f"({total}L * w) div sum_w")).withColumn("rest", F.expr(f"({total}L * w) % sum_w"))
    known = known.withColumn("left", F.lit(total) - F.sum("base").over(everything)).withColumn("k", F.row_number().over(everything.orderBy(F.desc("rest"), F.asc_nulls_last("source"))))
    return known.select("source", "all", (F.col("base") + (F.col("k") <= F.col("left")).cast("bigint")).alias("share"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, weights: dict | None = None, seed: int = 1, size: Column | None = None) -> DataFrame:
    """(doc_id, hash, source, n, copies) of all documents that get copies.

    ``weights`` maps sources to whole numbers (others get none); by default a
    source's weight is the root of its characters, rounded down.  ``total``
    is by default the number of documents with a text.  ``size`` is a
    document's size (a whole number), by default log_size.
    """
    text_, source_ = quoted(text), quoted(source)
    measure = F.coalesce(size if size is not None else log_size(text_), F.lit(0)).cast("bigint")
    rows = docs.where(text_.isNotNull()).select(quoted(doc_id).alias("doc_id"), text_hash(text_).alias("hash"), source_.cast("string").alias("source"), F.length(text_).cast("bigint").alias("length"), measure.alias("size"), uniform(quoted(doc_id), text_, seed).alias("u"))
    units = cut(rows.groupBy("doc_id", "hash", "source").agg(F.count("*").alias("n"), F.sum("length").alias("chars"), F.first("size").alias("size"), F.first("u").alias("u")))
    if total is None:
        total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = cut(source_shares(units, total, weights).withColumnRenamed("source", "_source"))
    side = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    placed = units.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("whole", F.expr("(share * size * n) div `all`")).withColumn("part", F.expr("(share * size * n) % `all`"))
    extra = placed.groupBy("source").agg((F.max("share") - F.sum("whole")).alias("_extra"))
    extra = F.broadcast(extra.withColumnRenamed("source", "_s")) if shares.count() <= BROADCAST_ROWS else extra.withColumnRenamed("source", "_s")
    placed = cut(placed.join(extra, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    ranked = placed.where("part > 0").withColumn("rank", (F.col("u") / (1 - F.col("u"))) * ((F.col("all") - F.col("part")).cast("double") / F.col("part").cast("double")))
    chosen = lowest(ranked, "source", "rank", "_extra", [F.asc_nulls_last("doc_id"), F.col("hash")]).select("doc_id", "hash", "source", "n", F.lit(1).cast("bigint").alias("copies"))
    certain = placed.where("whole > 0").select("doc_id", "hash", "source", "n", F.col("whole").alias("copies"))
    return chosen.union(certain).groupBy("doc_id", "hash", "source").agg(F.max("n").alias("n"), F.sum("copies").alias("copies"))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copies) of the documents of the mixture.

    Rows with the same id, text and source are one document of as many times
    the size.  Null sources are a source of their own.  Documents whose text
    is null have no size and are never taken; empty texts have size 1; texts
    may be of any length.  Equal ranks are taken in the order of doc_id (null
    ids last) and text hash; equal remainders of sources in that of their names
    (a null one last).  If no source has a weight the mixture is empty, as it
    is of an empty table.  Other columns are ignored.
    """
    return copies(docs, **options).select("doc_id", "source", "copies")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mixture has it; all columns are kept.

    Defined as mix_counts; of rows with the same id, text and source the first
    by its other columns stands for all.
    """
    i, h, s, n, c = (fresh(docs.columns, x) for x in ("_i", "_h", "_s", "_n", "_c"))
    decided = cut(copies(docs, doc_id, text, source, **options).toDF(i, h, s, n, c))
    on = quoted(doc_id).eqNullSafe(quoted(i)) & (text_hash(quoted(text)) == quoted(h)) & quoted(source).cast("string").eqNullSafe(quoted(s))
    side = F.broadcast(decided) if decided.count() <= BROADCAST_ROWS else decided
    both = docs.where(quoted(text).isNotNull()).join(side, on).drop(i, h, s)
    kept = both.where(quoted(n) == 1)
    if not decided.where(quoted(n) > 1).isEmpty():
        kept = kept.union(one_of_each(both.where(quoted(n) > 1), [quoted(doc_id), text_hash(quoted(text)), quoted(source)]))
    k = fresh([*docs.columns, n, c], "_k")
    return kept.withColumn(k, F.explode(F.sequence(F.lit(1), quoted(c).cast("int")))).drop(n, c, k)
