"""Near-duplicate documents by b-bit MinHash.

Texts are sets of pairs of neighbouring words (lower case, signs ignored; a
text of one word is that word).  Each set has PERMUTATIONS minima.  Bands of
ROWS minima find candidates; of every minimum just BITS low bits are kept and
packed, and the similarity of candidates is estimated from how many of them
agree, corrected for those that agree by chance:

    J = (agreeing / PERMUTATIONS - 2**-BITS) / (1 - 2**-BITS)

Documents of equal minima are one node from the start, so exact copies never
meet in a band.  In each bucket the connected components at the threshold are
found over all its pairs, by a search that compares what was reached with what
was not yet.  A bucket of n near copies costs about n comparisons and gives
n - 1 edges; one of n texts that just share a passage costs n**2 / 2.  No
bucket is capped: one of more than BLOCK nodes is split in blocks, and every
two blocks are a task's bucket of their own, so all its pairs are still
compared, in many tasks of bounded memory.  Components of all edges are the
groups.

Nodes are 64-bit digests of the minima: of n different texts about n**2 / 2**65
pairs are taken for one by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilith.llm.common import BROADCAST_ROWS, cut, fresh, one_of_each, quoted, text_hash

PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
THRESHOLD = 0.55
BLOCK_CHARS = 400_000
#: Nodes of a bucket that are compared in one task.
BLOCK = 1 << 13

_U = np.uint64
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(_ODD[3])
    x = (x ^ (x >> _U(29))) * _U(_ODD[2])
    return x ^ (x >> _U(32))


_WORD: list[np.ndarray] = []


def word_characters() -> np.ndarray:
    if not _WORD:
        table = np.zeros(0x110000, bool)
        for first in range(0, 0x110000, 0x8000):
            text = "".join(chr(p) for p in range(first, first + 0x8000) if not 0xD800 <= p < 0xE000)
            table[[ord(c) for c in regex.findall(r"[\p{L}\p{N}\p{M}]", text)]] = True
        _WORD.append(table)
    return _WORD[0]


def hash_runs(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of characters that ``table`` has, and the number of each text's."""
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = table[points]
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = np.flatnonzero(start)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(at, np.r_[0, ends]))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    letters = points[word].astype(np.uint64) * _U(_ODD[0])
    letters ^= letters >> _U(31)
    first = np.flatnonzero(start[word])
    sizes = np.diff(np.r_[first, len(letters)])
    powers = np.cumprod(np.r_[_U(1), np.full(int(sizes.max()), _ODD[1], np.uint64)], dtype=np.uint64)
    letters *= powers[np.arange(len(letters)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64)), counts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of each text's."""
    return hash_runs([t.lower() for t in texts], word_characters())


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the word pairs of all texts, and the number of each text's."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.uint32), counts
    ends = np.cumsum(counts)
    pair = np.r_[words[:-1] * _U(_ODD[1]) + words[1:], words[-1]]
    keep = np.ones(len(words), bool)
    last = ends[counts > 0] - 1
    keep[last] = False
    alone = ends[counts == 1] - 1
    keep[alone] = True
    pair[alone] = words[alone]
    return (mix(pair[keep]) >> _U(32)).astype(np.uint32), np.where(counts > 1, counts - 1, counts)


def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) | _U(1)


_A, _B, _R = _permutations()


def minima(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Minima, one row for each text that has words, and which texts those are."""
    hashes, counts = shingles(texts)
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    out = np.empty((PERMUTATIONS, len(has)), np.uint32)
    if len(has):
        work = np.empty_like(hashes)
        for k in range(PERMUTATIONS):
            np.multiply(hashes, _A[k], out=work)
            work += _B[k]
            work ^= work >> np.uint32(15)  # so that the order isn't that of a straight line
            np.minimum.reduceat(work * np.uint32(0x2C1B3C6D), starts, out=out[k])
    return out.T, has


def pack(found: np.ndarray) -> np.ndarray:
    """The BITS low bits of mixed minima, packed in 64-bit words."""
    low = (mix(found.astype(np.uint64) + _U(1)) & _U((1 << BITS) - 1)).reshape(len(found), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS)), axis=2)


_LOWEST = _U(sum(1 << (BITS * k) for k in range(64 // BITS)))


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for agreement by chance."""
    x = one ^ many
    for shift in (1, 2)[: BITS.bit_length() - 1]:
        x = x | (x >> _U(shift))
    agree = PERMUTATIONS - np.bitwise_count(x & _LOWEST).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (agree / PERMUTATIONS - chance) / (1 - chance)


SIGNED = "_hash bigint, _node bigint, _packed binary, _bands array<bigint>"


def signatures(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Node, packed bits and band hashes of each text; the last two are null where it has no words."""
    values = ["" if v is None else v for v in texts.to_pylist()]
    nodes, packed, bands = np.zeros(len(values), np.uint64), np.zeros((len(values), PERMUTATIONS * BITS // 64), np.uint64), np.zeros((len(values), BANDS), np.uint64)
    has = np.zeros(len(values), bool)
    low = 0
    while low < len(values):
        high, size = low + 1, len(values[low])
        while high < len(values) and size + len(values[high]) <= BLOCK_CHARS:
            size += len(values[high])
            high += 1
        found, which = minima(values[low:high])
        which = which + low
        has[which] = True
        wide = found.astype(np.uint64) + _U(1)
        nodes[which] = mix((mix(wide) * _R).sum(axis=1, dtype=np.uint64))
        packed[which] = pack(found)
        parts = mix(wide).reshape(len(which), BANDS, ROWS) * _R[:ROWS]
        bands[which] = mix(parts.sum(axis=2, dtype=np.uint64) + _R[:BANDS])
        low = high
    width = packed.shape[1] * 8
    binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [pa.array(has).buffers()[1], pa.py_buffer(packed.tobytes())]).cast(pa.binary()) if len(values) else pa.array([], pa.binary())
    offsets = pa.array(np.r_[0, np.cumsum(has * BANDS)].astype(np.int32), mask=np.r_[~has, False])
    return pa.array(nodes.view(np.int64), mask=~has), binary, pa.ListArray.from_arrays(offsets, pa.array(bands[has].ravel().view(np.int64)))


def signed(docs: DataFrame, text: str, others: list[str]) -> DataFrame:
    """Columns ``others``, the text's hash, its node, packed bits and bands.

    A text without words gets its hash as node: it is grouped with exact
    copies only.  Null texts get a null node: they are copies of nothing.
    """
    plain = docs.select(*[quoted(c).alias(f"_{k}") for k, c in enumerate(others)], quoted(text).alias("_text"), text_hash(quoted(text)).alias("_hash"))
    kept = [f for f in plain.schema.fields if f.name != "_text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column("_text"), batch.column("_hash")
            node, packed, bands = signatures(texts)
            node = pa.compute.if_else(pa.compute.is_null(texts), pa.scalar(None, pa.int64()), pa.compute.coalesce(node, hashes))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], node, packed, bands], names=[*[f.name for f in kept], "_node", "_packed", "_bands"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _node bigint, _packed binary, _bands array<bigint>"
    return plain.mapInArrow(sign, schema)


def joined(nodes: np.ndarray, packed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket, each node but the least of its component, and that one.

    Components are exact: every node that was reached is compared with all
    that were not.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, packed = nodes[order], packed[order]
    rest, out_a, out_b = np.arange(len(nodes)), [], []
    while len(rest) > 1:
        first, front = rest[0], rest[:1]
        rest = rest[1:]
        while len(front) and len(rest):
            one, front = front[0], front[1:]
            near = similarity(packed[one], packed[rest]) >= threshold
            hit = rest[near]
            rest = rest[~near]
            front = np.concatenate((front, hit))
            out_a.append(nodes[hit])
            out_b.append(np.full(len(hit), nodes[first]))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (nodes[:0], nodes[:0])


def edges_of(buckets: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges of buckets (band, node, packed) that come sorted by band, each whole within the iterator."""

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, np.zeros(0, np.int64)])), pa.array(np.concatenate([*b, np.zeros(0, np.int64)]))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def closed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        band, node, packed = (np.concatenate(x) for x in zip(*parts))
        cuts = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        found = [joined(node[i:j], packed[i:j], threshold) for i, j in zip(cuts, cuts[1:]) if j - i > 1]
        return out([a for a, _ in found], [b for _, b in found])

    for batch in buckets:
        if not batch.num_rows:
            continue
        band, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(band), -1)
        last = int(np.searchsorted(band, band[-1]))  # the last bucket may go on in the next batch
        if last:
            yield closed([*held, (band[:last], node[:last], packed[:last])])
            held = []
        elif held and held[-1][0][-1] != band[0]:
            yield closed(held)
            held = []
        held.append((band[last:], node[last:], packed[last:]))
    if held:
        yield closed(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, least) of the connected components of edges (a, b).

    Alternating stars: every node links its larger neighbours, then its
    smaller ones, to the least of them, until nothing changes.  No step
    gathers a node's neighbours in one row.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        """``e`` with m, the least of a's neighbours and a; a hot a is summed up before it is moved, and its rows can be split in the join."""
        return e.join(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = summary(edges)
    while before[0]:
        large = cut(least(both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small = least(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        after = summary(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))


def bucketed(members: DataFrame, block: int | None = None) -> DataFrame:
    """(_bucket, _node, _packed) of members (_band, _n, _node, _packed): bands of more than ``block`` (by default BLOCK) nodes give a bucket for every two of their blocks."""
    block = block or BLOCK
    blocks = F.ceil(F.col("_n") / block)
    own = F.pmod(F.xxhash64("_node"), blocks)
    small = members.where(F.col("_n") <= block).select(F.col("_band").alias("_bucket"), "_node", "_packed")
    large = members.where(F.col("_n") > block).select("_band", "_node", "_packed", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_other")).where("_own <> _other")
    return small.union(large.select(F.xxhash64("_band", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_bucket"), "_node", "_packed"))


def groups(docs: DataFrame, text: str, others: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs whose text isn't null: ``others`` as _0, _1 ..., _hash and _group."""
    rows = cut(signed(docs, text, others).where("_node is not null"))
    nodes = rows.where("_bands is not null").groupBy("_node").agg(F.first("_packed").alias("_packed"), F.first("_bands").alias("_bands"))
    banded = nodes.select(F.explode("_bands").alias("_band"), "_node")
    shared = cut(banded.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1"))
    members = banded.join(shared, "_band").join(nodes.select("_node", "_packed"), "_node").select("_band", "_n", "_node", "_packed")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucketed(members).repartition(spread, "_bucket").sortWithinPartitions("_bucket")
    edges = buckets.mapInArrow(lambda batches: edges_of(batches, threshold), "a bigint, b bigint")
    least = components(edges).withColumnRenamed("node", "_node")
    return rows.drop("_packed", "_bands").join(least, "_node", "left").withColumn("_group", F.coalesce("least", "_node")).drop("least", "_node")


def _keepers(found: DataFrame, order: Column) -> DataFrame:
    """(_group, _keep): the first document of each group of two rows or more."""
    return found.groupBy("_group").agg(F.min(order).alias("_keep"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): every document that another of its group stands for.

    A group's document with the least id stays (null ids last); the others are
    listed with its id.  Rows with the id and text of the one that stays are
    listed too, once for each further row.  Of equal ids with different texts
    the one with the least hash of the text stays.  Null texts are in no group;
    empty texts and texts without words are grouped with exact copies only.
    Texts are taken whole, whatever their length.  An empty table gives an empty one.  Other columns are
    ignored.
    """
    found = cut(groups(docs, text, [doc_id], threshold))
    keep = _keepers(found, F.struct(F.col("_0").isNull().alias("n"), F.col("_0").alias("i"), F.col("_hash").alias("h")))
    paired = found.join(keep, "_group")
    same = F.col("_0").eqNullSafe(F.col("_keep.i")) & (F.col("_hash") == F.col("_keep.h"))
    others = paired.where(~same).select(F.col("_0").alias("doc_id"), F.col("_keep.i").alias("duplicate_of"))
    again = paired.where(same).groupBy("_0").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_0").alias("doc_id"), F.explode(F.array_repeat("_0", (F.col("n") - 1).cast("int"))).alias("duplicate_of"))
    return others.union(again)


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group; all columns are kept.

    As near_duplicates, and of rows with the same id and text one stays: the
    first by its other columns.  Rows with null text all stay.
    """
    found = cut(groups(docs, text, [doc_id], threshold))
    keep = _keepers(found, F.struct(F.col("_0").isNull().alias("n"), F.col("_0").alias("i"), F.col("_hash").alias("h")))
    paired = found.join(keep, "_group")
    same = F.col("_0").eqNullSafe(F.col("_keep.i")) & (F.col("_hash") == F.col("_keep.h"))
    i, h, state = fresh(docs.columns, "_i"), fresh(docs.columns, "_h"), fresh(docs.columns, "_state")
    decided = cut(paired.groupBy(F.col("_0").alias(i), F.col("_hash").alias(h)).agg(F.max(F.when(same, F.lit(1)).otherwise(0)).alias(state), F.count("*").alias("_n")).where(f"`{state}` = 0 or _n > 1").drop("_n"))
    n = decided.count()
    if not n:
        return docs
    side = F.broadcast(decided) if n <= BROADCAST_ROWS else decided
    on = quoted(doc_id).eqNullSafe(quoted(i)) & (text_hash(quoted(text)) == quoted(h)) & quoted(text).isNotNull()
    left = docs.join(side, on, "left").drop(i, h)
    once = left.where(quoted(state).isNull()).drop(state)
    if decided.where(quoted(state) == 1).isEmpty():
        return once
    again = left.where(quoted(state) == 1).drop(state)
    return once.union(one_of_each(again, [quoted(doc_id), text_hash(quoted(text))]))
