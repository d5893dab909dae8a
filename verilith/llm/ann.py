"""Nearest neighbours by inner product with score-aware quantisation.

Vectors are split in pairs of dimensions, each pair quantised to one of 16
centres: four bits.  Centres and codes minimise a weighted error: the part of
the residual r that is parallel to the vector x changes large inner products
most, so it costs ETA times as much as the rest,

    loss = |r|**2 + (ETA - 1) * <r, x>**2 / |x|**2

What is quantised is the vector less its cell's centroid, whose inner product
with a query is the same for all of a cell and so changes no order in it; x is
still the whole vector.  Codes are found coordinate by coordinate, as the
parallel part hangs on all of a vector's codes; centres by weighted least
squares, on a sample of about SAMPLE vectors, on the driver.

Each vector lies in the cell of the nearest of CELLS centroids at most (from
the same sample).  A query looks into the cells whose centroids have the
largest inner products with it.  How many follows from the data: for TRIAL
queries, about, the true neighbours are found by brute force over all vectors,
and as many cells are taken as hold the share REACH of them.  Where vectors
have no clusters that is most cells, else few.  A cell of more than CODES
vectors is split in parts by hash, one of more than QUERIES queries too, so no
task holds more, however hot a cell is.

A block of codes is scanned with tables: for each query the inner products of
each pair of its dimensions with the 16 centres, rounded to eight bits; two
four-bit codes are one byte, which looks up the sum of two entries, and sums
are 16-bit integers.  The best of a block are reranked by the exact inner
product, next to where they lie, and just the neighbours leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilith.llm.common import cut, quoted

CENTRES, PAIR = 16, 2
#: Inner products (of unit vectors) from which on errors count.
SCORE = 0.2
#: Steps of training, and of choosing codes.
STEPS, SWEEPS = 6, 2
#: Vectors that centres and centroids are fitted to, and queries that the number of cells to look into is.
SAMPLE, TRIAL = 1 << 14, 128
#: Share of the trial's neighbours that the cells looked into have to hold.
REACH = 0.98
#: Vectors of a cell on average, and cells at most.
CELL_ROWS, CELLS = 1 << 12, 1 << 10
#: Rows of a block of queries and of a block of codes.
QUERIES, CODES = 1 << 13, 1 << 15
#: Candidates that are reranked, for each neighbour wanted, of a block of CODES rows; of smaller ones fewer, but LEAST.
RERANK, LEAST = 80, 8
#: Queries that are scanned at once, so that their tables stay in cache.
BATCH = 64


def eta_of(width: int, score: float = SCORE) -> float:
    """How much more the parallel error costs, for vectors of this length."""
    return max(1.0, (width - 1) * score**2 / (1 - score**2))


def padded(vectors: np.ndarray) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % PAIR)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return padded(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, PAIR), np.float32)


def codes(x: np.ndarray, centres: np.ndarray, eta: float, base: np.ndarray | None = None, sweeps: int = SWEEPS) -> np.ndarray:
    """Four-bit codes of ``x`` less ``base``, by coordinate descent on the anisotropic loss; parallel is what is so to ``x``."""
    parts = x.reshape(len(x), -1, PAIR)
    values = parts if base is None else (x - base).reshape(parts.shape)
    norm = np.maximum((x * x).sum(axis=1), 1e-12)
    out = np.empty(parts.shape[:2], np.uint8)
    parallel = np.zeros(len(x), np.float32)
    for m in range(parts.shape[1]):
        r = values[:, m, None, :] - centres[m]
        out[:, m] = (r * r).sum(axis=2).argmin(axis=1)
        parallel += ((values[:, m] - centres[m][out[:, m]]) * parts[:, m]).sum(axis=1)
    for _ in range(sweeps):
        for m in range(parts.shape[1]):
            r = values[:, m, None, :] - centres[m]
            along = (r * parts[:, m, None, :]).sum(axis=2)
            rest = parallel - np.take_along_axis(along, out[:, m, None].astype(np.int64), 1)[:, 0]
            loss = (r * r).sum(axis=2) + (eta - 1) * (rest[:, None] + along) ** 2 / norm[:, None]
            out[:, m] = loss.argmin(axis=1)
            parallel = rest + np.take_along_axis(along, out[:, m, None].astype(np.int64), 1)[:, 0]
    return out


def decoded(code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([centres[m][code[:, m]] for m in range(code.shape[1])], axis=1).reshape(len(code), -1)


def train(x: np.ndarray, base: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """Centres (pairs x CENTRES x PAIR) for the vectors ``x`` (one at least) less ``base``."""
    width = x.shape[1]
    eta, pairs = eta_of(width), width // PAIR
    rest_of = x if base is None else x - base
    start = np.resize(rest_of[:CENTRES], (CENTRES, width))
    centres = np.stack([start[:, m * PAIR : (m + 1) * PAIR] for m in range(pairs)]).astype(np.float32)
    parts = x.reshape(len(x), pairs, PAIR).astype(np.float64)
    values = rest_of.reshape(parts.shape).astype(np.float64)
    norm = np.maximum((x.astype(np.float64) ** 2).sum(axis=1), 1e-12)
    w = ((eta - 1) / norm)[:, None]
    left = parts[..., :, None] * parts[..., None, :] * w[..., None, None] + np.eye(PAIR)
    for _ in range(steps):
        code = codes(x, centres, eta, base).astype(np.int64)
        along = ((values - decoded(code, centres).reshape(parts.shape)) * parts).sum(axis=2)
        rest = along.sum(axis=1)[:, None] - along  # what the other pairs leave parallel
        # minimise |t - c|^2 + w (rest + <t - c, p>)^2 over c:  (I + w p p') c = t + w p (rest + <t, p>)
        right = values + parts * (w * (rest + (parts * values).sum(axis=2)))[..., None]
        for m in range(pairs):
            for c in range(CENTRES):
                own = code[:, m] == c
                if own.any():
                    centres[m, c] = np.linalg.solve(left[own, m].sum(axis=0), right[own, m].sum(axis=0))
    return centres


def centroids(x: np.ndarray, many: int, steps: int = STEPS) -> np.ndarray:
    """``many`` centroids of the vectors ``x`` at most."""
    out = np.unique(x[:many], axis=0)
    for _ in range(steps if len(out) > 1 else 0):
        own = nearest(x, out)
        sums = np.zeros((len(out), x.shape[1]))
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(out))
        out[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return out


def nearest(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((cells * cells).sum(axis=1) / 2 - x @ cells.T).argmin(axis=1)


def order_of(queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Each query's cells, those of the largest inner product first."""
    return np.argsort(-(queries @ cells.T), axis=1, kind="stable")


def packed(code: np.ndarray) -> np.ndarray:
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
    return code[:, ::2] | code[:, 1::2] << 4


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(bytes of a code x 256 x queries): what a byte adds to a query's score, in steps of the query's own size."""
    pairs = len(centres)
    t = np.einsum("mcd,qmd->mcq", centres, queries.reshape(len(queries), pairs, PAIR))
    t -= t.min(axis=1, keepdims=True)
    levels = min(255, 32_000 // (pairs + 1))
    step = np.maximum(t.max(axis=(0, 1)), 1e-30) / levels
    t = np.rint(t / step).astype(np.int16)
    if pairs % 2:
        t = np.concatenate([t, np.zeros_like(t[:1])])
    return (t[::2, None, :, :] + t[1::2, :, None, :]).reshape(len(t) // 2, CENTRES * CENTRES, -1)


def scan(queries: np.ndarray, code: np.ndarray, centres: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, places and table scores of the ``want`` best codes (packed; bytes x rows, as whole numbers)."""
    table = tables(queries, centres)
    scores = np.zeros((code.shape[1], len(queries)), np.int16)
    for own, at in zip(table, code):
        scores += own.take(at, axis=0)
    scores = np.ascontiguousarray(scores.T)
    if scores.shape[1] > want:
        best = np.argpartition(scores, scores.shape[1] - want, axis=1)[:, -want:]
    else:
        best = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return best, np.take_along_axis(scores, best, 1)


def best_of_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, code: np.ndarray, exact: np.ndarray, centres: np.ndarray, k: int, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, exact score) of the ``k`` best others of a block for each query."""
    place, _ = scan(queries, code, centres, want + 1)
    score = np.einsum("qcd,qd->qc", exact[place].astype(np.float64), queries.astype(np.float64))
    score[rows[place] == own[:, None]] = -np.inf  # a row isn't its own neighbour
    order = np.lexsort((rows[place], -score), axis=1)[:, :k]
    q = np.repeat(np.arange(len(queries)), order.shape[1])
    score, place = np.take_along_axis(score, order, 1).ravel(), np.take_along_axis(place, order, 1).ravel()
    keep = score > -np.inf
    return q[keep], place[keep], score[keep]


def sampled(df: DataFrame, rows: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows, by a hash of their numbers; all of them if they are no more."""
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) < (1 << 40) * most // rows)


def cells_to_look_into(plain: DataFrame, trial: np.ndarray, own: np.ndarray, cells: np.ndarray, k: int, reach: float) -> int:
    """As many as hold the share ``reach`` of the trial's neighbours, which are found by brute force over all vectors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = matrix(batch.column("v")), batch.column("row").to_numpy()
            if not len(x):
                continue
            score = trial @ x.T
            score[own[:, None] == rows[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
            cell = nearest(x, cells)
            q = np.repeat(np.arange(len(trial)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cell[top.ravel()]), pa.array(np.take_along_axis(score, top, 1).ravel().astype(np.float64)), pa.array(rows[top.ravel()])], names=["q", "cell", "score", "row"])

    found = plain.select("row", "v").mapInArrow(look, "q bigint, cell bigint, score double, row bigint")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    true = found.withColumn("k", F.row_number().over(first)).where((F.col("k") <= k) & (F.col("score") > float("-inf"))).select("q", "cell").toPandas()  # k rows for each query of the trial
    if not len(true):
        return len(cells)
    rank = np.argsort(order_of(trial, cells), axis=1)[true["q"].to_numpy(), true["cell"].to_numpy()]
    return int(np.sort(rank)[int(np.ceil(reach * len(rank))) - 1]) + 1


def left_out(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: how many rows ``neighbours`` leaves out for a null id, a null or empty vector, a bad element, another length."""
    rows = vectors.select(quoted(vec_id).alias("i"), quoted(vector).alias("v"))
    why = F.when(F.col("i").isNull(), "id").when(F.col("v").isNull() | (F.size("v") == 0), "vector").when(F.exists("v", _bad), "element")
    counts = rows.select(why.alias("why"), F.size("v").alias("n")).groupBy("why", "n").count()
    usual = counts.where("why is null").agg(F.coalesce(F.sum("count") - F.max("count"), F.lit(0)).alias("length"))
    n = lambda w: F.coalesce(F.sum(F.when(F.col("why") == w, F.col("count"))), F.lit(0)).alias(w)
    return counts.agg(n("id"), n("vector"), n("element")).crossJoin(F.broadcast(usual))  # one row each


def _bad(e: Column) -> Column:
    return e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))


def neighbours(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", asked: Column | None = None, rerank: int = RERANK, queries: int = QUERIES, codes_: int = CODES, cell_rows: int = CELL_ROWS, reach: float = REACH) -> DataFrame:
    """(vec_id, neighbour, rank, score): of every query, ``k`` others with the largest inner products.

    Queries are the rows where ``asked`` is true, all by default; they are
    searched among all rows.  Scores are exact; equal ones are ranked by the
    rows' order.  Repeated rows are queries, too; a row isn't its own
    neighbour but its copies are.  Null ids, null vectors and vectors with a
    null or infinite element are left out, and so are vectors whose length
    isn't that of most (of equally frequent lengths the least counts);
    ``left_out`` counts them.  Of fewer than ``k`` others all come back; an
    empty table gives an empty one.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = vectors.where(quoted(vec_id).isNotNull() & quoted(vector).isNotNull()).where(~F.exists(quoted(vector), _bad))
    plain = usable.select(quoted(vec_id).alias("i"), quoted(vector).cast("array<float>").alias("v"), F.coalesce(F.lit(True) if asked is None else asked, F.lit(False)).alias("asked")).where(F.size("v") > 0)
    kind = plain.schema["i"].dataType.simpleString()
    sizes = plain.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"vec_id {kind}, neighbour {kind}, rank int, score double")
    length, rows = sizes[0]
    width = length + -length % PAIR
    # a row's own number, so that copies are told apart
    plain = cut(plain.where(F.size("v") == length).withColumn("row", F.monotonically_increasing_id()).select("row", "i", "v", "asked"))
    sample = matrix(sampled(plain, rows, SAMPLE, 1).select("row", "v").orderBy(F.xxhash64("row")).select("v").toArrow().column(0).combine_chunks())
    cells = centroids(sample, min(CELLS, max(1, rows // cell_rows)))
    centres, eta = train(sample, cells[nearest(sample, cells)]), eta_of(width)
    ask = plain.where("asked").select("row", "i", "v")
    look_into = 1
    if len(cells) > 1:
        trial = sampled(ask, ask.count(), TRIAL, 2).select("row", "v").toArrow()
        if trial.num_rows:
            look_into = cells_to_look_into(plain, matrix(trial.column("v").combine_chunks()), trial.column("row").to_numpy(), cells, k, reach)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            if len(x):
                cell = nearest(x, cells)
                code = packed(codes(x, centres, eta, cells[cell]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bytes(r) for r in code], pa.binary()), pa.array(cell)], names=["row", "i", "v", "code", "cell"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            if len(x):
                found = order_of(x, cells)[:, :look_into].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["row", "i", "v", "cells"])

    encoded = cut(plain.select("row", "i", "v").mapInArrow(encode, f"row bigint, i {kind}, v array<float>, code binary, cell bigint"))
    placed = cut(ask.mapInArrow(place, f"row bigint, i {kind}, v array<float>, cells array<bigint>")).select("row", "i", "v", F.explode("cells").alias("cell"))
    per_cell = {r["cell"]: [r["count"], 0] for r in encoded.groupBy("cell").count().collect()}  # a row a cell, CELLS at most
    for r in placed.groupBy("cell").count().collect():
        per_cell.setdefault(r["cell"], [0, 0])[1] = r["count"]
    parts = F.broadcast(spark.createDataFrame([(c, max(1, -(-n // codes_)), max(1, -(-m // queries))) for c, (n, m) in per_cell.items()], "cell bigint, code_parts bigint, query_parts bigint"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = encoded.join(parts, "cell").select("cell", part("code_parts").alias("c"), others("query_parts").alias("q"), "row", "i", "v", "code")
    right = placed.join(parts, "cell").select("cell", others("code_parts").alias("c"), part("query_parts").alias("q"), "row", "i", "v")
    schema = f"q bigint, vec_id {kind}, row bigint, neighbour {kind}, score double"

    def look(mine: pa.Table, their: pa.Table) -> pa.Table:
        ids, names, x, own = mine.column("row").to_numpy(), mine.column("i"), matrix(their.column("v").combine_chunks()), their.column("row").to_numpy()
        out = {"q": [own[:0]], "place": [own[:0]], "at": [own[:0]], "score": [np.zeros(0)]}
        if mine.num_rows and their.num_rows:
            code = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).T.astype(np.intp)
            exact = matrix(mine.column("v").combine_chunks())
            want = max(LEAST * k, -(-k * rerank * len(ids) // CODES))
            for low in range(0, len(x), BATCH):
                q, place, score = best_of_block(x[low : low + BATCH], own[low : low + BATCH], ids, code, exact, centres, k, want)
                for name, value in (("q", own[low + q]), ("at", low + q), ("place", place), ("score", score)):
                    out[name].append(value)
        q, at, where, score = (np.concatenate(out[n]) for n in ("q", "at", "place", "score"))
        return pa.table([pa.array(q), their.column("i").take(pa.array(at)), pa.array(ids[where]), names.take(pa.array(where)), pa.array(score)], names=["q", "vec_id", "row", "neighbour", "score"])

    found = left.groupBy("cell", "c", "q").cogroup(right.groupBy("cell", "c", "q")).applyInArrow(look, schema)
    last = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("vec_id", "neighbour", "rank", "score")
