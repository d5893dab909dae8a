"""Searches: keys, candidates, verification on the text, budgets.

The order of decisions: no keys; the first key that no line has; candidates
over their cap; a result cap of 0; then verification, granule by granule, up
to the byte budget (the first granule that would exceed it and all behind it
are left) and the result cap.  Sums of bytes need no text, so the budget is
applied first and just lines within it are read; under a result cap ever longer
beginnings of the candidates are read until one has enough hits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilith.functions import text as T
from verilith.operators.containers import before
from verilith.operators.index import Index
from verilith.options import SearchOptions
from verilith.sources.store import shared_folder

#: Keys of a batch of queries that lines are tested for as they are read; more are joined.
BROADCAST_KEYS = 20_000

#: Granules of the first beginning that is read under a result cap, and how much longer the next one is.
FIRST, LONGER = 1 << 14, 32


@dataclass
class Report:
    hits: DataFrame
    capped: bool = False
    incomplete_reason: str | None = None
    selected_keys: list[str] = field(default_factory=list)
    missing_keys: list[str] = field(default_factory=list)
    high_df_keys: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


HITS = ["container_id", "granule_id", "logical_offset", "byte_length", "chunk_start", "chunk_end"]


def spans(kind: str, query: str, keys: list[str], line: str = "line") -> Column:
    return T.token_spans(F.col(line), keys) if kind == "token" else T.substring_spans(F.col(line), F.lit(query))


def candidates(posted: DataFrame, keys: list[str]) -> DataFrame:
    """Granules that have all keys."""
    own = posted.where(F.col("key").isin(keys))
    return own.groupBy("granule_id").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(keys)).select("granule_id")


def verified(lines: DataFrame, kind: str, query: str, keys: list[str]) -> DataFrame:
    """Candidate lines with all their spans, none if the text doesn't bear the query out."""
    own = spans(kind, query, keys)
    if kind == "token":
        own = F.when(F.size(F.array_intersect(T.tokens(F.col("line")), F.array(*map(F.lit, keys)))) == len(keys), own).otherwise(F.array().cast(T.SPANS))
    return lines.withColumn("spans", own)


def hit_rows(rows: DataFrame, options: SearchOptions, extra: list[str] | None = None) -> DataFrame:
    """Hits of verified lines; chunk_start and chunk_end are those of the line."""
    each = rows.select(*(extra or []), "container_id", "granule_id", F.col("logical_offset").alias("at"), "chunk_start", "chunk_end", "hits_before", F.posexplode("spans").alias("k", "s"))
    if options.max_results is not None:
        each = each.where(F.col("hits_before") + F.col("k") < options.max_results)
    return each.select(*(extra or []), "container_id", "granule_id", (F.col("at") + F.col("s.offset")).alias("logical_offset"), F.col("s.length").alias("byte_length"), "chunk_start", "chunk_end")


def search(index: Index, query: str, options: SearchOptions = SearchOptions()) -> Report:
    """Search one index.  The terms of the query's keys come to the driver, and counts; lines don't."""
    kind, keys = index.kind, T.query_keys(query, index.kind, index.n)
    none = index.granules.select(*HITS).limit(0)
    out = Report(none, metrics={"term_lookups": len(keys), "posting_bytes_read": 0, "candidate_granules": 0, "candidate_chunks": 0, "decoded_bytes": 0, "physical_decoded_bytes": 0, "verified_matches": 0})
    if not keys:
        out.incomplete_reason = "query_has_no_indexable_tokens" if kind == "token" else "query_shorter_than_ngram_n"
        return out
    known = {r["key"]: r for r in index.terms.where(F.col("key").isin(keys)).collect()}  # as many rows as the query has keys
    missing = next((k for k in keys if k not in known), None)
    read = lambda k: known[k]["posting_size"] if kind == "token" or known[k]["granule_frequency"] < 1024 else min(24 * known[k]["skip_points"] + 16, known[k]["posting_size"])
    if missing is not None:
        out.missing_keys = [missing]
        if kind == "token":
            out.metrics["posting_bytes_read"] = sum(read(k) for k in keys[: keys.index(missing)])
        elif not index.complete:
            out.incomplete_reason = "missing_required_key_in_incomplete_index"
        return out
    often = {k: known[k]["granule_frequency"] * 1_000_000 // max(index.granule_count, 1) >= index.per_million for k in keys}
    out.selected_keys = sorted(keys, key=lambda k: known[k]["granule_frequency"]) if kind == "token" else sorted(keys, key=lambda k: (often[k], known[k]["granule_frequency"]))
    out.high_df_keys = [k for k in keys if often[k]] if kind == "ngram" else []
    out.metrics["posting_bytes_read"] = sum(map(read, keys))
    able = candidates(index.postings, keys)
    lines = index.granules.join(able, "granule_id", "left_semi")
    chunks = F.transform(F.sequence("chunk_start", F.col("chunk_end") - 1), lambda c: F.struct(F.col("container_id").alias("k"), c.alias("c")))
    counted = lines.select("byte_length", F.explode(chunks).alias("c"), (F.col("chunk_start") == F.col("c.c")).alias("_one")).groupBy("c").agg(F.sum(F.when(F.col("_one"), 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("_one"), F.col("byte_length"))).alias("b"))
    counted = counted.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.count("*").alias("c"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    out.metrics |= {"candidate_granules": counted["g"], "candidate_chunks": counted["c"]}
    if counted["g"] > options.max_candidates or options.max_results == 0:
        out.capped = True
        return out
    over = counted["b"] > options.max_decoded_bytes
    if over:
        sized = before(index.granules.select("granule_id", "byte_length").join(able, "granule_id", "left_semi"), [], "granule_id", {"_decoded": F.col("byte_length")})
        lines = index.granules.join(sized.where(F.col("_decoded") + F.col("byte_length") <= options.max_decoded_bytes), "granule_id", "left_semi")
    reach = index.granule_count if options.max_results is None else FIRST
    while True:
        some = lines if reach >= index.granule_count else lines.where(F.col("granule_id") < reach)
        # verified once: what is kept has places, not text
        rows = _kept(verified(some, kind, query, keys).select("container_id", "granule_id", "logical_offset", "byte_length", "chunk_start", "chunk_end", "chunk_sizes", "spans"))
        hits = rows.agg(F.coalesce(F.sum(T.big(F.size("spans"))), F.lit(0)).alias("h")).first()["h"]
        if reach >= index.granule_count or hits >= options.max_results:
            break
        reach *= LONGER
    if options.max_results is None:
        rows = rows.withColumn("hits_before", F.lit(0).cast("bigint"))
    else:
        rows = before(rows, [], "granule_id", {"hits_before": T.big(F.size("spans"))}).where(F.col("hits_before") < options.max_results)
        hits = min(hits, options.max_results)
    each = rows.select("byte_length", "container_id", F.posexplode(F.arrays_zip(F.sequence("chunk_start", F.col("chunk_end") - 1).alias("id"), F.col("chunk_sizes").alias("size"))).alias("k", "c"))
    # one row for each chunk of a line: the first stands for the line
    touched = each.groupBy("container_id", "c.id").agg(F.max("c.size").alias("chunk"), F.sum(F.when(F.col("k") == 0, F.col("byte_length"))).alias("decoded"))
    zero = F.lit(0).cast("bigint")
    sums = touched.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("chunk", "decoded")]).first()
    out.hits = hit_rows(rows, options)
    out.capped = (options.max_results is not None and hits >= options.max_results) or over
    out.metrics |= {"decoded_bytes": sums["decoded"], "physical_decoded_bytes": sums["chunk"], "verified_matches": hits}
    return out


def _kept(rows: DataFrame) -> DataFrame:
    """Rows written to the folder that all executors share, and read again."""
    folder = shared_folder(rows.sparkSession, "verified")
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def scan(lines: DataFrame, kind: str, query: str, n: int = 3) -> DataFrame:
    """All hits without an index: lines are tested as they are read."""
    keys = T.query_keys(query, kind, n)
    if not keys:
        return lines.select(*HITS).limit(0)
    if kind == "token":
        likely = F.lower("line")
        for k in keys:
            lines = lines.where(likely.contains(k))
    else:
        lines = lines.where(F.col("line").contains(query))
    return hit_rows(verified(lines, kind, query, keys).where(F.size("spans") > 0).withColumn("hits_before", F.lit(0)), SearchOptions())


def search_batch(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, matches, candidate_granules) of many token queries (query_id, keys) in one plan.

    Queries without a key have no candidates.  The rarest key of a query makes
    its candidates, which are then held against all keys.  Lines are told apart
    by nothing, and where the rarest keys are few they aren't moved: each is
    tested for these keys where it is read.
    """
    wanted = queries.select(F.explode("keys").alias("key")).distinct()
    listed = [r["key"] for r in wanted.limit(BROADCAST_KEYS + 1).collect()]
    words = lines.select(T.tokens(F.col("line")).alias("w")).withColumn("d", F.array_distinct("w"))
    few = len(listed) <= BROADCAST_KEYS and queries.count() <= BROADCAST_KEYS
    posted = words.select(F.explode(F.filter("d", lambda t: t.isin(listed)) if few else F.col("d")).alias("key"))
    often = (posted if few else posted.join(wanted, "key", "left_semi")).groupBy("key").agg(F.count("*").alias("n"))
    rarest = queries.select("query_id", "keys", F.explode("keys").alias("key")).join(often, "key", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))["key"].alias("key"), F.first("keys").alias("keys"))
    if few:
        rarest = [tuple(r) for r in rarest.where("key is not null").select("query_id", "key", "keys").collect()]  # as many as there are queries of the listed keys
        rarest = queries.sparkSession.createDataFrame(rarest, queries.select("query_id", F.lit("").alias("key"), "keys").schema)
        chosen = sorted({r["key"] for r in rarest.select("key").collect()})
        able = words.select("w", F.explode(F.filter("d", lambda t: t.isin(chosen))).alias("key")).join(F.broadcast(rarest), "key")
    else:
        able = words.select("w", F.explode("d").alias("key")).join(rarest, "key")
    able = able.where(F.size(F.array_except("keys", "w")) == 0)
    done = able.groupBy("query_id").agg(F.count("*").alias("candidate_granules"), F.sum(T.big(F.size(F.filter("w", lambda t: F.array_contains(F.col("keys"), t))))).alias("matches"))
    return queries.select("query_id").join(done, "query_id", "left").select("query_id", F.coalesce("candidate_granules", F.lit(0)).alias("candidate_granules"), F.coalesce("matches", F.lit(0)).alias("matches"))
