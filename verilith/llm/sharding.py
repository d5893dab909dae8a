"""Shards of linked documents by balanced label propagation.

All documents that share a line are linked with each other; a line shares one
vote of each document among the others, so that rare lines count for more in
each link.  The links themselves are never made: a line
counts its documents in each shard, and these counts are its vote, which is
that of all links, in work that is linear in occurrences.  A hot
line's occurrences are spread over parts, so that none is joined in one task.

Documents begin in groups: that of the least document within two shared lines,
or, where all lines have more documents than a shard, of the rarest of these
lines.  Groups larger than a shard are split.  The largest groups are
placed first, each into the emptiest shard, the others by hash in proportion
to the room that is left.  Documents without links come last, where room is.

In each round those that another shard would suit better ask to move there.
Between two shards as many may move as want to move the other way, and more
while there is room below the quota; those who gain most (to within a
hundredth) go first.  At last shards that are above the even size hand their
least linked documents to those below, group by group, so sizes differ by one
at most.  Who goes first is found by counting rows in buckets; just the bucket
that a quota cuts is sorted, never a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilith.llm.common import BROADCAST_ROWS, cut, quoted, text_hash

SHARDS, ROUNDS = 16, 6
#: Room above the even size while documents move.
SLACK = 0.05
CHAINS = 256
#: So many occurrences of a line at most, about, are joined under one key.
PART = 4096
#: The votes of one line, shared among its other documents.
WHOLE = 1_000_000
#: So many groups at most, the largest, are placed one by one on the driver.
PLACED = 4096
#: Buckets of hashes in which rows are counted, and rows that are numbered in one task, about.
BUCKETS, NUMBERED = 4096, 1 << 16


def nodes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, doc_id, hash, lines): rows with the same id and text are one node."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), text_hash(quoted(text)).alias("hash"), F.array_distinct(F.transform(F.filter(F.split(quoted(text), "\n", -1), lambda x: F.length(F.trim(x)) > 0), lambda x: F.xxhash64(x))).alias("lines"))
    return rows.select(F.xxhash64("doc_id", "hash").alias("node"), "doc_id", "hash", "lines")


def links(found: DataFrame) -> DataFrame:
    """(a, b, w): each link both ways, of (node, lines)."""
    rows = found.select(F.explode("lines").alias("line"), "node").withColumn("chain", F.pmod("node", F.lit(CHAINS)))
    inner = Window.partitionBy("line", "chain").orderBy("node")
    rows = rows.select("line", "chain", "node", F.lag("node").over(inner).alias("before"))
    heads = rows.where("before is null").select("node", F.lag("node").over(Window.partitionBy("line").orderBy("chain")).alias("before"))
    one = rows.select("node", "before").union(heads).where("before is not null and before <> node")
    one = one.groupBy(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).agg(F.count("*").alias("w"))
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def members(found: DataFrame) -> DataFrame:
    """(line, part, node, n, hub): the occurrences of shared lines, with the line's number of nodes and the least of them, of (node, lines)."""
    rows = found.select(F.explode("lines").alias("line"), "node").distinct()
    shared = rows.groupBy("line").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    return rows.join(shared, "line").select("line", F.pmod(F.xxhash64("node"), parts()).alias("part"), "node", "n", "hub")


def parts() -> Column:
    """The number of parts of a line with ``n`` nodes."""
    return F.ceil(F.col("n") / PART)


def votes(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, shard, to, w): for each linked node the weight of its links into each shard that has any."""
    placed = member.select("line", "part", "node", "n").join(labels.select("node", "shard"), "node")
    each = placed.groupBy("line", "n", "shard").agg(F.count("*").alias("w")).groupBy("line", "n").agg(F.collect_list(F.struct(F.col("shard").alias("to"), "w")).alias("counts"))
    each = each.select("line", "counts", F.explode(F.sequence(F.lit(0).cast("bigint"), parts() - 1)).alias("part"))
    all_ = placed.join(each, ["line", "part"]).select("node", "shard", "n", F.explode("counts").alias("c"))
    others = F.col("c.w") - F.when(F.col("c.to") == F.col("shard"), 1).otherwise(0)
    return all_.withColumn("w", others * WHOLE).groupBy("node", "shard", F.col("c.to").alias("to")).agg(F.sum(F.expr("w div (n - 1)")).alias("w"))


def wishes(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, shard, own, to, gain) of all linked nodes; ``to`` is the best other shard."""
    best = F.max(F.when(F.col("to") != F.col("shard"), F.struct("w", (-F.col("to")).alias("t"))))
    return votes(member, labels).groupBy("node", "shard").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("shard"), F.col("w"))), F.lit(0)).alias("own"), best.alias("best")).select("node", "shard", "own", (-F.col("best.t")).alias("to"), (F.coalesce(F.col("best.w"), F.lit(0)) - F.col("own")).alias("gain"))


def groups(member: DataFrame, even: int) -> DataFrame:
    """(node, seed): documents of a seed begin in one shard; about ``even`` have the same at most."""
    few = member.where(F.col("n") <= even)
    near = few.groupBy("node").agg(F.min("hub").alias("near"))
    far = few.select("line", "node").join(near, "node").groupBy("line").agg(F.min("near").alias("far"))
    small = few.select("line", "node").join(far, "line").groupBy("node").agg(F.min("far").alias("far")).join(near, "node")
    hot = member.where(F.col("n") > even).groupBy("node").agg(F.min(F.struct("n", "hub"))["hub"].alias("hot"))
    own = F.col("node")
    out = cut(member.select("node").distinct().join(small, "node", "left").join(hot, "node", "left").select("node", F.coalesce("near", own).alias("near"), F.coalesce("far", "hot").alias("far")))
    large = out.groupBy("far").count().where(F.col("count") > even).select("far", F.ceil(F.col("count") / even).alias("pieces"))  # fewer than there are shards
    return out.join(F.broadcast(large), "far", "left").select("node", F.xxhash64("far", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("near"), F.col("pieces")))).alias("seed"))


def begin(seeds: DataFrame, shards: int, total: int) -> DataFrame:
    """(node, shard, seed): the largest groups one by one into the emptiest shard, the others by hash where room is left."""
    spark, load, table = seeds.sparkSession, [0] * shards, []
    counts = seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "seed").limit(PLACED)
    for r in counts.collect():
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += r["n"]
        table.append((r["seed"], s))
    known = F.broadcast(spark.createDataFrame(table, "seed bigint, shard int"))
    return seeds.join(known, "seed", "left").select("node", F.coalesce("shard", by_room(load, total)).alias("shard"), "seed")


def by_room(load: list[int], total: int) -> Column:
    """A shard by the hash of ``seed``, in proportion to the room that the load leaves below the even size."""
    scale, shards, at, ends = 1 << 30, len(load), 0, []
    room = [max(0, -(-total // shards) - x) for x in load]
    for s in range(shards):
        at += room[s]
        ends.append(F.when(F.pmod(F.xxhash64("seed", F.lit(shards)), F.lit(scale)) < at * scale // max(sum(room), 1), s))
    return F.coalesce(*ends, F.lit(shards - 1)).cast("int")


def quotas(demand: dict[tuple[int, int], int], sizes: list[int], limit: int) -> dict[tuple[int, int], int]:
    """How many may move between each two shards: as many as the other way, and more while there is room."""
    out = {pair: min(n, demand.get(pair[::-1], 0)) for pair, n in demand.items()}
    room = [limit - s for s in sizes]
    for (a, b), n in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        more = max(0, min(n - out[a, b], room[b]))
        out[a, b] += more
        room[b] -= more
    return {pair: n for pair, n in out.items() if n}


def bucket(of: str) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(9)), F.lit(BUCKETS))


def first_of(rows: DataFrame, group: str, quota: str, levels: list[Column], order: list[Column]) -> DataFrame:
    """Of each ``group`` (there are few) the first ``quota`` rows by the levels (whole numbers), then ``order``.

    Rows are counted by the first level; of the number that the quota cuts by
    the next one, and so on.  ``rows`` are read several times.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[group]
    rest = rows.where(F.col(quota) > 0).select("*", F.col(quota).cast("bigint").alias("_room"), *[x.cast("bigint").alias(f"_l{k}") for k, x in enumerate(levels)])
    sure = []
    for k in range(len(levels)):
        level = F.col(f"_l{k}")
        so_far = Window.partitionBy(group).orderBy("l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = rest.groupBy(group, level.alias("l")).agg(F.count("*").alias("n"), F.max("_room").alias("q")).withColumn("to", F.sum("n").over(so_far))
        cuts = counts.where("to - n < q").groupBy(group).agg(F.max(F.when(F.col("to") <= F.col("q"), F.col("l"))).alias("last"), F.min(F.when(F.col("to") > F.col("q"), F.struct("l", (F.col("q") - F.col("to") + F.col("n")).alias("left")))).alias("edge"))
        table = [(r[group], r["last"], r["edge"] and r["edge"]["l"], r["edge"] and r["edge"]["left"]) for r in cuts.collect()]  # a row a group
        side = F.broadcast(spark.createDataFrame(table, f"{group} {kind}, _last bigint, _edge bigint, _left bigint"))
        both = rest.join(side, group)
        sure.append(both.where(level <= F.col("_last")).select(rows.columns))
        rest = both.where(level == F.col("_edge")).drop("_room", "_edge", "_last").withColumnRenamed("_left", "_room")
        if all(x[2] is None for x in table):
            break
    else:
        k += 1
    if k < len(levels):  # every quota falls between two buckets
        out, sure = sure[0], sure[1:]
        for x in sure:
            out = out.union(x)
        return out
    last = Window.partitionBy(group).orderBy(*[f"_l{j}" for j in range(len(levels))], *order)
    out = rest.withColumn("_k", F.row_number().over(last)).where("_k <= _room").select(rows.columns)
    for x in sure:
        out = out.union(x)
    return out


def numbered(rows: DataFrame, total: int, by: str, then: str) -> DataFrame:
    """``rows`` with ``r`` from 0 on, in an order that keeps equal ``by`` near each other; prefix sums over counts of buckets."""
    many = max(1, total // NUMBERED)
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(many)) * 64 + F.pmod(F.xxhash64(then), F.lit(64)))
    sums = placed.groupBy("_b").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_base")  # 64 rows for NUMBERED
    own = F.row_number().over(Window.partitionBy("_b").orderBy(by, then)) - 1
    return placed.withColumn("_own", own).join(sums, "_b").withColumn("r", F.col("_base") + F.col("_own")).drop("_b", "_own", "_base")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, hash, shard), one row for each different pair of id and text."""
    spark = docs.sparkSession
    found = nodes(docs, doc_id, text)
    member = cut(members(found.select("node", "lines")))
    all_ = cut(found.select("node", "doc_id", "hash").distinct())
    every = all_.select("node").distinct()
    total = every.count()
    seeds = groups(member, max(1, -(-total // shards)))
    linked = seeds.count()
    labels = cut(begin(seeds, shards, linked))

    def sizes(of: DataFrame) -> list[int]:
        out = [0] * shards
        for r in of.groupBy("shard").count().collect():
            out[r["shard"]] = r["count"]
        return out

    limit = max(total // shards, -(-linked * (1 + SLACK) // shards))  # documents without links take what room is left
    for n in range(rounds):
        half = F.pmod(F.xxhash64("node", F.lit(n)), F.lit(2)) == 0  # neighbours that swap places gain nothing, so half of all may ask
        asking = cut(wishes(member, labels).where((F.col("gain") > 0) & half))
        allowed = quotas({(r["shard"], r["to"]): r["count"] for r in asking.groupBy("shard", "to").count().collect()}, sizes(labels), int(limit))
        if not allowed:
            break
        table = F.broadcast(spark.createDataFrame([(a, b, q) for (a, b), q in allowed.items()], "shard int, to int, quota bigint"))  # shards x shards rows
        asked = asking.join(table, ["shard", "to"]).withColumn("way", F.col("shard") * shards + F.col("to"))
        moved = first_of(asked, "way", "quota", [-F.floor(F.log2("gain") * 64), bucket("node")], [F.desc("gain"), F.col("node")]).select("node", "to")
        labels = cut(labels.join(moved, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard"), "seed"))
    alone = every.join(labels, "node", "left_anti").withColumn("seed", F.col("node"))
    labels = cut(labels.union(alone.select("node", by_room(sizes(labels), total).alias("shard"), "seed")))
    labels = evened(labels, member, sizes(labels))
    return all_.join(labels, "node")


def evened(labels: DataFrame, member: DataFrame, sizes: list[int]) -> DataFrame:
    """(node, shard) with sizes that differ by one at most; the documents with the least links to their shard move, those of a group together."""
    spark, total, n = labels.sparkSession, sum(sizes), len(sizes)
    order = sorted(range(n), key=lambda s: (-sizes[s], s))
    goal = [0] * n
    for k, s in enumerate(order):
        goal[s] = total // n + (k < total % n)
    over = [(s, sizes[s] - goal[s]) for s in range(n) if sizes[s] > goal[s]]
    if not over:
        return labels.select("node", "shard")
    first, at = [], 0
    for s in range(n):
        if goal[s] > sizes[s]:
            first.append((at, at + goal[s] - sizes[s], s))
            at += goal[s] - sizes[s]
    ties = wishes(member, labels).select("node", "own")
    table = F.broadcast(spark.createDataFrame(over, "shard int, q bigint"))
    into = F.broadcast(spark.createDataFrame(first, "low bigint, high bigint, to int"))
    able = cut(labels.join(table, "shard").join(ties, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    strength = F.when(F.col("own") > 0, F.floor(F.log2("own") * 8) + 1).otherwise(0).cast("bigint")
    out = first_of(able, "shard", "q", [strength, bucket("seed"), bucket("node")], [F.col("seed"), F.col("node")])
    ranked = numbered(cut(out.select("node", "seed")), sum(q for _, q in over), "seed", "node")
    moved = ranked.join(into, (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high"))).select("node", "to")
    return labels.join(moved, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard) of all documents; shards are numbered from 0.

    Sizes, in different documents, differ by one at most.  Rows with the same
    id and text are one document and have one row.  Documents with null or
    empty texts, and lines of white space, have no links.  Of shards that suit
    a document equally its own counts, then the least number; documents that
    gain equally move in the order of a hash, so the result follows from the
    rows alone.  Texts are taken whole, whatever their length; an empty table
    gives an empty one; with one shard all lie in it.  Other columns are
    ignored.
    """
    if shards < 1:
        raise ValueError("there is at least one shard")
    return assign(docs, shards, rounds, doc_id, text).select("doc_id", "shard")


def cut_weight(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """The weight of links between shards and of all, given ``assign``'s rows."""
    linked = links(nodes(docs, doc_id, text).select("node", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines")).distinct())
    side = placed.select("node", "shard")
    both = linked.where("a < b").join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b")
    row = both.agg(F.coalesce(F.sum(F.when(F.col("x") != F.col("y"), F.col("w"))), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return row[0], row[1]


def cut_pairs(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int | None = None) -> tuple[int, int]:
    """The pairs of documents that share a line and lie in different shards, and all that share one, once for each line (of ``most`` documents at most)."""
    member = members(nodes(docs, doc_id, text).select("node", "lines"))
    if most is not None:
        member = member.where(F.col("n") <= most)
    each = member.join(placed.select("node", "shard"), "node").groupBy("line", "n", "shard").count()
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    lines = each.groupBy("line", "n").agg(F.sum(pairs("count")).alias("inside")).withColumn("all", pairs("n"))
    row = lines.agg(F.coalesce(F.sum(F.col("all") - F.col("inside")), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    return row[0], row[1]
