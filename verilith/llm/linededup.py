"""Removal of passages that came before, by windows of three units.

A text is cut into units: its lines, or its clauses.  A clause ends behind
signs such as comma, full stop or line feed, so a passage is found again
though the lines around it are others or it begins within one.  Every three
consecutive units of a text are a window.  Of a window that occurs more than
once in all texts the first occurrence (by doc_id, null ids last, then
position) stays; the units that later ones cover, together, are removed.  A
unit that goes is therefore always still there in an earlier place.

Lines are compared as they are, clauses by their words (white space and the
signs that end them don't count).  Three short clauses are often alike by
chance, so a window of clauses counts from LEAST characters on, or where each of the
three ends a line.

Windows are compared by 96 bits of hash.  First just 64 of them are moved, to
find what is repeated at all; positions are moved once, to that.  Hot windows
are reduced before the join, never sorted in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilith.llm.common import BROADCAST_ROWS, blocks, cut, fresh, quoted, text_hash
from verilith.llm.minhash import mix

WINDOW = 3
#: Characters, signs between clauses not counted, from which on a window of clauses counts.
LEAST = 60
SIGNS = ".,;:!?。，、！？；："
CLAUSE = f"[^{SIGNS}\\n]*[{SIGNS}\\n]+[ \\t\\r]*|[^{SIGNS}\\n]+"
BETWEEN = f"[{SIGNS} \\t\\r\\n]+"
UNITS = ("lines", "clauses")


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_POWERS = [np.cumprod(np.r_[np.uint64(1), np.full(1 << 12, m, np.uint64)], dtype=np.uint64) for m in _MULTIPLIERS]


#: 0 part of a word, 1 sign, 2 blank; 3 is behind a text
_KINDS = np.zeros(0x110000, np.uint8)
_KINDS[[ord(c) for c in SIGNS + "\n"]] = 1
_KINDS[[ord(c) for c in " \t\r"]] = 2


def _power(which: int, exponents: np.ndarray) -> np.ndarray:
    most = int(exponents.max(initial=0))
    while len(_POWERS[which]) <= most:
        _POWERS[which] = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(_POWERS[which]), _MULTIPLIERS[which], np.uint64)], dtype=np.uint64)
    return _POWERS[which][exponents]


def clauses(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashes, characters, whether it ends a line) of all clauses of all texts, by the rule of CLAUSE, in linear time."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # one sign that is of no kind behind each text
    stops = np.cumsum(lengths)
    begins = stops - lengths
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[points]
    kind[stops - 1] = 3
    solid = np.maximum.accumulate(np.where(kind == 2, -1, np.arange(len(points))))  # the last place up to here that isn't blank
    start = np.zeros(len(points), bool)
    start[1:] = (kind[1:] != 2) & (solid[:-1] >= 0) & (kind[np.maximum(solid[:-1], 0)] == 1) & ~((kind[1:] == 1) & (kind[:-1] == 1))
    start[begins] = True
    start[stops - 1] = False
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.add.reduceat(points == 10, at) > 0
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    place, letters = np.flatnonzero(first), points[word].astype(np.uint64)
    size, hashes = np.zeros(len(at), np.int64), np.zeros((2, len(at)), np.uint64)
    if len(place):
        low = np.flatnonzero(first[word])
        sizes = np.diff(np.r_[low, len(letters)])
        letters = mix(letters + np.uint64(1)) * _power(0, np.arange(len(letters)) - np.repeat(low, sizes))
        words = mix(np.add.reduceat(letters, low) + sizes.astype(np.uint64))
        unit = np.searchsorted(at, place, side="right") - 1
        head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        many = np.diff(np.r_[head, len(unit)])
        rank = np.arange(len(unit)) - np.repeat(head, many)
        size[unit[head]] = np.add.reduceat(sizes, head) + many - 1
        for k in (0, 1):
            hashes[k, unit[head]] = mix(np.add.reduceat((words ^ np.uint64(k)) * _power(k, rank), head) + many.astype(np.uint64))
    return np.searchsorted(stops, at, side="right"), hashes, size, ends


def clause_windows(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, two hashes) of the windows that count."""
    text, hashes, chars, ends = clauses(texts)
    n = max(0, len(text) - size + 1)
    at = np.arange(n)
    good = (text[:n] == text[size - 1 :][:n]) if n else np.zeros(0, bool)
    total, lines, found = np.zeros(n, np.int64), np.ones(n, bool), np.zeros((2, n), np.uint64)
    for j in range(size):
        total += chars[j : n + j]
        lines &= ends[j : n + j]
        found = mix(found * _MULTIPLIERS[:, None] + hashes[:, j : n + j] + np.uint64(j + 1))
    good &= (total >= LEAST) | lines
    start = np.searchsorted(text, text[:n])  # the text's first clause
    return text[:n][good], (at - start)[good], found[:, good].view(np.int64)


def windows(docs: DataFrame, doc_id: str, text: str, size: int, units: str) -> DataFrame:
    """(i, h, p, w1, w2): of each window the id and text hash of its document, its position, and two hashes."""
    rows = docs.where(quoted(text).isNotNull()).select(quoted(doc_id).alias("i"), text_hash(quoted(text)).alias("h"), quoted(text).alias("text"))
    if units == "lines":

        def of(s: Column) -> Column:
            def one(k: Column) -> Column:
                parts = [F.element_at(s["l"], k + j + 1) for j in range(size)]
                return F.struct(k.alias("p"), F.xxhash64(*[x["a"] for x in parts]).alias("w1"), F.xxhash64(*[x["b"] for x in parts]).alias("w2"))

            return F.when(F.size(s["l"]) >= size, F.transform(F.sequence(F.lit(0), F.size(s["l"]) - size), one))

        hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
        once = F.transform(F.array(F.struct(hashed.alias("l"))), of)[0]  # so that a text is cut once, not for each window
        each = rows.select("i", "h", F.explode(once).alias("w")).select("i", "h", "w.p", "w.w1", (F.shiftrightunsigned("w.w2", 32)).cast("bigint").alias("w2"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(2).to_pylist()
                low = 0
                for group in blocks(values):
                    row, p, w = clause_windows(group, size)
                    here = batch.slice(low, len(group)).select([0, 1]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*here.columns, pa.array(p.astype(np.int32)), pa.array(w[0]), pa.array((w[1].view(np.uint64) >> np.uint64(32)).view(np.int64))], names=["i", "h", "p", "w1", "w2"])
                    low += len(group)

        each = rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, h bigint, p int, w1 bigint, w2 bigint")
    return each


def covered(docs: DataFrame, doc_id: str, text: str, size: int = WINDOW, units: str = "lines") -> DataFrame:
    """(i, h, removed): the numbers of the units to remove, for each id and text hash that has any."""
    found = windows(docs, doc_id, text, size, units)
    again = found.groupBy("w1").agg(F.count("*").alias("many")).where("many > 1").select("w1")
    repeated = cut(found.join(again, "w1", "left_semi"))
    placed = repeated.select("w1", "w2", F.struct(F.col("i").isNull().alias("n"), "i", "h", "p").alias("at"))
    firsts = placed.groupBy("w1", "w2").agg(F.min("at").alias("first"))
    later = placed.join(firsts, ["w1", "w2"]).where("at > first").select("at.i", "at.h", "at.p")
    sets = later.groupBy("i", "h").agg(F.collect_set("p").alias("p"))
    return sets.select("i", "h", F.array_distinct(F.flatten(F.transform("p", lambda x: F.sequence(x, x + size - 1)))).alias("removed"))


def without(text: Column, gone: Column, units: str) -> Column:
    """The text without the units of the numbers ``gone`` (the text itself where these are null); it is cut once, whatever its length."""
    if units == "clauses":

        def rest(texts: pa.Array, numbers: pa.Array) -> pa.Array:
            clause, out = re.compile(CLAUSE), []
            for value, own in zip(texts.to_pylist(), numbers.to_pylist()):
                if value is None or own is None:
                    out.append(None)
                    continue
                own = set(own)
                out.append("".join(part for k, part in enumerate(clause.findall(value)) if k not in own))
            return pa.array(out, pa.string())

        rest.__annotations__ = {"texts": pa.Array, "numbers": pa.Array, "return": pa.Array}
        return F.coalesce(F.arrow_udf(rest, "string").asNondeterministic()(F.when(gone.isNotNull(), text), gone), text)
    once = F.array(F.struct(F.split(text, "\n", -1).alias("u"), gone.alias("gone")))
    kept = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["u"]) - 1), s["gone"])
    return F.when(gone.isNull(), text).otherwise(F.transform(once, lambda s: F.array_join(F.transform(kept(s), lambda k: F.element_at(s["u"], k + 1)), "\n"))[0])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, count: str | None = None, units: str = "lines") -> DataFrame:
    """``docs`` without the units that later occurrences of windows cover.

    ``units`` are "lines", which end at LF and are compared as they are, also
    empty ones, or "clauses".  Texts of fewer than ``size`` units and null
    texts stay as they are; a text all of whose units go becomes empty.  Rows
    with the same id and text are one document: neither is a later occurrence
    of the other.  Of equal windows in one document the first stays.  Texts may
    be of any length and have any number of units, in linear time; an empty
    table gives an empty one; other columns are kept.  With ``count``, a column
    of that name, which replaces one that is called so, has the number of units
    removed (0 where the text is null).
    """
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}")
    if count is not None and count.lower() in (doc_id.lower(), text.lower()):
        raise ValueError(f"{count} is needed for the documents themselves")
    i, h, gone = (fresh(docs.columns, x) for x in ("_i", "_h", "_gone"))
    side = cut(covered(docs, doc_id, text, size, units).select(F.col("i").alias(i), F.col("h").alias(h), F.col("removed").alias(gone)))
    if side.count() <= BROADCAST_ROWS // 10 and side.agg(F.coalesce(F.sum(F.size(quoted(gone))), F.lit(0))).first()[0] <= 50 * BROADCAST_ROWS:
        side = F.broadcast(side)
    both = docs.join(side, quoted(doc_id).eqNullSafe(quoted(i)) & (text_hash(quoted(text)) == quoted(h)), "left")
    new = without(quoted(text), quoted(gone), units)
    columns = [new.alias(c) if c == text else quoted(c) for c in docs.columns if count is None or c.lower() != count.lower()]
    if count:
        columns.append(F.when(quoted(gone).isNull(), 0).otherwise(F.size(quoted(gone))).cast("bigint").alias(count))
    return both.select(columns)
