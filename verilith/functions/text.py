"""Text as bytes and lines, tokens and n-grams, in Catalyst expressions.

Where an expression would need more than linear time, as running sums and
spans would, it is a function over Arrow batches.

A line goes up to and with its LF; a last line may lack it; empty text has
none.  Offsets and sizes are bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "[^\n]*\n|[^\n]+"
TOKEN = "[A-Za-z0-9_-]+"


def big(c: Column) -> Column:
    return c.cast("bigint")


def size(text: Column) -> Column:
    return big(F.octet_length(text))


def lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def feeds(text: Column) -> Column:
    """Line feeds."""
    return big(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))


def crlf(text: Column) -> Column:
    return big((F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2)


def line_count(text: Column) -> Column:
    return feeds(text) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def newline_mode(all_feeds: Column, with_cr: Column) -> Column:
    return F.when(all_feeds == 0, "none").when(with_cr == 0, "lf").when(all_feeds == with_cr, "crlf").otherwise("mixed")


def tokens(line: Column) -> Column:
    """Keys of all tokens, repeated ones too; only ASCII letters change, as no others are matched."""
    return F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), F.lower)


def ngrams(line: Column, n: int) -> Column:
    """All windows of n code points, overlapping, as they are."""
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def keys_of(line: Column, kind: str, n: int = 3) -> Column:
    return F.array_distinct(tokens(line) if kind == "token" else ngrams(line, n))


def query_keys(query: str, kind: str, n: int = 3) -> list[str]:
    """Keys of a query, sorted by their bytes, each once."""
    found = [t.lower() for t in re.findall(TOKEN, query, re.ASCII)] if kind == "token" else [query[i : i + n] for i in range(len(query) - n + 1)]
    return sorted(set(found), key=str.encode)


def _arrow(f, kind: str, many: int):
    f.__annotations__ = {**dict.fromkeys(f.__code__.co_varnames[:many], pa.Array), "return": pa.Array}
    return F.arrow_udf(f, kind)


def _running(sizes: pa.Array) -> pa.Array:
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
    sums = np.concatenate(([0], np.cumsum(flat)))
    at = sums[:-1] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
    null = pc.is_null(sizes).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(at))


def running(sizes: Column) -> Column:
    """Sums of all that came before, one for each element.

    A fold that appends to an array copies it at each step; this is linear.
    """
    return _arrow(_running, "array<bigint>", 1)(sizes)


SPANS = "array<struct<offset:bigint,length:bigint>>"


def _span_lists(found: list[list[tuple[int, int]] | None]) -> pa.Array:
    return pa.array([None if f is None else [{"offset": a, "length": b} for a, b in f] for f in found], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))


def token_spans(line: Column, keys: list[str]) -> Column:
    """(offset, length) in bytes of the tokens among ``keys``.

    Every byte that isn't ASCII is a delimiter, so tokens are found in the
    bytes, in one pass.
    """
    wanted, pattern = {k.encode() for k in keys}, re.compile(TOKEN.encode())

    def spans(lines: pa.Array) -> pa.Array:
        return _span_lists([None if v is None else [(m.start(), m.end() - m.start()) for m in pattern.finditer(v.encode()) if m.group().lower() in wanted] for v in lines.to_pylist()])

    return _arrow(spans, SPANS, 1)(line)


def substring_spans(line: Column, query: Column) -> Column:
    """(offset, length) in bytes of all occurrences, overlapping ones too."""

    def spans(lines: pa.Array, queries: pa.Array) -> pa.Array:
        out = []
        for value, wanted in zip(lines.to_pylist(), queries.to_pylist()):
            if value is None or wanted is None:
                out.append(None)
                continue
            raw, part, found = value.encode(), wanted.encode(), []
            at = raw.find(part) if part else -1
            while at >= 0:
                found.append((at, len(part)))
                at = raw.find(part, at + 1)
            out.append(found)
        return _span_lists(out)

    return _arrow(spans, SPANS, 2)(line, query)


def varuint_size(value: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(value < (1 << (7 * k)), k).otherwise(out)
    return big(out)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def _steps(ids: pa.Array) -> pa.Array:
    def written(v: int) -> bytes:
        out = bytearray()
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    return pa.array([b"".join(written(b - a) for a, b in zip([own[0], *own], own)) for own in ids.to_pylist()], pa.binary())


def steps(ids: Column) -> Column:
    """Differences of sorted numbers, the first 0, in seven-bit groups."""
    return _arrow(_steps, "binary", 1)(ids)


def joined_bytes(parts: Column) -> Column:
    """Binary parts as one, in linear time: a fold that concatenates copies what it has at each step."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def escaped(text: Column) -> Column:
    """An id on one line: backslash, tab, CR and LF escaped."""
    for plain, written in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text
