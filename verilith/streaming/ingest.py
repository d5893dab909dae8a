"""Ingest of a stream of text fragments into lines.

The state of a container is the text behind its last LF and its position; it
becomes a line when its LF comes, or when the container is sealed.  So how the
text is cut into fragments makes no difference.  Fragments of one batch are
put in order by ``seq``; after sealing, more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verilith.errors import EvidenceError

LINES = "container_id string, line_no bigint, logical_offset bigint, byte_length bigint, line string"
STATE = "pending string, offset bigint, line_no bigint, sealed boolean"


def push(state: tuple[str, int, int, bool], fragments: list[tuple[str, bool]]) -> tuple[tuple[str, int, int, bool], list[tuple[int, int, int, str]]]:
    """The next state and the lines (line_no, offset, size, line) that are whole now."""
    pending, offset, line_no, sealed = state
    out = []
    for fragment, last in fragments:
        if sealed:
            raise EvidenceError("writer_already_finished")
        parts = (pending + (fragment or "")).split("\n")
        pending, sealed = parts.pop(), last
        whole = [p + "\n" for p in parts]
        if sealed and pending:
            whole.append(pending)
            pending = ""
        for line in whole:
            size = len(line.encode())
            out.append((line_no, offset, size, line))
            offset, line_no = offset + size, line_no + 1
    return (pending, offset, line_no, sealed), out


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq")
    before = state.get if state.exists else ("", 0, 0, False)
    after, lines = push(tuple(before), list(zip(rows["fragment"], rows["last"].astype(bool))))
    state.update(after)
    yield pd.DataFrame([(key[0], *line) for line in lines], columns=["container_id", "line_no", "logical_offset", "byte_length", "line"])


def lines_of(fragments: DataFrame) -> DataFrame:
    """A stream (container_id, seq, fragment, last) as a stream of lines."""
    return fragments.groupBy("container_id").applyInPandasWithState(_step, LINES, STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(fragments: DataFrame, path: str, checkpoint: str):
    """Write lines to Parquet, exactly once; returns the running query."""
    return lines_of(fragments).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
