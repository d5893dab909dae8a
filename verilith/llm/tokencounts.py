"""Token counts of fields and lines from one encoding of the whole document.

A document is its fields, one after the other with a line feed between them;
it is encoded once, whole.  Its sections are the fields or, of each field,
the lines (with the line feed that ends them).  The spans of the tokens are
joined with the sections' as intervals.  A token that crosses a boundary
counts where RULE says:

    start     in the section of its first character
    majority  in the section that holds most of its bytes, of equals the first

So the counts of a document's sections add up to its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verilith.llm.bpe import Vocabulary, vocabulary
from verilith.llm.common import VOCABULARY, blocks, quoted

RULES = ("start", "majority")


def allocate(token_ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; both lie on one line of bytes from 0 on.

    ``token_ends`` and ``sections`` (where sections begin) ascend; empty
    sections, which begin where the next one does, get nothing.
    """
    starts = np.concatenate(([0], token_ends[:-1])).astype(np.int64)
    where = np.searchsorted(sections, starts, side="right") - 1
    if rule == "majority":
        for k in np.flatnonzero(np.searchsorted(sections, token_ends - 1, side="right") - 1 > where):
            low, high = where[k], int(np.searchsorted(sections, token_ends[k] - 1, side="right"))
            edges = np.r_[starts[k], sections[low + 1 : high], token_ends[k]]
            where[k] = low + int(np.argmax(np.diff(edges)))
    return np.bincount(where, minlength=len(sections))


def count_block(docs: list[list[str | None]], vocab: Vocabulary, lines: bool, rule: str) -> tuple[np.ndarray, ...]:
    """Arrays (document, field, section, characters, tokens) of the sections of some documents."""
    texts, document, field, section, chars, starts = [], [], [], [], [], []
    at = 0
    for d, values in enumerate(docs):
        present = [(f, v) for f, v in enumerate(values) if v is not None]
        for n, (f, value) in enumerate(present):
            if n + 1 < len(present):
                value += "\n"
            parts = value.split("\n") if lines else [value]
            ended = len(parts) > 1 and parts[-1] == "" and n + 1 < len(present)  # the line feed between fields ends a line
            for s, part in enumerate(parts[:-1] if ended else parts):
                size = len(part) + (lines and s + 1 < len(parts))
                document.append(d)
                field.append(f)
                section.append(s)
                chars.append(size)
                starts.append(at)
                at += len(part.encode("utf-8", "surrogatepass")) + (lines and s + 1 < len(parts))
        texts.append("\n".join(v for _, v in present))
    tokens = np.frombuffer(b"".join(vocab.encode(texts)), vocab.dtype)
    if len(starts):
        counts = allocate(np.cumsum(vocab.lengths[tokens]), np.array(starts, np.int64), rule) if len(tokens) else np.zeros(len(starts), np.int64)
    else:
        counts = np.zeros(0, np.int64)
    return tuple(np.array(x, np.int64) for x in (document, field, section, chars, counts))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = "start", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, field, section, n_chars, n_tokens) of all sections of all documents.

    Null fields have no section; an empty field has one, of no tokens; a text
    that ends with a line feed has an empty last line.  Documents are encoded
    whole, whatever their length; repeated rows give repeated rows; an empty
    table gives an empty one.  Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    plain = docs.select(quoted(doc_id).alias("doc_id"), *[quoted(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        names = pa.array(list(fields))
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(len(fields))]
            rows = [list(r) for r in zip(*columns)]
            low = 0
            for group in blocks(["".join(v or "" for v in r) for r in rows]):
                document, field, section, chars, counts = count_block(rows[low : low + len(group)], vocab, lines, rule)
                ids = batch.column(0).take(pa.array(document + low))
                yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(field)), *map(pa.array, (section, chars, counts))], names=["doc_id", "field", "section", "n_chars", "n_tokens"])
                low += len(group)

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, field string, section bigint, n_chars bigint, n_tokens bigint")
