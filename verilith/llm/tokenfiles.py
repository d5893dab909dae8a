"""Token ids as flat files with document offsets, to be memory-mapped.

Every task writes the ids of its documents, one behind the other, as unsigned
integers to ``NNNNNN.tokens``, and where each document ends, counted from its
own first token, to ``NNNNNN.ends``.  The numbers of tokens of the partitions
come back; their prefix sums are the partitions' bases, and a second job
writes ``NNNNNN.offsets``: 64-bit offsets of the documents (one more than
there are) in all files' tokens.

Files are written under a name of the attempt and renamed when they are
whole, so tasks may be repeated, also at the same time.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilith.llm.bpe import PATTERN, vocabulary
from verilith.llm.common import BROADCAST_ROWS, VOCABULARY, blocks, quoted, shared_folder

#: Texts with a run of so much white space are encoded by the subpackage's own encoder: the library's pattern overflows the stack in runs of a million.
_SPACES = re.compile(r"\s{10000}")

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def ids_of(text: str, path: str) -> np.ndarray:
    if _SPACES.search(text):
        own = vocabulary(path)
        return np.frombuffer(own.encode([text])[0], own.dtype).astype(id_type(path))
    return np.array(encoding(path).encode_ordinary(text), id_type(path))


def _name(folder: str, part: int, kind: str) -> str:
    return os.path.join(folder, f"{part:06d}.{kind}")


class _Whole:
    """A file that gets its name when it is written and closed."""

    def __init__(self, path: str):
        self.path, self.other = path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = open(self.other, "wb")
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            os.replace(self.other, self.path)
        else:
            os.unlink(self.other)


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2") if encoding(path).n_vocab <= 1 << 16 else np.dtype("<u4")


def write_tokens(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Write the files to ``folder``, shared by all executors; (doc_id, part, document, token_start, n_tokens) of all documents.

    Documents are in the table's own order; ``document`` is a document's
    number in its part, ``token_start`` its first token's in all files, counted
    from 0.  Null and empty texts have no tokens, and a place like any other;
    texts are encoded whole, whatever their length and the runs in them;
    repeated rows are written again.  An empty table
    gives no files but meta.json.  Other columns are ignored.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    os.makedirs(folder, exist_ok=True)
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, n = 0, 0
        with _Whole(_name(folder, part, "tokens")) as tokens, _Whole(_name(folder, part, "ends")) as ends:
            for batch in batches:
                sizes = []
                for group in blocks(["" if v is None else v for v in batch.column(1).to_pylist()]):
                    found = [ids_of(value, path) for value in group]
                    tokens.write(np.concatenate(found).tobytes())
                    sizes += map(len, found)
                size = np.array(sizes, np.int64)
                end = at + np.cumsum(size)
                ends.write(end.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(size), part, np.int64)), pa.array(n + np.arange(len(size))), pa.array(end - size), pa.array(size)], names=["doc_id", "part", "document", "start", "n_tokens"])
                at, n = int(end[-1]) if len(end) else at, n + len(size)

    index = os.path.join(folder, "index")
    plain.mapInArrow(first, f"doc_id {kind}, part bigint, document bigint, start bigint, n_tokens bigint").write.mode("overwrite").parquet(f"file://{index}")
    spark = docs.sparkSession
    rows = spark.read.parquet(f"file://{index}")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # two numbers for each partition
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    with _Whole(os.path.join(folder, "meta.json")) as meta:
        meta.write(json.dumps({"type": id_type(path).str, "tokens": base, "parts": [{"part": p, "base": b} for p, b in bases]}).encode())
    if not bases:
        return rows.select("doc_id", "part", "document", F.col("start").alias("token_start"), "n_tokens")
    table = spark.createDataFrame(bases, "part bigint, base bigint").repartition(min(len(bases), 2 * spark.sparkContext.defaultParallelism), "part")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                ends = np.fromfile(_name(folder, part, "ends"), "<u8")
                with _Whole(_name(folder, part, "offsets")) as file:
                    file.write((np.concatenate((np.zeros(1, np.uint64), ends)) + np.uint64(own)).astype("<u8").tobytes())
            yield batch

    table.mapInArrow(second, "part bigint, base bigint").count()
    side = F.broadcast(table) if len(bases) <= BROADCAST_ROWS else table
    return rows.join(side, "part").select("doc_id", "part", "document", (F.col("base") + F.col("start")).alias("token_start"), "n_tokens")


class TokenFiles:
    """The files of one folder, memory-mapped part by part."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(os.path.join(folder, "meta.json")) as file:
            meta = json.load(file)
        self.type, self.size = np.dtype(meta["type"]), meta["tokens"]
        self.base = {p["part"]: p["base"] for p in meta["parts"]}
        self._maps: dict = {}

    def _map(self, part: int, kind: str, dtype) -> np.ndarray:
        if (part, kind) not in self._maps:
            path = _name(self.folder, part, kind)
            self._maps[part, kind] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        return self._maps[part, kind]

    def offsets(self, part: int) -> np.ndarray:
        return self._map(part, "offsets", "<u8")

    def tokens(self, part: int, document: int) -> np.ndarray:
        low, high = (int(x) - self.base[part] for x in self.offsets(part)[document : document + 2])
        return self._map(part, "tokens", self.type)[low:high]


def decode(tokens: np.ndarray, path: str = VOCABULARY) -> str:
    return encoding(path).decode(tokens.tolist())
