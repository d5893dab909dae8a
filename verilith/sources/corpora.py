"""Corpora that follow from a formula: logs and validation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MULTIPLIER, _INCREMENT, _MASK = 6364136223846793005, 1442695040888963407, (1 << 64) - 1


class Generator:
    """A linear congruential generator; its numbers are the high 32 bits."""

    def __init__(self, seed: int, kind: int):
        self.state = (seed ^ kind) or 1

    def next(self) -> int:
        self.state = (self.state * _MULTIPLIER + _INCREMENT) & _MASK
        return self.state >> 32


def log_lines(spark: SparkSession, rows: int, rare_every: int = 0) -> DataFrame:
    """(line_no, line) of a log of so many rows; it is made where it is read."""
    level = F.element_at(F.array(*map(F.lit, ("info", "warn", "error", "debug"))), (F.col("id") % 4 + 1).cast("int"))
    rare = F.when(F.lit(rare_every > 0) & (F.col("id") % F.lit(rare_every or 1) == 0), " rare-token-unique").otherwise("")
    line = F.concat(F.format_string("ts=%06d level=", "id"), level, F.format_string(" request_id=req-%d", "id"), rare, F.lit("\n"))
    return spark.range(rows).select(F.col("id").alias("line_no"), line.alias("line"))


def _conversation(g: Generator, k: int) -> str:
    return f"## talk {k}\nuser: question {g.next() % 1000}\nassistant: answer {g.next() % 1000}\n```\nx = {k}\n```\n"


def _log(g: Generator, k: int) -> str:
    return f"t={k:08d} level={('info', 'warn', 'error')[g.next() % 3]} request_id=req-{k} rare-token-{str(g.next() % 97 == 0).lower()}\n"


def _prose(g: Generator, k: int) -> str:
    return f"Sentence {k} stands here. Another has {g.next() % 10_000}. A third one ends it.\n\n"


def _code(g: Generator, k: int) -> str:
    return f'def f{k}(x):\n    data = {{"k": {g.next() % 100}, "v": [1, 2]}}\n    return data\n'


def _languages(g: Generator, k: int) -> str:
    return ("日本語の行です\n", "中文的一行\n", "한국어 줄\n", "emoji 😀👩‍👩‍👧 line\n")[g.next() % 4]


def _adverse(g: Generator, k: int) -> str:
    return ("a" * 1024 + "\n", "crlf\r\n", "".join(chr(33 + g.next() % 90) for _ in range(40)) + "\n", "lf\r\r\n")[k % 4]


KINDS = {"c1": (0xC1, _conversation), "c2": (0xC2, _log), "c3": (0xC3, _prose), "c4": (0xC4, _code), "c5": (0xC5, _languages), "c6": (0xC6, _adverse)}


def validation_text(kind: str, seed: int = 1, target_bytes: int = 64 << 10) -> str:
    """Text of at least so many bytes; the same for the same arguments.  c6 ends without LF."""
    number, make = KINDS[kind]
    g, parts, size, k = Generator(seed, number), [], 0, 0
    while size < target_bytes:
        parts.append(make(g, k))
        size += len(parts[-1].encode())
        k += 1
    return "".join(parts) + ("end" if kind == "c6" else "")
