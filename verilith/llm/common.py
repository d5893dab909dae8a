"""Helpers shared by the operators of this subpackage.

Row identity.  ``doc_id`` may be null and may repeat, so operators that have
to find a row again use the pair (doc_id, 64-bit hash of the text).  Rows that
agree in both are one document to every operator: they get the same decision.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of the public tokenizers; every operator takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Sides of a join of up to so many rows are broadcast after they were counted.
BROADCAST_ROWS = 20_000

#: Characters of texts that are handled at once in a worker.
BLOCK_CHARS = 1_000_000


def fresh(names: Iterable[str], wanted: str) -> str:
    """``wanted``, or with a number behind it, so that no name in ``names`` equals it."""
    taken = {n.lower() for n in names}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_place(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is
    made where it is unset; on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_place(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a local path, below the one that all executors share.

    Its files are memory-mapped, so ``spark.checkpoint.dir`` has to be mounted
    (a ``file:`` URL or a path).
    """
    place = shared_place(spark)
    parts = urlparse(place)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{place} can't be memory-mapped; mount it and set spark.checkpoint.dir to the mounted path")
    path = os.path.join(parts.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Whole texts in groups of about ``size`` characters; a longer text is its own group."""
    group, total = [], 0
    for text in texts:
        if group and total + len(text) > size:
            yield group
            group, total = [], 0
        group.append(text)
        total += len(text)
    if group:
        yield group


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again."""
    spark = df.sparkSession
    path = f"{shared_place(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def one_of_each(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Of rows that agree in ``keys`` the first by all columns (maps aside); nothing is sorted in one task."""
    order = [quoted(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"]
    names = [f"_k{k}" for k in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("row"), F.struct(*order).alias("order"))
    first = rows.groupBy(*names).agg(F.min_by("row", "order").alias("row"))
    return first.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)])
