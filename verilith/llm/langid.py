"""Language identification by compression.

For each language a Zstandard dictionary is made of raw text: labelled
documents in the order of a hash of id and text, up to a bounded size.  A text
is compressed whole (lower case, all but letters as spaces) with each
dictionary and gets the language whose result is the smallest.  Where the next
one is hardly larger, it is rejected.

What a dictionary saves at the start of a text levels off, as the text itself
becomes the better dictionary.  So the text is compressed in blocks of fixed
size, each with the dictionary alone, and the sizes are summed: the margin of
a long text is then that of its blocks, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilith.llm.common import cut, fresh, quoted

#: The sample of labelled rows of each language: so many rows at most, of which so many bytes at most make the dictionary.
SAMPLE_ROWS = 200
DICTIONARY_BYTES = 40_000
LEVEL = 6
#: A text is compressed in blocks of so many bytes; all blocks count.
BLOCK_BYTES = 8192
#: Rejected if the next language takes fewer bytes more than this share of the smallest result ...
MARGIN = 0.005
#: ... or fewer than so many bytes more.
MARGIN_BYTES = 1


def dictionaries(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionary content of each language that ``labelled`` has.

    Rows without language or with an empty text aren't used; rows with the
    same id and text are one.  The rows with the least hash of id and text are
    taken, ``rows`` of each language at most, whichever partition they lie in;
    of them the first ``size`` bytes.  An empty table gives no dictionary.

    Texts are moved of few rows only: a first pass counts each language's rows
    by the leading zeros of the hash, which gives a bound below which about
    twice ``rows`` lie, and just these come together, cut to ``size``.
    """
    value = quoted(text)
    some = labelled.where(quoted(lang).isNotNull() & (F.length(value) > 0)).select(quoted(lang).cast("string").alias("lang"), F.xxhash64(quoted(doc_id), value).alias("h"), value.alias("text"))
    level = 64 - F.length(F.regexp_replace(F.bin("h"), "^0+", ""))  # 64-bit numbers of so many leading zeros; negative ones have none
    counts: dict[str, dict[int, int]] = {}
    for r in some.groupBy("lang", level.alias("level")).agg(F.approx_count_distinct("h").alias("n")).collect():  # 65 rows a language at most
        counts.setdefault(r["lang"], {})[r["level"]] = r["n"]
    bound = F.lit(0)
    for name, by_level in counts.items():
        total, least = 0, 0
        for k in range(64, -1, -1):
            total += by_level.get(k, 0)
            if total >= 2 * rows:
                least = k
                break
        bound = F.when(F.col("lang") == name, least).otherwise(bound)
    few = some.where(level >= bound).groupBy("lang", "h").agg(F.min(F.substring("text", 1, size)).alias("t"))
    few = few.withColumn("n", F.octet_length("t"))
    order = Window.partitionBy("lang").orderBy("h", "t")  # about four times ``rows`` at most
    few = few.withColumn("k", F.row_number().over(order)).withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    used = cut(few.where((F.col("k") <= rows) & (F.coalesce("before", F.lit(0)) < 4 * size)).select("lang", "k", "t"))  # words_of may shorten texts
    out: dict[str, list[bytes]] = {}
    for r in used.orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(words_of(r["t"]))
    return {name: b" ".join(parts)[:size] for name, parts in out.items()}


def words_of(text: str) -> bytes:
    """The whole text in lower case, with one space in place of all that isn't a letter."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass")


def sizes(raw: bytes, known: list[zstandard.ZstdCompressor], block: int = BLOCK_BYTES) -> list[int]:
    """The compressed size of all blocks of ``raw`` together, for each dictionary."""
    view = memoryview(raw)
    parts = [view[k : k + block] for k in range(0, len(raw), block)]
    return [sum(len(c.compress(p)) for p in parts) for c in known]


def compressors(content: dict[str, bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    out = []
    parameters = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
    for lang in sorted(content):
        raw = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters))
    return out


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text", output: str = "language", margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES, level: int = LEVEL) -> DataFrame:
    """``docs`` with the columns ``output`` and ``output``_margin.

    ``output`` is null where the text is rejected: null, without a letter, or
    with a margin (bytes that the next language takes more, as a share of the
    smallest result) that is too narrow.  With one dictionary all texts but
    null ones get its language; with none all are rejected.  Of equal results
    the first in alphabetical order would count, with margin 0, which is too
    narrow unless both ``margin`` and ``margin_bytes`` are 0: by default ties
    are rejected.  Texts are compressed whole, in blocks, whatever their
    length; rows are independent of each other, so repeated rows get the same;
    an empty table gives an empty one.  Columns of these names are replaced.
    """
    names = sorted(content)
    result, share = output, fresh([c for c in docs.columns if c != f"{output}_margin"], f"{output}_margin")

    def classify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = compressors(content, level)
        for column in columns:
            langs: list[str | None] = []
            margins: list[float | None] = []
            for value in column:
                value = value.as_py()
                lang, gap = None, None
                if value is not None and names and any(map(str.isalpha, value)):
                    found = sizes(words_of(value), known)
                    best = min(found)
                    k = found.index(best)
                    rest = found[:k] + found[k + 1 :]
                    more = min(rest) - best if rest else best
                    gap = more / best
                    if gap >= margin and more >= margin_bytes:
                        lang = names[k]
                langs.append(lang)
                margins.append(gap)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(margins, pa.float64())], names=["lang", "margin"])

    classify.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = fresh(docs.columns, "_found")
    with_ = docs.withColumn(found, F.arrow_udf(classify, "lang string, margin double").asNondeterministic()(quoted(text)))
    return with_.withColumn(result, quoted(found)["lang"]).withColumn(share, quoted(found)["margin"]).drop(found)
