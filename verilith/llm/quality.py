"""Quality rules by the divergence of a text from its language.

For each language two histograms over all its documents: character classes,
and common words (every word that makes at least 1 / COMMON of the language's
words; all other words are one more bin).  A document has the same two, and
the Jensen-Shannon distance (root of the divergence, base 2) between them and
its language's is between 0 and 1.  Too long a distance is a reason to drop
it; texts that are too short for a histogram aren't judged.

Words are runs of letters in lower case, counted by 64-bit hashes.  Candidates
for common words are found with summaries of bounded size: a task keeps its
2 * COMMON most frequent words of a language, each count less the next one's,
so it is too small by less than a 2 * COMMON-th of the task's words.  Summed by
Spark, a common word's counts are still at least that share of the language's
words, which no more than 2 * COMMON words can have; a second pass counts these
exactly.  So what a task sends and what the driver holds doesn't grow with the
number of documents or tasks, just with that of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilith.llm.common import BLOCK_CHARS, cut, quoted
from verilith.llm.minhash import hash_runs

CLASSES = [r"\p{Ll}", r"\p{Lu}", r"[\p{L}--\p{Ll}--\p{Lu}]", r"\p{Nd}", r"[ ]", r"\n", r"\p{P}"]
OTHER = len(CLASSES)
COMMON = 200
#: Texts with fewer characters, or fewer words, aren't judged by that histogram.
MIN_CHARS, MIN_WORDS = 200, 40
#: Longest distances of texts that are kept.
MAX_CLASS, MAX_WORD = 0.32, 0.40

_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, OTHER, np.uint8)
        for first in range(0, 0x110000, 0x8000):
            text = "".join(chr(p) for p in range(first, first + 0x8000) if not 0xD800 <= p < 0xE000)
            for k, pattern in enumerate(CLASSES):
                table[[ord(c) for c in regex.findall(f"(?V1){pattern}", text)]] = k
        _TABLE.append(table)
    return _TABLE[0]


def class_counts(texts: list[str]) -> np.ndarray:
    """One row of character-class counts for each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.bincount(row * (OTHER + 1) + class_table()[points], minlength=len(texts) * (OTHER + 1)).reshape(len(texts), OTHER + 1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's."""
    hashes, counts = hash_runs([t.lower() for t in texts], class_table() <= 2)
    return hashes.view(np.int64), counts


def slices(batches: Iterator[pa.RecordBatch], size: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches (with ``text``) in slices of about ``size`` characters; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(low, high - low)
            low = high


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["lang", "kind", "key", "n"])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[str]]]:
    groups: dict[str | None, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def summary(keys: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent keys, their counts less that of the next one."""
    if len(n) <= size:
        return keys, n
    top = np.argpartition(-n, size)[: size + 1]
    less = n[top].min()
    return keys[top][n[top] > less], n[top][n[top] > less] - less


def first_pass(batches: Iterator[pa.RecordBatch], common: int) -> Iterator[pa.RecordBatch]:
    """A task's class counts, word totals and summary of words of each language."""
    classes: dict = {}
    found: dict = {}
    totals: dict = {}
    for batch in slices(batches):
        for lang, texts in _by_lang(batch):
            classes[lang] = classes.get(lang, 0) + class_counts(texts).sum(axis=0)
            parts = found.setdefault(lang, [])
            parts.append(np.unique(words(texts)[0], return_counts=True))
            totals[lang] = totals.get(lang, 0) + int(parts[-1][1].sum())
            if len(parts) > 32:
                found[lang] = [_merged(parts)]
    rows = []
    for lang, counts in classes.items():
        rows += [(lang, "class", k, int(n)) for k, n in enumerate(counts)]
        keys, n = summary(*_merged(found[lang]), 2 * common)
        rows.append((lang, "words", 0, totals[lang]))
        rows += [(lang, "word", int(k), int(c)) for k, c in zip(keys, n)]
    yield _rows(rows)


def count_pass(batches: Iterator[pa.RecordBatch], wanted: dict) -> Iterator[pa.RecordBatch]:
    """A task's counts of the candidates."""
    counts = {lang: np.zeros(len(keys), np.int64) for lang, keys in wanted.items()}
    for batch in slices(batches):
        for lang, texts in _by_lang(batch):
            if len(keys := wanted.get(lang, ())):
                hashes = words(texts)[0]
                k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                counts[lang] += np.bincount(k[keys[k] == hashes], minlength=len(keys))
    yield _rows([(lang, "word", int(key), int(n)) for lang, keys in wanted.items() for key, n in zip(keys, counts[lang]) if n])


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> dict:
    """(class counts, common words' hashes, their counts and that of all others) of each language.

    Counted over all documents; null languages are a language of their own.
    The driver gets fewer than 2 * common words of each language.
    """
    plain = docs.where(quoted(text).isNotNull()).select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"))
    schema = "lang string, kind string, key bigint, n bigint"
    sums = lambda f: plain.mapInArrow(f, schema).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    first = cut(sums(lambda b: first_pass(b, common)))
    classes: dict = {}
    totals: dict = {}
    for row in first.where("kind <> 'word'").collect():
        if row.kind == "class":
            classes.setdefault(row.lang, np.zeros(OTHER + 1, np.int64))[row.key] = row.n
        else:
            totals[row.lang] = row.n
    # of every language the words that may still be common: true count <= n + total / (2 * common)
    all_words = F.broadcast(first.where("kind = 'words'").select(F.col("lang").alias("of"), F.col("n").alias("total")))  # one row a language
    likely = first.where("kind = 'word'").join(all_words, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") * 2 * common >= F.col("total"))
    wanted: dict = {}
    for row in likely.select("lang", "key").collect():
        wanted.setdefault(row.lang, []).append(row.key)
    wanted = {k: np.sort(np.array(v, np.int64)) for k, v in wanted.items()}
    counted: dict = {k: {} for k in totals}
    for row in sums(lambda b: count_pass(b, wanted)).collect():
        if row.n * common >= totals[row.lang]:
            counted[row.lang][row.key] = row.n
    out = {}
    for k, total in totals.items():
        keys = np.array(sorted(counted[k]), np.int64)
        n = np.array([counted[k][x] for x in keys.tolist()], np.int64)
        out[k] = (classes[k], keys, np.append(n, total - n.sum()))
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts from one row; NaN where a row is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / counts.sum(axis=1, keepdims=True)
        q = reference / reference.sum()
        m = (p + q) / 2
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
        out = np.sqrt(np.maximum(each.sum(axis=1), 0) / 2)
    return np.where(counts.sum(axis=1) > 0, np.minimum(out, 1), np.nan)


def judge(docs: DataFrame, known: dict, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS, max_word: float = MAX_WORD, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lang, class_distance, word_distance, keep) of each document.

    Distances have six decimals.  They are null where the text is null or too
    short for that histogram, or where ``known`` lacks the language; what is
    null is no reason to drop.  A null text is dropped; an empty or short one
    is kept.  Texts are counted whole, in blocks of about BLOCK_CHARS
    characters of whole texts; rows are independent of each other, so repeated
    rows are judged alike; a distance equal to its limit is kept; an empty
    table gives an empty one.  Other columns are ignored.
    """
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = batch.column("text").to_pylist()
            langs = np.array([x if x is None else str(x) for x in batch.column("lang").to_pylist()], object)
            texts = ["" if v is None else v for v in values]
            classes = class_counts(texts)
            hashes, many = words(texts)
            row = np.repeat(np.arange(len(texts)), many)
            found = np.full((2, len(texts)), np.nan)
            for k, (reference, keys, counts) in known.items():
                mine = np.array([x == k for x in langs], bool)
                if not mine.any():
                    continue
                found[0, mine] = distance(classes[mine], reference)
                here = mine[row]
                at = np.minimum(np.searchsorted(keys, hashes[here]), max(len(keys) - 1, 0)) if len(keys) else np.zeros(here.sum(), np.int64)
                bin_ = np.where(keys[at] == hashes[here], at, len(keys)) if len(keys) else at
                table = np.bincount(row[here] * (len(keys) + 1) + bin_, minlength=len(texts) * (len(keys) + 1)).reshape(len(texts), -1)
                found[1, mine] = distance(table[mine], counts)
            found[0, classes.sum(axis=1) < min_chars] = np.nan
            found[1, many < min_words] = np.nan
            found = np.round(found, 6)
            null = np.array([v is None for v in values], bool)
            keep = ~null & ~(found[0] > max_class) & ~(found[1] > max_word)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(f, mask=np.isnan(f) | null) for f in found), pa.array(keep)], names=["doc_id", "lang", "class_distance", "word_distance", "keep"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, lang string, class_distance double, word_distance double, keep boolean")
