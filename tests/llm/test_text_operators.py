"""Edge cases of every text operator on one awkward table, and results against brute force."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from verilith.llm import bpe, langid, linededup, minhash, mixing, quality, sharding, tokencounts, tokenfiles
from verilith.llm.common import VOCABULARY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _i string, _h int, _0 string, _node string, language string, language_margin string, token_ids string, _n int, hash int, copies int, `a.b` string"
EXTRA = ("x", 1, "y", "z", "old", "old", "old", 2, 3, 4, "dot")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows], SCHEMA)


def text_of(seed, words=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words))


LONG = "\n".join(text_of(900 + k, 400) for k in range(60))
AWKWARD = [
    (1, text_of(1), "en", "s0"), (1, text_of(1), "en", "s0"), (2, text_of(1), "en", "s1"), (None, text_of(1), "de", "s1"),
    (3, "", "en", "s0"), (4, "", None, None), (5, None, "en", "s0"), (None, None, None, None),
    (6, LONG, "en", "s0"), (7, "a", "de", None), (8, "!!! ... 123", "de", "s2"), (9, "same\nsame\nsame\nsame\nsame", "en", "s2"), (9, "other text with this id", "en", "s2"), (10, "\n\n\n", "en", "s1"), (11, "ß😀é\r\nx", None, "s0"),
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def encoder():
    return tokenfiles.encoding(VOCABULARY)


# -- near duplicates ------------------------------------------------------------------------


def jaccard(a, b):
    def pairs(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:])) or set(w)

    x, y = pairs(a), pairs(b)
    return len(x & y) / len(x | y) if x | y else float(a == b)


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join("new" + str(rng.random())[2:8] if rng.random() < share else w for w in text.split(" "))


def test_near_duplicates_against_brute_force(spark):
    texts = {}
    for k in range(40):
        texts[k] = text_of(k)
        if k % 3 == 0:
            texts[100 + k] = edited(texts[k], k, 0.04)
        if k % 5 == 0:
            texts[200 + k] = texts[k].upper() + "!"
        if k % 4 == 0:
            texts[300 + k] = texts[k][: len(texts[k]) // 3] + " " + text_of(500 + k, 70)  # a shared passage isn't a copy
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a], texts[b]) >= minhash.THRESHOLD:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((k, find(k)) for k in texts if find(k) != k)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert rows_of(minhash.near_duplicates(docs), "doc_id", "duplicate_of") == sorted(want, key=repr)
    kept = minhash.without_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in texts if find(k) == k)


def test_near_duplicates_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    found = rows_of(minhash.near_duplicates(docs), "doc_id", "duplicate_of")
    assert found == sorted([(1, 1), (2, 1), (None, 1), (4, 3)], key=repr)
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == sorted([(1,), (3,), (5,), (None,), (6,), (7,), (8,), (9,), (9,), (10,), (11,)], key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 == minhash.without_near_duplicates(docs.limit(0)).count()


def test_large_groups_stay_whole(spark):
    base = text_of(7, 120)
    docs = spark.createDataFrame([(k, edited(base, k, 0.01)) for k in range(300)], "doc_id bigint, text string")
    assert minhash.without_near_duplicates(docs).count() == 1


def test_hot_buckets_are_split(spark, monkeypatch):
    """Texts that share a passage only, and near copies among them; buckets are split in blocks of a few nodes."""
    passage = text_of(3, 200)
    rows = [(k, f"{passage} {text_of(1000 + k, 250)}") for k in range(60)]
    rows += [(100 + k, edited(rows[k][1], k, 0.02)) for k in range(0, 60, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = rows_of(minhash.near_duplicates(docs), "doc_id", "duplicate_of")
    assert {i for i, _ in want} == {100 + k for k in range(0, 60, 7)}
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert rows_of(minhash.near_duplicates(docs), "doc_id", "duplicate_of") == want


def test_blocks_hold_every_pair(spark):
    members = spark.createDataFrame([(7, 50, k, bytes([k])) for k in range(50)] + [(8, 3, k, b"x") for k in range(3)], "_band bigint, _n bigint, _node bigint, _packed binary")
    held = {}
    for r in minhash.bucketed(members, 8).collect():
        held.setdefault(r._bucket, set()).add(r._node)
    assert held[8] == {0, 1, 2}
    for a in range(50):
        for b in range(a):
            assert any(a in x and b in x for k, x in held.items() if k != 8)


def test_ties_of_near_duplicates(spark):
    """Of equal ids, and of a null id, the one that stays follows from the rows."""
    base = text_of(5, 200)
    docs = frame(spark, [(1, base, "en", "a"), (1, edited(base, 1, 0.01), "en", "b"), (None, base, "en", "c"), (1, base, "en", "d")])
    found = rows_of(minhash.near_duplicates(docs), "doc_id", "duplicate_of")
    assert found == sorted([(1, 1), (1, 1), (None, 1)], key=repr)
    kept = [tuple(r) for r in minhash.without_near_duplicates(docs).collect()]
    assert len(kept) == 1 and kept == [tuple(r) for r in minhash.without_near_duplicates(docs.repartition(3)).collect()]


def test_estimates_are_corrected():
    a, b = text_of(1, 400), edited(text_of(1, 400), 5, 0.1)
    packed = minhash.pack(minhash.minima([a, b, text_of(2, 400)])[0])
    assert abs(minhash.similarity(packed[0], packed[1:2])[0] - jaccard(a, b)) < 0.15
    assert abs(minhash.similarity(packed[0], packed[2:])[0]) < 0.12


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.least for r in minhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


# -- line dedup ---------------------------------------------------------------------------


def brute_lines(rows):
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seen, out = set(), {}
    for n, i, t in order:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[None if n else i, t] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_lines(rows)
    assert rows_of(linededup.dedup_lines(docs), "doc_id", "text") == sorted(((i, want[i, t]) for i, t in rows), key=repr)


def brute_clauses(rows):
    clause, between = re.compile(linededup.CLAUSE), re.compile(linededup.BETWEEN)
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}):
        units = clause.findall(t)
        keys = [between.sub(" ", u).strip(" ") for u in units]
        assert "".join(units) == t
        gone = set()
        for p in range(len(units) - 2):
            w = tuple(keys[p : p + 3])
            if sum(map(len, w)) < linededup.LEAST and not all("\n" in u for u in units[p : p + 3]):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i, t] = ("".join(u for p, u in enumerate(units) if p not in gone), len(gone))
    return out


def test_clauses_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["a", " ", "  ", ". ", ",", "\n", "\r\n", "é😀", "。", " \t", "same words of some length here", "\0", "\u00a0x"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    passage = "one two three four five, six seven eight nine ten eleven. twelve thirteen fourteen fifteen sixteen, seventeen eighteen nineteen. "
    rows += [(1000 + k, f"{text_of(k, 30)}. {passage}{text_of(50 + k, 30)}") for k in range(5)]  # a passage within a line
    want = brute_clauses(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = linededup.dedup_lines(docs, count="n", units="clauses")
    assert rows_of(got, "doc_id", "text", "n") == sorted(((i, *want[i, t]) for i, t in rows), key=repr)
    assert [("twelve" in r.text) for r in got.where("doc_id >= 1000").orderBy("doc_id").collect()] == [True] + [False] * 4


@pytest.mark.parametrize("units", linededup.UNITS)
def test_line_dedup_is_linear(spark, units):
    """A text of 200,000 lines, of which the second half repeats the first, and one of 5 million spaces."""
    half = "".join(f"line {k} of a very long text, which goes on\n" for k in range(100_000))
    docs = spark.createDataFrame([(1, half + half), (2, " " * 5_000_000), (3, "\n" * 300_000)], "doc_id bigint, text string")
    began = time.time()
    out = {r.doc_id: (r.size, r.n) for r in linededup.dedup_lines(docs, count="n", units=units).select("doc_id", F.length("text").alias("size"), "n").collect()}
    assert time.time() - began < 90
    assert 0 <= out[1][0] - len(half) < 20 and out[1][1] >= (100_000 if units == "lines" else 199_999)
    assert out[2] == (5_000_000, 0) and (out[3] == (300_000, 0) if units == "clauses" else out[3][0] <= 3)


def test_line_dedup_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    replaced = linededup.dedup_lines(docs, count="N_CHARS")
    assert len(replaced.columns) == len(docs.columns) and rows_of(replaced.where("doc_id = 9"), "N_CHARS") == [(0,), (4,)]
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs, count="text")
    assert linededup.dedup_lines(docs, units="clauses").where("doc_id <> 9").exceptAll(docs.where("doc_id <> 9")).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs, units="words")
    out = linededup.dedup_lines(docs, count="removed")
    assert out.columns == [*docs.columns, "removed"] and out.count() == len(AWKWARD)
    assert rows_of(out.where("doc_id = 9"), "text", "removed") == [("other text with this id", 0), ("same", 4)]
    assert rows_of(out.where("text is null"), "removed") == [(0,), (0,)]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    twice = frame(spark, [(1, "a\nb\nc", "en", "s"), (1, "a\nb\nc", "en", "s"), (2, "x\na\nb\nc\ny", "en", "s")])
    assert rows_of(linededup.dedup_lines(twice), "doc_id", "text") == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\ny")]


# -- mixing -------------------------------------------------------------------------------


def test_mixture_is_exact(spark):
    docs = frame(spark, [(k, text_of(k, 5 + k % 40), "en", f"s{k % 7 % 4}") for k in range(200)])
    got = mixing.mix_counts(docs, total=333, weights={"s0": 1, "s1": 2, "s3": 6})
    by = {r.source: r.n for r in got.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert by == {"s0": 37, "s1": 74, "s3": 222}
    assert rows_of(got, *got.columns) == rows_of(mixing.mix_counts(docs, total=333, weights={"s0": 1, "s1": 2, "s3": 6}), *got.columns)
    source = [r for r in docs.where("source = 's3'").collect()]
    size = {r.doc_id: len(bin(len(r.text))) - 2 for r in source}
    copies = {r.doc_id: r.copies for r in got.where("source = 's3'").collect()}
    for i, s in size.items():
        assert math.floor(222 * s / sum(size.values())) <= copies.get(i, 0) <= math.ceil(222 * s / sum(size.values()))


def test_ties_in_the_mixture(spark):
    """Rows of one rank are taken in the order of ids, null ids last; shares with equal remainders go by name."""
    ranked = spark.createDataFrame([("s", 0.5, 3, i) for i in (5, 1, None, 4, 2)], "source string, rank double, q bigint, doc_id bigint")
    got = mixing.lowest(ranked, "source", "rank", "q", [F.asc_nulls_last("doc_id")])
    assert rows_of(got, "doc_id") == [(1,), (2,), (4,)]
    units = spark.createDataFrame([(s, 10, 1, 4) for s in ("b", "a", None)], "source string, chars bigint, size bigint, n bigint")
    assert rows_of(mixing.source_shares(units, 4, None), "source", "share") == sorted([("a", 2), ("b", 1), (None, 1)], key=repr)
    long = spark.createDataFrame([(1, "x" * 3_000_000, "s"), (2, "y", "s")], "doc_id bigint, text string, source string")
    assert mixing.mix_counts(long, total=40).agg(F.sum("copies")).first()[0] == 40


def test_mixing_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns and out.where("text is null").count() == 0
    assert out.count() == sum(t is not None for _, t, _, _ in AWKWARD)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, weights={"none": 3}).count() == 0
    assert mixing.mix_counts(docs, weights={None: 1}, total=5).agg(F.sum("copies")).first()[0] == 5


# -- languages ----------------------------------------------------------------------------

WORDS = {"en": "the and of with this that from have which their", "de": "der die und nicht eine sich auch nach über können", "es": "los una para con por como más pero sus entre"}


def spoken(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    docs = frame(spark, [(k, spoken(lang, k * 7 + j), lang, "s") for k in range(30) for j, lang in enumerate(WORDS)])
    known = langid.dictionaries(docs.where("doc_id < 15"))
    out = langid.identify(docs.where("doc_id >= 15"), known)
    assert out.where("language = lang").count() == 45
    assert set(out.columns) == set(docs.columns)  # columns of these names are replaced


def test_sizes_are_those_of_direct_compression(spark):
    """Each text against zstandard itself: every block with every dictionary, the least sum of sizes, and margins; ties are rejected."""
    docs = frame(spark, [(k, spoken(lang, k * 7 + j, 5 + k * 60), lang, "s") for k in range(12) for j, lang in enumerate(WORDS)] + [(99, spoken("en", 5), "en", "s")])
    known = langid.dictionaries(docs)
    out = {r.doc_id * 10 + "ed".find(r.lang[0]): r for r in langid.identify(docs, known).select("doc_id", "lang", "text", "language", "language_margin").collect()}
    for r in out.values():
        raw = " ".join(re.findall(r"[^\W\d_]+", r.text.lower())).encode()
        total = {}
        for lang, content in known.items():
            total[lang] = 0
            for k in range(0, len(raw), langid.BLOCK_BYTES):
                own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0))
                total[lang] += len(own.compress(raw[k : k + langid.BLOCK_BYTES]))
        (best, lang), (second, _) = sorted((n, x) for x, n in total.items())[:2]
        assert r.language_margin == (second - best) / best
        assert r.language == (lang if (second - best) / best >= langid.MARGIN and second - best >= langid.MARGIN_BYTES else None)
    same = {"a": known["en"], "b": known["en"]}
    assert langid.identify(docs, same).where("language is not null").count() == 0
    assert langid.identify(docs, same, margin=0.0, margin_bytes=0).where("language = 'a'").count() == docs.count()


def test_dictionaries_are_bounded(spark):
    rows = [(k, f"text {k} " + "x" * (k % 50), "en", "s") for k in range(3000)] + [(7, "copy", "en", "s")] * 1500
    known = langid.dictionaries(frame(spark, rows), rows=20, size=300)
    assert set(known) == {"en"} and 100 < len(known["en"]) <= 300
    assert known == langid.dictionaries(frame(spark, rows[::-1]).repartition(7), rows=20, size=300)


def test_long_texts_keep_their_language(spark):
    docs = frame(spark, [(k, spoken(lang, k * 7 + j), lang, "s") for k in range(30) for j, lang in enumerate(WORDS)])
    known = langid.dictionaries(docs)
    long = [(100 + j, spoken(lang, 900 + j, 600_000), lang, "s") for j, lang in enumerate(WORDS)]
    assert min(len(t.encode()) for _, t, _, _ in long) > 2_500_000 and max(len(t.encode()) for _, t, _, _ in long) > 3_000_000
    out = langid.identify(frame(spark, long), known).select("doc_id", "lang", "language", "language_margin").collect()
    assert all(r.language == r.lang and r.language_margin > 4 * langid.MARGIN for r in out) and len(out) == 3


def test_languages_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    known = langid.dictionaries(docs)
    assert set(known) == {"en", "de"}
    out = langid.identify(docs, known)
    assert out.count() == len(AWKWARD)
    assert out.where("text is null or text = '' or doc_id = 8").where("language is not null").count() == 0
    assert langid.identify(docs, {}).where("language is not null").count() == 0
    assert langid.identify(docs, {"en": b"x"}).where("language = 'en'").count() == out.where("text rlike '\\\\p{L}'").count()
    assert langid.identify(docs.limit(0), known).count() == 0 and langid.dictionaries(docs.limit(0)) == {}


# -- quality ------------------------------------------------------------------------------


def test_quality_against_brute_force(spark):
    docs = frame(spark, [(k, spoken("en", k, 200), "en", "s") for k in range(30)] + [(99, "X1 ## 77 %% " * 40, "en", "s")])
    known = quality.references(docs)
    got = {r.doc_id: r for r in quality.judge(docs, known).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        total = 0
        for k in q.keys() | p.keys():
            a, b = p.get(k, 0) / n, q.get(k, 0) / m
            total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x)
        return math.sqrt(total / 2)

    def words(t):
        return re.findall(r"[^\W\d_]+", t.lower())

    every = [w for t in texts.values() for w in words(t)]
    common = {w for w in set(every) if every.count(w) * quality.COMMON >= len(every)}
    hist = lambda ws: {w: sum(x == w for x in ws) for w in common} | {"other": sum(x not in common for x in ws)}
    for i in (0, 17, 99):
        assert got[i].word_distance == pytest.approx(distance(hist(words(texts[i])), hist(every)), abs=2e-6)
    assert not got[99].keep and all(got[i].keep for i in range(30))


def test_quality_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = quality.judge(docs, quality.references(docs))
    assert out.count() == len(AWKWARD)
    assert rows_of(out.where("doc_id in (3, 4, 5, 7)"), "doc_id", "class_distance", "word_distance", "keep") == [(3, None, None, True), (4, None, None, True), (5, None, None, False), (7, None, None, True)]
    assert quality.references(docs.limit(0)) == {}
    unknown = quality.judge(docs, {})
    assert unknown.where("keep").count() == docs.where("text is not null").count()
    assert unknown.where("class_distance is not null or word_distance is not null").count() == 0


def test_summaries_keep_every_common_word(spark):
    """Words spread over tasks so that none is common in all; a task of few words; the result against plain counts."""
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice("the of and to".split()) if rng.random() < 0.1 else "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)), "en", "s") for k in range(80)] + [(500, "alone here", "de", "s")]
    known = quality.references(frame(spark, rows).repartition(9))
    words = [w for _, t, lang, _ in rows if lang == "en" for w in t.split()]
    common = sorted(words.count(w) for w in set(words) if words.count(w) * quality.COMMON >= len(words))
    assert sorted(known["en"][2][:-1].tolist()) == common and known["en"][2].sum() == len(words)
    assert sorted(known["de"][2].tolist()) == [0, 1, 1]
    keys, n = quality.summary(np.arange(50), np.arange(50), 10)
    assert len(keys) <= 10 and all(0 <= k - v <= np.arange(50).sum() / 11 for k, v in zip(keys, n))


def test_slices_are_bounded_by_characters():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400, None, "y" * 700, "", "z" * 2500, "w"])], names=["text"])
    got = [b.column("text").to_pylist() for b in quality.slices(iter([batch]), 1000)]
    assert [len(g) for g in got] == [2, 2, 1, 1] and sum(got, []) == batch.column("text").to_pylist()


# -- tokens -------------------------------------------------------------------------------


def test_encoding_agrees_with_the_library(spark):
    rng = random.Random(3)
    alphabet = "abc thing'sTHE  \n\t1234é😀ßÄ中文  .,!?'ll"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)] + [t for _, t, _, _ in AWKWARD if t] + ["x" * 700, " " * 90, "\U0010ffff a"]
    own = bpe.vocabulary()
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == encoder().encode_ordinary(text), text


def test_appends_and_edits():
    rng = random.Random(4)
    text = bpe.PrefixEncoder(text_of(1, 50))
    plain = text.text
    for _ in range(60):
        a = rng.randint(0, len(plain))
        b = min(len(plain), a + rng.randint(0, 6))
        new = "".join(rng.choice("ab 'sl1\né") for _ in range(rng.randint(0, 6)))
        text.replace(a, b, new)
        plain = plain[:a] + new + plain[b:]
        text.append("tail's")
        plain += "tail's"
        assert text.text == plain and text.tokens() == encoder().encode_ordinary(plain)
    before = text.computed
    text.append("x")
    assert text.computed - before < 8


def test_encoding_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = bpe.encode_documents(docs)
    assert set(out.columns) == set(docs.columns)
    for r in out.collect():
        assert r.token_ids == (None if r.text is None else encoder().encode_ordinary(r.text))
    back = bpe.decode_tokens(out.select("text", "token_ids"))
    assert back.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = frame(spark, AWKWARD).repartition(3)
    out = tokenfiles.write_tokens(docs, str(tmp_path)).collect()
    files = tokenfiles.TokenFiles(str(tmp_path))
    got = sorted(((r.doc_id, tokenfiles.decode(files.tokens(r.part, r.document))) for r in out), key=repr)
    assert got == sorted(((i, t or "") for i, t, _, _ in AWKWARD), key=repr)
    ends = sorted((r.token_start, r.token_start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and ends[-1][1] == files.size and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert all(files.offsets(r.part).dtype == np.uint64 and files.offsets(r.part)[r.document] == r.token_start for r in out)
    assert not [p for p in tmp_path.iterdir() if len(p.suffix) > 12]  # no file of an attempt is left
    assert tokenfiles.write_tokens(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_token_files_hold_the_library_s_ids(spark, tmp_path):
    """The files' raw bytes against ids of the public library, read without this module."""
    docs = frame(spark, AWKWARD).repartition(3)
    rows = tokenfiles.write_tokens(docs, str(tmp_path)).collect()
    text_of_ = {(r.doc_id, r.text) for r in docs.collect()}
    held = []
    for part in {r.part for r in rows}:
        ids = np.fromfile(tmp_path / f"{part:06d}.tokens", "<u2")
        offsets = np.fromfile(tmp_path / f"{part:06d}.offsets", "<u8")
        assert len(ids) == offsets[-1] - offsets[0]
        held += [(r.doc_id, ids[int(offsets[r.document] - offsets[0]) : int(offsets[r.document + 1] - offsets[0])].tolist()) for r in rows if r.part == part]
    want = [(i, [] if not t else encoder().encode_ordinary(t)) for i, t in text_of_]
    assert sorted({repr(x) for x in held}) == sorted({repr(x) for x in want})


def test_long_runs_are_encoded_in_linear_time(spark, tmp_path):
    """Runs that overflow the library's stack, and long pieces of every kind."""
    texts = [" " * 5_000_000 + "a", "\n" * 300_000, "x" * 300_000, "中文" * 60_000, "-=" * 100_000, "7" * 200_000]
    own = bpe.vocabulary()
    began = time.time()
    for text, ids in zip(texts, own.encode(texts)):
        ids = np.frombuffer(ids, own.dtype)
        assert own.decode(ids) == text.encode()
        if not text.startswith(" "):
            assert ids.tolist() == encoder().encode_ordinary(text)
    assert time.time() - began < 90
    rows = tokenfiles.write_tokens(spark.createDataFrame(list(enumerate(texts[:2])), "doc_id bigint, text string"), str(tmp_path)).collect()
    files = tokenfiles.TokenFiles(str(tmp_path))
    assert {r.doc_id: own.decode(files.tokens(r.part, r.document)).decode() for r in rows} == dict(enumerate(texts[:2]))


def test_unknown_ids_are_an_error(spark):
    size = bpe.vocabulary().size
    for bad in ([-1], [size], [1, None]):
        with pytest.raises(Exception, match="an id that the vocabulary lacks|a null among the ids"):
            bpe.decode_tokens(spark.createDataFrame([(bad,)], "token_ids array<int>")).collect()
    assert [r.decoded for r in bpe.decode_tokens(spark.createDataFrame([([],), (None,)], "token_ids array<int>")).collect()] == ["", None]


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_against_brute_force(spark, rule):
    rows = [(k, f"{k}", t) for k, t in enumerate(["ab\n\ncd\n", "", "\n\n\n\n", "x y\nzz é😀\n", "a\n\n\n\n  b"])] + [(9, None, "only"), (10, "only", None), (11, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    for lines in (True, False):
        got = tokencounts.token_counts(docs, fields=("title", "text"), lines=lines, rule=rule).collect()
        for i, title, text in rows:
            whole = "\n".join(x for x in (title, text) if x is not None)
            ids = encoder().encode_ordinary(whole)
            own = [r for r in got if r.doc_id == i]
            assert sum(r.n_tokens for r in own) == len(ids) and sum(r.n_chars for r in own) == len(whole)
            order = {"title": 0, "text": 1}
            own.sort(key=lambda r: (order[r.field], r.section))
            edges = np.cumsum([0] + [r.n_chars for r in own])
            starts = [len(whole[:e].encode()) for e in edges]
            want, at = [0] * len(own), 0
            for t in ids:
                size = len(encoder().decode_single_token_bytes(t))
                shares = [max(0, min(at + size, b) - max(at, a)) for a, b in zip(starts, starts[1:])]
                k = next(j for j, s in enumerate(shares) if s) if rule == "start" else shares.index(max(shares))
                want[k] += 1
                at += size
            assert [r.n_tokens for r in own] == want


def test_token_counts_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = tokencounts.token_counts(docs)
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(len(encoder().encode_ordinary(t)) for _, t, _, _ in AWKWARD if t)
    assert tokencounts.token_counts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokencounts.token_counts(docs, rule="other")


# -- shards -------------------------------------------------------------------------------


def test_shards_keep_linked_documents_together(spark):
    rows = [(k, f"passage {k // 5} one\npassage {k // 5} two\nown {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = sharding.assign(docs, shards=4)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert sorted(sizes) == [50] * 4
    between, all_ = sharding.cut_weight(docs, placed)
    start = sharding.cut_weight(docs, placed.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(4))))
    assert all_ == 40 * 4 * 2 and between <= 0.25 * start[0]


def test_shards_gather_all_documents_of_a_line(spark):
    """Groups of 2 to 30 documents, each with one line of its own, and single documents."""
    rows, group = [], {}
    for g, size in enumerate([2] * 30 + [5] * 20 + [12] * 10 + [30] * 4):
        for _ in range(size):
            group[len(rows)] = g
            rows.append((len(rows), f"group {g}\nown {len(rows)}"))
    rows += [(len(rows) + k, f"alone {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = sharding.assign(docs, shards=8)
    at = {r["doc_id"]: r["shard"] for r in placed.collect()}
    sizes = [list(at.values()).count(s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    pairs = [(a, b) for a in group for b in group if a < b and group[a] == group[b]]
    split = sum(at[a] != at[b] for a, b in pairs)
    assert split <= 0.02 * len(pairs)
    assert sharding.cut_pairs(docs, placed) == (split, len(pairs))


def test_groups_above_a_shard_are_split(spark):
    docs = spark.createDataFrame([(k, f"license\nown {k}" if k < 120 else f"alone {k}") for k in range(200)], "doc_id bigint, text string")
    at = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards=4).collect()}
    held = sorted(sum(at[k] == s for k in range(120)) for s in range(4))
    assert held[:1] == [0] and sum(held[2:]) >= 80


def test_shards_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = sharding.shard_documents(docs, shards=3)
    assert out.count() == len({(i, t or "") for i, t, _, _ in AWKWARD})
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 3
    assert sharding.shard_documents(docs, shards=1).select("shard").distinct().count() == 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=0)


def test_first_of_each_group(spark):
    rng = random.Random(8)
    rows = [(k % 3, rng.randint(0, 4), rng.randint(0, 9), k, q) for k, q in ((k, (7, 0, 1000)[k % 3]) for k in range(90))]
    df = spark.createDataFrame(rows, "g int, a int, b int, node int, q bigint")
    got = sharding.first_of(df, "g", "q", [F.col("a").cast("bigint"), F.col("b").cast("bigint")], [F.col("node")])
    want = [r for g in range(3) for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:4])[: (7, 0, 1000)[g]]]
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    numbers = sharding.numbered(df, 90, "a", "node").collect()
    assert sorted(r.r for r in numbers) == list(range(90))


def test_votes_against_brute_force(spark):
    """Each document's weight of links into every shard, counted over all pairs that share a line."""
    rng = random.Random(9)
    texts = {k: "\n".join(f"line {rng.randint(0, 25)}" for _ in range(rng.randint(0, 6))) for k in range(60)}
    found = sharding.nodes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "doc_id", "text")
    of = {r.node: r.doc_id for r in found.collect()}
    member = sharding.members(found.select("node", "lines"))
    labels = found.select("node", F.pmod("doc_id", F.lit(4)).cast("int").alias("shard"))
    want = {}
    for a, x in texts.items():
        for line in set(x.split("\n")) - {""}:
            others = [b for b, y in texts.items() if b != a and line in y.split("\n")]
            for b in others:
                want.setdefault((a, b % 4), {}).setdefault(line, [0, len(others)])[0] += 1
    want = {k: sum(n * sharding.WHOLE // m for n, m in v.values()) for k, v in want.items()}
    got = {(of[r.node], r.to): r.w for r in sharding.votes(member, labels).collect() if r.w}
    assert got == want
    best = {}
    for (a, s), w in want.items():
        if s != a % 4:
            best[a] = max(best.get(a, (0, 0)), (w, -s))
    for r in sharding.wishes(member, labels).collect():
        a = of[r.node]
        assert r.own == want.get((a, a % 4), 0)
        if a in best:
            assert (r.to, r.gain) == (-best[a][1], best[a][0] - r.own)


def test_quotas():
    got = sharding.quotas({(0, 1): 5, (1, 0): 3, (0, 2): 4}, [10, 10, 9], 10)
    assert got == {(0, 1): 3, (1, 0): 3, (0, 2): 1}


def test_tiktoken_is_the_yardstick():
    assert isinstance(encoder(), tiktoken.Encoding)
