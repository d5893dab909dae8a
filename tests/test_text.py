import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.functions import text as T
from verilith.options import ChunkOptions, byte_limit, span


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


@pytest.mark.parametrize("text, count", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\nb\n", 2), ("\n", 1), ("\n\n", 2), ("a\r\nb\rc", 2)])
def test_lines(spark, text, count):
    row = one(spark, text, T.line_count(F.col("text")), T.lines(F.col("text")))
    assert row[0] == count == len(row[1])
    assert "".join(row[1]) == text


@pytest.mark.parametrize("text, mode", [("", "none"), ("a", "none"), ("a\n", "lf"), ("a\r\nb\r\n", "crlf"), ("a\nb\r\n", "mixed"), ("a\r", "none")])
def test_newline_mode(spark, text, mode):
    t = F.col("text")
    assert one(spark, text, T.newline_mode(T.feeds(t), T.crlf(t)))[0] == mode


def test_tokens_and_spans(spark):
    line = "Äa-B_c 12é The the"
    row = one(spark, line, T.tokens(F.col("text")), T.token_spans(F.col("text"), ["the", "12"]))
    assert row[0] == ["a-b_c", "12", "the", "the"]
    raw = line.encode()
    assert [raw[s.offset : s.offset + s.length].decode() for s in row[1]] == ["12", "The", "the"]


def test_overlapping_substrings_and_ngrams(spark):
    row = one(spark, "é😀aaaa\n", T.substring_spans(F.col("text"), F.lit("aa")), T.ngrams(F.col("text"), 3))
    assert [s.offset for s in row[0]] == [6, 7, 8]
    text = "é😀aaaa\n"
    assert row[1] == [text[i : i + 3] for i in range(len(text) - 2)]


def test_query_keys():
    assert T.query_keys("The the OF", "token") == ["of", "the"]
    assert T.query_keys("証拠", "token") == []
    assert T.query_keys("ab", "ngram", 3) == []
    assert T.query_keys("aaaa", "ngram", 3) == ["aaa"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé😀\n\r -", max_size=12), min_size=1, max_size=6))
def test_running_offsets(spark, values):
    text = "".join(values)
    row = one(spark, text, T.lines(F.col("text")), T.running(F.transform(T.lines(F.col("text")), T.size)))
    at = 0
    for line, offset in zip(*row):
        assert offset == at
        at += len(line.encode())


def test_numbers(spark):
    row = one(spark, "x", *[T.varuint_size(F.lit(v).cast("bigint")) for v in (0, 127, 128, 16383, 16384, 1 << 35)])
    assert list(row) == [1, 1, 2, 2, 3, 6]
    assert byte_limit("64KiB") == 65536 and byte_limit("7") == 7 and span("3:9") == (3, 9)
    with pytest.raises(EvidenceError):
        span("9:3")
    with pytest.raises(EvidenceError):
        ChunkOptions(8, 4)
