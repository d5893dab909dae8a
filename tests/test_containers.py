import hashlib
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.operators import access as A
from verilith.operators import containers as C
from verilith.operators import verify as V
from verilith.options import ChunkOptions
from verilith.sources import corpora, store


def source(spark, *texts, container="c"):
    return spark.createDataFrame([(container, k, f"d{k}", t) for k, t in enumerate(texts)], "container_id string, doc_seq bigint, doc_id string, text string")


def lines_of(spark, *texts):
    return C.lines(C.placed(source(spark, *texts)))


def plan(spark, text, target, maximum):
    rows = C.chunk_plan(lines_of(spark, text), ChunkOptions(target, maximum)).orderBy("chunk_id").collect()
    return [(r.logical_offset, r.uncompressed_size, r.first_line, r.line_count, r.flags) for r in rows]


def test_chunks_end_at_lines(spark):
    assert plan(spark, "abc\ndef", 3, 4) == [(0, 4, 0, 1, 0), (4, 3, 1, 1, 0)]
    assert plan(spark, "", 4, 8) == []
    found = plan(spark, "x\n" * 150, 100, 1000)
    assert len(found) > 1 and sum(f[3] for f in found) == 150


def test_forced_splits(spark):
    assert plan(spark, "abcdef", 2, 3) == [(0, 3, 0, 1, 0), (3, 3, 1, 0, 1)]
    assert [f[:2] for f in plan(spark, "あ😀い", 4, 5)] == [(0, 3), (3, 4), (7, 3)]
    assert [f[:2] for f in plan(spark, "a\r\nb", 2, 2)] == [(0, 1), (1, 2), (3, 1)]
    with pytest.raises(PythonException, match="resource_limit_exceeded"):
        plan(spark, "😀", 1, 3)


def test_documents_share_lines(spark):
    docs = C.placed(source(spark, "alpha\nbe", "ta\ngamma", "", "\nx\n"))
    assert [r.line for r in C.lines(docs).orderBy("line_no").collect()] == ["alpha\n", "beta\n", "gamma\n", "x\n"]
    rows = docs.orderBy("doc_seq").collect()
    assert [(r.logical_offset, r.first_line, r.line_count) for r in rows] == [(0, 0, 2), (8, 1, 2), (16, 2, 0), (16, 2, 2)]


def test_spans(spark):
    lines = lines_of(spark, "alpha\nbeta\ngamma\n")
    chunks = C.chunk_plan(lines, ChunkOptions(9, 9))
    spans = spark.createDataFrame([("c", "single", 0, 6), ("c", "cross", 6, 11), ("c", "mid", 2, 7), ("c", "empty", 17, 0)], "container_id string, doc_id string, logical_offset bigint, byte_length bigint")
    got = {r.doc_id: (r.first_line, r.line_count, r.chunk_start, r.chunk_end, r.text) for r in C.spans_index(lines, spans, chunks, 9).collect()}
    assert got["single"] == (0, 1, 0, 1, "alpha\n")
    assert got["cross"] == (1, 2, 1, 3, "beta\ngamma\n")
    assert got["mid"] == (0, 2, 0, 2, "pha\nbet")
    assert got["empty"] == (3, 0, 0, 0, "")


def stored(spark, text, options):
    lines = lines_of(spark, text)
    chunks = C.chunk_plan(lines, options)
    content = C.chunk_bytes(lines, chunks, options.maximum)
    return chunks.join(C.compressed(content), ["container_id", "chunk_id"]), chunks.join(content, ["container_id", "chunk_id"])


def test_ranges(spark):
    _, chunks = stored(spark, "あaい\nabcdefgh\nlast", ChunkOptions(8, 8))
    raw = "あaい\nabcdefgh\nlast".encode()
    for low, n in ((0, 3), (5, 9), (0, len(raw)), (4, 0)):
        assert A.read_range(chunks, "c", low, n) == raw[low : low + n]
    assert A.read_text_range(chunks, "c", 0, 3) == "あ"
    with pytest.raises(EvidenceError, match="invalid_utf8_boundary"):
        A.read_text_range(chunks, "c", 1, 2)
    with pytest.raises(EvidenceError, match="logical_range_out_of_bounds"):
        A.read_range(chunks, "c", len(raw), 1)
    assert A.read_range_verified(chunks, "c", 3, 1, hashlib.sha256(b"a").hexdigest()) == b"a"
    with pytest.raises(EvidenceError, match="verified_checksum_mismatch"):
        A.read_range_verified(chunks, "c", 3, 1, "0" * 64)
    assert b"".join(A.export(chunks, "c")) == raw


def test_range_work(spark):
    chunks = C.chunk_plan(lines_of(spark, "aaaaaaa\nbbbbbbb\nccccccc\nddddddd\n"), ChunkOptions(8, 8))
    assert A.range_metrics(chunks, 9, 2).first()[1:] == (1, 8)
    assert A.range_metrics(chunks, 14, 4).first()[1:] == (2, 16)


def test_line_reads(spark):
    lines = lines_of(spark, "first\nabcdefghijklmnopqrstuvwxyz\nlast")
    assert A.read_lines(lines, "c", 1, 2) == ["abcdefghijklmnopqrstuvwxyz\n", "last"]
    with pytest.raises(EvidenceError, match="line_out_of_range"):
        A.read_lines(lines, "c", 2, 3)


@pytest.mark.parametrize("kind", sorted(corpora.KINDS))
def test_corpora_survive(spark, kind):
    text = corpora.validation_text(kind, seed=3, target_bytes=6000)
    assert text == corpora.validation_text(kind, seed=3, target_bytes=6000) and len(text.encode()) >= 6000
    whole, plain = stored(spark, text, ChunkOptions(1500, 2048))
    assert b"".join(A.export(plain, "c")) == text.encode()
    assert V.violations(whole).count() == 0
    assert V.report(whole, V.violations(whole)).first().decoded_bytes == len(text.encode())


def test_corruption_is_found(spark):
    whole, _ = stored(spark, "alpha\nbeta\ngamma\n", ChunkOptions(8, 8))
    whole = whole.cache()
    first = F.col("chunk_id") == 0
    flipped = whole.withColumn("payload", F.when(first, F.unhex(F.lit("00"))).otherwise(F.col("payload")))
    assert {r.violation for r in V.violations(flipped, level="normal").collect()} == {"compressed_chunk_checksum_mismatch"}
    assert V.violations(flipped, level="quick").count() == 0
    assert V.report(whole, V.violations(flipped)).first().first_error == "compressed_chunk_checksum_mismatch"
    gap = whole.withColumn("logical_offset", F.when(first, F.col("logical_offset") + 1).otherwise(F.col("logical_offset")))
    assert V.report(whole, V.violations(gap)).first().first_error == "logical_gap"
    count = whole.withColumn("line_count", F.col("line_count") + first.cast("bigint"))
    assert {r.violation for r in V.violations(count).collect()} >= {"line_count_mismatch", "first_line_gap"}
    with pytest.raises(EvidenceError, match="unknown_level"):
        V.violations(whole, level="other")
    assert V.attest(whole, {"size": 17}) == '{"level":"deep","size":17,"verified":true}\n'


def test_store_round_trip(spark, tmp_path):
    tables = store.pack(source(spark, "alpha\n", "beta\r\n", "gamma"), ChunkOptions(8, 16))
    store.save(tables, f"{tmp_path}/box")
    again = store.load(spark, f"{tmp_path}/box")
    row = again.containers.first()
    assert (row.original_size, row.document_count, row.line_count, row.newline_mode) == (17, 3, 3, "mixed")
    with pytest.raises(EvidenceError, match="duplicate_document_id"):
        store.pack(source(spark, "a").union(source(spark, "b")))
    docs = source(spark, "x", "y").withColumn("checksum", F.sha2("text", 256))
    assert A.read_document(docs, "d1") == "y"
    with pytest.raises(EvidenceError, match="document_not_found"):
        A.read_document(docs, "none")


def test_null_keys_and_a_line_feed_over_a_boundary(spark):
    schema = "container_id string, doc_seq bigint, doc_id string, text string"
    rows = [("c", 0, "a", "a\r"), ("c", 1, "b", ""), ("c", 2, None, "\nb"), (None, 0, "n", "x\n"), (None, 1, None, None)]
    docs = C.placed(spark.createDataFrame(rows, schema))
    assert sorted(((r.container_id or "", r.doc_seq, r.logical_offset, r.line_count) for r in docs.collect())) == [("", 0, 0, 1), ("", 1, 2, 0), ("c", 0, 0, 1), ("c", 1, 2, 0), ("c", 2, 2, 2)]
    info = {r.container_id: (r.original_size, r.document_count, r.line_count, r.newline_mode) for r in store.summary(docs).collect()}
    assert info == {"c": (4, 3, 2, "crlf"), None: (2, 2, 1, "lf")}
    lines = C.lines(docs)
    chunks = C.chunk_plan(lines, ChunkOptions(8, 8))
    entries = {(r.container_id, r.doc_id): (r.chunk_start, r.chunk_end) for r in C.document_index(docs, chunks, 8).collect()}
    assert entries == {("c", "a"): (0, 1), ("c", "b"): (0, 0), ("c", None): (0, 1), (None, "n"): (0, 1), (None, None): (0, 0)}
    with pytest.raises(Exception, match="null_doc_seq"):
        C.placed(spark.createDataFrame([("c", None, "a", "a")], schema)).collect()


def test_last_line_between_target_and_maximum(spark):
    assert plan(spark, "abcdef", 3, 8) == [(0, 6, 0, 1, 0)]
    assert plan(spark, "ab\nabcdef", 3, 8) == [(0, 3, 0, 1, 0), (3, 6, 1, 1, 0)]


def test_planned_lines_agree_with_the_plan(spark):
    text = "alpha\nbeta gamma delta epsilon\n\nzeta"
    found = C.planned_lines(spark.createDataFrame([("c", text), ("n", None)], "doc_id string, text string"), ChunkOptions(8, 10)).orderBy("line_no").collect()
    chunks = C.chunk_plan(lines_of(spark, text), ChunkOptions(8, 10)).orderBy("chunk_id").collect()
    for r in found:
        own = [c for c in chunks if c.logical_offset < r.logical_offset + r.byte_length and c.logical_offset + c.uncompressed_size > r.logical_offset]
        assert (r.chunk_start, r.chunk_end, r.chunk_sizes) == (own[0].chunk_id, own[-1].chunk_id + 1, [c.uncompressed_size for c in own])


def test_container_and_document_findings(spark, tmp_path):
    tables = store.pack(source(spark, "alpha\n", "beta\r\n", "gamma"), ChunkOptions(8, 16))
    store.save(tables, f"{tmp_path}/box")
    t = store.load(spark, f"{tmp_path}/box")
    first = lambda d, c: V.report(t.chunks, V.violations(t.chunks, d, "deep", c, 16)).first().first_error
    assert first(t.documents, t.containers) is None
    assert V.attest_all(t.containers, V.violations(t.chunks, t.documents, "deep", t.containers, 16)).count() == 1
    bad = t.documents.withColumn("logical_offset", F.when(F.col("doc_id") == "d2", F.col("logical_offset") + 1).otherwise(F.col("logical_offset")))
    assert first(bad, t.containers) == "document_out_of_bounds"
    assert first(t.documents, t.containers.withColumn("newline_mode", F.lit("lf"))) == "newline_mode_mismatch"
    assert V.attest_all(t.containers, V.violations(t.chunks, bad, "deep", t.containers, 16)).count() == 0


def test_text_files(spark, tmp_path):
    for name, text in (("b.txt", "beta"), ("a.txt", "alpha\n")):
        (tmp_path / name).write_text(text)
    rows = store.text_files(spark, f"{tmp_path}/*.txt", "box", "p/").orderBy("doc_seq").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("p/a.txt", "alpha\n"), ("p/b.txt", "beta")]
    (tmp_path / "c.txt").write_bytes(b"\xff")
    with pytest.raises(EvidenceError, match="invalid_utf8"):
        store.text_files(spark, f"{tmp_path}/*.txt", "box")


def test_spark_entry_without_the_optional_part(spark):
    import __spark_entry__

    assert os.path.isdir("/root/testdata/sf0.001") and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_documents_read_again_are_all_there(spark):
    from verilith.queries import catalogue

    rows = [("c", 0, "0", "one\ntwo"), ("c", 1, "1", ""), ("c", 2, "2", None), (None, 3, "3", "three\nfour\nfive"), (None, 4, "4", "é" * 9), ("", 5, "5", "six")]
    src = spark.createDataFrame(rows, "container_id string, doc_seq bigint, doc_id string, text string")
    found = catalogue.read_verified(src, ChunkOptions(5, 8)).collect()
    assert sorted(map(tuple, found)) == [(k, text, True) for _, k, _, text in rows]


def test_positions_over_groups_move_rows_once(spark, monkeypatch):
    monkeypatch.setattr(C, "SUMMED", 3)
    rows = [(p, o, 1 if o is None else o * 7 % 5) for p in ("a", None, "") for o in (None, *range(11))]
    df = spark.createDataFrame(rows, "p string, o bigint, n bigint")
    found = C.before(df, ["p"], "o", {"s": F.col("n")})
    for p, o, _, s in found.collect():
        assert s == sum(n for q, k, n in rows if q == p and o is not None and (k is None or k < o))


def test_export_streams_containers(spark):
    import hashlib

    rows = [("c", k, str(k), f"line {k}\nand {'é' * k}") for k in range(40)] + [(None, 0, "0", "abc")]
    lines = C.lines(C.placed(spark.createDataFrame(rows, "container_id string, doc_seq bigint, doc_id string, text string")))
    chunks = C.chunk_plan(lines, ChunkOptions(16, 20))
    packed = C.compressed(C.chunk_bytes(lines, chunks, 20))
    want = {c: "".join(t for q, *_, t in rows if q == c).encode() for c in ("c", None)}
    found = C.exported(C.joined(chunks, packed, ["container_id", "chunk_id"])).collect()
    assert {r.container_id: (r.exported_bytes, r.checksum) for r in found} == {c: (len(b), hashlib.sha256(b).hexdigest()) for c, b in want.items()}


def test_stored_tables_pass_and_agree_with_saved_ones(spark, tmp_path):
    rows = [(c, k, str(k), f"line {k}\nand {'é' * k}\r\n"[: 3 * k]) for c in ("a", None) for k in range(30)]
    src = spark.createDataFrame(rows, "container_id string, doc_seq bigint, doc_id string, text string")
    store.store(src, str(tmp_path), ChunkOptions(16, 20))
    one, two = store.load(spark, str(tmp_path)), store.pack(src, ChunkOptions(16, 20))
    for name in store.TABLES:
        a, b = getattr(one, name), getattr(two, name)
        assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count(), name
    assert V.violations(one.chunks, one.documents, "deep", one.containers, 20).collect() == []
