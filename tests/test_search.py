import pytest
from pyspark.sql import functions as F

from verilith.errors import EvidenceError
from verilith.operators import index as I
from verilith.options import ChunkOptions, SearchOptions
from verilith.plans import search as S
from verilith.streaming import ingest


def lines(spark, text):
    return I.granules(spark.createDataFrame([(0, text)], "doc_id bigint, text string"))


def hits(report):
    return sorted((r.logical_offset, r.byte_length) for r in report.hits.collect())


def find(spark, text, query, kind="token", options=SearchOptions(), **build):
    return S.search(I.build(lines(spark, text), kind, **build), query, options)


def test_tokens_of_one_line(spark):
    r = find(spark, "alpha beta\nbeta gamma\n", "alpha beta")
    assert hits(r) == [(0, 5), (6, 4)] and not r.capped
    assert r.metrics["candidate_granules"] == 1 and r.metrics["decoded_bytes"] == 11
    assert find(spark, "info\nerror code\nerror again\n", "error").metrics["candidate_granules"] == 2


def test_stale_postings_are_verified(spark):
    own = I.build(lines(spark, "alpha\nbeta\n"))
    own.postings = own.postings.union(spark.createDataFrame([("alpha", 1)], "key string, granule_id bigint"))
    r = S.search(own, "alpha")
    assert r.metrics["candidate_granules"] == 2 and hits(r) == [(0, 5)]
    assert {v.violation for v in I.violations(own).collect()} == {"frequency_mismatch"}


def test_chunks_of_hits_and_physical_bytes(spark):
    own = I.granules(spark.createDataFrame([(0, "alpha one\nbeta two\nalpha three\n"), (1, "alpha\n"), (None, "alpha\nx")], "doc_id bigint, text string"), options=ChunkOptions(10, 12))
    assert own.count() == 6 and {r.granule_id for r in own.collect()} == set(range(6))
    r = S.search(I.build(own), "alpha")
    assert sorted((h.container_id is None, h.container_id, h.logical_offset, h.chunk_start, h.chunk_end) for h in r.hits.collect()) == [(False, 0, 0, 0, 1), (False, 0, 19, 2, 3), (False, 1, 0, 0, 1), (True, None, 0, 0, 1)]
    assert (r.metrics["candidate_granules"], r.metrics["candidate_chunks"], r.metrics["decoded_bytes"], r.metrics["physical_decoded_bytes"]) == (4, 4, 34, 35)


@pytest.mark.parametrize("kind", ["token", "ngram"])
def test_terms_agree_with_those_of_postings(spark, monkeypatch, kind):
    monkeypatch.setattr(I, "RANGE", 8)
    own = lines(spark, "".join(f"common word{k % 7} {'rare' if k % 31 == 0 else ''}\n" for k in range(300)))
    want = sorted(map(tuple, I.terms(I.postings(own, kind)).collect()))
    assert sorted(map(tuple, I.terms_of(own, kind).collect())) == want
    lists = {}
    for r in I.postings(own, kind).collect():
        lists.setdefault(r.key, []).append(r.granule_id)
    for key, n, size, _ in want:
        ids = sorted(lists[key])
        assert n == len(ids) and size == sum(1 if d < 128 else 2 for d in [ids[0], *(b - a for a, b in zip(ids, ids[1:]))])


def test_no_keys_and_missing_keys(spark):
    assert find(spark, "alpha one\nbeta two\n", "証拠").incomplete_reason == "query_has_no_indexable_tokens"
    assert find(spark, "中文証拠の行\n", "中文", "ngram").incomplete_reason == "query_shorter_than_ngram_n"
    r = find(spark, "alpha\nbeta\n", "zzz", "ngram")
    assert r.missing_keys == ["zzz"] and r.incomplete_reason is None and hits(r) == []
    assert find(spark, "alpha\nbeta\n", "zzz", "ngram", complete=False).incomplete_reason == "missing_required_key_in_incomplete_index"


def test_substrings(spark):
    assert hits(find(spark, "abc東京xyz\n京都abc\n", "東京x", "ngram", n=2)) == [(3, 7)]
    r = find(spark, "aaaxxx\n" * 64 + "aaazzz\n", "aaazzz", "ngram")
    assert "aaa" in r.high_df_keys and r.selected_keys[0] != "aaa" and len(hits(r)) == 1
    assert hits(find(spark, "aaaa\n", "aaa", "ngram")) == [(0, 3), (1, 3)]


def test_budgets(spark):
    text = "".join(f"aaa common {k}\n" for k in range(128))
    r = find(spark, text, "aaa", "ngram", SearchOptions(max_candidates=10))
    assert r.capped and r.metrics["decoded_bytes"] == 0 and hits(r) == []
    r = find(spark, text, "common", options=SearchOptions(max_results=128))
    assert r.capped and len(hits(r)) == 128
    r = find(spark, text, "common", options=SearchOptions(max_results=0))
    assert r.capped and hits(r) == []
    r = find(spark, "x aa\nx\nx aaaaaa\nx\n", "x", options=SearchOptions(max_decoded_bytes=9))
    assert r.capped and len(hits(r)) == 2  # the line that doesn't fit ends it, though a shorter one follows
    r = find(spark, "".join(f"aaa line {k}\n" for k in range(1100)), "aaa", "ngram")
    assert r.metrics["posting_bytes_read"] < 1100


def test_scan_agrees_with_the_index(spark):
    text = "the cat of the hat\nOf course The\nnothing\n"
    assert sorted(map(tuple, S.scan(lines(spark, text), "token", "the of").collect())) == sorted(map(tuple, find(spark, text, "the of").hits.collect()))
    assert S.scan(lines(spark, text), "ngram", "th").count() == 0


def test_saved_index(spark, tmp_path):
    own = lines(spark, "alpha evidence\nshared token\nbeta evidence\nshared token\n")
    I.save(I.build(own), f"{tmp_path}/i")
    again = I.load(spark, f"{tmp_path}/i", own)
    assert hits(S.search(again, "shared")) == [(15, 6), (42, 6)]
    assert I.violations(again).count() == 0
    with pytest.raises(EvidenceError, match="sidecar_binding_mismatch"):
        I.load(spark, f"{tmp_path}/i", lines(spark, "other\n"))
    with pytest.raises(EvidenceError, match="unsupported_index_mode"):
        I.build(own, "normalised")


def test_fragments_make_no_difference(spark, tmp_path):
    text = "alpha\nbéta\r\n\nend"
    start = ("", 0, 0, False)
    whole = ingest.push(start, [(text, True)])
    for n in (1, 2, 5):
        state, out = start, []
        for k in range(0, len(text), n):
            state, some = ingest.push(state, [(text[k : k + n], k + n >= len(text))])
            out += some
        assert (state, out) == whole
    with pytest.raises(EvidenceError, match="writer_already_finished"):
        ingest.push(whole[0], [("more", False)])


def test_streaming(spark, tmp_path):
    schema = "container_id string, seq bigint, fragment string, last boolean"
    for k, (fragment, last) in enumerate((("al", False), ("pha\nbe", False), ("ta", True))):
        spark.createDataFrame([("c", k, fragment, last)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = ingest.ingest(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("line_no").select("line_no", "logical_offset", "byte_length", "line").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 6, "alpha\n"), (1, 6, 4, "beta")]
    assert rows and F is not None


@pytest.mark.parametrize("kind", ["token", "ngram"])
def test_packed_postings_are_the_postings(spark, monkeypatch, kind, tmp_path):
    monkeypatch.setattr(I, "BLOCK_CHARS", 900)
    text = "".join(f"Common {chr(0x4E00 + 37 * k)}é word{k % 7}-_X {'rare' if k % 201 == 0 else ''}\n" for k in range(700)) + "\n\n!\nend"
    own = lines(spark, text)
    want = sorted(map(tuple, I.postings(own, kind).collect()))
    assert sorted(map(tuple, I.unpacked(I.packed(own, kind)).collect())) == want
    gaps = own.where("granule_id % 5 <> 3")
    assert sorted(map(tuple, I.unpacked(I.packed(gaps, kind)).collect())) == [x for x in want if x[1] % 5 != 3]
    I.store(own, str(tmp_path / "a"), kind)
    I.save(I.build(own, kind), str(tmp_path / "b"))
    for folder in ("a", "b"):
        found = I.load(spark, str(tmp_path / folder), own)
        assert sorted(map(tuple, found.postings.collect())) == want and I.violations(found).isEmpty()
        assert sorted(map(tuple, found.terms.collect())) == sorted(map(tuple, I.terms(I.postings(own, kind)).collect()))


def test_result_cap_beyond_the_first_beginning(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST", 2)
    monkeypatch.setattr(S, "LONGER", 2)
    text = "".join("beta\n" if k % 3 else "alpha alpha\n" for k in range(40))
    for cap in (1, 3, 9, 27, 28, 29):
        r = find(spark, text, "alpha", options=SearchOptions(max_results=cap))
        assert len(hits(r)) == min(cap, 28) == r.metrics["verified_matches"] and r.capped == (cap <= 28)
        assert hits(r) == hits(find(spark, text, "alpha"))[:cap] and r.metrics["decoded_bytes"] == 12 * -(-min(cap, 28) // 2)


def test_byte_budget_reads_just_lines_within_it(spark):
    r = find(spark, "alpha 1\n" * 20, "alpha", options=SearchOptions(max_decoded_bytes=29))
    assert len(hits(r)) == 3 and r.capped and (r.metrics["decoded_bytes"], r.metrics["candidate_granules"]) == (24, 20)


def test_lines_of_small_documents_need_no_python_for_chunks(spark):
    own = I.granules(spark.createDataFrame([(0, "a\nbb"), (1, "x" * 30 + "\n" + "é" * 9 + "\nend"), (2, ""), (3, None)], "doc_id bigint, text string"), options=ChunkOptions(8, 10))
    assert [(r.container_id, r.chunk_start, r.chunk_end, r.chunk_sizes) for r in own.orderBy("granule_id").collect()] == [(0, 0, 1, [4]), (0, 0, 1, [4]), (1, 0, 4, [10, 10, 10, 1]), (1, 4, 6, [10, 9]), (1, 6, 7, [3])]
    assert I.bare_granules(spark.createDataFrame([(0, "a\nbb")], "doc_id bigint, text string")).collect() == [(0, "a\n"), (1, "bb")]
    for keys in (["a\n", "bb", "b"], ["ab"]):
        assert sorted(map(tuple, I.postings(own, "ngram", 2, keys).collect())) == sorted(x for x in map(tuple, I.postings(own, "ngram", 2).collect()) if x[0] in keys)
