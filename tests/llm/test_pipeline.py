import random
import shutil

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from verilith.llm import langid, minhash, queries, tokenfiles
from verilith.llm.common import VOCABULARY

from .test_text_operators import AWKWARD, brute_lines, edited, frame, jaccard, rows_of, spoken


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        lang = ("en", "de", "es")[k % 3]
        rows.append((k, "\n".join(spoken(lang, k * 10 + j, 12) + f" w{k}x{j}" for j in range(5)), lang, f"s{k % 4}"))
    rows += [(100 + k, edited(rows[k][1], k, 0.02), rows[k][2], "s1") for k in range(0, 20, 4)]
    rows += [(200, "12345 !!!", "en", "s0"), (201, None, "en", "s0"), (202, "", "en", "s0"), (203, rows[3][1], "en", "s2")]
    rng.shuffle(rows)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs
    first = after["language id"]
    known = langid.dictionaries(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = {i for i, t, _, _ in rows if t and any(map(str.isalpha, t))}
    assert {r.doc_id for r in first.collect()} == kept and set(known) == {"en", "de", "es"}
    want = brute_lines([(r.doc_id, r.text) for r in first.collect()])
    assert rows_of(after["line dedup"], "doc_id", "text", "n_chars") == sorted(((i, t, len(t)) for (i, _), t in want.items() if t), key=repr)
    texts = {r.doc_id: r.text for r in after["line dedup"].collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a], texts[b]) >= minhash.THRESHOLD:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in after["near duplicates"].collect()} == {i for i in texts if find(i) == i} and any(find(i) != i for i in texts)
    mixture = duckdb.connect()
    mixture.register("documents", after["near duplicates"].toPandas())
    want = sorted((i, s) for i, s, n in mixture.sql(queries.ORACLES["op2_mixing"]).select("doc_id, source, copies").fetchall() for _ in range(n))
    assert sorted((r.doc_id, r.source) for r in after["mixing"].collect()) == want
    for r in before.join(docs.dropDuplicates(["doc_id"]).select("doc_id", "token_ids"), "doc_id").collect():
        assert r.token_ids == tokenfiles.encoding(VOCABULARY).encode_ordinary(r.text)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert rows_of(whole.withColumn("t", F.col("token_ids").cast("string")), "doc_id", "t") == rows_of(docs.withColumn("t", F.col("token_ids").cast("string")), "doc_id", "t")
    shutil.rmtree(tmp_path)


@pytest.mark.parametrize("rows", [0, 14])
def test_awkward_tables(spark, tmp_path, rows):
    """The awkward rows with columns of clashing names, and an empty table."""
    docs = frame(spark, AWKWARD).limit(rows).withColumn("removed_lines", F.lit(1)).withColumn("removed", F.lit("x")).withColumn("_found", F.lit(2))
    assert "language" in docs.columns and "language_margin" in docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        assert out.where("removed_lines <> 1 or removed <> 'x' or language <> 'old'").count() == 0
        assert out.count() <= before.count()
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "lang", "source", "n_chars", "token_ids"]
    assert final.count() == out.count() and (final.count() > 0) == (rows > 0)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
