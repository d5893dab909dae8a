"""The engine's operators over whole tables.

Containers are documents where the name says nothing else, and sources (all
documents of one, by id) where offsets across documents matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verilith.functions import text as T
from verilith.operators import access as A
from verilith.operators import containers as C
from verilith.operators import index as I
from verilith.operators import verify as V
from verilith.options import HIGH_DF, ChunkOptions, SearchOptions
from verilith.plans import search as S
from verilith.sources import corpora, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHUNKS = ChunkOptions(16 << 10, 64 << 10)
TOKENS_AND, TOKEN, SUBSTRING, OVERLAP = "the of", "rerely", "tion the", "anan"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.source(documents(spark, sf_dir), container=F.col("source"))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.granules(documents(spark, sf_dir), options=CHUNKS)


def one_row(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row.values())], schema)


# -- SQL parts ---------------------------------------------------------------------------

LINES = r"""
l0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, unnest(range(len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')))) AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, line, strlen(line)::BIGINT AS byte_length, (sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(line))::BIGINT AS logical_offset FROM l0),
granules AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS granule_id, doc_id AS container_id, * EXCLUDE doc_id FROM lines)
"""
FEEDS = "(length(text) - length(replace(text, chr(10), '')))::BIGINT"
COUNT = f"({FEEDS} + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT"
CRLF = "((length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2)::BIGINT"
MODE = "CASE WHEN f = 0 THEN 'none' WHEN c = 0 THEN 'lf' WHEN f = c THEN 'crlf' ELSE 'mixed' END"
PLACED = f"""
d0 AS (SELECT source AS container_id, doc_id, text, strlen(text)::BIGINT AS byte_length, {FEEDS} AS feeds, {COUNT} AS line_count FROM documents),
placed AS (SELECT *, (sum(byte_length) OVER w - byte_length)::BIGINT AS logical_offset, (sum(feeds) OVER w - feeds)::BIGINT AS first_line FROM d0 WINDOW w AS (PARTITION BY container_id ORDER BY doc_id))
"""
PLAN = (
    r"""
whole AS (SELECT source AS container_id, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY source),
w0 AS (SELECT container_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, unnest(range(len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')))) AS line_no FROM whole),
wl AS (SELECT *, strlen(line)::BIGINT AS n, (sum(strlen(line)) OVER (PARTITION BY container_id ORDER BY line_no))::BIGINT AS e FROM w0),
feed_ends AS (SELECT container_id, e FROM wl WHERE right(line, 1) = chr(10)),
totals AS (SELECT container_id, max(e) AS total FROM wl GROUP BY container_id),
starts AS (SELECT container_id, 0::BIGINT AS s FROM totals UNION ALL SELECT container_id, e FROM feed_ends),
"""
    + f"""
reach AS (SELECT s.container_id, s.s, max(f.e) FILTER (WHERE f.e <= s.s + {CHUNKS.target}) AS a, max(f.e) AS b FROM starts s LEFT JOIN feed_ends f ON s.container_id = f.container_id AND f.e > s.s AND f.e <= s.s + {CHUNKS.maximum} GROUP BY s.container_id, s.s),
next_end AS (SELECT r.container_id, r.s, total, CASE WHEN total - r.s <= {CHUNKS.target} THEN total ELSE coalesce(a, b, CASE WHEN total - r.s <= {CHUNKS.maximum} THEN total END) END AS e FROM reach r JOIN totals t ON r.container_id = t.container_id),
walk AS (SELECT container_id, s, e, total, 0::BIGINT AS chunk_id FROM next_end WHERE s = 0 UNION ALL SELECT n.container_id, n.s, n.e, n.total, walk.chunk_id + 1 FROM walk JOIN next_end n ON walk.container_id = n.container_id AND n.s = walk.e WHERE walk.e < walk.total),
plan AS (SELECT w.container_id, w.chunk_id, w.s AS logical_offset, w.e - w.s AS uncompressed_size, count(l.line_no) FILTER (WHERE l.e - l.n < w.s)::BIGINT AS first_line, count(l.line_no) FILTER (WHERE l.e - l.n >= w.s AND l.e - l.n < w.e)::BIGINT AS line_count, 0::INTEGER AS flags
         FROM walk w JOIN wl l ON w.container_id = l.container_id GROUP BY w.container_id, w.chunk_id, w.s, w.e)
"""
)
#: The same plan where each document is a container.
DOC_PLAN = PLAN.replace("source AS container_id, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY source", "doc_id AS container_id, text FROM documents").replace("whole AS", "dwhole AS").replace("FROM whole", "FROM dwhole").replace("w0", "dw0").replace("wl", "dwl").replace("feed_ends", "dfeeds").replace("totals", "dtotals").replace("starts ", "dstarts ").replace("reach", "dreach").replace("next_end", "dnext").replace("walk", "dwalk").replace("plan AS", "dplan AS")
CHUNKED = """
chunked AS (SELECT g.container_id, g.granule_id, min(c.chunk_id)::BIGINT AS chunk_start, max(c.chunk_id)::BIGINT + 1 AS chunk_end FROM granules g JOIN dplan c ON g.container_id = c.container_id AND c.logical_offset < g.logical_offset + g.byte_length AND c.logical_offset + c.uncompressed_size > g.logical_offset GROUP BY ALL)
"""
TOKEN_KEYS = "keyed AS (SELECT DISTINCT granule_id, unnest(list_transform(regexp_extract_all(line, '[A-Za-z0-9_-]+'), lambda x: lower(x))) AS key FROM granules)"
NGRAM_KEYS = "keyed AS (SELECT DISTINCT granule_id, unnest(list_transform(range(1, greatest(length(line) - 1, 1)), lambda i: substring(line, i, 3))) AS key FROM granules)"
VARINT = "CASE WHEN d < 128 THEN 1 WHEN d < 16384 THEN 2 WHEN d < 2097152 THEN 3 WHEN d < 268435456 THEN 4 ELSE 5 END"
TERMS = f"""
deltas AS (SELECT key, granule_id - coalesce(lag(granule_id) OVER (PARTITION BY key ORDER BY granule_id), 0) AS d FROM keyed),
terms AS (SELECT key, count(*)::BIGINT AS granule_frequency, sum({VARINT})::BIGINT AS posting_size, CASE WHEN count(*) >= 1024 THEN (count(*) - 1) // 128 ELSE 0 END::BIGINT AS skip_points FROM deltas GROUP BY key)
"""
RUNS = """
runs AS (SELECT *, unnest(regexp_extract_all(line, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+')) AS run, unnest(range(len(regexp_extract_all(line, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+')))) AS k FROM able),
spans AS (SELECT container_id, granule_id, lower(run) AS key, (logical_offset + sum(strlen(run)) OVER (PARTITION BY granule_id ORDER BY k) - strlen(run))::BIGINT AS logical_offset, strlen(run)::BIGINT AS byte_length FROM runs)
"""


def _token_sql(*keys: str) -> str:
    tests = " AND ".join(f"list_contains(list_transform(regexp_extract_all(line, '[A-Za-z0-9_-]+'), lambda x: lower(x)), '{k}')" for k in keys)
    return f"WITH RECURSIVE {DOC_PLAN}, {LINES}, {CHUNKED}, able AS (SELECT * FROM granules WHERE {tests}), {RUNS}, hits AS (SELECT s.container_id, s.granule_id, logical_offset, byte_length, chunk_start, chunk_end FROM spans s JOIN chunked c ON s.granule_id = c.granule_id WHERE key IN ({', '.join(repr(k) for k in keys)}))"


def _substring_sql(q: str) -> str:
    return f"""WITH RECURSIVE {DOC_PLAN}, {LINES}, {CHUNKED}, able AS (SELECT * FROM granules WHERE contains(line, '{q}')),
places AS (SELECT *, unnest(range(1, length(line) - {len(q)} + 2)) AS i FROM able),
hits AS (SELECT p.container_id, p.granule_id, (logical_offset + strlen(substring(line, 1, i - 1)))::BIGINT AS logical_offset, {len(q.encode())}::BIGINT AS byte_length, chunk_start, chunk_end FROM places p JOIN chunked c ON p.granule_id = c.granule_id WHERE substring(line, i, {len(q)}) = '{q}')"""


NO_HITS = "SELECT 0::BIGINT AS container_id, 0::BIGINT AS granule_id, 0::BIGINT AS logical_offset, 0::BIGINT AS byte_length, 0::BIGINT AS chunk_start, 0::BIGINT AS chunk_end FROM documents WHERE false"


# -- containers, lines and chunks ----------------------------------------------------------


@query(f"""WITH {PLACED}, b AS (SELECT *, last_value(CASE WHEN text <> '' THEN right(text, 1) END IGNORE NULLS) OVER (PARTITION BY container_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM placed),
  digests AS (SELECT container_id, sha256(string_agg(c, '' ORDER BY g)) AS content_checksum FROM (SELECT container_id, doc_id // 65536 AS g, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS c FROM placed GROUP BY container_id, g) GROUP BY container_id),
  s AS (SELECT b.container_id, sum(byte_length)::BIGINT AS original_size, count(*)::BIGINT AS document_count, sum(feeds)::BIGINT AS f, sum({CRLF} + CASE WHEN before = chr(13) AND left(text, 1) = chr(10) THEN 1 ELSE 0 END)::BIGINT AS c,
  max_by(right(text, 1), doc_id) FILTER (WHERE text <> '') AS last_char, any_value(content_checksum) AS content_checksum FROM b JOIN digests ON b.container_id IS NOT DISTINCT FROM digests.container_id GROUP BY b.container_id)
SELECT container_id, original_size, document_count, (f + CASE WHEN original_size > 0 AND last_char <> chr(10) THEN 1 ELSE 0 END)::BIGINT AS line_count, {MODE} AS newline_mode, content_checksum FROM s""")
def container_info(spark, sf_dir):
    return store.summary(C.placed(by_source(spark, sf_dir)))


@query(f"SELECT doc_id, strlen(text)::BIGINT AS original_size, {COUNT} AS line_count, {MODE} AS newline_mode, sha256(text) AS checksum FROM (SELECT *, {FEEDS} AS f, {CRLF} AS c FROM documents)")
def newline_mode_by_doc(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.size(text).alias("original_size"), T.line_count(text).alias("line_count"), T.newline_mode(T.feeds(text), T.crlf(text)).alias("newline_mode"), T.checksum(text).alias("checksum"))


@query(f"WITH {LINES} SELECT doc_id, line_no, logical_offset, byte_length, sha256(line) AS checksum FROM lines")
def line_granules(spark, sf_dir):
    return C.document_lines(documents(spark, sf_dir)).select("doc_id", "line_no", "logical_offset", "byte_length", T.checksum(F.col("line")).alias("checksum"))


@query(f"WITH RECURSIVE {PLAN} SELECT container_id, line_no, e - n AS logical_offset, n AS byte_length, sha256(line) AS checksum FROM wl")
def container_lines(spark, sf_dir):
    found = C.lines(C.placed(by_source(spark, sf_dir)))
    return found.select("container_id", "line_no", "logical_offset", "byte_length", T.checksum(F.col("line")).alias("checksum"))


@query(f"WITH RECURSIVE {PLAN} SELECT * FROM plan")
def chunk_plan(spark, sf_dir):
    return C.chunk_plan(C.lines(C.placed(by_source(spark, sf_dir))), CHUNKS)


@query("SELECT source AS container_id, 0::BIGINT AS chunk_id, '' AS violation FROM documents WHERE false")
def chunk_plan_validate(spark, sf_dir):
    return C.chunk_violations(chunk_plan(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, list(logical_offset ORDER BY line_no) AS offsets FROM lines GROUP BY doc_id")
def dense_line_offsets(spark, sf_dir):
    rows = documents(spark, sf_dir).where(F.length("text") > 0)
    return rows.select("doc_id", T.running(F.transform(T.lines(F.col("text")), T.size)).alias("offsets"))


# -- access --------------------------------------------------------------------------------


@query("SELECT doc_id, lower(substr(hex(encode(text)), 201, 128)) AS bytes FROM documents WHERE strlen(text) >= 164")
def byte_range_read(spark, sf_dir):
    rows = documents(spark, sf_dir).where(F.octet_length("text") >= 164)
    return rows.select("doc_id", F.lower(F.hex(A.cut_bytes(F.encode("text", "utf-8"), 100, 64))).alias("bytes"))


@query(f"WITH RECURSIVE {PLAN} SELECT container_id, count(*) FILTER (WHERE logical_offset < 30000 AND logical_offset + uncompressed_size > 10000)::BIGINT AS decoded_chunks, coalesce(sum(uncompressed_size) FILTER (WHERE logical_offset < 30000 AND logical_offset + uncompressed_size > 10000), 0)::BIGINT AS decoded_bytes FROM plan GROUP BY container_id HAVING sum(uncompressed_size) >= 30000")
def byte_range_metrics(spark, sf_dir):
    return A.range_metrics(chunk_plan(spark, sf_dir), 10_000, 20_000)


@query("SELECT doc_id, NOT (ascii_at BETWEEN '80' AND 'BF') AND NOT (end_at BETWEEN '80' AND 'BF') AS valid FROM (SELECT doc_id, substr(hex(encode(text)), 101, 2) AS ascii_at, substr(hex(encode(text)), 181, 2) AS end_at FROM documents WHERE strlen(text) > 90)")
def text_range_validity(spark, sf_dir):
    rows = documents(spark, sf_dir).where(F.octet_length("text") > 90)
    return rows.select("doc_id", F.is_valid_utf8(A.cut_bytes(F.encode("text", "utf-8"), 50, 40).cast("string")).alias("valid"))


@query(f"WITH {LINES} SELECT doc_id, line FROM lines WHERE line_no = 1")
def line_read(spark, sf_dir):
    line = F.try_element_at(T.lines(F.col("text")), F.lit(2))
    return documents(spark, sf_dir).select("doc_id", line.alias("line")).where("line is not null")


@query(f"WITH {LINES} SELECT doc_id, string_agg(line, '' ORDER BY line_no) AS text FROM lines WHERE line_no BETWEEN 1 AND 3 GROUP BY doc_id HAVING count(*) = 3")
def line_range_read(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("l")).where(F.size("l") >= 4)
    return rows.select("doc_id", F.array_join(F.slice("l", 2, 3), "").alias("text"))


_ENTRY = "p.container_id, p.doc_id::VARCHAR AS doc_id, p.logical_offset, p.byte_length, p.first_line, p.line_count, coalesce(min(c.chunk_id), 0)::BIGINT AS chunk_start, coalesce(max(c.chunk_id) + 1, 0)::BIGINT AS chunk_end, sha256(p.text) AS checksum"
_INDEXED = f"WITH RECURSIVE {PLAN}, {PLACED} SELECT {_ENTRY} FROM placed p LEFT JOIN plan c ON p.container_id = c.container_id AND p.byte_length > 0 AND c.logical_offset < p.logical_offset + p.byte_length AND c.logical_offset + c.uncompressed_size > p.logical_offset GROUP BY p.container_id, p.doc_id, p.logical_offset, p.byte_length, p.first_line, p.line_count, p.text"


@query(_INDEXED)
def document_index(spark, sf_dir):
    docs = C.placed(by_source(spark, sf_dir))
    return C.document_index(docs, C.chunk_plan(C.lines(docs), CHUNKS), CHUNKS.maximum)


@query(f"SELECT container_id, doc_id, chunk_start, chunk_end FROM ({_INDEXED}) WHERE chunk_end - chunk_start > 1")
def document_chunk_ranges(spark, sf_dir):
    return document_index(spark, sf_dir).where("chunk_end - chunk_start > 1").select("container_id", "doc_id", "chunk_start", "chunk_end")


@query(f"WITH {PLACED} SELECT container_id, doc_id::VARCHAR AS doc_id, logical_offset, byte_length, first_line + 1 AS first_line, line_count FROM placed")
def document_list(spark, sf_dir):
    docs = C.placed(by_source(spark, sf_dir))
    return docs.select("container_id", T.escaped(F.col("doc_id")).alias("doc_id"), "logical_offset", "byte_length", (F.col("first_line") + 1).alias("first_line"), "line_count")


@query("SELECT doc_id, text, true AS verified FROM documents")
def document_read_verified(spark, sf_dir):
    """Every document again, cut out of its container's chunks by its index entry, against its checksum."""
    return read_verified(by_source(spark, sf_dir), CHUNKS)


def read_verified(src: DataFrame, options: ChunkOptions) -> DataFrame:
    """(doc_id, text, verified) of each document of a source, empty and null texts too."""
    docs = C.placed(src.withColumn("_null", F.col("text").isNull()))
    lines = C.lines(docs)
    chunks = C.chunk_plan(lines, options)
    stored = C.chunk_bytes(lines, chunks, options.maximum)
    keys = ["container_id", "doc_id", "logical_offset", "byte_length", "checksum"]
    spans = docs.select(*keys, "_null")
    hits = C.overlaps(chunks, spans, options.maximum)
    listed = hits.groupBy("container_id", "chunk_id").agg(F.collect_list(F.struct(*keys[1:], "c_low", "c_high")).alias("_in"))
    held = C.joined(stored, listed, ["container_id", "chunk_id"]).select("container_id", "bytes", F.explode("_in").alias("x")).select("container_id", "bytes", "x.*")
    low = F.greatest("c_low", "logical_offset")
    cut = A.cut_bytes(F.col("bytes"), low - F.col("c_low"), F.least(F.col("c_high"), F.col("logical_offset") + F.col("byte_length")) - low)
    found = held.select(*keys, low.alias("at"), cut.alias("b")).groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("at", "b"))), F.lit(b""), lambda a, x: F.concat(a, x["b"])).alias("b"))
    empty = spans.where("byte_length = 0").select("doc_id", F.when(~F.col("_null"), F.lit("")).alias("text"), (F.col("checksum") == T.checksum(F.lit(b""))).alias("verified"))
    both = found.select("doc_id", F.col("b").cast("string").alias("text"), (T.checksum(F.col("b")) == F.col("checksum")).alias("verified")).union(empty)
    return both.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("SELECT source AS container_id, sum(strlen(text))::BIGINT AS exported_bytes, sha256(string_agg(text, '' ORDER BY doc_id)) AS checksum FROM documents GROUP BY source")
def export_roundtrip(spark, sf_dir):
    """Chunks compressed, decompressed and put together again, each container's as a stream in one task."""
    lines = C.lines(C.placed(by_source(spark, sf_dir)))
    chunks = C.chunk_plan(lines, CHUNKS)
    packed = C.compressed(C.chunk_bytes(lines, chunks, CHUNKS.maximum))
    return C.exported(C.joined(chunks, packed, ["container_id", "chunk_id"]))


# -- indexes -------------------------------------------------------------------------------


@query(f"WITH {LINES}, {TOKEN_KEYS}, {TERMS} SELECT * FROM terms")
def token_terms(spark, sf_dir):
    return I.terms_of(I.bare_granules(documents(spark, sf_dir)))


@query(f"WITH {LINES}, {TOKEN_KEYS} SELECT key, granule_id FROM keyed")
def token_postings(spark, sf_dir):
    return I.postings(I.bare_granules(documents(spark, sf_dir)))


@query(f"WITH {LINES}, {NGRAM_KEYS}, {TERMS} SELECT * FROM terms WHERE length(key) = 3")
def ngram_terms(spark, sf_dir):
    return I.terms_of(I.bare_granules(documents(spark, sf_dir)), "ngram")


@query(f"WITH {LINES}, {TOKEN_KEYS}, {TERMS} SELECT key, granule_frequency FROM terms WHERE granule_frequency * 1000000 // (SELECT greatest(count(*), 1) FROM granules) >= {HIGH_DF}")
def high_df_terms(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = I.terms_of(I.bare_granules(docs)).select("key", "granule_frequency")
    return own.crossJoin(F.broadcast(I.loose_lines(docs).agg(F.count("*").alias("n")))).where(I.is_frequent(F.col("granule_frequency"), F.col("n"))).drop("n")


_SIZE = f"""WITH {LINES}, {TOKEN_KEYS}, {TERMS}, n AS (SELECT count(*)::BIGINT AS g FROM granules),
sized AS (SELECT *, (SELECT {VARINT} FROM (SELECT strlen(key) AS d)) + (SELECT {VARINT} FROM (SELECT granule_frequency AS d)) + (SELECT {VARINT} FROM (SELECT posting_size AS d)) + strlen(key) AS entry FROM terms)"""


@query(f"{_SIZE} SELECT any_value(g)::BIGINT AS granule_count, count(*)::BIGINT AS term_count, sum(posting_size)::BIGINT AS postings_size, (16 + 20 * any_value(g) + sum(entry) + sum(posting_size))::BIGINT AS index_size_bytes FROM sized, n")
def index_size(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return I.index_size(I.terms_of(I.bare_granules(docs)), I.granule_count(docs))


@query(f"WITH {LINES}, {TOKEN_KEYS}, {TERMS} SELECT 'token' AS kind, true AS complete, {HIGH_DF} AS high_df_per_million, (SELECT count(*) FROM granules)::BIGINT AS granule_count, count(*)::BIGINT AS term_count, sum(granule_frequency)::BIGINT AS posting_count, max(granule_frequency)::BIGINT AS longest_list FROM terms")
def index_inspect(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sums = I.terms_of(I.bare_granules(docs)).agg(F.count("*").alias("term_count"), F.sum("granule_frequency").alias("posting_count"), F.max("granule_frequency").alias("longest_list"))
    return sums.crossJoin(F.broadcast(I.loose_lines(docs).agg(F.count("*").alias("granule_count")))).select(F.lit("token").alias("kind"), F.lit(True).alias("complete"), F.lit(HIGH_DF).alias("high_df_per_million"), "granule_count", "term_count", "posting_count", "longest_list")


@query("SELECT * FROM (VALUES ('same', true), ('other', false)) AS t(source, bound)")
def index_binding_check(spark, sf_dir):
    lines = granules(spark, sf_dir)
    own = I.source_checksum(lines)
    other = I.source_checksum(lines.withColumn("line", F.when(F.col("granule_id") == 0, F.concat(F.lit("x"), "line")).otherwise(F.col("line"))))
    return spark.createDataFrame([("same", I.source_checksum(granules(spark, sf_dir)) == own), ("other", other == own)], "source string, bound boolean")


# -- search --------------------------------------------------------------------------------


_STORED: dict[tuple[str, str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, kind: str = "token") -> I.Index:
    """The index of all lines, built and saved once in a session, and loaded again, with its binding checked by the manifest."""
    name = (spark.sparkContext.applicationId, sf_dir, kind)
    if name not in _STORED:
        folder = store.shared_folder(spark, f"index-{kind}")
        I.store(granules(spark, sf_dir), folder, kind)
        _STORED[name] = folder
    return I.load(spark, _STORED[name])


def ad_hoc(lines: DataFrame, text: str, kind: str = "token", n: int = 3, complete: bool = True) -> I.Index:
    """An index of just the query's keys, which is what a search without a stored one builds."""
    posted = I.postings(lines, kind, n, T.query_keys(text, kind, n))
    return I.Index(kind, n, complete, HIGH_DF, "", lines.count(), lines, I.terms(posted), posted)


OPEN = SearchOptions(max_candidates=1 << 62, max_decoded_bytes=1 << 62)


@query(f"{_token_sql(TOKEN)} SELECT * FROM hits")
def token_search_single(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir), TOKEN, OPEN).hits


@query(f"{_token_sql('the', 'of')} SELECT * FROM hits")
def token_search_and(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir), TOKENS_AND, OPEN).hits


@query(f"{_token_sql('the', 'of')} SELECT * FROM hits")
def token_scan(spark, sf_dir):
    """The same hits without an index."""
    return S.scan(granules(spark, sf_dir), "token", TOKENS_AND)


@query(NO_HITS)
def token_search_missing(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir), "the zzzzqqqq", OPEN).hits


@query(NO_HITS)
def token_search_no_tokens(spark, sf_dir):
    return S.search(ad_hoc(granules(spark, sf_dir), "証拠"), "証拠", OPEN).hits


@query(f"{_substring_sql(SUBSTRING)} SELECT * FROM hits")
def ngram_search_substring(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir, "ngram"), SUBSTRING, OPEN).hits


@query(f"{_substring_sql(OVERLAP)} SELECT * FROM hits")
def ngram_search_overlap(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir, "ngram"), OVERLAP, OPEN).hits


@query(f"{_substring_sql(SUBSTRING)} SELECT * FROM hits")
def substring_scan(spark, sf_dir):
    """The same hits without an index."""
    return S.scan(granules(spark, sf_dir), "ngram", SUBSTRING)


METRICS = ("term_lookups", "posting_bytes_read", "candidate_granules", "candidate_chunks", "decoded_bytes", "physical_decoded_bytes", "verified_matches")
REPORT = "capped boolean, incomplete_reason string, " + ", ".join(f"{m} bigint" for m in METRICS)


def report_row(spark: SparkSession, r: S.Report) -> DataFrame:
    return one_row(spark, {"capped": r.capped, "reason": r.incomplete_reason, **{k: r.metrics[k] for k in METRICS}}, REPORT)


@query("SELECT false AS capped, 'query_shorter_than_ngram_n' AS incomplete_reason, 0::BIGINT AS term_lookups, 0::BIGINT AS posting_bytes_read, 0::BIGINT AS candidate_granules, 0::BIGINT AS candidate_chunks, 0::BIGINT AS decoded_bytes, 0::BIGINT AS physical_decoded_bytes, 0::BIGINT AS verified_matches")
def ngram_query_too_short(spark, sf_dir):
    return report_row(spark, S.search(ad_hoc(granules(spark, sf_dir), "an", "ngram"), "an", OPEN))


_READ = f"{TOKEN_KEYS}, {TERMS}"
_TOUCHED = "touched AS (SELECT DISTINCT d.container_id, d.chunk_id, d.uncompressed_size FROM able a JOIN chunked c ON a.granule_id = c.granule_id JOIN dplan d ON d.container_id = a.container_id AND d.chunk_id >= c.chunk_start AND d.chunk_id < c.chunk_end)"


@query(f"{_token_sql('the')}, {_READ}, {_TOUCHED} SELECT true AS capped, NULL AS incomplete_reason, 1::BIGINT AS term_lookups, (SELECT sum(posting_size)::BIGINT FROM terms WHERE key = 'the') AS posting_bytes_read, (SELECT count(*) FROM able)::BIGINT AS candidate_granules, (SELECT count(*) FROM touched)::BIGINT AS candidate_chunks, 0::BIGINT AS decoded_bytes, 0::BIGINT AS physical_decoded_bytes, 0::BIGINT AS verified_matches")
def search_candidate_cap(spark, sf_dir):
    return report_row(spark, S.search(stored_index(spark, sf_dir), "the", SearchOptions(max_candidates=10)))


@query(f"{_token_sql('the', 'of')}, reach AS (SELECT granule_id FROM (SELECT granule_id, sum(byte_length) OVER (ORDER BY granule_id) AS s FROM able) WHERE s <= 50000) SELECT * FROM hits WHERE granule_id IN (SELECT granule_id FROM reach)")
def search_byte_budget(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir), TOKENS_AND, SearchOptions(max_candidates=1 << 62, max_decoded_bytes=50_000)).hits


@query(f"{_token_sql('the', 'of')} SELECT * FROM hits ORDER BY granule_id, logical_offset LIMIT 25")
def search_result_cap(spark, sf_dir):
    return S.search(stored_index(spark, sf_dir), TOKENS_AND, SearchOptions(max_candidates=1 << 62, max_results=25)).hits


@query(f"{_token_sql('the', 'of')}, {_READ}, {_TOUCHED} SELECT false AS capped, NULL AS incomplete_reason, 2::BIGINT AS term_lookups, (SELECT sum(posting_size)::BIGINT FROM terms WHERE key IN ('the', 'of')) AS posting_bytes_read, (SELECT count(*) FROM able)::BIGINT AS candidate_granules, (SELECT count(*) FROM touched)::BIGINT AS candidate_chunks, (SELECT sum(uncompressed_size) FROM touched)::BIGINT AS physical_decoded_bytes, (SELECT sum(byte_length) FROM able)::BIGINT AS decoded_bytes, (SELECT count(*) FROM hits)::BIGINT AS verified_matches")
def search_metrics(spark, sf_dir):
    return report_row(spark, S.search(stored_index(spark, sf_dir), TOKENS_AND, OPEN))


@query(f"WITH {LINES}, {NGRAM_KEYS}, n AS (SELECT count(*) AS g FROM granules), t AS (SELECT key, count(*)::BIGINT AS granule_frequency FROM keyed WHERE key IN ('tio', 'ion', 'on ', 'n t', ' th', 'the') GROUP BY key), o AS (SELECT *, granule_frequency * 1000000 // g >= {HIGH_DF} AS high_df FROM t, n) SELECT key, granule_frequency, high_df, row_number() OVER (ORDER BY high_df, granule_frequency, key)::INTEGER AS position FROM o")
def planner_decision(spark, sf_dir):
    """The order in which the planner takes the keys of a substring query."""
    docs = documents(spark, sf_dir)
    posted = I.postings(I.loose_lines(docs).withColumn("granule_id", F.lit(0)), "ngram", 3, T.query_keys(SUBSTRING, "ngram"))  # no more than how often each key occurs is asked for
    flag = posted.groupBy("key").agg(F.count("*").alias("granule_frequency")).select("key", "granule_frequency", I.is_frequent(F.col("granule_frequency"), F.lit(I.granule_count(docs))).alias("high_df"))
    return flag.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("high_df", "granule_frequency", "key")))


@query(f"""WITH {LINES}, {TOKEN_KEYS},
words AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda x: lower(x)) AS w FROM benchmark),
qk AS (SELECT DISTINCT query_id, unnest(w) AS key FROM words),
asked AS (SELECT query_id FROM words),
many AS (SELECT query_id, count(*) AS n FROM qk GROUP BY query_id),
able AS (SELECT qk.query_id, granule_id FROM keyed JOIN qk ON keyed.key = qk.key JOIN many ON many.query_id = qk.query_id GROUP BY qk.query_id, granule_id, n HAVING count(*) = n),
occ AS (SELECT granule_id, unnest(list_transform(regexp_extract_all(line, '[A-Za-z0-9_-]+'), lambda x: lower(x))) AS key FROM granules),
m AS (SELECT a.query_id, count(*)::BIGINT AS matches FROM able a JOIN occ o ON a.granule_id = o.granule_id JOIN qk ON qk.query_id = a.query_id AND qk.key = o.key GROUP BY a.query_id),
c AS (SELECT query_id, count(*)::BIGINT AS candidate_granules FROM able GROUP BY query_id)
SELECT asked.query_id, coalesce(candidate_granules, 0)::BIGINT AS candidate_granules, coalesce(matches, 0)::BIGINT AS matches FROM asked LEFT JOIN c ON asked.query_id = c.query_id LEFT JOIN m ON asked.query_id = m.query_id""")
def search_batch(spark, sf_dir):
    """All benchmark items at once, each by all its tokens."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("keys"))
    return S.search_batch(I.loose_lines(documents(spark, sf_dir)), items)


@query(f"{_substring_sql(OVERLAP)} SELECT container_id AS doc_id, count(*)::BIGINT AS occurrences FROM hits GROUP BY container_id")
def raw_scan_count(spark, sf_dir):
    """Overlapping occurrences counted on the raw text, without lines."""
    rows = documents(spark, sf_dir).where(F.col("text").contains(OVERLAP))
    return rows.select("doc_id", T.big(F.regexp_count("text", F.lit(f"(?=\\Q{OVERLAP}\\E)"))).alias("occurrences"))


# -- integrity -----------------------------------------------------------------------------


def stored_containers(spark: SparkSession, sf_dir: str) -> store.Tables:
    """All sources packed, saved once in a session, and loaded."""
    name = (spark.sparkContext.applicationId, sf_dir, "containers")
    if name not in _STORED:
        folder = store.shared_folder(spark, "containers")
        store.store(by_source(spark, sf_dir), folder, CHUNKS)
        _STORED[name] = folder
    return store.load(spark, _STORED[name])


def _findings(t: store.Tables, level: str = "deep") -> DataFrame:
    return V.violations(t.chunks, t.documents, level, t.containers, CHUNKS.maximum)


@query(f"WITH RECURSIVE {PLAN} SELECT container_id, 'deep' AS level, count(*)::BIGINT AS checked_chunks, sum(uncompressed_size)::BIGINT AS decoded_bytes, true AS ok, NULL AS first_error FROM plan GROUP BY container_id")
def verify_deep(spark, sf_dir):
    t = stored_containers(spark, sf_dir)
    return V.report(t.chunks, _findings(t))


@query("SELECT source AS container_id, 0 AS rank, '' AS violation FROM documents WHERE false")
def verify_deep_violations(spark, sf_dir):
    return _findings(stored_containers(spark, sf_dir))


@query(f"WITH RECURSIVE {PLAN} SELECT DISTINCT container_id, 1 AS rank, 'compressed_chunk_checksum_mismatch' AS violation FROM plan")
def verify_detects_corruption(spark, sf_dir):
    """A byte is flipped in the first chunk of every container."""
    payload = F.when(F.col("chunk_id") == 0, F.concat(F.unhex(F.lit("00")), A.cut_bytes(F.col("payload"), F.lit(1), F.octet_length("payload") - 1))).otherwise(F.col("payload"))
    return V.violations(stored_containers(spark, sf_dir).chunks.withColumn("payload", payload), level="normal")


FAULTS = [None, "compressed_chunk_checksum_mismatch", "chunk_checksum_mismatch", "total_line_count_mismatch", "total_size_mismatch", "newline_mode_mismatch", "document_checksum_mismatch", "document_chunk_range_mismatch", "flag_mismatch", "logical_gap", "document_count_mismatch", "document_line_count_mismatch", "document_out_of_bounds", "empty_chunk", "chunk_id_sequence", "unknown_flag"]
_FAULT = f"(CASE substr(source, 4)::BIGINT % {len(FAULTS)} " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FAULTS) if f) + " END)"


@query(f"SELECT DISTINCT source AS container_id, {_FAULT} IS NULL AS ok, {_FAULT} AS first_error FROM documents")
def verify_planted_faults(spark, sf_dir):
    """Into the tables of each source another fault is put, by its number; what deep verification finds first."""
    t = stored_containers(spark, sf_dir)
    fault = lambda name: F.pmod(F.substring("container_id", 4, 10).cast("bigint"), F.lit(len(FAULTS))) == FAULTS.index(name)

    bad = F.lit("0" * 64)
    plants = {
        "chunks": {"payload": {"compressed_chunk_checksum_mismatch": F.concat(F.unhex(F.lit("00")), "payload")}, "uncompressed_checksum": {"chunk_checksum_mismatch": bad}, "flags": {"flag_mismatch": F.lit(1), "unknown_flag": F.lit(2)}, "logical_offset": {"logical_gap": F.col("logical_offset") + 1}, "uncompressed_size": {"empty_chunk": F.lit(0).cast("bigint")}, "chunk_id": {"chunk_id_sequence": F.lit(-1).cast("bigint")}},
        "documents": {"checksum": {"document_checksum_mismatch": bad}, "chunk_end": {"document_chunk_range_mismatch": F.col("chunk_end") + 1}, "line_count": {"document_line_count_mismatch": F.col("line_count") + 1}, "byte_length": {"document_out_of_bounds": F.lit(1 << 40).cast("bigint")}},
        "containers": {"line_count": {"total_line_count_mismatch": F.col("line_count") + 1}, "original_size": {"total_size_mismatch": F.col("original_size") + 1}, "newline_mode": {"newline_mode_mismatch": F.lit("crlf")}, "document_count": {"document_count_mismatch": F.col("document_count") + 1}},
    }
    where = {"chunks": F.col("chunk_id") == 0, "documents": (F.col("logical_offset") == 0) & (F.col("byte_length") > 0), "containers": F.lit(True)}
    of = {}
    for table, columns in plants.items():
        rows = getattr(t, table)
        values = {c: F.col(c) for c in columns}
        for c, faults in columns.items():
            for name, value in faults.items():
                values[c] = F.when(where[table] & fault(name), value).otherwise(values[c])
        of[table] = rows.withColumns(values)
    found = V.violations(of["chunks"], of["documents"], "deep", of["containers"], CHUNKS.maximum)
    return V.report(t.chunks, found).select("container_id", "ok", "first_error")


_INFO = ORACLES["container_info"]


@query(f"""SELECT container_id, '{{"container_id":"' || container_id || '","content_checksum":"' || content_checksum || '","document_count":' || document_count || ',"level":"deep","line_count":' || line_count || ',"newline_mode":"' || newline_mode || '","original_size":' || original_size || ',"verified":true}}' || chr(10) AS record FROM ({_INFO})""")
def attest(spark, sf_dir):
    """A record of each container, after deep verification of what is stored of it."""
    t = stored_containers(spark, sf_dir)
    return V.attest_all(t.containers, _findings(t))


@query("""SELECT doc_id AS container_id, '{"checksum":"' || sha256(text) || '","doc_id":' || doc_id || ',"original_size":' || strlen(text) || '}' || chr(10) AS record FROM documents""")
def document_records(spark, sf_dir):
    """Records of documents' sizes and checksums; nothing is verified."""
    rows = documents(spark, sf_dir).select("doc_id", T.size(F.col("text")).alias("original_size"), T.checksum(F.col("text")).alias("checksum"))
    return V.attested(rows).select(F.col("doc_id").alias("container_id"), "record")


# -- corpora and figures -------------------------------------------------------------------


@query("SELECT range AS line_no, 'ts=' || lpad(range::VARCHAR, 6, '0') || ' level=' || CASE range % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE 'debug' END || ' request_id=req-' || range || CASE WHEN range % 1000 = 0 THEN ' rare-token-unique' ELSE '' END || chr(10) AS line FROM range(24000)")
def corpus_logs(spark, sf_dir):
    return corpora.log_lines(spark, 24_000, 1000)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (WHERE k >= ceil(n * 0.5)) AS p50, min(value) FILTER (WHERE k >= ceil(n * 0.95)) AS p95, min(value) FILTER (WHERE k >= ceil(n * 0.99)) AS p99 FROM r GROUP BY event_type""")
def latency_nearest_rank(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type")
    return rows.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_search_and(spark, sf_dir)
