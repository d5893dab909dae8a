"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilith.llm import ann, bpe, langid, linededup, minhash, mixing, quality, sharding, tokencounts, tokenfiles
from verilith.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 20, against all rows."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=10, asked=F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, count="removed_units", units="clauses")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.dictionaries(docs))
    return found.select("doc_id", "language", "language_margin", F.col("language").isNotNull().alias("keep"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_tokens(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest_neighbours, op2_mixing, op3_sharding, op4_near_duplicates, op5_line_dedup, op6_language_id, op7_token_files, op8_token_counts, op9_quality_rules, op10_bpe)}

_MIXING = """
WITH rows AS (
  SELECT doc_id, source, text, length(text)::BIGINT AS chars, length(bin(length(text)))::BIGINT AS size,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(text)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, source, text, count(*)::BIGINT AS n, sum(chars)::BIGINT AS chars, min(size) AS size, min(u) AS u FROM rows GROUP BY doc_id, source, text),
sources AS (SELECT source, sum(size * n)::BIGINT AS whole_size, floor(sqrt(sum(chars)::DOUBLE))::BIGINT AS w FROM units GROUP BY source),
total AS (SELECT (SELECT sum(n) FROM units)::BIGINT AS t, sum(w)::BIGINT AS all_w FROM sources WHERE w > 0),
base AS (SELECT source, whole_size, (t * w) // all_w AS b, (t * w) % all_w AS rest, t FROM sources, total WHERE w > 0),
shares AS (
  SELECT source, whole_size, b + CASE WHEN row_number() OVER (ORDER BY rest DESC, source ASC NULLS LAST) <= t - sum(b) OVER () THEN 1 ELSE 0 END AS share
  FROM base),
placed AS (
  SELECT doc_id, units.source, text, u, whole_size, share, (share * size * n) // whole_size AS whole, (share * size * n) % whole_size AS part
  FROM units JOIN shares ON units.source IS NOT DISTINCT FROM shares.source),
ranked AS (
  SELECT *, share - sum(whole) OVER (PARTITION BY source) AS extra,
         row_number() OVER (PARTITION BY source, part > 0 ORDER BY (u / (1 - u)) * ((whole_size - part)::DOUBLE / part::DOUBLE), doc_id) AS k
  FROM placed)
SELECT doc_id, source, (whole + CASE WHEN part > 0 AND k <= extra THEN 1 ELSE 0 END)::BIGINT AS copies
FROM ranked WHERE whole + CASE WHEN part > 0 AND k <= extra THEN 1 ELSE 0 END > 0
"""

_CLAUSES = f"""
WITH l AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{linededup.CLAUSE}')) AS unit, unnest(range(len(regexp_extract_all(text, '{linededup.CLAUSE}')))) AS p
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, p, unit, trim(regexp_replace(unit, '{linededup.BETWEEN}', ' ', 'g')) AS k, contains(unit, chr(10)) AS ends FROM l),
w AS (SELECT doc_id, p, k AS a, lead(k, 1) OVER d AS b, lead(k, 2) OVER d AS c, ends AND lead(ends, 1) OVER d AND lead(ends, 2) OVER d AS ends FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL AND (ends OR length(a) + length(b) + length(c) >= {linededup.LEAST})) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + j AS p, 1 AS g FROM later, (VALUES (0), (1), (2)) AS t(j)),
done AS (
  SELECT l.doc_id, coalesce(string_agg(unit, '' ORDER BY l.p) FILTER (WHERE g IS NULL), '') AS text, count(g) AS removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(done.text, d.text) AS text, coalesce(done.removed, 0)::BIGINT AS removed_units FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""


def _quality() -> str:
    kinds = [r"\p{Ll}", r"\p{Lu}", r"\p{Lt}|\p{Lm}|\p{Lo}", r"\p{Nd}", " ", r"\n", r"\p{P}"]
    count = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))::BIGINT"
    one = ", ".join(f"{count(p)} AS c{k}" for k, p in enumerate(kinds))
    rest = " - ".join(["length(text)", *[f"c{k}" for k in range(len(kinds))]])
    every = [f"c{k}" for k in range(len(kinds) + 1)]
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    classes = " + ".join(f"{term(f'(d.{c} / d.n::DOUBLE)', f'(r.{c} / r.n::DOUBLE)')} + {term(f'(r.{c} / r.n::DOUBLE)', f'(d.{c} / d.n::DOUBLE)')}" for c in every)
    return f"""
WITH first AS (SELECT doc_id, lang, text, length(text)::BIGINT AS n, {one} FROM documents),
d AS (SELECT *, ({rest})::BIGINT AS c{len(kinds)} FROM first),
r AS (SELECT lang, sum(n)::BIGINT AS n, {", ".join(f"sum({c})::BIGINT AS {c}" for c in every)} FROM d GROUP BY lang),
by_class AS (SELECT d.doc_id, d.lang, d.text, CASE WHEN d.n >= {quality.MIN_CHARS} THEN round(sqrt(greatest({classes}, 0) / 2), 6) END AS class_distance FROM d JOIN r ON d.lang IS NOT DISTINCT FROM r.lang),
w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
all_words AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
common AS (SELECT w.lang, word, count(*) AS k, any_value(n) AS n FROM w JOIN all_words ON w.lang = all_words.lang GROUP BY w.lang, word HAVING count(*) * {quality.COMMON} >= any_value(n)),
bins AS (SELECT lang, word, k, n FROM common UNION ALL SELECT a.lang, NULL, a.n - coalesce(sum(k), 0)::BIGINT, a.n FROM all_words a LEFT JOIN common c ON a.lang = c.lang GROUP BY a.lang, a.n),
mine AS (SELECT doc_id, w.lang, c.word, count(*) AS k FROM w LEFT JOIN common c ON w.lang = c.lang AND w.word = c.word GROUP BY doc_id, w.lang, c.word),
docs AS (SELECT doc_id, lang, count(*) AS n FROM w GROUP BY doc_id, lang),
pq AS (SELECT docs.doc_id, docs.n AS words, coalesce(mine.k, 0) / docs.n::DOUBLE AS p, bins.k / bins.n::DOUBLE AS q
       FROM docs JOIN bins ON docs.lang = bins.lang LEFT JOIN mine ON mine.doc_id = docs.doc_id AND mine.word IS NOT DISTINCT FROM bins.word),
by_word AS (SELECT doc_id, CASE WHEN any_value(words) >= {quality.MIN_WORDS} THEN round(sqrt(greatest(sum({term('p', 'q')} + {term('q', 'p')}), 0) / 2), 6) END AS word_distance FROM pq GROUP BY doc_id)
SELECT c.doc_id, c.lang, class_distance, word_distance,
       c.text IS NOT NULL AND NOT coalesce(class_distance > {quality.MAX_CLASS}, false) AND NOT coalesce(word_distance > {quality.MAX_WORD}, false) AS keep
FROM by_class c LEFT JOIN by_word w ON c.doc_id = w.doc_id
"""


ORACLES: dict[str, str] = {"op2_mixing": _MIXING, "op5_line_dedup": _CLAUSES, "op9_quality_rules": _quality()}
