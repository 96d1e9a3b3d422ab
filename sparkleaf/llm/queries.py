"""One query for each training-data operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, minhash, packing, pii, quality, sentencepieces, substring, tokencount, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha256(column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best integer inner products of every vector whose vec_id is divisible by 100, against all other rows."""
    rows = topk.sparse_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 1024)
    found = topk.search(rows.where(F.col("id") % 100 == 0), rows, k=10)
    return found.select("query_id", "rank", F.col("item_id").alias("vec_id"), "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    pieces = packing.tokenize_pieces(docs, 2048, "byte_bpe_50k.json", 0)
    sized = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(sized, 2048, groups=packing.groups_for(docs))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that aren't held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold() != 1))
    rows = docs.select("doc_id", F.coalesce(langid.fold() == 1, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    coded = sentencepieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), "text", "piece_bpe_32k.model", end=True).select("doc_id", "ids")
    both = sentencepieces.decode(coded)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(ids).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle_words=2, percent=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    found = quality.repetition(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller document holds."""
    found = linededup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", _sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = tokencount.token_counts(docs, "text", "byte_bpe_50k.json")
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that also start in a smaller document."""
    found = substring.dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"), words=13)
    return found.select("doc_id", "n_words", "n_removed", _sha256(F.col("text")).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, _sha256(joined(base)).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_packing, op3_langid, op4_sentencepiece, op5_near_dedup, op6_quality, op7_line_dedup, op8_token_counts, op9_substring_dedup, op10_pii)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL_1 = """
WITH live AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT)) AS w, generate_subscripts(embedding, 1) AS d FROM live),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, sum(a.w * b.w)::BIGINT AS score
  FROM q a JOIN q b ON a.d = b.d AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_SQL_5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = w.doc_id
"""


def _sql_6() -> str:
    lengths = sorted({5, *quality.MAX_NGRAM_SHARE})
    ctes = [f"w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws FROM documents)", "k AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w)"]
    for n in lengths:
        ctes.append(f"g{n} AS (SELECT doc_id, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g FROM w WHERE len(ws) >= {n})")
        ctes.append(f"d{n} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1)")
        ctes.append(f"c{n} AS (SELECT doc_id, count(*) AS words, sum(length(word)) AS chars FROM k JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM d{n}) USING (doc_id, i) GROUP BY 1)")
    ctes.append("l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w)")
    ctes.append(r"dl AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE r > 1 GROUP BY 1)")
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in lengths)
    bad = " OR ".join([f"coalesce(dl.chars, 0) > {quality.MAX_LINE_SHARE} * word_chars", *(f"coalesce(c{n}.chars, 0) > {s} * word_chars" for n, s in quality.MAX_NGRAM_SHARE.items())])
    return f"""
WITH {", ".join(ctes)},
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
o AS (SELECT m.*, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(c5.words, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(c5.words, 0) > 20 * n_words AS base_failed, {bad} AS bad
  FROM m LEFT JOIN dl USING (doc_id) {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM o
"""


_SQL_7 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOWER.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY 1),
j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY 1
"""

_SQL_9 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
b AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM b),
k AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: SQL has no tokenizers, trained models or packing heuristics: ops 2, 3, 4, 8 and 10 are tested against brute force.
SQL = {"op1_topk": _SQL_1, "op5_near_dedup": _SQL_5, "op6_quality": _sql_6(), "op7_line_dedup": _SQL_7, "op9_substring_dedup": _SQL_9}
