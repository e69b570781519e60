"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .chat import format_and_read
from .decontaminate import decontaminate
from .line_dedup import dropped_lines
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_components
from .scratch import Scratch
from .sharding import shard_documents
from .token_files import read_token_index, write_token_files
from .topk import exact_topk


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded: 0 toxic, 1 of low quality, 2 good.  Those likely to be good are kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    out = quality.grade_documents(docs, quality.learn(docs, labels, grade, 3))
    tail = lambda k: F.col("tails")[k - 1]
    return out.select("doc_id", "score", "expected_grade", tail(1).alias("p_not_toxic"), tail(2).alias("p_good"), (tail(1) < 0.7).alias("toxic"), (tail(2) >= 0.3).alias("keep"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Re-Pair compressed token ids, written and read back."""
    import public_tokenizers

    path = Scratch(spark, "tokens").top + "/shards"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_index(spark, path)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same components, and of each document the number of documents that it links with."""
    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100, count_links=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix of sources in which no source is repeated more than twice, with nothing left out."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_repeats=2.0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents to drop, of any length but blank ones, as an earlier line is equal or one character away."""
    return dropped_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_chars=1).withColumn("dropped", F.array_join("dropped", ","))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose id isn't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.filter(~held))
    return language_id.predict(docs, model, {"doc_id": (F.col("doc_id").cast("long"), "long"), "held_out": (held, "boolean")})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of each query vector."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted in windows and read back."""
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return format_and_read(turns.unionByName(more))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op3_ngram_links": op3_ngram_links,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_topk": op8_exact_topk,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
}

#: Words of either kind, after lower-casing A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS g
  FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS i
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
h AS (SELECT x, y FROM c WHERE 100 * i >= 90 * (m + n - i)),
l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

_DECONTAMINATE_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT m FROM v),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM d, k, unnest(range(1, len(w) - m + 2)) u(i)),
h AS (SELECT p.doc_id, p.i, p.m, v.item_id FROM p JOIN v ON p.m = v.m AND p.g = v.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY 1),
j AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN j USING (doc_id)
"""

_TOPK_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM x q JOIN x r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

#: Lines within one edit share their first or second half, of the length or of one less; then characters are compared from both ends.
_LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(x)))::INTEGER AS line, unnest(x) AS said FROM d WHERE x IS NOT NULL),
o AS (SELECT * FROM l WHERE regexp_matches(said, '[^\x20\x09-\x0D]')),
u AS (SELECT said, length(said) AS n, min((doc_id, line)) AS f FROM o GROUP BY said),
k AS (SELECT DISTINCT said, n, f, side, CASE side WHEN 0 THEN substr(said, 1, p) ELSE substr(said, n - p + 1, p) END AS half, p
  FROM (SELECT *, unnest([n // 2, greatest(n - 1, 0) // 2]) AS p FROM u), (SELECT unnest([0, 1]) AS side)),
c AS (SELECT DISTINCT x.said, y.said AS other, x.n, y.n AS m FROM k x JOIN k y ON x.side = y.side AND x.p = y.p AND x.half = y.half
  AND x.f > y.f AND abs(x.n - y.n) <= 1),
e AS (SELECT DISTINCT said FROM c WHERE len(list_filter(range(0, greatest(n, m) + 1), lambda i:
  substr(said, 1, i) = substr(other, 1, i) AND substr(said, i + 1 + (n >= m)::INTEGER) = substr(other, i + 1 + (m >= n)::INTEGER))) > 0),
g AS (SELECT o.doc_id, list(line ORDER BY line) AS dropped FROM o JOIN u USING (said) LEFT JOIN e ON e.said = o.said
  WHERE e.said IS NOT NULL OR (o.doc_id, o.line) > u.f GROUP BY o.doc_id)
SELECT doc_id, coalesce(len(x), 0)::BIGINT AS n_lines, coalesce(len(dropped), 0)::BIGINT AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped
FROM d LEFT JOIN g USING (doc_id)
"""

SQL: dict[str, str] = {
    "op5_line_dedup": _LINES_SQL,
    "op3_ngram_jaccard": _JACCARD_SQL,
    "op7_decontaminate": _DECONTAMINATE_SQL,
    "op8_exact_topk": _TOPK_SQL,
}
