"""The registered queries of this subpackage: thin uses of the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, licenses, mixing, onebit, quality, setsketch, suffixes, topk, toxicity
from .storage import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op1_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(_fold(5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return onebit.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = cut(quality.describe(_table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(described, _table(spark, sf_dir, "labels").where(_fold(4) != 2))
    scored = quality.score(described, model)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.formatted(chat.conversations(chat.linear_nodes(turns)))
    back = chat.read_back(made)
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_top_products, op2_bpe_round_trip, op3_license_scan, op4_mix_sources, op5_toxicity, op6_nearest, op7_near_duplicates, op8_suffix_dedup, op9_quality, op10_chat)}

_TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text)
    + (length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))
    + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')))
    + CASE WHEN regexp_matches(role, '^[a-z]') THEN 0 ELSE 1 END + 15 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), w AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
f AS (
  SELECT doc_id, i, n, t || coalesce(' ' || lead(t, 1) OVER o, '') || coalesce(' ' || lead(t, 2) OVER o, '') || coalesce(' ' || lead(t, 3) OVER o, '') AS x
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS MATERIALIZED (
  SELECT d.doc_id, coalesce(f.g, []) AS g FROM d LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT x)) AS g FROM f WHERE i = 1 OR i <= n - 3 GROUP BY doc_id) f USING (doc_id)
), c AS MATERIALIZED (SELECT min(doc_id) AS rep, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS MATERIALIZED (SELECT rep, n, unnest(g) AS x FROM c),
l AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN k ON c.rep = k.rep
"""

# Windows are cut from hexadecimal pieces of 500 bytes with the 49 that follow.
_REPEATS = r"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, regexp_extract_all(x, '.{1,1000}') AS parts FROM h),
q AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM p),
b AS (SELECT doc_id, 500 * (i - 1) AS base, parts[i] || coalesce(parts[i + 1], '')[1:98] AS x, len(parts[i]) // 2 AS n FROM q),
w AS (SELECT doc_id, base + o AS pos, substring(x, 2 * o + 1, 100) AS g FROM (SELECT doc_id, base, x, unnest(range(0, least(n, len(x) // 2 - 49))) AS o FROM b)),
m AS MATERIALIZED (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY g) AS least_id FROM w) WHERE doc_id > least_id),
t AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 1 ELSE 0 END AS new FROM m),
u AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t),
r AS (SELECT doc_id, min(pos) AS lo, max(pos) + 50 AS hi FROM u GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM r),
j AS (SELECT h.doc_id, count(*) AS n, sum(k.hi - k.lo) AS cut, max(k.hi) AS tail, string_agg(substring(h.x, 2 * k.since + 1, 2 * (k.lo - k.since)), '' ORDER BY k.lo) AS kept FROM k JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(len(h.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(j.cut, 0) AS BIGINT) AS n_removed, CAST(coalesce(j.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(j.kept, '') || substring(h.x, 2 * coalesce(j.tail, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN j USING (doc_id)
"""

ORACLES = {
    "op1_top_products": _TOP_PRODUCTS,
    "op3_license_scan": licenses.oracle(),
    "op7_near_duplicates": _NEAR,
    "op8_suffix_dedup": _REPEATS,
    "op10_chat": _CHAT,
}
