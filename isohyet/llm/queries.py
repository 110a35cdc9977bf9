"""The thin queries over the training-data operators, by the names they are registered under."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, divergence, filteraudit, jaccard, mixing, ordering, sharding, simhash, topk, toxicity, urlfilter, vectors, warc
from .runtime import ship, table

#: The URL rules of op10 as host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer() -> dict[str, str]:
    """The public vocabulary and split pattern, as parameters of the codec."""
    return {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector against all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").where(vectors.finite(F.col("embedding")))
    scaled = F.transform("embedding", lambda x, i: F.struct(i.alias("term"), F.floor(x.cast("double") * 64).alias("weight")))
    rows = rows.select("id", F.filter(scaled, lambda t: t["weight"] != 0).alias("t")).select("id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    return topk.search(rows.where("id % 20 = 0"), rows, 20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a model fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of their near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return jaccard.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as BPE ids of two bytes, in sequences of 512, written in training order and read back."""
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", width=2, **tokenizer())
    return ordering.round_trip(ids, length=512, width=2)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the capture index."""
    out = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and its ids decoded again."""
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", decoded="decoded", **tokenizer())
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of sizes one row apart at most."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by RULES; without a fitting rule it is allowed, as the list blocks."""
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"), strict=True)]) for r in RULES])))
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergences of all sources of a lang, and each source's terms that diverge most from the lang's."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash and the component of those at most four bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = r"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM bodies),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to FROM last
"""

OP10_SQL = r"""
WITH seen AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM seen),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.k = 1
"""


#: Vectors that are null or hold null or non-finite components take no part.
OP1_SQL = r"""
WITH valid AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
terms AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS t FROM valid),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score FROM terms q JOIN terms c ON q.t = c.t AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 20
"""


#: DuckDB's // is exact on integers. Terms per lang and source, those kept, and every pair of sources over every kept term.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
words AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM words GROUP BY ALL HAVING count(*) >= 10),
counts AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
filled AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) AS whole FROM filled),
chances AS (SELECT s.lang, source, term, s.n, 1 + (1000000000 * (s.n + 2)) // (whole + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (l.n + 2 * v) AS q FROM summed s JOIN langs l ON s.lang = l.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM chances WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
marked AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM worded x LEFT JOIN marked m ON x.doc_id = m.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY ALL),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
done AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM done
"""


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_exact_topk, op2_ngram_jaccard, op3_training_order, op4_mix_sources, op5_warc, op6_byte_bpe, op7_shard, op8_toxicity, op9_ann, op10_url_filter, op11_source_divergence, op12_simhash, op13_filter_audit)}
ORACLE_SQL = {"op1_exact_topk": OP1_SQL, "op4_mix_sources": mixing.ORACLE_SQL, "op5_warc": OP5_SQL, "op10_url_filter": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_filter_audit": OP13_SQL}
