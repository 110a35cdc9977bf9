"""A training corpus from documents: toxic texts go, one of each group of near duplicates stays, sources are mixed, texts become ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last keep the columns of docs, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from isohyet.llm import bpe, jaccard, mixing, toxicity
from isohyet.llm.queries import tokenizer
from isohyet.llm.runtime import cut, ship, table

#: Ids that one stage removes, and rows of what the mix takes, are broadcast up to this many, counted first; more are joined by a shuffle.
MAX_BROADCAST = 500_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic by a model fitted on labelled rows of docs. Null and empty texts are scored as empty ones."""
    ship(spark)
    return toxicity.accept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the row of smallest id of each group of near duplicates; of rows that repeat an id and its text, one. Empty texts and null ids all stay.

    Rows that share an id and have different texts are rows of their own, told apart by a number in order of id and text.
    """
    ship(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(_linked_away(docs, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    known = docs.where("doc_id is not null").withColumn("__text", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = known.select("doc_id", "__text").distinct().repartitionByRange("doc_id", "__text").sortWithinPartitions("doc_id", "__text")
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    known = cut(known.join(rows, ["doc_id", "__text"]), "pipeline-known")
    kept = known.join(_linked_away(known, "__row"), "__row", "left_anti")
    wordy = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)) > 0
    repeated = cut(known.where(wordy).groupBy("__row").count().where("count > 1").select("__row"), "pipeline-repeated")
    again = kept.join(repeated, "__row", "left_semi")
    first = again.withColumn("__k", F.row_number().over(W.partitionBy("__row").orderBy(F.xxhash64(*docs.columns)))).where("__k = 1")
    once = kept.join(repeated, "__row", "left_anti")
    return once.select(*docs.columns).unionByName(first.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def _linked_away(docs: DataFrame, key: str) -> DataFrame:
    """The keys whose component has a smaller one, broadcast where few."""
    found = cut(jaccard.join_components(docs, key).select(F.col("doc_id").alias(key), "component_id"), "pipeline-components")
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows of one id, source and size are alike to the mix; what it takes of them is dealt out among them."""
    ship(spark)
    drawn = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    drawn = drawn.agg(F.min("copies").alias("__low"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("__extra"))
    drawn = cut(drawn, "pipeline-drawn")
    listed = F.broadcast if drawn.count() <= MAX_BROADCAST else (lambda df: df)  # else texts are shuffled once, to their counts
    same = docs["doc_id"].eqNullSafe(drawn["__id"]) & docs["source"].eqNullSafe(drawn["__source"]) & (mixing.words(docs["text"]) == drawn["__size"])
    joined = docs.join(listed(drawn.where("__low > 0 or __extra > 0")), same)
    taken = joined.where("__extra = 0").withColumn("__copies", F.col("__low"))
    if not drawn.where("__extra > 0").isEmpty():
        place = F.row_number().over(W.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(*[docs[c] for c in docs.columns])))
        uneven = joined.where("__extra > 0").withColumn("__place", place)
        uneven = uneven.withColumn("__copies", F.col("__low") + (F.col("__place") <= F.col("__extra")).cast("long")).drop("__place")
        taken = taken.unionByName(uneven.where("__copies > 0"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids, their digest and that of the bytes they decode to, a row for each row of docs."""
    ship(spark)
    both = bpe.encode(docs.select("doc_id", "text"), "text", decoded="decoded", **tokenizer())
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode_ids)]

#: A trained network and tokenization are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
