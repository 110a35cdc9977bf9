"""Filter interaction audit: what each of five filters removes, alone and in every order, as a relational word pipeline.

Words are exploded and aggregated by (document, word), then by document for totals and distinct words. Texts are shuffled
once, by document, so that both aggregations find their rows where they are: no (document, word) row is shuffled. The
other flags are columns of their own (capitals, symbols) or an aggregation by the text's digest (copies), and are joined
by outer joins. A document's failures are five bits; one aggregation a part counts documents, good and toxic ones by each
of the 32 sets of failures, and all orders, steps and Shapley sums are arithmetic over these 32 columns.

Documents are told apart by id and a hash of text and part; equal rows share their words' counts, which a null "word" a row
divides again. A key holds the map task's number as well, so that any number of equal rows stays spread.

Defined results: a null text is empty, a null lang is the part ''. An empty text has no words: it fails A, and neither B
nor C. Rows with a null id are audited like others, but are nobody's copy and have no copies and no labels. Rows of one id
are rows of their own and no copies of each other. An id with several labels counts as good, or toxic, if any says so.
An empty table has no parts.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut

WORD, UPPER, SYMBOL = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
FILTERS = "ABCDE"
#: Failure limits: words; distinct words and capitals in per cent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def word_counts(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key, text, task. One row per (doc_id, key): words, distinct words."""
    by = ["doc_id", "key", "task"]
    dealt = rows.repartition(*[F.col(c) for c in by])
    exploded = dealt.select(*by, F.explode(F.concat(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array(F.lit(None).cast("string")))).alias("word"))
    counted = exploded.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*by).agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.count("word").alias("distinct"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"))
    stats = totals.select("doc_id", "key", F.expr("coalesce(n, 0) div rows").alias("words"), "distinct")
    return stats.groupBy("doc_id", "key").agg(F.max("words").alias("words"), F.max("distinct").alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): part, mask (bit k: fails FILTERS[k]), good, toxic."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("part"))
    rows = rows.withColumn("key", F.xxhash64("text", "part"))
    own = rows.select(
        "doc_id", "key", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.regexp_count("text", F.lit(UPPER)) * 100 > F.length("text") * MOST_CAPITALS).alias("C"), F.col("text").rlike(SYMBOL).alias("D"),
    )
    own = cut(own, "audit-flags")
    first = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = cut(first, "audit-copies")  # a table, so that Spark may split the join where a third of all rows are copies
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counts = word_counts(rows.withColumn("task", F.spark_partition_id())).withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    known = own.join(first, "digest", "left").drop("digest").join(marked, F.col("doc_id") == F.col("id"), "left")
    known = known.join(counts, known["doc_id"].eqNullSafe(counts["__id"]) & (known["key"] == counts["__key"]), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    flags = [words < LEAST_WORDS, distinct * 100 < words * LEAST_DISTINCT, F.col("C"), F.col("D"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))
    return known.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sets, each = range(1 << len(FILTERS)), range(len(FILTERS))
    conditions = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.count_if((F.col("mask") == m) & test).alias(f"{name}{m}") for name, test in conditions.items() for m in sets]
    counts = failures(docs, labels).groupBy("part").agg(*columns)
    counts = counts.select("part", F.inline(F.array(*[F.struct(F.lit(m).alias("mask"), *[F.col(f"{name}{m}").alias(name) for name in conditions]) for m in sets])))

    # What a filter does depends on it and on the set before it, not on their order: 80 cells a part, each a sum over the 32 sets of failures.
    orders = [(o, [sum(1 << f for f in o[:k]) for k in each]) for o in permutations(each)]
    times = Counter((f, b) for o, befores in orders for f, b in zip(o, befores, strict=True))
    ways = [(f, b, n, m, not m & (b | 1 << f), bool(m >> f & 1 and not m & b), bool(m >> f & 1 and m & b), m == 1 << f) for (f, b), n in times.items() for m in sets]
    ways = docs.sparkSession.createDataFrame(ways, "filter int, before int, times int, mask int, keeps boolean, removes boolean, late boolean, only boolean")
    of = lambda name, test: F.sum(F.when(F.col(test), F.col(name)).otherwise(0))
    cells = counts.join(F.broadcast(ways), "mask").groupBy("part", "filter", "before", "times").agg(
        of("n", "keeps").alias("kept"), of("n", "removes").alias("removed"), of("n", "late").alias("redundant"), of("n", "only").alias("unique_fails"),
        of("good", "removes").alias("good_lost"), of("toxic", "removes").alias("toxic_lost"),
    )
    cells = cells.withColumn("shapley", F.sum(F.col("removed") * F.col("times")).over(W.partitionBy("part", "filter")))
    steps = [(f, b, "".join(FILTERS[x] for x in o), k + 1) for o, befores in orders for k, (f, b) in enumerate(zip(o, befores, strict=True))]
    names = docs.sparkSession.createDataFrame(steps, "filter int, before int, filter_order string, step int")
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return cells.join(F.broadcast(names), ["filter", "before"]).select("part", "filter_order", "step", *numbers)
