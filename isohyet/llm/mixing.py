"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Targets: each source's share of the budget by its weight, never above `cap` times its size; what is cut off goes
to the others by weight (water filling, in closed form over the sources sorted by size / weight). A source's rate
target / size gives every document floor(rate) certain copies; the words left are an order sample of unequal probabilities:
a document's inclusion odds are in proportion to the square root of its words over the source's mean, so that longer
documents are likelier to be taken once more; documents are ranked by random odds u / (1 - u) over inclusion odds, and taken
in that order until the source's words are reached, which sets the level of the odds. The cut falls where the words taken
are nearest the target; then one document per source, the one whose size fits the remaining gap best, is added or left out,
a bias of one document a source. u comes from md5 of the seed, the id and, where rows share an id, the row's number among
them, so reruns agree, any engine can repeat the draw, and equal ids are free of each other.

No source is ever ordered as a whole: ranks r, as r / (1 + r), fall into CELLS cells, cells are summed, only the cell in
which the cut falls is cut into CELLS again, and rows are ordered only within such a second cell.

Defined results: a null text has size 0; a null source is a source of its own, the last. Sources of size 0 have
target 0. Of rows that share an id, which has which number is arbitrary. Null ids are ids that all these rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import cut, release
from .sharding import number_among_equal

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1024
#: Most sources whose table is broadcast.
MAX_BROADCAST = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """sizes: source, source_size. Adds target. One row per source, so the windows over all of it are small."""
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("room", F.col("source_size") * F.lit(cap) / F.col("w"))
    by_room = W.orderBy("room", F.col("source").isNull(), "source")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, W.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    # The level if every source before this one stops at its cap; it holds from the first source with room for it.
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("source_size").over(before) * F.lit(cap), F.lit(0.0))) / F.sum("w").over(after))
    # From there on levels only fall, so that source has the highest of those that hold.
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(W.partitionBy()))
    return ranked.select("source", "source_size", F.coalesce(F.least(F.col("source_size") * F.lit(cap), F.col("level") * F.col("w")), F.col("source_size") * F.lit(cap)).alias("target"))


def draw(key: Column, number: Column, seed: int) -> Column:
    """u in (0, 1) from 52 bits of md5(seed:id), or md5(seed:id:number) from the second row of an id on."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken (= copies * size)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("size"), F.col(source).alias("source"))
    read = cut(base, "mix-read")
    base = cut(number_among_equal(read, ["doc_id"]).select(*read.columns, draw(F.col("doc_id"), F.col("__k"), seed).alias("u")), "mix-sizes")
    release(read)
    sizes = cut(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    aim = targets(sizes.select("source", "source_size"), list(weights), share, cap)
    aim = aim.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    aim = aim.withColumn("certain", F.floor("rate")).withColumn("p", F.col("rate") - F.col("certain"))
    aim = aim.withColumn("need", F.col("target") - F.col("certain") * F.col("source_size"))
    aim = cut(aim.join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")

    few = sources_are_few(aim)
    rows = few(base, aim)
    # Random odds over inclusion odds, without the level that is one for a source.
    odds = F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double") * F.col("rows") / F.greatest(F.col("source_size"), F.lit(1)))
    ratio = (F.col("u") / (1 - F.col("u"))) / odds
    rows = rows.withColumn("rank", ratio / (1 + ratio)).withColumn("cell", F.floor(F.col("rank") * CELLS).cast("int"))
    rows = rows.withColumn("sub", F.floor((F.col("rank") * CELLS - F.col("cell")) * CELLS).cast("int"))

    def cut_cell(df: DataFrame, by: str, start: Column, name: str) -> DataFrame:
        """Per source, the first cell that does not fit whole, and the words before it. No row: all fit."""
        sums = df.groupBy("source", by).agg(F.sum("size").alias("cell_size"), F.first("need").alias("need"), F.first(start).alias("start"))
        upto = F.col("start") + F.sum("cell_size").over(W.partitionBy("source").orderBy(by))
        sums = sums.withColumn("upto", upto).where("upto > need")
        at = sums.groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("cell_size")).alias("before"))).alias("at"))
        return at.select("source", F.col(f"at.{by}").alias(f"{name}_cell"), F.col("at.before").alias(f"{name}_before"))

    rows = few(rows, cut_cell(rows, "cell", F.lit(0).cast("long"), "c"))
    edge = rows.where("cell = c_cell")
    edge = few(edge, cut_cell(edge, "sub", F.col("c_before"), "s"))
    last = edge.where("sub = s_cell")
    upto = F.col("s_before") + F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    taken_in = lambda df, test: df.withColumn("included", F.when(test, 1).otherwise(0)).select("doc_id", "size", "source", "source_size", "target", "certain", "need", "included")
    drawn = taken_in(rows.where("c_cell is null or cell <> c_cell"), F.col("c_cell").isNull() | (F.col("cell") < F.col("c_cell")))
    drawn = drawn.union(taken_in(edge.where("s_cell is null or sub <> s_cell"), F.col("s_cell").isNull() | (F.col("sub") < F.col("s_cell"))))
    drawn = cut(drawn.union(taken_in(last, upto - F.col("size") / 2 <= F.col("need"))), "mix-drawn")

    gap = drawn.groupBy("source").agg((F.first("need") - F.sum(F.col("size") * F.col("included"))).alias("gap"))
    allowed = F.col("certain") + 1 - F.col("included") <= cap
    effect = F.col("size") * F.when(F.col("included") == 1, -1).otherwise(1)
    fits = few(drawn.where("size > 0 and need > 0").where(allowed), gap).withColumn("off", F.abs(F.col("gap") - effect)).where(F.col("off") < F.abs("gap"))
    fix = fits.groupBy("source").agg(F.min(F.struct("off", "doc_id", "size")).alias("fix")).select("source", F.col("fix.doc_id").alias("fix_id"), F.col("fix.size").alias("fix_size"))
    flip = (F.col("doc_id") == F.col("fix_id")) & (F.col("size") == F.col("fix_size"))
    copies = F.col("certain") + F.when(F.coalesce(flip, F.lit(False)), 1 - F.col("included")).otherwise(F.col("included"))
    return few(drawn, fix).select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def sources_are_few(sources: DataFrame):
    """A left join of rows with a table of one row a source: broadcast up to MAX_BROADCAST sources, counted first, else shuffled."""
    small = sources.count() <= MAX_BROADCAST

    def join(rows: DataFrame, per_source: DataFrame) -> DataFrame:
        per_source = per_source.withColumnRenamed("source", "__source")
        return rows.join(F.broadcast(per_source) if small else per_source, rows["source"].eqNullSafe(per_source["__source"]), "left").drop("__source")

    return join


#: Rows and targets as a pure SQL query would give them, for `documents` with the default parameters.
ORACLE_SQL = r"""
WITH read AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size, source, row_number() OVER (PARTITION BY doc_id) - 1 AS k FROM documents),
base AS (SELECT doc_id, size, source, (CAST(('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN k > 0 THEN ':' || k ELSE '' END), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM read),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM base GROUP BY source),
weighed AS (SELECT source, source_size, n_rows, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sized),
room AS (SELECT *, source_size * 2.0::DOUBLE / w AS room FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY room, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY room, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM room),
aims AS (SELECT source, source_size, n_rows, coalesce(least(source_size * 2.0::DOUBLE, w * max(CASE WHEN level <= room THEN level END) OVER ()), source_size * 2.0::DOUBLE) AS target FROM levels),
rates AS (SELECT *, floor(coalesce(target / nullif(source_size, 0), 0)) AS certain, target - floor(coalesce(target / nullif(source_size, 0), 0)) * source_size AS need FROM aims),
odds AS (SELECT b.doc_id, b.size, r.source, source_size, target, certain, need, (u / (1 - u)) / sqrt(CAST(greatest(size, 1) AS DOUBLE) * n_rows / greatest(source_size, 1)) AS ratio FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio / (1 + ratio), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM odds),
drawn AS (SELECT *, CASE WHEN upto - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END AS included FROM ranked),
gaps AS (SELECT *, need - sum(size * included) OVER (PARTITION BY source) AS gap, CASE WHEN included = 1 THEN -size ELSE size END AS effect FROM drawn),
fixed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size > 0 AND need > 0 AND certain + 1 - included <= 2 AND abs(gap - effect) < abs(gap) DESC, abs(gap - effect), doc_id, size) = 1
  AND size > 0 AND need > 0 AND certain + 1 - included <= 2 AND abs(gap - effect) < abs(gap) AS flip FROM gaps)
SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN flip THEN 1 - included ELSE included END) * size AS BIGINT) AS taken FROM fixed
"""
