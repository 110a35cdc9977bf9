"""URL filters: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

A rule is (host, path, verdict). It fits its host and every subdomain when the URL's path starts with the
rule's path; the longest fitting rule decides. Each URL yields the keys a rule could have (its host's last
1..D labels x its path's prefixes of the lengths that rules have, both taken from the rules), the Bloom
filter drops nearly all keys that no rule has, row by row and before anything is shuffled: a URL without a
possible hit is judged where it is read. The (host, path) pairs of the others meet the rules in an exact hash join,
which removes false positives, and their verdicts are joined back to the rows with a hit alone.

Defined results: a null URL, or one without "://", has empty host and path and the default verdict. Repeated
rows stay repeated. Rows with equal (host, path) are judged once; a hot pair's rows are not gathered, as the verdicts are
broadcast up to BROADCAST_PAIRS pairs, counted first, and beyond that Spark's skew join splits plain exchanges.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import cut

#: The filter has at most this many 64-bit blocks (8 MB); a longer list only passes more keys on to the join.
MAX_BLOCKS = 1 << 20
#: A list of at most this many rules is broadcast; a longer one is joined by a shuffle.
BROADCAST_RULES = 100_000
#: Verdicts of at most this many (host, path) pairs are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four of the 64 bits of the key's block."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.expr("1L") for _ in range(4)]
    one = lambda k: F.call_function("shiftleft", bits[k], F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))


def bloom_words(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row: the filter's words, an array of `blocks` longs."""
    words = keys.select(_block(F.col(column), blocks).alias("b"), _mask(F.col(column)).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"))
    listed = every.join(words, "b", "left").agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("m", F.lit(0)).alias("m")))).alias("w"))
    return listed.select(F.transform("w", lambda x: x["m"]).alias("words"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (host and path of the deciding rule, else null) and verdict added.

    rules: columns host, path, verdict. Columns of urls that have one of the four names are replaced.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    rules = rules.select(F.concat("rule_host", "rule_path").alias("key"), "verdict", F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("labels").alias("labels"), F.max("chars").alias("chars"))
    shape = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    n, deepest, lengths = shape["n"], shape["labels"] or 1, shape["chars"] or [0]
    blocks = min(MAX_BLOCKS, 1 << max(3, math.ceil(math.log2(max(1, n) / 4 + 1))))
    # The filter, bounded by MAX_BLOCKS, goes along as a constant: a lambda over a row's keys can hold no subquery.
    words = F.from_json(F.lit(json.dumps(bloom_words(rules, "key", blocks).first()["words"])), "array<bigint>")

    host, path = host_and_path(F.col(url))
    seen = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -d) for d in range(1, deepest + 1)]))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path")), lambda x: F.substr(F.col("path"), F.lit(1), x))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    possible = F.filter(keys, lambda key: F.element_at(words, _block(key, blocks) + 1).bitwiseAND(_mask(key)) == _mask(key))
    names = seen.columns
    tested = seen.withColumn("__hits", F.when(F.col("host") != "", possible).otherwise(F.array().cast("array<string>")))
    hit = tested.where(F.size("__hits") > 0)
    verdict = F.lit(default)
    passed = tested.where(F.size("__hits") == 0).select(*names, F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"))

    listed = rules.select("key", "verdict")
    found = hit.select("host", "path", "__hits").dropDuplicates(["host", "path"]).withColumn("key", F.explode("__hits"))
    exact = found.join(F.broadcast(listed) if n <= BROADCAST_RULES else listed, "key")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "key")).alias("best"))
    best = cut(best.select(F.xxhash64("host", "path").alias("best_pair"), F.col("host").alias("best_host"), F.col("path").alias("best_path"), "best"), "url-verdicts")
    same = (F.xxhash64("host", "path") == F.col("best_pair")) & (F.col("host") == F.col("best_host")) & (F.col("path") == F.col("best_path"))
    joined = hit.join(F.broadcast(best) if best.count() <= BROADCAST_PAIRS else best, same, "left")
    return passed.union(joined.select(*names, F.col("best.key").alias("rule"), F.coalesce("best.verdict", verdict).alias("verdict")))
