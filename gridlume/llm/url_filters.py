"""Operator 7, URL filters: a Bloom filter cascade, native DataFrame operations only.

Level 1 holds the listed keys; each further level holds the keys of the other side that the level above lets
through, over the corpus's complete key universe, until none is left. A key's membership is then exact: it is
listed if the first level that rejects it has an even number. Rows are judged by looking bits up in the
levels' arrays, without a join on keys.

The levels together are checked against max_filter_bytes; a larger list is cut in shards by hash, and each row
meets its own shard's arrays by a join on the shard number, dealt to SALTS tasks.

The list is a table of keys (hosts, or hosts and paths), each once or more; null and keys that the pages haven't don't count. Null url, or
one without "://": host and path are empty, and no rule fits. Very long urls are read whole. Repeated rows are each
judged. An empty table gives no rows, an empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import stage

#: Tasks to which the rows of one shard are dealt.
SALTS = 16
#: The rules of the contract: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. Longest: by the letters of host and path together, then by host."""
    rule = verdict = F.lit(None).cast("string")
    for of, start, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def bit_positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing from two seeded hashes of the key."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.shiftright(a, 24) + F.lit(i) * F.shiftright(b, 24), F.lit(bits)) for i in range(hashes)]


def mask(bit: Column) -> Column:
    """The 64-bit word in which only this bit's place is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


class Cascade:
    """levels: for each, its number of bits and a one-column table of 64-bit words by shard."""

    def __init__(self, universe: DataFrame, bits_per_key: int = 10, hashes: int = 5, max_filter_bytes: int = 32 << 20, most_levels: int = 40):
        """universe: key, listed; keys without repeats. Each level's bits follow the keys it holds."""
        spark, self.hashes, self.levels = universe.sparkSession, hashes, []
        n = universe.agg(F.count_if("listed"), F.count("*")).first()
        self.shards = max(1, -(-int(n[0]) * bits_per_key * 2 // (8 * max_filter_bytes)))
        keys = stage(universe.withColumn("shard", self.shard(F.col("key"))), "cascade-keys")
        inside, held = F.col("listed"), int(n[0])
        while held and len(self.levels) < most_levels:
            level = len(self.levels)
            bits = max(64, -(-held * bits_per_key // (64 * self.shards)) * 64)
            every_word = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long")))
            empty = spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), every_word.alias("word"), F.lit(0).cast("long").alias("mask"))
            held_bits = keys.where(inside).select("shard", F.explode(F.array(*bit_positions(F.col("key"), level, bits, hashes))).alias("bit"))
            words = (
                held_bits.select("shard", F.shiftright("bit", 6).alias("word"), mask(F.col("bit")).alias("mask"))
                .union(empty)
                .groupBy("shard", "word")
                .agg(F.bit_or("mask").alias("mask"))
                .groupBy("shard")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias(f"level_{level}"))
            )
            self.levels.append((bits, stage(words, f"cascade-level-{level}")))
            through = self.holds(F.col("key"), level, F.col(f"level_{level}"))
            # The next level holds what this one lets through wrongly: the other side's keys.
            keys = stage(self.met(keys, self.levels[-1][1]).where(inside | through).drop(f"level_{level}"), f"cascade-through-{level}")
            inside = ~inside
            held = keys.where(inside).count()
        if held:
            raise RuntimeError(f"{held} keys are left after {most_levels} levels: use more bits a key")

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int")

    def met(self, rows: DataFrame, words: DataFrame) -> DataFrame:
        """rows with their shard's words. With one shard the words are one row within max_filter_bytes."""
        if self.shards == 1:
            return rows.join(F.broadcast(words), "shard", "left")
        salted = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.spark_partition_id() % SALTS).join(salted, ["shard", "_salt"], "left").drop("_salt")

    def holds(self, key: Column, level: int, words: Column) -> Column:
        bits = self.levels[level][0]
        tests = [F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(mask(p)) != 0 for p in bit_positions(key, level, bits, self.hashes)]
        return F.coalesce(reduce(Column.__and__, tests), F.lit(False))

    def judge(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with column listed, exact for every key of the universe."""
        out = rows.withColumn("shard", self.shard(F.col(key)))
        for _, words in self.levels:
            out = self.met(out, words)
        listed = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            listed = F.when(self.holds(F.col(key), level, F.col(f"level_{level}")), listed).otherwise(F.lit(level % 2 == 1))
        return out.withColumn("listed", listed).drop("shard", *(f"level_{i}" for i in range(len(self.levels))))


def parsed(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, host, path and more columns of pages."""
    host, path = url_parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"), *more)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, by: tuple[str, ...] = ("host",), **settings) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: key, the entries of the block list; without a rule a page with a listed key is
    blocked. by: what a key is made of, host or host and path, one after the other."""
    rows = parsed(pages).withColumn("key", F.concat(*by))
    cascade = Cascade(key_universe(rows, listed), **settings)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return cascade.judge(rows, "key").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def key_universe(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """key, listed: every key of rows once. listed: key."""
    known = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    return rows.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def marked_pages(pages: DataFrame, marks: str = r"[*$%#]{3}|!! | \| ") -> DataFrame:
    """key (host and path): a block list made from what the pages hold, where none is given: those of which some page's html has
    marks of junk text. Pages without a url list nothing."""
    junk = parsed(pages, "html").where(F.col("html").rlike(marks)).select(F.concat("host", "path").alias("key"))
    return junk.where("key <> ''").distinct()


def named_hosts(pages: DataFrame, words: tuple[str, ...] = ("spam", "ads", "track", "porn", "casino")) -> DataFrame:
    """key: a block list made from the pages themselves, where none is given: hosts with a label that begins with one of words, but the last."""
    host, _ = url_parts(F.col("url"))
    return pages.select(host.alias("key")).where(F.col("key").rlike(rf"(^|\.)({'|'.join(words)})[^.]*\.")).distinct()
