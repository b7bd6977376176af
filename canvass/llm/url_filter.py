"""Operator 3: URL filter by a cascade of Bloom filters, in SQL functions only.

Level 0 is a Bloom filter of the listed keys; the keys of the universe that it
reports falsely are encoded in level 1, the listed keys that level 1 reports
falsely in level 2, and so on until no key is reported falsely. The first level
that does not report a key decides: an even one says unlisted, an odd one says
listed. For every key of the universe this is exact, and judging a row needs no
join: the levels are binary literals.

Only the levels' bits reach the driver. Their number is known beforehand from
the number of listed keys; above MAX_LEVEL_BITS the list is matched by a plain
semi-join instead, with the same results.

Defined cases: a null URL or one without `://` has empty host and path and is
never listed; an empty list blocks nothing; rows that repeat stay; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import read_table, staged

#: Bits per encoded key and hash functions of a level: the first cuts the many, the later ones halve what is left.
BITS_PER_KEY, HASHES = 16, 5
#: A level of more bits than this (4 MB) is not sent through the driver.
MAX_LEVEL_BITS = 1 << 25
#: 32-bit words in one block of a level; a block is one row (4 kB) on its way to the driver.
BLOCK_WORDS = 1024

#: Fixed rules: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words that list a host when one of its labels has them between hyphens.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "track"]


@dataclass(frozen=True)
class Cascade:
    """Bits of each level, most significant bit first in each byte, and its size in bits."""

    levels: tuple[tuple[bytes, int], ...]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)  # reported by every level
        for depth in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(~reported(key, self.levels[depth], depth), F.lit(depth % 2 == 1)).otherwise(verdict)
        return verdict


def positions(key: Column, depth: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(depth * 64 + i)), F.lit(bits)) for i in range(HASHES)]


def reported(key: Column, level: tuple[bytes, int], depth: int) -> Column:
    """Whether one level reports the key: all its bits are set."""
    data, bits = level
    found = F.lit(True)
    for at in positions(key, depth, bits):
        byte = F.conv(F.hex(F.substring(F.lit(data), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.pmod(F.floor(byte / F.pow(F.lit(2), 7 - F.pmod(at, F.lit(8)))), F.lit(2)) == 1)
    return found


def level_of(keys: DataFrame, depth: int, bits: int) -> tuple[bytes, int]:
    """The bits of one level as bytes, put together in blocks (the only rows that reach the driver; `bits` bounds them)."""
    words = (keys.select(F.explode(F.array(*positions(F.col("key"), depth, bits))).alias("at"))
             .groupBy(F.floor(F.col("at") / 32).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(31 - pmod(at, 32) AS int)))").alias("set")))
    blocks = (words.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias("block"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(BLOCK_WORDS)).cast("int").alias("at"), "set"))).alias("sets"))
              .select("block", F.expr(f"unhex(array_join(transform(sequence(0, {BLOCK_WORDS - 1}), "
                                      "i -> lpad(hex(coalesce(element_at(sets, i), 0L)), 8, '0')), ''))").alias("data")))
    data = bytearray(-(-bits // (32 * BLOCK_WORDS)) * 4 * BLOCK_WORDS)
    for row in blocks.collect():
        data[4 * BLOCK_WORDS * row["block"]:4 * BLOCK_WORDS * (row["block"] + 1)] = row["data"]
    return bytes(data[:bits // 8]), bits


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """Cascade of the listed keys within the universe (both distinct `key` columns); None if a level is too large."""
    inside = universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed"))
    rest = staged(inside, "universe")
    levels: list[tuple[bytes, int]] = []
    while True:
        depth = len(levels)
        own = rest.where(F.col("listed") == F.lit(depth % 2 == 0)).select("key")
        n = own.count()
        if n == 0:
            return Cascade(tuple(levels))
        bits = max(64, -(-n * BITS_PER_KEY // 32) * 32)
        if bits > MAX_LEVEL_BITS:
            return None
        levels.append(level_of(own, depth, bits))
        # keys of the other kind that this level reports, and the own keys that the next level must not report
        other = (F.col("listed") == F.lit(depth % 2 == 1)) & reported(F.col("key"), levels[-1], depth)
        rest = rest.where(other | (F.col("listed") == F.lit(depth % 2 == 0)))
        rest = staged(rest, "level")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def best_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one. Of equally long ones the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule_host, rule_path in sorted(rules or RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row; `listed` holds the hosts to block in a column `key`."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    universe = rows.where("host <> ''").select(F.col("host").alias("key")).distinct()
    keys = listed.select("key").where("key is not null").distinct()
    cascade = build_cascade(universe, keys)
    if cascade is None:
        rows = rows.join(keys.select(F.col("key").alias("host"), F.lit(True).alias("in_list")), "host", "left").withColumn(
            "listed", F.coalesce("in_list", F.lit(False)))
    else:
        rows = rows.withColumn("listed", (F.col("host") != "") & cascade.lists(F.col("host")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_hosts(pages: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Distinct hosts with a label that has a listed word between its hyphens."""
    host, _ = url_parts(F.col("url"))
    pattern = r"(^|[.\-])(" + "|".join(words or LISTED_WORDS) + r")([.\-]|$)"
    return pages.select("url").select(host.alias("key")).where(F.col("key").rlike(pattern)).distinct()


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the rules and by the cascade of listed hosts."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_hosts(pages))


#: The verdict of a host without a rule is its membership in the list, which SQL can state directly.
OP3_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
      regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|porn|spam|track)([.-]|$)') AS listed FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
