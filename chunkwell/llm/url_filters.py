"""URL filters: path rules first, then exact membership of the host by a Bloom filter cascade.

The cascade has alternating levels. The first holds the listed hosts; the second
those hosts of the corpus which are not listed but pass the first; the third
listed hosts that pass the second; and so on, until nothing passes wrongly.
A host is listed if the first level that rejects it has an even number. As the levels are made
over the complete universe of hosts, answers are exact for all of it, without a join: each level reaches the
rows as a scalar subquery, one array of 64-bit words whose length is bounded by ``max_bits``.

Nulls: a null url, or one without ``://``, has an empty host and path; such rows
fit no rule and are allowed. Repeated urls are judged one by one, an empty table
gives an empty result, and further columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table

#: (verdict, host, path) in any order; the longest that fits wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Listed domains: they and their subdomains are blocked where no rule speaks.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)
BITS_PER_KEY = 12
HASHES = 6
#: 32 MB a level at most. Beyond it levels pass more keys wrongly, so that there are more levels; answers stay exact.
MAX_BITS = 1 << 28
MAX_LEVELS = 40


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """``a.b.c``, ``b.c`` and ``c``."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits).cast("long")) for i in range(HASHES)]


@dataclass
class Level:
    words: DataFrame  # one row, one array
    bits: int
    number: int

    def passes(self, key: Column) -> Column:
        words, out = self.words.scalar(), F.lit(True)
        for p in positions(key, self.number, self.bits):
            out = out & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, count: int, number: int, bits_per_key: int, max_bits: int) -> Level:
    bits = min(max_bits, max(64, -(-count * bits_per_key // 64) * 64))
    where = keys.select(F.explode(F.array_distinct(F.array(*positions(F.col("key"), number, bits)))).alias("p"))
    words = where.select(
        F.floor(F.col("p") / 64).cast("long").alias("id"),
        F.expr("shiftleft(1L, cast(p % 64 as int))").alias("w"),
    )
    words = words.groupBy("id").agg(F.bit_or("w").alias("w"))
    every = keys.sparkSession.range(bits // 64).join(words, "id", "left")
    array = every.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("words")
    )
    return Level(cut(array), bits, number)


class Cascade:
    """Exact membership for every key of a universe."""

    def __init__(self, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS):
        """``universe``: distinct ``key`` and ``listed`` (boolean)."""
        self.levels: list[Level] = []
        left, wanted = universe, True
        count = left.filter("listed").count()
        while count:
            if len(self.levels) == MAX_LEVELS:
                raise ValueError(f"{count} keys still pass after {MAX_LEVELS} levels; raise max_bits")
            mine = left.filter(F.col("listed") == F.lit(wanted))
            level = build_level(mine, count, len(self.levels), bits_per_key, max_bits)
            self.levels.append(level)
            left = cut(left.filter((F.col("listed") == F.lit(wanted)) | level.passes(F.col("key"))))
            wanted = not wanted
            count = left.filter(F.col("listed") == F.lit(wanted)).count()

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.passes(key), F.lit(level.number % 2 == 1)).otherwise(out)
        return out


def host_universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct ``key`` of hosts with whether a listed domain (column ``domain``) is the host or above it."""
    keys = hosts.select(F.col("host").alias("key")).distinct()
    each = keys.select("key", F.explode(suffixes(F.col("key"))).alias("domain"))
    hits = each.join(listed.select("domain").distinct(), "domain", "left_semi").select("key").distinct()
    return keys.join(hits.withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed"))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    cascade = Cascade(cut(host_universe(split, listed)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    member = F.when(cascade.contains(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, member).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED], "domain string")
    return url_filter(table(spark, sf_dir, "pages"), listed)


def _sql() -> str:
    cases, says = [], []
    for say, domain, prefix in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])):
        fits = f"(host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '{prefix}')"
        cases.append(f"when {fits} then '{domain}{prefix}'")
        says.append(f"when {fits} then '{say}'")
    block = " or ".join(f"host = '{d}' or ends_with(host, '.{d}')" for d in LISTED)
    return f"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest
)
select page_id, host, path, case {' '.join(cases)} end as rule,
  case {' '.join(says)} when {block} then 'block' else 'allow' end as verdict
from split"""


QUERIES = {"op1_url_filters": op1_url_filters}
SQL = {"op1_url_filters": _sql()}
